"""ZIP archives as tables: directories, members, lines, and rows by their place.

A directory is a data source (`zip_directory`) that reads the central directory of each archive by range, in tasks of some archives each, with
filters on archive and member pushed down to it. Contents are read from directory rows, so only members that are left are opened,
each at its offset. Directory rows are dealt out by bytes: neighbours in an archive stay together and share range reads, and a
stored member longer than a share is read by several tasks. No archive is one value or one task, so its size has no limit; a deflated member
is one task, which streams it.

Lines are counted once into an index, a row for each member or share of one. It gives every line its number and every non-blank line its
place in the whole source, and a request for some places opens only the shares that hold them.

An archive that is no ZIP, a member that is encrypted, packed by a method other than stored, deflated or bzip2, cut off, or
different from its checksum is a row with an error beside the good ones. Paths are those that pyarrow's file systems open (local, file://, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import bz2
import io
import json
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from tracewise.session import scratch

#: Archives whose directories one task reads, and bytes of packed content that one task reads, about.
ARCHIVES_PER_TASK, TASK_BYTES = 16, 64 << 20
#: Bytes of a range read, and of content in one Arrow batch.
READ_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
#: Places of rows that a request looks up together.
PLACES = 100_000

STORED, DEFLATED, BZIPPED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2
DIRECTORY = "archive string, member string, method int, offset long, packed long, size long, crc long, error string"
_MEMBER = ("archive", "member", "method", "offset", "packed", "size", "crc")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def buffered(path: str) -> io.BufferedReader:
    files, name = opened(path)
    return io.BufferedReader(files.open_input_file(name), READ_BYTES)


def _reason(e: BaseException) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


class _Archives(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _DirectoryReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths
        self.tests: list[tuple[str, str, tuple]] = []  # column, kind and values

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, membership, and beginnings and ends of archive and member; the rest stays with the engine."""
        kinds = {EqualTo: "in", In: "in", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and f.attribute[0] in ("archive", "member"):
                self.tests.append((f.attribute[0], kinds[type(f)], tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def _passes(self, column: str, value: str) -> bool:
        tests = {"in": lambda v: value in v, "starts": value.startswith, "ends": value.endswith}
        return all(tests[kind](values) for c, kind, values in self.tests if c == column)

    def partitions(self) -> list[_Archives]:
        left = [p for p in self.paths if self._passes("archive", p)]
        return [_Archives(left[k : k + ARCHIVES_PER_TASK]) for k in range(0, len(left), ARCHIVES_PER_TASK)] or [_Archives([])]

    def read(self, partition: _Archives) -> Iterator[tuple]:
        bare = any(c == "member" for c, *_ in self.tests)  # a filter on members leaves no row without one
        for path in partition.paths:
            try:
                with zipfile.ZipFile(buffered(path)) as archive:
                    found = [(path, i.filename, i.compress_type, i.header_offset, i.compress_size, i.file_size, i.CRC, _refused(i)) for i in archive.infolist() if not i.is_dir() and self._passes("member", i.filename)]
            except Exception as e:  # noqa: BLE001  errors are data here
                reason = "BadZipFile: no ZIP archive" if isinstance(e, zipfile.BadZipFile | pa.ArrowInvalid) else _reason(e)
                found = [] if bare else [(path, None, None, None, None, None, None, reason)]
            yield from found


def _refused(member: zipfile.ZipInfo) -> str | None:
    if member.flag_bits & 1:
        return "ValueError: the member is encrypted"
    return None if member.compress_type in (STORED, DEFLATED, BZIPPED) else f"ValueError: method {member.compress_type} is not supported"


class ZipDirectory(DataSource):
    """Members of ZIP archives. Option paths: a JSON list of archives."""

    @classmethod
    def name(cls) -> str:
        return "zip_directory"

    def schema(self) -> str:
        return DIRECTORY

    def reader(self, schema: T.StructType) -> _DirectoryReader:
        return _DirectoryReader(json.loads(self.options["paths"]))


def archive_paths(spark: SparkSession, path: str) -> list[str]:
    """Archives at a path: the files of a folder that end in .zip, those that a pattern names, or the one file."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    store = found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if store.exists(found) and store.getFileStatus(found).isDirectory():
        found = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*.zip")
    there = store.globStatus(found)
    return sorted(s.getPath().toString() for s in there or [])


def directory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(archive, member, method, offset, packed, size, crc, error) of the members of archives; an archive that cannot be read is one row with an error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipDirectory)
    paths = archive_paths(spark, path) if isinstance(path, str) else path
    return spark.read.format("zip_directory").option("paths", json.dumps(paths)).load()


def _dealt(members: DataFrame, at: Column, n_bytes: Column, task_bytes: int) -> DataFrame:
    """Rows in partitions of about task_bytes of packed content, neighbours together and in order."""
    total = members.agg(F.coalesce(F.sum(n_bytes), F.lit(0)).alias("n")).first()["n"]
    return members.repartition(max(1, -(-total // task_bytes)), "archive", F.floor(at / task_bytes)).sortWithinPartitions("archive", at)


def _at_data(f: io.BufferedReader, offset: int) -> int:
    """Puts f at the content of the member whose header is at offset; gives that place."""
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member at its offset")
    at = offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    f.seek(at)
    return at


def _unpacked(method: int, packed: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces unpacked, none much longer than a batch, however well they were packed."""
    if method == STORED:
        yield from packed
    elif method == DEFLATED:
        unpack = zlib.decompressobj(-15)
        for piece in packed:
            while piece:
                yield unpack.decompress(piece, BATCH_BYTES)
                piece = unpack.unconsumed_tail
        yield unpack.flush()
    else:
        unpack = bz2.BZ2Decompressor()
        for piece in packed:
            yield unpack.decompress(piece, BATCH_BYTES)
            while not (unpack.needs_input or unpack.eof):
                yield unpack.decompress(b"", BATCH_BYTES)


def _ranges(f: io.BufferedReader, n: int) -> Iterator[bytes]:
    while n:
        piece = f.read(min(n, READ_BYTES))
        if not piece:
            raise zipfile.BadZipFile("the member is cut off")
        n -= len(piece)
        yield piece


def _pieces(f: io.BufferedReader, method: int, offset: int, packed: int, crc: int) -> Iterator[bytes]:
    """The unpacked content in pieces. Raises at the end if its checksum is another."""
    _at_data(f, offset)
    found = 0
    for piece in _unpacked(method, _ranges(f, packed)):
        found = zlib.crc32(piece, found)
        yield piece
    if found != crc:
        raise zipfile.BadZipFile("the checksum is another")


class _Open:
    """The archive that was read last, kept open for its next members."""

    def __init__(self):
        self.path, self.file = None, None

    def __call__(self, path: str) -> io.BufferedReader:
        if path != self.path:
            self.close()
            self.file, self.path = buffered(path), path
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = None


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)


def contents(members: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Directory rows (archive, member, size, content, error), each with its content or the reason why there is none. A content is one value, of 2 GB at most."""
    out = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Open()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for m in batch.to_pylist():
                    content, error = None, m["error"]
                    if error is None:
                        try:
                            content = b"".join(_pieces(held(m["archive"]), m["method"], m["offset"], m["packed"], m["crc"]))
                        except Exception as e:  # noqa: BLE001
                            held.close()
                            error = _reason(e)
                    yield m["archive"], m["member"], m["size"], content, error
            held.close()

        yield from _batches(rows(), out, lambda r: len(r[3] or b""))

    return _dealt(members, F.col("offset"), F.col("packed"), task_bytes).mapInArrow(read, "archive string, member string, size long, content binary, error string")


def _lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Lines of a content in pieces, without their ends; the last needs none."""
    rest: list[bytes] = []
    for piece in pieces:
        first, *more = piece.split(b"\n")
        rest.append(first)
        if more:
            yield b"".join(rest)
            yield from more[:-1]
            rest = [more[-1]]
    last = b"".join(rest)
    if last:
        yield last


def _share(f: io.BufferedReader, offset: int, size: int, begin: int, end: int) -> Iterator[bytes]:
    """Lines of a stored member that begin in its bytes from begin to end."""
    at = _at_data(f, offset)
    f.seek(at + max(0, begin - 1))
    place = begin
    if begin:
        skipped = f.read(1)
        if skipped != b"\n":
            place += len(f.readline())
    while place < end:
        line = f.readline(size - place)
        if not line:
            raise zipfile.BadZipFile("the member is cut off")
        place += len(line)
        yield line[:-1] if line.endswith(b"\n") else line


def _shares(members: DataFrame, task_bytes: int) -> DataFrame:
    """Directory rows by shares (share, begin, end): of a stored member longer than task_bytes several, of others one."""
    n = F.when((F.col("method") == STORED) & F.col("error").isNull(), F.greatest(F.lit(1), F.ceil(F.col("size") / task_bytes))).otherwise(F.lit(1))
    rows = members.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))).withColumn("_n", n)
    cut = lambda k: F.floor(F.col("size") / F.col("_n") * k).cast("long")
    end = F.when(F.col("share") + 1 == F.col("_n"), F.col("size")).otherwise(cut(F.col("share") + 1))
    return rows.withColumn("begin", F.when(F.col("_n") > 1, cut(F.col("share"))).otherwise(F.lit(0).cast("long"))).withColumn("end", end).withColumn("whole", F.col("_n") == 1).drop("_n")


def _of_share(held: _Open, m: dict) -> Iterator[bytes]:
    f = held(m["archive"])
    if m["whole"]:
        return _lines(_pieces(f, m["method"], m["offset"], m["packed"], m["crc"]))
    return _share(f, m["offset"], m["size"], m["begin"], m["end"])


def _dealt_shares(shares: DataFrame, task_bytes: int) -> DataFrame:
    return _dealt(shares, F.col("offset") + F.col("begin"), F.when(F.col("whole"), F.col("packed")).otherwise(F.col("end") - F.col("begin")), task_bytes)


def strict(rows: DataFrame) -> DataFrame:
    """rows without error; a row with one raises."""
    said = F.concat(F.col("archive"), F.lit("::"), F.coalesce("member", F.lit("")), F.lit(": "), F.col("error"))
    return rows.where(F.when(F.col("error").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def line_index(members: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Directory rows by shares with n_lines, n_rows (non-blank lines), first_line (from 1, in the member) and first_row (from 0, by archive, member and line over all). Members with an error have no rows. Contents are read once here, and the index is kept in the shared folder."""
    spread = _dealt_shares(_shares(members, task_bytes), task_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Open()
        for batch in batches:
            lines, rows, errors = [], [], []
            for m in batch.to_pylist():
                n = filled = 0
                error = m["error"]
                if error is None:
                    try:
                        for line in _of_share(held, m):
                            n += 1
                            filled += bool(line.strip())
                    except Exception as e:  # noqa: BLE001
                        held.close()
                        n, filled, error = 0, 0, _reason(e)
                lines.append(n)
                rows.append(filled)
                errors.append(error)
            kept = [batch.column(c) for c in batch.schema.names if c != "error"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lines, pa.int64()), pa.array(rows, pa.int64()), pa.array(errors, pa.string())], names=[*[c for c in batch.schema.names if c != "error"], "n_lines", "n_rows", "error"])
        held.close()

    fields = [f for f in spread.schema.fields if f.name != "error"]
    out = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_rows", T.LongType()), T.StructField("error", T.StringType())])
    counted = spread.mapInArrow(count, out)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.withColumn("first_line", 1 + before("n_lines", Window.partitionBy("archive", "member").orderBy("share"))).withColumn("_in", before("n_rows", Window.partitionBy("archive").orderBy("member", "share")))
    archives = counted.groupBy("archive").agg(F.sum("n_rows").alias("_rows"))
    archives = archives.select("archive", before("_rows", Window.orderBy("archive")).alias("_before"))  # a row an archive
    index = counted.join(archives, "archive").withColumn("first_row", F.col("_before") + F.col("_in")).drop("_before", "_in")
    path = scratch(members.sparkSession, "zip-index")
    index.write.parquet(path)
    return members.sparkSession.read.schema(index.schema).parquet(path)


def lines(index: DataFrame, limit: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(archive, member, line, row_index, value) of the non-blank lines of an index; limit keeps the first rows, and shares behind them are not opened. Bytes that are no UTF-8 become U+FFFD."""
    shares = index.where("error IS NULL AND n_rows > 0")
    if limit is not None:
        shares = shares.where(F.col("first_row") < limit)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Open()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for m in batch.to_pylist():
                    place = m["first_row"]
                    for n, line in enumerate(_of_share(held, m), m["first_line"]):
                        if line.strip():
                            yield m["archive"], m["member"], n, place, line.removesuffix(b"\r").decode("utf-8", "replace")
                            place += 1
                            if place == limit:
                                break
            held.close()

        yield from _batches(rows(), pa.schema([("archive", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("row_index", pa.int64()), ("value", pa.string())]), lambda r: len(r[4]))

    in_order = _dealt_shares(shares, task_bytes).sortWithinPartitions("first_row")
    return in_order.mapInArrow(read, "archive string, member string, line long, row_index long, value string")


def rows_at(index: DataFrame, wanted: DataFrame, place: str = "row_index", position: str = "position") -> DataFrame:
    """Lines at the places of wanted (row_index, position), with position; only shares that hold one are opened. Places that no line has are left out, and one asked for twice is given twice."""
    of = lambda c: F.floor(c / PLACES)
    held = index.where("error IS NULL AND n_rows > 0").withColumn("_run", F.explode(F.sequence(of(F.col("first_row")), of(F.col("first_row") + F.col("n_rows") - 1))))
    asked = wanted.select(F.col(place).alias("_place")).distinct().withColumn("_run", of(F.col("_place")))
    within = (F.col("_place") >= F.col("first_row")) & (F.col("_place") < F.col("first_row") + F.col("n_rows"))
    asked = held.join(asked, "_run").where(within).select("archive", "member", "share").distinct()
    found = lines(index.join(asked, ["archive", "member", "share"], "left_semi"))
    return found.join(wanted.withColumnRenamed(place, "row_index"), "row_index")


def write(rows: DataFrame, folder: str, archive: Column, member: Column, content: Column, stored: Column | None = None, tasks: int | None = None) -> None:
    """Writes rows as members of archives below folder, a file `<archive>.zip` each, members by name. stored: which are not deflated.

    An archive is written by one task, a member at a time, and put in place when it is whole, so a task that
    is run again leaves one file.
    """
    made = rows.select(archive.cast("string").alias("archive"), member.cast("string").alias("member"), content.cast("binary").alias("content"), (F.lit(False) if stored is None else stored).alias("stored"))
    spread = (made.repartition("archive") if tasks is None else made.repartition(tasks, "archive")).sortWithinPartitions("archive", "member")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        name, out, zipped = None, None, None
        draft = f"attempt-{TaskContext.get().taskAttemptId()}"

        def close() -> None:
            if zipped is not None:
                zipped.close()
                out.close()
                files.move(f"{root}/.{name}.{draft}", f"{root}/{name}.zip")

        for batch in batches:
            for a, m, c, s in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if a != name:
                    close()
                    name = a
                    out = files.open_output_stream(f"{root}/.{name}.{draft}", compression=None)
                    zipped = zipfile.ZipFile(out, "w", allowZip64=True)
                info = zipfile.ZipInfo(m)  # the format's first date, so files are the same each time
                info.compress_type = STORED if s else DEFLATED
                zipped.writestr(info, c or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
        close()

    files, root = opened(folder)
    files.create_dir(root, recursive=True)
    spread.mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()
