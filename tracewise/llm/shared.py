"""What several operators need: the shared folder, written tables, and word hashing in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass takes. A longer document makes a pass of its own.
CHUNK_BYTES = 1 << 20

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INV = _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: A key that more than one in so many rows hold is broadcast by spread_join; there are at most so many of them.
HOT_SHARE = 4096
#: Keys of fewer rows are never hot.
LEAST_HOT = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets a temp folder; on a cluster that is an error."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tracewise.shared.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = f"file://{tempfile.mkdtemp(prefix='tracewise-')}"
        spark.conf.set("tracewise.shared.dir", own)
    return own.rstrip("/")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of few bytes for this session, so that long texts do not fill a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of ids and numbers that a task writes, about.
TASK_ROWS = 500_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back.

    rows: at most how many it has, if they are narrow; it is then written in as many files as they ask for, but one a core
    at least, instead of one for each shuffle partition.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // TASK_ROWS))
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tracewise_path = path
    return back


def drop_written(df: DataFrame) -> None:
    """Removes a table of written() that no later plan reads."""
    path = getattr(df, "_tracewise_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def quoted(name: str) -> str:
    """A column name as it can stand in an expression, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def held(docs: DataFrame, used: dict[str, str], made: tuple[str, ...] = (), packed: bool = True) -> tuple[DataFrame, list[Column]]:
    """docs as an operator works on them, and the expressions that give the columns of docs back.

    used: the operator's name of each column that it reads, and its name in docs. All other columns are
    in one struct `_rest`, so no name of theirs, in any case and with any sign, meets one of the
    operator's. Columns of docs named as one of made (in any case) are left out: the operator replaces
    them. Without packed, only the columns used are kept.
    """
    low = {c.lower(): name for name, c in used.items()}
    replaced = {m.lower() for m in made}
    rest = [c for c in docs.columns if c.lower() not in low and c.lower() not in replaced]
    columns = [F.col(quoted(c)).alias(name) for name, c in used.items()]
    if packed and rest:
        columns.append(F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(rest)]).alias("_rest"))
    at = {c: k for k, c in enumerate(rest)}
    back = [F.col(low[c.lower()] if c.lower() in low else f"_rest.c{at[c]}").alias(c) for c in docs.columns if c.lower() in low or c in at]
    return docs.select(*columns), back


def spread_join(rows: DataFrame, table: DataFrame, key: str | list[str], n: str, how: str = "inner", hint: str | None = None) -> DataFrame:
    """rows joined with table, a written table with a row for each key whose n says how many of rows hold it.

    A key of more than 1 / HOT_SHARE of all rows would fill a task. There are at most HOT_SHARE such
    keys at any size, so they are broadcast and their rows stay where they are; the rest meet by a
    plain join, with hint "merge" by a shuffle at any size, so that small tables are planned as large ones are.
    """
    hinted = lambda t: t.hint(hint) if hint else t
    total, most = table.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(LEAST_HOT, total // HOT_SHARE)
    if most <= least:
        return rows.join(hinted(table), key, how)
    hot = F.broadcast(table.where(F.col(n) > least))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")  # a null key is in neither
    return rows.join(hot, key).unionByName(rest.join(hinted(table.where(F.col(n) <= least)), key, how))


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts of about limit bytes; keeps the order."""
    part: list[bytes] = []
    held = 0
    for t in texts:
        if part and held + len(t) > limit:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t) + 1
    if part:
        yield part


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=_U64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=_U64)
    up, down = _powers["up"][:n], _powers["down"][:n]
    if len(_powers["up"]) > 4 * CHUNK_BYTES:  # tables of one very long text do not stay
        _powers.clear()
    return up, down


def release() -> None:
    """Gives memory that this process no longer uses back to the system: tables of powers, Arrow's pool, and the heap where the C library can."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def giving_back(step: Step) -> Step:
    """A step of mapInArrow that ends with release(). Workers outlive their tasks, and idle ones of earlier stages would hold what their largest task took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            release()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads all bits."""
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x ^= x >> _U64(33)
    x *= _U64(0xC4CEB9FE1A85EC53)
    x ^= x >> _U64(33)
    return x


def word_table(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts (ASCII letters lower-cased here): each word's 64-bit hash, text number, first and end byte in its text.

    is_word has a truth value for each of 256 byte values; a newline must not be of a word.
    """
    blob = b"\n".join(texts).lower()
    buf = np.frombuffer(blob, dtype=np.uint8)
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(_U64), none, none, none
    edge = np.diff(is_word[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(buf))
    sums = np.empty(len(buf) + 1, dtype=_U64)
    sums[0] = 0
    np.cumsum((buf.astype(_U64) + _U64(1)) * up, out=sums[1:])
    hashes = mix64((sums[end] - sums[first]) * down[first] + (end - first).astype(_U64))
    begins = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=begins[1:])
    of = np.searchsorted(begins, first, side="right") - 1
    return hashes, of, first - begins[of], end - begins[of]


#: Bytes of a word between white space: all but 0x20 and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
