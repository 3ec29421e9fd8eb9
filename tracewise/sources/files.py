"""Readers and writers of the library's file forms. Bad rows are data: readers give them apart."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.functions import text as X
from tracewise.sources import archives


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line raises, a missing file is empty."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, value) of non-blank lines, line from 1, blank ones counted.

    Files are read in splits: a row knows the split that it is in and its place there, splits are
    counted, and the lines of a file's earlier splits are added. So no file is one value or one task.
    """
    from pyspark.sql import Window

    made = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    first = made.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))  # a row per split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("file", "start", (before - F.col("first") + 1).alias("shift"))
    rows = made.join(first, ["file", "start"]).select("file", (F.col("id") + F.col("shift")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))
    return rows.where(X.filled(F.col("value")))


def read_objects(spark: SparkSession, paths: list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows (file, line and schema) and errors (file, line, error_type, error_message) of JSON-line files."""
    return parsed_objects(read_lines(spark, paths), schema)


def parsed_objects(rows: DataFrame, schema: T.StructType, kept: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Lines (file, line, value and kept) as good rows (file, line, kept and schema) and errors (file, line, error_type, error_message)."""
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = rows.withColumn("o", F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("o").isNull() | F.col("o._corrupt").isNotNull() | ~F.ltrim("value").startswith("{")
    good = rows.where(~bad).select("file", "line", *kept, *[F.col(f"o.{f}").alias(f) for f in schema.fieldNames()])
    errors = rows.where(bad).select("file", "line", F.lit("ValueError").alias("error_type"), F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": not a JSON object")).alias("error_message"))
    return good, errors


def with_places(rows: DataFrame, place: str = "place", file: str = "file", line: str = "line", share: int = 100_000, by_file: bool = False) -> DataFrame:
    """rows with their place by file and line, from 0, or in their file with by_file. Runs of share lines of a file are counted first, so no task sorts a whole file."""
    from pyspark.sql import Window

    rows = rows.withColumn("_run", F.floor(F.col(line) / share))
    counts = rows.groupBy(file, "_run").agg(F.count("*").alias("_c"))  # a row per run
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over((Window.partitionBy(file).orderBy("_run") if by_file else Window.orderBy(file, "_run")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    n = F.col("_before") + F.row_number().over(Window.partitionBy(file, "_run").orderBy(line))
    return rows.join(counts, [file, "_run"]).withColumn(place, n - 1).drop("_before", "_run")


def with_row_ids(rows: DataFrame, prefix: str = "row_", file: str = "file", line: str = "line", share: int = 100_000) -> DataFrame:
    """rows with row_id: their place by file and line, from 1, in 12 digits."""
    return with_places(rows, "_place", file, line, share).withColumn("row_id", F.format_string(f"{prefix}%012d", F.col("_place") + 1)).drop("_place")


def read_documents(spark: SparkSession, paths: list[str], fields: T.StructType) -> DataFrame:
    """(file, at, key, fields, error) of JSON documents that are lists of records, or objects of records by id.

    at is the record's place in its document, from 0, and key its id, or the place in a list. Entries that are no objects are left
    out but count as places. A document that is cut off, no JSON, or neither a list nor an object is one row with an error.
    """
    if clash := [f for f in fields.fieldNames() if f in ("file", "at", "key", "error")]:
        raise ValueError(f"a record's fields cannot be named {', '.join(clash)}")
    doc = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json("value")), r"^[A-Z]+", 0)
    text, listed = T.StringType(), kind == "ARRAY"
    entry = lambda key, value: F.struct(key.cast("string").alias("key"), value.alias("value"))
    by_place = F.transform(F.from_json("value", T.ArrayType(text)), lambda x, i: entry(i, x))
    by_id = F.transform(F.map_entries(F.from_json("value", T.MapType(text, text))), lambda e: entry(e["key"], e["value"]))
    error = F.when(kind.isNull(), "invalid JSON").when(~kind.isin("ARRAY", "OBJECT"), "neither a list nor an object of records")
    doc = doc.select("file", error.alias("error"), F.when(error.isNull(), F.when(listed, by_place).otherwise(by_id)).alias("entries"))
    rows = doc.select("file", "error", F.posexplode_outer("entries").alias("at", "entry"))
    rows = rows.where(F.col("error").isNotNull() | F.ltrim("entry.value").startswith("{"))
    record = F.from_json("entry.value", fields)
    return rows.withColumn("r", record).select("file", F.col("at").cast("long").alias("at"), F.col("entry.key").alias("key"), *[F.col(f"r.{f}").alias(f) for f in fields.fieldNames()], "error")


def read_records(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """The records of a JSON document with their key; a bad document raises."""
    rows = read_documents(spark, [path], fields)
    good = rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), "error")).cast("boolean")).otherwise(F.lit(True)))
    return good.select("key", *fields.fieldNames())


def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV with a header, all texts; a missing cell is null."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Few-shot examples (id, generation_type, anchor, generated), each field a non-empty text."""
    fields = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "generation_type", "anchor", "generated")])
    rows = read_records(spark, path, fields).drop("key")
    bad = F.lit(False)
    for c in fields.fieldNames():
        bad |= X.coerce_text(F.col(c)) == ""
    return rows.where(F.when(bad, F.raise_error(F.lit("a pool example lacks a text"))).otherwise(F.lit(True)))


def read_zip_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(archive, member, line, value) of the text members of ZIP files; a bad archive or member raises."""
    return indexed_zip_lines(spark, path, suffix).drop("row_index")


def indexed_zip_lines(spark: SparkSession, path: str, suffix: str = ".jsonl", limit: int | None = None) -> DataFrame:
    """read_zip_lines with row_index: the row's place by archive, member and line, from 0; limit keeps the first rows."""
    members = archives.directory(spark, path).where(F.col("member").endswith(suffix) | F.col("error").isNotNull())
    return archives.lines(archives.strict(archives.line_index(members)), limit)


def count_zip_rows(rows: DataFrame) -> DataFrame:
    """Rows of each archive."""
    return rows.groupBy("archive").agg(F.count("*").alias("n"))


def zip_references(members: DataFrame) -> DataFrame:
    """Archive members with `uri`, by which a reader finds one without unpacking the rest."""
    return members.withColumn("uri", F.concat(F.lit("zip://"), "archive", F.lit("::"), "member"))


def read_zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, content) of the files in ZIP archives; a bad archive or member raises."""
    return archives.strict(archives.contents(archives.directory(spark, path))).drop("error")


def rows_by_index(rows: DataFrame, wanted: DataFrame, index: str = "row_index", position: str = "position") -> DataFrame:
    """rows at the indices of wanted (index, position), in order of position."""
    return rows.join(wanted, index).orderBy(position)


def candidates(roots: Iterable[str], names: Iterable[str]) -> list[str]:
    """Paths of names below roots that exist, by root, then name."""
    return [str(p) for r in roots for n in names if (p := Path(r) / n).is_file()]


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file in the order of columns; null and missing are empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).coalesce(1).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with nulls written; mode append adds to a log."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_json_atomic(value: object, path: str) -> None:
    """A small document on the driver, put in place by a rename."""
    tmp = f"{path}.tmp-{os.getpid()}"
    Path(tmp).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    os.replace(tmp, path)


def markdown(df: DataFrame, columns: list[str], limit: int = 10_000) -> str:
    """A report of a small table: floats with 6 significant digits, null as empty. More than limit rows are an error."""
    rows = df.select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    body = ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *body]) + "\n"


def load_staged(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A dataset that was staged as Parquet, or as JSON lines if its name says so, with an explicit schema for JSON; columns are read alone."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        if schema is None:
            raise ValueError("JSON needs a schema")
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        rows = spark.read.parquet(path)
    return rows if columns is None else rows.select(*columns)


def zip_uri(archive: str, member: str) -> str:
    return f"zip://{archive}::{member}"


def split_list(text: str) -> list[str]:
    """The non-empty parts of a comma list."""
    return [x.strip() for x in text.split(",") if x.strip()]
