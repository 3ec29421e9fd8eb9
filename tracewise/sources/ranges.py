"""The first lines of a text file, read by byte ranges: a plain read of a file plans all of its splits, this one those that hold the lines.

Ranges are a data source (`line_ranges`): a partition reads the lines that begin in its range, at its offset. Counts of ranges give the
number of each line, so nothing is sorted. Ranges are counted in growing runs until they hold enough lines, so what is read
is at most about three times what the lines take, and a range more.
Paths are those that pyarrow's file systems open (local, file://, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewise.functions import text as X
from tracewise.sources.archives import buffered, opened

#: Bytes of a range.
RANGE_BYTES = 8 << 20


class _Range(InputPartition):
    def __init__(self, path: str, k: int, begin: int, end: int):
        super().__init__(k)
        self.path, self.k, self.begin, self.end = path, k, begin, end


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.first, self.last, self.size, self.step = options["path"], int(options["first"]), int(options["last"]), int(options["size"]), int(options["step"])

    def partitions(self) -> list[_Range]:
        return [_Range(self.path, k, k * self.step, min(self.size, (k + 1) * self.step)) for k in range(self.first, self.last)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with buffered(partition.path) as f:
            place = partition.begin
            f.seek(max(0, place - 1))
            if place and f.read(1) != b"\n":
                place += len(f.readline())
            n = 0
            while place < partition.end and (line := f.readline()):
                place += len(line)
                n += 1
                yield partition.k, n, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")


class LineRanges(DataSource):
    """Lines of one text file by ranges. Options: path, size (of the file), step (bytes of a range), first and last (the ranges wanted)."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "range int, n long, value string"

    def reader(self, schema: T.StructType) -> _RangeReader:
        return _RangeReader(self.options)


def first_lines(spark: SparkSession, path: str, wanted: int, step: int = RANGE_BYTES) -> DataFrame:
    """(file, line, value) of the first wanted lines that are not blank, line from 1, blank ones counted; all of them if there are fewer."""
    spark.dataSource.register(LineRanges)
    files, name = opened(path)
    size = files.get_file_info(name).size
    ranges, first, last, held, before, counted = -(-size // step), 0, 1, 0, 0, []
    source = lambda a, b: spark.read.format("line_ranges").options(path=path, size=size, step=step, first=a, last=b).load()
    while first < ranges and held < wanted:
        last = min(last, ranges)
        counts = {r["range"]: r for r in source(first, last).groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.filled(F.col("value"))).alias("filled")).collect()}  # a row a range
        for k in range(first, last):
            counted.append((k, before, held))
            before, held = before + (counts[k]["n"] if k in counts else 0), held + (counts[k]["filled"] if k in counts else 0)
            if held >= wanted:
                break
        first, last = last, last + 2 * (last - first)
    at = spark.createDataFrame(counted, "range int, before long, filled long")
    rows = source(0, len(counted)).join(F.broadcast(at), "range").where(X.filled(F.col("value")))
    place = F.col("filled") + F.row_number().over(Window.partitionBy("range").orderBy("n"))
    return rows.withColumn("_place", place).where(F.col("_place") <= wanted).select(F.lit(path).alias("file"), (F.col("before") + F.col("n")).alias("line"), "value")
