"""Samples and splits in hash order: exact counts, the same on every run and every partitioning.

The order is a digest of the seed and the key, so membership is not that of a sequential shuffle.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.session import scratch


def hash_order(seed: int, *keys: str | Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]), 256)


def capped(rows: DataFrame, group: list[str], key: list[str], cap: int, seed: int = 42) -> DataFrame:
    """At most cap rows of each group."""
    w = Window.partitionBy(*group).orderBy(hash_order(seed, *key), *key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


#: Rows of a range that places are counted by, about: one task sorts a range.
RANGE_ROWS = 200_000


def _digits(rows: DataFrame) -> int:
    """Hex digits of a digest that part so many rows into ranges of RANGE_ROWS at most, about; 2 at least."""
    n, digits = rows.count(), 2
    while 16**digits * RANGE_ROWS < n:
        digits += 1
    return digits


#: Rows of a task that works on keys, about.
KEY_ROWS = 500_000


def together(rows: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """rows with those of a key in one task: the one exchange, which later steps by the key find as they need it.

    Tasks follow from rows, if not given, up to the number that an exchange writes without sorting rows in memory first.
    """
    return rows.repartition(tasks or _tasks(rows), *keys)


def _tasks(rows: DataFrame) -> int:
    most = int(rows.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(1, min(most, -(-rows.count() // KEY_ROWS)))


def ranked_groups(rows: DataFrame, within: list[str], key: str, seed: int) -> DataFrame:
    """Distinct keys with _n, their place in hash order, and _of, their number, in each group of within. Ranges of the digest, as many as rows ask for, are counted first, so no task sorts all keys of a group."""
    ids = rows.select(*within, key).distinct().withColumn("_h", hash_order(seed, *within, key)).withColumn("_b", F.substring("_h", 1, _digits(rows)))
    counts = ids.groupBy(*within, "_b").agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*within)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_of", F.sum("_c").over(own)).drop("_c")
    n = F.col("_before") + F.row_number().over(Window.partitionBy(*within, "_b").orderBy("_h", key))
    return ids.join(counts, [*within, "_b"]).withColumn("_n", n).drop("_h", "_b", "_before")


def calibration_split(rows: DataFrame, fraction: float = 0.85, dataset: str = "dataset", case: str = "case_id", seed: int = 42) -> DataFrame:
    """rows with split: of each dataset's cases, the rounded fraction (half to even; at least 1, and 1 less than all) is `calib`, the rest `heldout`."""
    tasks = _tasks(rows)
    rows = together(rows, dataset, case, tasks=tasks)
    ids = ranked_groups(rows, [dataset], case, seed)
    n = F.when(F.col("_of") == 1, 1).otherwise(F.greatest(F.lit(1), F.least(F.bround(F.col("_of") * F.lit(fraction)).cast("long"), F.col("_of") - 1)))
    ids = ids.select(dataset, case, F.when(F.col("_n") <= n, "calib").otherwise("heldout").alias("split"))
    return rows.join(together(ids, dataset, case, tasks=tasks), [dataset, case])


def _numbered(rows: DataFrame, bucket: Column, order: list[str]) -> tuple[DataFrame, int]:
    """rows with _n, their place in order, which must rise with bucket, and their number. Buckets are counted first, so a task sorts one."""
    rows = rows.withColumn("_b", bucket)
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = counts.select(F.col("_b").alias("_bucket"), "_before")  # a row per bucket
    numbered = rows.join(F.broadcast(named), F.col("_b").eqNullSafe(F.col("_bucket"))).withColumn("_n", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return numbered.drop("_b", "_bucket", "_before"), counts.agg(F.sum("_c")).first()[0] or 0


def _placed(rows: DataFrame, key: str, seed: int) -> tuple[DataFrame, int]:
    """Distinct keys with _n, their place in the whole hash order, and their number."""
    ids = rows.select(key).distinct().withColumn("_h", hash_order(seed, key))
    ids, total = _numbered(ids, F.substring("_h", 1, _digits(rows)), ["_h", key])
    return ids.select(key, "_n"), total


def _tie(rows: DataFrame) -> Column:
    """A digest of a row's columns, so that rows that tie in an order have one of their own."""
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    return F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in plain])


def placed_in_order(rows: DataFrame, order: list[str], range_rows: int | None = None) -> tuple[DataFrame, int]:
    """rows with _n, their place in the order of columns, from 1, nulls first, and their number.

    Splitters are sampled from whole order keys, with ties parted by a digest of the row and then by where it stands, so one value that many rows
    hold is several ranges. Ranges are as many as rows ask for, written once into the shared folder, and counted there.
    """
    total = rows.count()
    ranges = max(1, -(-total // (range_rows or RANGE_ROWS)))
    keys = [*[F.col(c).asc_nulls_first() for c in order], F.col("_tie"), F.col("_at")]
    placed = rows.withColumns({"_tie": _tie(rows), "_at": F.monotonically_increasing_id()}).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = placed.drop("_tie", "_at").withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    path = scratch(rows.sparkSession, "places")
    placed.write.parquet(path)
    placed = rows.sparkSession.read.schema(placed.schema).parquet(path)
    counts = placed.groupBy("_range").agg(F.count("*").alias("_c"), F.min("_place").alias("_least"))  # a row a range
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_range", (before + 1 - F.col("_least")).alias("_shift"))
    return placed.join(F.broadcast(counts), "_range").withColumn("_n", F.col("_place") + F.col("_shift")).select(*rows.columns, "_n"), total


#: Ids that a legacy order is made for, at most: the driver draws a place for each.
LEGACY_IDS = 1_000_000


def legacy_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct keys with _n, their place from 1 in the order that CPython's random.Random(seed).shuffle gives their sorted list. More than LEGACY_IDS keys are an error.

    The permutation follows from seed and number alone: the driver draws it and ships a pair of numbers a key; keys stay where they are.
    """
    ids, n = placed_in_order(rows.select(key).where(F.col(key).isNotNull()).distinct(), [key])
    if n > LEGACY_IDS:
        raise ValueError(f"a legacy order has at most {LEGACY_IDS} ids, not {n}")
    drawn = list(range(1, n + 1))
    random.Random(seed).shuffle(drawn)
    places = rows.sparkSession.createDataFrame(pd.DataFrame({"_n": pd.Series(drawn, dtype="int64"), "_new": pd.Series(range(1, n + 1), dtype="int64")}), "_n long, _new long")
    return ids.join(F.broadcast(places), "_n").select(key, F.col("_new").alias("_n"))


def grouped_split(rows: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with split train, val or test; all rows of a key go together. An empty split is an error."""
    if abs(train + val - 1) > 1 + 1e-8 or train <= 0 or val < 0 or train + val > 1 + 1e-8:
        raise ValueError(f"ratios out of range: {train}, {val}")
    ids, total = _placed(rows, key, seed)
    first = round(total * train)
    second = first + round(total * val)
    if not 0 < first < second < total:
        raise ValueError(f"a split of {total} groups would be empty")
    name = F.when(F.col("_n") <= first, "train").when(F.col("_n") <= second, "val").otherwise("test")
    return rows.join(ids.select(key, name.alias("split")), key)


def holdout_split(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """rows with split train or val by key; no val if ratio is 0 or there are fewer than 2 keys, else at least 1 and at least 1 left."""
    ids, total = _placed(rows, key, seed)
    n = 0 if ratio == 0 or total < 2 else min(max(round(total * ratio), 1), total - 1)
    return rows.join(ids.select(key, F.when(F.col("_n") <= n, "val").otherwise("train").alias("split")), key)


def ratio_sample(rows: DataFrame, key: str, ratio: float, cap: int | None = None, seed: int = 42) -> DataFrame:
    """max(1, floor(n * ratio)) rows, at most cap. Rows are placed by counted digest ranges, so no task holds the sample."""
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must be in (0, 1]: {ratio}")
    placed = rows.withColumn("_h", hash_order(seed, key))
    placed, total = _numbered(placed, F.substring("_h", 1, _digits(rows)), ["_h", key])
    n = max(1, int(total * ratio))
    return placed.where(F.col("_n") <= (n if cap is None else min(n, cap))).drop("_h", "_n")


def balanced_sample(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, taken from the groups in turn, so counts differ by at most 1 while groups last."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, key), key)
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return kept.orderBy("_n", hash_order(seed, group, "_n"), group).limit(n).drop("_n")


def _draws(seed: Column, size: Column, k: int) -> Column:
    """k distinct places from 1 to size, by seed, or all if there are fewer: each draw is a digest's number among the places that are left."""
    def drawn(taken: Column, j: Column) -> Column:
        number = F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), j.cast("string")), 256), 1, 12), 16, 10).cast("long")
        at = F.pmod(number, size - j) + 1
        pick = F.aggregate(F.array_sort(taken), at, lambda p, t: F.when(t <= p, p + 1).otherwise(p))  # past those taken, in rising order
        return F.when(j < size, F.concat(taken, F.array(pick))).otherwise(taken)

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), drawn)


#: Items of a pool that are broadcast to their requests, at most; the places of a larger one are many keys.
SMALL_POOL = 100_000


def per_request_sample(requests: DataFrame, pool: DataFrame, on: str, request: str, item: str, k: int, short: str = "raise", seed: int = 42) -> DataFrame:
    """(request, items): k distinct pool items of the request's kind, drawn by the request's generation_seed.

    Items are numbered once by kind, in hash order, and a request draws k places, so work is k rows a request and a place an
    item at any size of the pool. A kind with fewer than k items raises, or with short="drop" gives what it has, and nothing if it has none.
    Repeated items count once; a null item is none.
    """
    items = ranked_groups(pool.where(F.col(item).isNotNull()), [on], item, seed).select(F.col(on).alias("_on"), F.col("_n").alias("_place"), F.col(item).alias("_item"))
    sizes = items.groupBy("_on").agg(F.count("*").alias("_of"))
    asked = requests.join(sizes, F.col(on) == F.col("_on"), "left").drop("_on")
    size = F.coalesce("_of", F.lit(0).cast("long"))
    if short == "raise":
        message = F.concat(F.lit(f"{k} items asked of the pool "), F.coalesce(F.col(on).cast("string"), F.lit("null")), F.lit(" of "), size.cast("string"))
        size = F.when(size < k, F.raise_error(message).cast("long")).otherwise(size)
    drawn = asked.select(request, F.col(on).alias("_kind"), F.posexplode(_draws(F.coalesce(F.col("generation_seed"), F.lit(0)), size.cast("long"), k)).alias("_j", "_place"))
    if items.count() <= SMALL_POOL:  # of few places each has many requests
        items = F.broadcast(items)
    found = drawn.join(items, (F.col("_kind") == F.col("_on")) & (drawn["_place"] == items["_place"]))
    picked = F.transform(F.array_sort(F.collect_list(F.struct("_j", "_item"))), lambda x: x["_item"])
    return found.groupBy(request).agg(picked.alias("items"))


def head_split(rows: DataFrame, order: list[str], eval_ratio: float) -> DataFrame:
    """rows with split: the first max(1, floor(n * ratio)) in order, at most n - 1, are `val`. A single row is both, so it comes twice."""
    placed, n = placed_in_order(rows, order)
    if n == 1:
        return rows.withColumn("split", F.explode(F.array(F.lit("val"), F.lit("train"))))
    k = min(max(1, int(n * eval_ratio)), n - 1)
    return placed.withColumn("split", F.when(F.col("_n") <= k, "val").otherwise("train")).drop("_n")


def capped_groups(rows: DataFrame, group: list[str], key: str, cap: int, seed: int = 42) -> DataFrame:
    """All rows of at most cap keys of each group."""
    ids = ranked_groups(rows, group, key, seed).where(F.col("_n") <= cap).select(*group, key)
    return rows.join(ids, [*group, key])


def shuffled(rows: DataFrame, keys: list[str], seed: int = 42, parts: int | None = None) -> DataFrame:
    """rows dealt out by a digest of seed and keys, and in its order in each part: an order that looks random, without a sort of the whole. It is the same on every run with as many parts (by default, the session's shuffle partitions)."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = hash_order(seed, *keys)
    return rows.repartition(parts, order).sortWithinPartitions(order, *keys)


def leaks(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are in more than one split."""
    return rows.groupBy(key).agg(F.min("split").alias("_a"), F.max("split").alias("_b"), F.count_distinct("split").alias("n_splits")).where("_a < _b").select(key, "n_splits")
