"""Exact deduplication by distributed MSD radix partitioning.

All documents start in one group. A round deals each open group out by the next bytes of its texts, a digit; a group of one row
is settled, and so is a group whose texts have ended, which are equal. The others go on with the bytes behind. Rows are compared
by bytes alone; there is no digest. Digits grow from 64 bytes by four times a round, so rounds grow with the logarithm of the
longest text that two rows begin alike; beyond 1 MB they stay, so no key is larger.

A round counts the groups with partial sums in the map tasks, so copies meet as one row, and joins rows with the counts of
those groups that hold at least two. Groups of more than 1/4096 of all rows would fill a task: their counts are broadcast and
their rows stay where they are. There are at most (open rows) / (least such group) of them, and the digit is kept so short that
they take 64 MB at most. Bytes that are read are not carried on, and settled rows carry no text.

Defined results: a null text counts as empty, and empty texts are one group; texts are whole, of any length; of equal texts the
row with the largest id stays, null ids being smaller than all; of repeated rows that tie in text and id exactly one stays; an
empty table gives an empty result; extra columns are kept, whatever their names, and columns named keep_id, group_size or kept
(in any case) are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.shared import HOT_SHARE, LEAST_HOT, drop_written, held, written

#: Bytes of the first digit, how it grows, and the widest.
FIRST, GROWTH, WIDEST = 64, 4, 1 << 20
#: Bytes that the digits of broadcast groups take at most.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MADE = ("keep_id", "group_size", "kept")


def folded(text: Column) -> Column:
    """text with A to Z in lower case and nothing else changed; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _spread_left(rows: DataFrame, table: DataFrame, keys: list[str], n: str, least: int) -> DataFrame:
    """rows left-joined with table, a row for each key that holds n of rows; keys of more than least are broadcast, and their rows stay apart from the exchange of the rest."""
    more = [c for c in table.columns if c not in keys]
    hot = table.where(F.col(n) > least)
    if hot.isEmpty():
        return rows.join(table.hint("merge"), keys, "left")  # a shuffle at any size, so small tables are planned as large ones are
    met = rows.join(F.broadcast(hot.select(*keys, *[F.col(c).alias(f"_hot{c}") for c in more])), keys, "left")
    done = F.col(f"_hot{n}").isNotNull()
    # rows that have met go to the tasks that their ids and partitions give, under keys that no group has
    apart = F.when(done, -1 - F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(1 << 40))).otherwise(F.col(keys[0]))
    met = met.withColumn("_apart", apart)
    cold = table.where(F.col(n) <= least).withColumnRenamed(keys[0], "_apart")
    joined = met.join(cold.hint("merge"), ["_apart", *keys[1:]], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_hot{c}", c).alias(c) for c in more])


def _dealt(rows: DataFrame, width: int, least: int, level: int) -> DataFrame:
    """A round: rows (node, left) with what their next digit says: share and keep of their group, child if it is not alone, and left again if it goes on."""
    rows = rows.withColumn("_digit", F.substring("_left", 1, width))
    shares = rows.groupBy("_node", "_digit").agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_keep")).where("_n > 1")
    shares = written(shares.withColumn("_child", F.monotonically_increasing_id()), f"radix-{level}")
    met = _spread_left(rows, shares, ["_node", "_digit"], "_n", least)
    goes_on = F.col("_n").isNotNull() & (F.octet_length("_digit") == width)
    left = F.when(goes_on, F.substring("_left", width + 1, 2**31 - 1))
    kept = [c for c in rows.columns if c not in ("_node", "_left", "_digit")]
    out = written(met.select(*kept, "_n", "_keep", F.col("_child").alias("_node"), goes_on.alias("_open"), left.alias("_left"), F.monotonically_increasing_id().alias("_row")), f"dealt-{level}")
    drop_written(shares)
    return out


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """docs with keep_id (the largest id of the rows of equal text), group_size and kept; the text itself only with_text."""
    rows, back = held(docs, {"doc_id": doc_id, "_text": text}, _MADE)
    rows = rows.withColumn("_left", folded(F.col("_text")).cast("binary"))
    if not with_text:
        names = [c for c in docs.columns if c.lower() not in _MADE]
        rows, back = rows.drop("_text"), [b for b, c in zip(back, names, strict=True) if c.lower() != text.lower()]
    total = rows.count()
    least = max(LEAST_HOT, total // HOT_SHARE)
    rows, n_open, level, settled = rows.withColumn("_node", F.lit(0).cast("long")), total, 0, []
    while n_open or not level:
        width = min(FIRST * GROWTH**level, WIDEST, max(FIRST, BROADCAST_BYTES // max(1, n_open // least)))
        dealt = _dealt(rows, width, least, level)
        settled.append(dealt.where(~F.col("_open")).drop("_left", "_open").withColumn("_level", F.lit(level)))
        rows = dealt.where("_open").drop("_n", "_keep", "_open", "_row")
        n_open, level = rows.count(), level + 1
    return _kept(reduce(DataFrame.unionByName, settled), least).select(*back, "keep_id", "group_size", "kept")


def _kept(rows: DataFrame, least: int) -> DataFrame:
    """Settled rows with their results; of rows that share the largest id of their group, the first written stays."""
    largest = F.col("_n").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep"))
    ties = rows.where("_n > 1").where(largest).groupBy("_node", "_level").agg(F.count(F.lit(1)).alias("_ties"), F.min("_row").alias("_first")).where("_ties > 1")
    if ties.isEmpty():
        kept = largest
    else:
        rows = _spread_left(rows, written(ties, "radix-ties"), ["_node", "_level"], "_ties", least)
        kept = largest & (F.col("_first").isNull() | (F.col("_first") == F.col("_row")))
    keep = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return rows.select("*", keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))


def deduped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their columns."""
    rows = groups(docs, text, doc_id, with_text=True)
    return rows.where("kept").drop(*_MADE)
