"""Mixing sources to target weights.

Each row gets a hash-random key. Within a source, rows are sorted by ranges of that key: a range
is the key's top bits, so its bounds need no sampling and a source of any size spreads over
RANGES of them. Sums per range give each range its offset (a distributed prefix sum) and show the
one range in which the source's budget ends; only that range is sorted, by a second prefix sum over
its distinct (key, id, size), to find the row at which the source is cut. All rows are then
compared with the cut of their source where they stand: whole epochs first, then the rows before the
cut. Rows are not shuffled, so texts stay in place.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is a source
of its own, last in order; a null id has the digest of its content (the column `tie`) instead; repeated
rows count each; rows tie if id (or content) and size are equal, and tied rows at a cut are numbered by
their content, so reruns agree up to rows that are alike in all; a very long text is measured
by built-in functions and is taken up to the cut, or, with whole, if most of it is before the cut; an
empty table gives an empty result; extra columns are kept, whatever their names, and columns named as
those made here (in any case) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.shared import quoted, written

WEIGHTS = (5, 2, 1)
#: Bits of the key that number a range, of its 60.
RANGE_BITS = 12
#: Sources whose cuts are broadcast at most, a row of about 100 bytes each; beyond, cuts are joined by source and salt.
MANY_SOURCES, SALTS = 50_000, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(doc_id), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (_src, source, source_size) with `target`: share of the total by weight, at most `most` times a source's size.

    Reshared excess settles at one level: a source gets min(most * size, level * weight). In order
    of size by weight, the sources below the level come first, so one prefix sum finds it. The
    window has a row per source, never one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("_mix_ratio", F.col("source").asc_nulls_last())
    before, rest, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    return (
        sources.withColumn("_mix_weight", pick)
        .withColumn("_mix_cap", F.lit(most) * F.col("source_size"))
        .withColumn("_mix_ratio", F.col("_mix_cap") / F.col("_mix_weight"))
        .withColumn("_mix_all", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("_mix_level", (F.col("_mix_all") - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0))) / F.sum("_mix_weight").over(rest))
        .withColumn("_mix_open", F.max(F.when(F.col("_mix_level") < F.col("_mix_ratio"), F.col("_mix_level"))).over(everything))
        .withColumn("target", F.least(F.col("_mix_cap"), F.coalesce(F.col("_mix_open") * F.col("_mix_weight"), F.col("_mix_cap"))))
        .drop("_mix_weight", "_mix_cap", "_mix_ratio", "_mix_all", "_mix_level", "_mix_open")
    )


def _numbered(tied: DataFrame) -> DataFrame:
    """tied, rows of one key at a source's cut, with _index: their place among those of their source, from 0. Counted by content hash first, so no task numbers all of them."""
    tied = written(tied.withColumn("_salt", F.pmod(F.xxhash64("_rest"), F.lit(SALTS))), "tied")
    salts = tied.groupBy("_src", "_salt").agg(F.count("*").alias("_n"))
    salts = salts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_src").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_src", "_salt").orderBy(F.xxhash64("_rest")))
    return tied.withColumn("_rank", rank).join(F.broadcast(salts), ["_src", "_salt"]).withColumn("_index", F.col("_before") + F.col("_rank") - 1).drop("_salt", "_rank", "_n", "_before")


def _cuts(slim: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """A row per source of slim (_src, _key, _id, _size): source_size, target, _epochs, the (key, id, size) at which its last epoch is cut, _left (words of the budget that are left there) and _alike (rows of that key). Written."""
    ranged = slim.withColumn("_range", F.shiftright("_key", 60 - RANGE_BITS).cast("int"))
    ranges = written(ranged.groupBy("_src", "_range").agg(F.sum("_size").alias("_sum")), "ranges")
    sources = ranges.groupBy("_src").agg(F.sum("_sum").alias("source_size"))
    sources = targets(sources.withColumn("source", F.when(F.col("_src") != "", F.substring("_src", 2, 1 << 30))), share, most, weights).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = written(sources.withColumn("_epochs", epochs).withColumn("_budget", F.floor("target").cast("long") - F.col("_epochs") * F.col("source_size")), "sources")

    earlier = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).join(sources, "_src")
    ends = offsets.where("_offset <= _budget AND _budget < _offset + _sum").select("_src", "_range", (F.col("_budget") - F.col("_offset")).alias("_left"))
    groups = ranged.join(F.broadcast(ends) if sources.count() <= MANY_SOURCES else ends, ["_src", "_range"]).groupBy("_src", "_key", "_id", "_size", "_left").agg(F.count("*").alias("_alike"))
    upto = F.sum(F.col("_size") * F.col("_alike")).over(Window.partitionBy("_src").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("_left", F.col("_left") - F.coalesce(upto, F.lit(0))).where("_left >= 0 AND _left < _size * _alike")
    groups = groups.select("_src", F.col("_key").alias("_cut_key"), F.col("_id").alias("_cut_id"), F.col("_size").alias("_cut_size"), "_left", "_alike")
    return written(sources.drop("_budget").join(groups, "_src", "left"), "cuts")


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, whole: bool = False, tie: Column | None = None) -> DataFrame:
    """docs with `size`, `source_size`, `target` and `taken` (words the mix takes of the row, repeats counted).

    The row at a source's cut gives the words up to the cut, so a source's taken words are its
    target, rounded down. With whole, a row is taken in whole epochs only, and the cut goes to the
    nearest row boundary. size and tie are expressions over docs; tie stands for null ids.
    """
    made = ("size", "source_size", "target", "taken")
    measured = docs.select(size.cast("long").alias("_size"), F.coalesce(F.col(quoted(key)).cast("string"), tie if tie is not None else F.lit("")).alias("_id"), F.coalesce(F.concat(F.lit("="), F.col(quoted(source))), F.lit("")).alias("_src"), F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("_rest"))
    measured = measured.withColumn("_key", _key(F.col("_id")))
    cuts = _cuts(written(measured.select("_src", "_key", "_id", "_size"), "sizes"), share, most, weights)
    back = [F.col(f"_rest.c{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in made]

    if cuts.count() <= MANY_SOURCES:
        joined = measured.join(F.broadcast(cuts), "_src")
    else:  # a row per source and salt, so that a source of a third of all rows is many keys
        copies = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("_salt", F.pmod("_key", F.lit(SALTS)).cast("int")).join(copies, ["_src", "_salt"]).drop("_salt")
    row, cut = F.struct("_key", "_id", "_size"), F.struct(F.col("_cut_key"), F.col("_cut_id"), F.col("_cut_size"))
    at_cut = F.coalesce(row == cut, F.lit(False))
    plain = joined.withColumn("_index", F.lit(0).cast("long"))
    if not cuts.where("_alike > 1").isEmpty():
        tied = at_cut & (F.col("_alike") > 1)
        plain = plain.where(~F.coalesce(tied, F.lit(False))).unionByName(_numbered(joined.where(tied)))
    left = F.when(at_cut, F.col("_left") - F.col("_index") * F.col("_size")).when(F.col("_cut_key").isNotNull() & (row < cut), F.col("_size")).otherwise(F.lit(0))
    last = F.when(left * 2 >= F.col("_size"), F.col("_size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(F.col("_size"), left))
    taken = (F.col("_epochs") * F.col("_size") + last).cast("long")
    return plain.select(*back, F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """A mix of whole rows, each as often as it is taken. Rows of size 0 go once when their source is kept."""
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(1))
    return mixed.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), times))).drop("_mix_copy")
