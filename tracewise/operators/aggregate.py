"""Grouped tables of rewards and scores. One pass and one exchange each, with partial sums before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions import rewards as M

TAUS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def reward_rows(scores: DataFrame, kappa: float = 0.0) -> DataFrame:
    """Scores (dataset, subcategory, scorer, score_field, pair_type, value, ...) as rewards; other pair types and null values are dropped, null groups are empty texts."""
    rows = scores.withColumn("pair_type", M.pair_type(F.col("pair_type"))).where(F.col("pair_type").isin("positive", "negative") & F.col("value").isNotNull())
    blank = {c: F.coalesce(c, F.lit("")) for c in ("dataset", "subcategory") if c in scores.columns}
    return rows.withColumns(blank | {"reward": M.scale_reward(F.col("value"), kappa)})


def _means() -> list:
    pos, neg = F.col("pair_type") == "positive", F.col("pair_type") == "negative"
    return [F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"), F.avg(F.when(pos, F.col("reward"))).alias("mean_pos"), F.avg(F.when(neg, F.col("reward"))).alias("mean_neg")]


def reward_means(rewards: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and mean rewards of positives and negatives, and their margin (null if a side is empty)."""
    return rewards.groupBy(*keys).agg(*_means()).withColumn("margin", F.col("mean_pos") - F.col("mean_neg"))


def reward_grouping_sets(rewards: DataFrame, key_lists: list[list[str]]) -> DataFrame:
    """reward_means at several key lists in one pass; `level` numbers the list, keys outside it are null."""
    keys = list(dict.fromkeys(k for ks in key_lists for k in ks))
    grouped = rewards.groupingSets([[F.col(k) for k in ks] for ks in key_lists], *keys).agg(F.grouping_id().alias("_g"), *_means())
    bits = {sum(0 if k in ks else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)): n for n, ks in enumerate(key_lists)}
    level = F.create_map(*[F.lit(x) for kv in bits.items() for x in kv])[F.col("_g").cast("int")]
    return grouped.withColumn("level", level).drop("_g").withColumn("margin", F.col("mean_pos") - F.col("mean_neg"))


def deduped_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, nulls being equal, in the order of the columns named. Rows are sorted by a digest of their key first, which tells most of them apart by one number."""
    w = Window.partitionBy("_digest", *keys).orderBy(*order)
    return rows.withColumn("_digest", F.xxhash64(*keys)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_digest")


def case_counts(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Cases and their negatives by keys."""
    return cases.groupBy(*keys).agg(F.count("*").alias("n_cases"), F.sum(F.size("negatives")).alias("n_negatives"))


def negative_type_counts(rows: DataFrame, keys: list[str], types: list[str], trace: str = "trace_id") -> DataFrame:
    """Distinct traces, and rows of each negative type, by keys."""
    return rows.groupBy(*keys).agg(F.count_distinct(trace).alias("n_traces"), *[F.count_if(F.col("negative_type") == t).alias(t) for t in types])


def preview(rows: DataFrame, keys: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def ranking_margins(scores: DataFrame, keys: list[str], order: str, first: bool) -> DataFrame:
    """Of ranking cases: the positive (first or last in order) less the hardest negative, where both exist. No join: one grouping."""
    pos, neg = F.col("pair_type") == "positive", F.col("pair_type") == "negative"
    pick = (F.min_by if first else F.max_by)(F.col("value"), F.when(pos, F.col(order)))
    grouped = scores.where("mode = 'ranking'").groupBy(*keys).agg(F.count_if(pos).alias("_p"), pick.alias("_pos"), F.max(F.when(neg, F.col("value"))).alias("_neg"))
    return grouped.where("_p > 0 AND _neg IS NOT NULL").withColumn("margin", F.col("_pos") - F.col("_neg")).drop("_p", "_pos", "_neg")


def ranking_accuracy(margins: DataFrame, keys: list[str]) -> DataFrame:
    """Share of margins above 0."""
    return margins.groupBy(*keys).agg(F.count("*").alias("n_cases"), F.avg((F.col("margin") > 0).cast("double")).alias("ranking_acc"))


def passes(value, tau):
    """value >= tau, with NaN never passing."""
    return F.when(F.isnan(value), F.lit(0.0)).otherwise((value >= tau).cast("double"))


def tau_sensitivity(scores: DataFrame, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """Scores (scorer, score_field, family, mode, pair_type, case_id, value, line): for each tau the false-positive rate of each family, with ranking accuracies.

    Margins do not depend on tau and are aggregated once. Rates of all taus are conditional
    averages of one pass, so scores are never multiplied by the grid.
    """
    keys = ["scorer", "score_field"]
    neg = F.col("pair_type") == "negative"
    rates = [F.avg(F.when(neg & (F.col("family") == f), passes(F.col("value"), t))).alias(f"{f}_{n}") for n, t in enumerate(taus) for f in ("hn", "neg", "num")]
    wide = scores.groupBy(*keys).agg(*rates)
    points = F.array(*[F.struct(F.lit(t).alias("tau"), *[F.col(f"{f}_{n}").alias(f"{f}_fpr") for f in ("hn", "neg", "num")]) for n, t in enumerate(taus)])
    grid = wide.select(*keys, F.explode(points).alias("_t")).select(*keys, "_t.*")
    margins = ranking_margins(scores.where(F.col("family").isin("hn", "num")), [*keys, "family", "case_id"], "line", first=False)
    good = (F.col("margin") > 0).cast("double")
    ranked = margins.groupBy(*keys).agg(F.avg(good).alias("ranking_acc"), *[F.avg(F.when(F.col("family") == f, good)).alias(f"{f}_ranking_acc") for f in ("hn", "num")])
    return grid.join(ranked, keys, "left")
