"""Calibration of NLI scores: weights, logistic fit, thresholds and report tables."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions import rewards as M
from tracewise.operators import sampling as B
from tracewise.operators.aggregate import passes


def with_case_modes(rows: DataFrame, keys: tuple[str, ...] = ("dataset", "case_id")) -> DataFrame:
    """rows with mode: ranking where the case has both pair types, else separation."""
    w = Window.partitionBy(*keys)
    both = F.max(F.when(F.col("pair_type") == "positive", 1).otherwise(0)).over(w) + F.max(F.when(F.col("pair_type") == "negative", 1).otherwise(0)).over(w)
    return rows.withColumn("mode", F.when(both == 2, "ranking").otherwise("separation"))


def with_sample_weights(rows: DataFrame) -> DataFrame:
    """rows with weight: the inverse count of (dataset, label), scaled so that weights sum to the rows.

    The raw weights of a group sum to 1, so the scale is rows by groups; both come from one small grouping, whose totals are one row.
    """
    counts = rows.groupBy("dataset", "label").agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_groups"))
    counts = counts.crossJoin(totals).select("dataset", "label", (F.col("_rows") / (F.col("_groups") * F.col("_n"))).alias("weight"))
    return rows.join(counts, ["dataset", "label"])


#: Rows of a task of a fit, at most, about.
FIT_ROWS = 500_000


def fit_logistic(rows: DataFrame, features: str = "features", max_iter: int = 1000) -> tuple[list[float], float]:
    """Coefficients and bias of a logistic fit with weights and an L2 penalty of unit strength."""
    # rows that are the same count as one of their whole weight
    data = rows.groupBy(F.col("label").cast("double").alias("label"), F.col(features).alias("x")).agg(F.sum("weight").alias("weight"))
    n, total, least, most = data.agg(F.count("*"), F.sum("weight"), F.min("label"), F.max("label")).first()
    if least == most:
        raise ValueError("both labels are needed")
    data = data.repartition(-(-n // FIT_ROWS), "x").withColumn("x", array_to_vector("x"))
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1.0 / total, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8).fit(data)
    return [float(w) for w in model.coefficients], float(model.intercept)


def parse_tau_grid(text: str) -> list[float]:
    """start:end:step, or a comma list: rounded to 10 places, sorted, distinct, in [0, 1]."""
    if ":" in text:
        start, end, step = map(float, text.split(":"))
        if step <= 0 or end < start:
            raise ValueError(f"bad grid: {text}")
        values = [start + i * step for i in range(int((end - start) / step + 1e-9) + 1)]
    else:
        values = [float(x) for x in text.split(",") if x.strip()]
    taus = sorted({round(v, 10) for v in values})
    if not taus or taus[0] < 0 or taus[-1] > 1:
        raise ValueError(f"thresholds must be in [0, 1]: {text}")
    return taus


def rate(label: int, tau: float | Column) -> Column:
    return F.avg(F.when(F.col("label") == label, passes(F.col("calibrated_score"), F.lit(tau) if isinstance(tau, float) else tau)))


def _case_parts(rows: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """A row per case, kind and first positives' row_id within keys, with the sums that all metrics follow from. All columns are plain, so rows are grouped without a sort."""
    score, label, ranking = F.col("calibrated_score"), F.col("label"), F.col("mode") == "ranking"
    pos, neg = F.col("pair_type") == "positive", F.col("pair_type") == "negative"
    kind = F.when(neg, F.coalesce(F.nullif("negative_type", F.lit("")), F.lit("__all__")))
    sums = [F.count("*").alias("_rows")]
    for k in (0, 1):
        own = F.when(label == k, score)
        sums += [F.count(own).alias(f"_n{k}"), F.sum(own).alias(f"_s{k}"), F.sum(F.when(label == k, passes(score, F.lit(tau)))).alias(f"_t{k}")]
    least = F.when(F.count_if(score.isNull()) == 0, F.min(score)).alias("_pos")  # of one row_id a null comes first
    case = list(dict.fromkeys([*keys, "dataset", "case_id"]))
    return rows.groupBy(*case, kind.alias("_kind"), F.when(ranking & pos, F.col("row_id")).alias("_row")).agg(*sums, least, F.max(F.when(ranking & neg, score)).alias("_neg"))


def _margins(parts: DataFrame, keys: list[str], levels: list[list[str]]) -> DataFrame:
    """By each level: ranking accuracy and mean margin of (case, negative type) pairs within keys: the case's first positive less the type's hardest negative."""
    case = list(dict.fromkeys([*keys, "dataset", "case_id"]))
    ranked = parts.where("_row IS NOT NULL OR _neg IS NOT NULL")
    first = F.first(F.when(F.col("_row").isNotNull(), F.col("_pos"))).over(Window.partitionBy(*case).orderBy(F.col("_row").asc_nulls_last(), F.col("_pos").asc_nulls_first()))
    by_type = ranked.withColumn("_first", first).groupBy(*case, "_kind").agg(F.max("_first").alias("_first"), F.max("_neg").alias("_neg")).where("_neg IS NOT NULL AND _first IS NOT NULL")
    margin = F.col("_first") - F.col("_neg")
    return _grouped(by_type, levels, F.avg((margin > 0).cast("double")).alias("ranking_acc"), F.avg(margin).alias("mean_margin"))


def _grouped(rows: DataFrame, levels: list[list[str]], *columns: Column) -> DataFrame:
    """One pass for all levels: _level counts a row's keys. Each level's keys begin with those of the level before."""
    deepest = max(levels, key=len)
    grouped = rows.groupingSets([[F.col(k) for k in ks] for ks in levels], *[F.col(k) for k in deepest]).agg(F.grouping_id().alias("_g"), *columns)
    level = F.create_map(*[F.lit(x) for ks in levels for x in ((1 << (len(deepest) - len(ks))) - 1, len(ks))])[F.col("_g").cast("int")]
    return grouped.withColumn("_level", level).drop("_g")


def metrics(rows: DataFrame, levels: list[list[str]], tau: float) -> DataFrame:
    """Threshold and ranking metrics at levels of keys, each beginning with the one before; _level is the number of keys. Rows of a case come together; what follows has a row per case and kind and stays in its task until it is a sum."""
    deepest = max(levels, key=len)
    parts = _case_parts(rows, deepest, tau)
    sums = [F.sum(c).alias(c) for c in ("_rows", "_n0", "_n1", "_s0", "_s1", "_t0", "_t1")]
    # a case counts at a level in the first of its rows there
    whole = F.col("dataset").isNotNull() & F.col("case_id").isNotNull()
    firsts = {f"_case{len(ks)}": F.when(whole & (F.row_number().over(Window.partitionBy(*dict.fromkeys([*ks, "dataset", "case_id"])).orderBy(*[F.col(k) for k in deepest])) == 1), 1) for ks in levels}
    by = _grouped(parts.withColumns(firsts), levels, *[F.count(c).alias(c) for c in firsts], *sums)
    by = by.withColumn("num_cases", F.coalesce(*[F.when(F.col("_level") == len(ks), F.col(f"_case{len(ks)}")) for ks in levels])).drop(*firsts)
    # a case is ranked within the keys of its level, but dataset and case tell cases apart already
    plain = [ks for ks in levels if set(ks) <= {deepest[0], "dataset"}]
    deep = [ks for ks in levels if ks not in plain]
    margins = [_margins(parts, [*ks], [ks]) for ks in deep]
    if plain:
        margins.append(_margins(parts, max(plain, key=len), plain))
    all_margins = margins[0]
    for m in margins[1:]:
        all_margins = all_margins.unionByName(m, allowMissingColumns=True)
    on = F.col("_level") == F.col("m_level")
    for k in deepest:
        on &= F.col(k).eqNullSafe(F.col(f"m_{k}"))
    renamed = all_margins.select(F.col("_level").alias("m_level"), *[F.col(k).alias(f"m_{k}") for k in deepest], "ranking_acc", "mean_margin")
    out = by.join(renamed, on, "left").drop("m_level", *[f"m_{k}" for k in deepest])
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    out = out.withColumns({"num_pairs": F.col("_rows"), "tpr_at_tau": ratio("_t1", "_n1"), "fpr_at_tau": ratio("_t0", "_n0"), "mean_positive_score": ratio("_s1", "_n1"), "mean_negative_score": ratio("_s0", "_n0")})
    tpr, fpr = F.col("tpr_at_tau"), F.col("fpr_at_tau")
    out = out.withColumn("threshold_balanced_acc", 0.5 * tpr + 0.5 * (1.0 - fpr)).drop("_rows", "_n0", "_n1", "_s0", "_s1", "_t0", "_t1")
    mode = F.when(F.col("ranking_acc").isNotNull(), "ranking").when(tpr.isNotNull() & fpr.isNotNull(), "mixed").when(fpr.isNotNull(), "separation").when(tpr.isNotNull(), "positive_only").otherwise("")
    return out.withColumns({"mode": mode, "component": F.coalesce("threshold_balanced_acc", 1.0 - fpr, tpr)})


def tau_table(rows: DataFrame, taus: list[float]) -> DataFrame:
    """For each tau the unweighted means over datasets of tpr, fpr and balanced accuracy. One pass for all taus."""
    wide = rows.groupBy("dataset").agg(*[rate(k, t).alias(f"{name}_{n}") for n, t in enumerate(taus) for k, name in ((1, "tpr"), (0, "fpr"))])
    points = F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"tpr_{n}").alias("tpr"), F.col(f"fpr_{n}").alias("fpr")) for n, t in enumerate(taus)])
    long = wide.select("dataset", F.explode(points).alias("p")).select("dataset", "p.*").withColumn("balanced", 0.5 * F.col("tpr") + 0.5 * (1.0 - F.col("fpr")))
    return long.groupBy("tau").agg(F.avg("tpr").alias("tpr"), F.avg("fpr").alias("fpr"), F.avg("balanced").alias("balanced"))


def choose_tau(table: DataFrame, metric: str = "fpr_at_fixed_tpr", target_tpr: float = 0.96, fixed_tau: float | None = None) -> DataFrame:
    """The row of tau_table that is best, the smallest tau among equals, with selection_score. With metric fixed_tau, the row of that tau, which the table must have; its score is its fpr."""
    if metric == "fixed_tau":
        return table.where(F.abs(F.col("tau") - F.lit(fixed_tau)) < 1e-12).withColumn("selection_score", F.col("fpr"))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    tpr, fpr, balanced = F.coalesce("tpr", low), F.coalesce("fpr", high), F.coalesce("balanced", low)
    met = F.coalesce(F.col("tpr") >= target_tpr, F.lit(False))
    if metric == "fpr_at_fixed_tpr":
        keys = [met.cast("double"), F.when(met, -fpr).otherwise(tpr), F.when(met, tpr).otherwise(-fpr)]
        score = F.when(met, 1.0 - F.col("fpr")).otherwise(F.col("tpr"))
    elif metric == "balanced_threshold":
        keys, score = [balanced, -fpr, tpr], F.col("balanced")
    else:
        raise ValueError(f"unknown metric: {metric}")
    best = table.withColumn("selection_score", score).orderBy(*[k.desc() for k in keys], "tau").limit(1)
    return best


def report(rows: DataFrame, tau: float) -> DataFrame:
    """Metrics of each split: overall (component is the mean of its datasets'), by dataset and by subcategory."""
    out = metrics(B.together(rows, "dataset", "case_id"), [["split"], ["split", "dataset"], ["split", "dataset", "subcategory"]], tau)
    names = F.create_map(F.lit(1), F.lit("overall"), F.lit(2), F.lit("dataset"), F.lit(3), F.lit("subcategory"))
    mean = F.avg(F.when(F.col("_level") == 2, F.col("component"))).over(Window.partitionBy("split"))  # a row per subcategory at most
    return out.withColumns({"table": names[F.col("_level")], "component": F.when(F.col("_level") == 1, mean).otherwise(F.col("component"))}).drop("_level")


def by_negative_type(rows: DataFrame, tau: float) -> DataFrame:
    """Metrics by split, dataset and negative type; a case's positives count for each type that the case has."""
    own = F.when(F.col("pair_type") == "negative", F.coalesce(F.nullif("negative_type", F.lit("")), F.lit("__all__")))
    kinds = F.collect_set(own).over(Window.partitionBy("dataset", "case_id"))
    named = (F.col("pair_type") == "positive") & F.col("dataset").isNotNull() & F.col("case_id").isNotNull()
    rows = B.together(rows, "dataset", "case_id").withColumns({"_own": own, "_kinds": kinds})
    rows = rows.withColumn("kind", F.explode(F.when(F.col("_own").isNotNull(), F.array("_own")).when(named, F.col("_kinds")))).drop("_own", "_kinds")
    return metrics(rows, [["split", "dataset", "kind"]], tau).drop("_level")


def scored(rows: DataFrame, weights: list[float], bias: float) -> DataFrame:
    return rows.withColumn("calibrated_score", M.logistic_score(F.col("features"), tuple(weights), bias))
