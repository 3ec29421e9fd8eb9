"""From score files to reward rows and threshold tables: which field is the score, its value, and the union of sources.

Scores are DataFrames with scorer, dataset, subcategory, case_id, mode and pair_type, and score columns: caption
scores have a column per score field, numeric scores are long (score_field, score) with the NLI values in
`all_raw_values`. Columns that a file lacks count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions import rewards as M
from tracewise.operators.aggregate import TAUS, deduped_first, reward_grouping_sets, reward_means, tau_sensitivity

#: Score fields of each scorer, for rewards and for thresholds; other scorers have raw_score.
NLI_VALUES = ("E_ab", "E_ba", "C_ab", "C_ba", "N_ab", "N_ba")
BERTSCORE_FIELDS = ("bertscore_precision", "bertscore_recall", "bertscore_f1")
REWARD_FIELDS = {"nli": ("nli_heuristic",), "bertscore": BERTSCORE_FIELDS, "bge_reranker": ("sigmoid_raw_score",)}
TAU_FIELDS = {"nli": ("nli_score_coverage", "nli_score_equiv", "E_ab", "E_ba", "C_ab", "C_ba"), "bertscore": BERTSCORE_FIELDS, "bge_reranker": ("sigmoid_raw_score",)}
CAPTION, NUMERIC, NUMERIC_DATASET = "caption_negation", "visualprm_numeric", "visualprm"
CALIBRATED = ("nli_calibrated_logistic", "calibrated_score")
REWARD_ROW = ("dataset", "subcategory", "source", "scorer", "score_field", "pair_type", "reward")


def column(rows: DataFrame, name: str, type_: str = "string") -> Column:
    """A column, or null where rows lacks it."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(type_)


def raw_value(rows: DataFrame, name: str, nested_first: bool = True) -> Column:
    """An NLI value: from all_raw_values where that is not null, else from the row. Without nested_first, the row's own value comes first."""
    own = M.num(column(rows, name, "double"))
    if "all_raw_values" not in rows.columns:
        return own
    inner = M.num(F.col("all_raw_values").getField(name)) if name in rows.schema["all_raw_values"].dataType.fieldNames() else F.lit(None).cast("double")
    return F.when(F.col("all_raw_values").isNull(), own).otherwise(inner) if nested_first else F.coalesce(own, inner)


def routed(rows: DataFrame, fields: dict[str, tuple[str, ...]], default: Column | None = None) -> DataFrame:
    """rows with score_field: one row for each field of the row's scorer. default: the fields of other scorers, an array."""
    pick = default if default is not None else F.array(F.lit("raw_score"))
    for scorer, names in reversed(fields.items()):
        pick = F.when(F.col("scorer") == scorer, F.array(*[F.lit(n) for n in names])).otherwise(pick)
    return rows.withColumn("_fields", pick).drop("score_field").withColumn("score_field", F.explode("_fields")).drop("_fields")


def field_value(rows: DataFrame, names: tuple[str, ...], sigmoid_of: str = "raw_score") -> Column:
    """The value of the column that score_field names; sigmoid_raw_score is the sigmoid of a raw score."""
    out = F.when(F.col("score_field") == "sigmoid_raw_score", F.when(F.col("scorer") == "bge_reranker", M.sigmoid(M.num(column(rows, sigmoid_of, "double")))).otherwise(M.num(column(rows, "sigmoid_raw_score", "double"))))
    for n in names:
        out = out.when(F.col("score_field") == n, M.num(column(rows, n, "double")))
    return out


def _heuristic(rows: DataFrame) -> Column:
    return M.nli_heuristic(*[raw_value(rows, n) for n in NLI_VALUES[:4]])


def calibrated_value(rows: DataFrame, weights: dict[str, float], bias: float) -> Column:
    """The logistic score of a row's NLI values; null if one is missing."""
    return M.logistic_score(M.nli_features(*[raw_value(rows, n) for n in NLI_VALUES]), tuple(weights[n] for n in ("E_ab", "E_ba", "C_max", "N_max")), bias)


def _rewards(rows: DataFrame, source: Column | str, value: Column, kappa: float, dataset: Column | None = None, calibrated: Column | None = None) -> DataFrame:
    """rows as reward rows by value, and by calibrated where that is not null. Values are elements of an array, so the filter and the scaling name them and do not work them out again."""
    kind = M.pair_type(column(rows, "pair_type"))
    scored = [F.struct("scorer", "score_field", value.alias("value"))]
    if calibrated is not None:
        scored.append(F.struct(F.lit(CALIBRATED[0]).alias("scorer"), F.lit(CALIBRATED[1]).alias("score_field"), calibrated.alias("value")))
    made = rows.select(
        F.coalesce(dataset if dataset is not None else column(rows, "dataset"), F.lit("")).alias("dataset"), F.coalesce(column(rows, "subcategory"), F.lit("")).alias("subcategory"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"), kind.alias("pair_type"), F.explode(F.array(*scored)).alias("_s"),
    )
    known = made.where(F.col("pair_type").isin("positive", "negative") & F.col("_s.value").isNotNull())
    return known.select("dataset", "subcategory", "source", "_s.scorer", "_s.score_field", "pair_type", M.scale_reward(F.col("_s.value"), kappa).alias("reward"))


def _weighted(rows: DataFrame, weights: dict[str, float] | None, bias: float) -> Column | None:
    """The calibrated value of NLI rows, null for others; None without weights."""
    return None if weights is None else F.when(F.col("scorer") == "nli", calibrated_value(rows, weights, bias))


def collect_caption(scores: DataFrame, kappa: float = 0.0, weights: dict[str, float] | None = None, bias: float = 0.0) -> DataFrame:
    """Caption scores as reward rows, one for each score field of the scorer; with weights, those of collect_caption_calibrated too, in the same pass."""
    rows = routed(scores, REWARD_FIELDS)
    value = F.when((F.col("scorer") == "nli") & (F.col("score_field") == "nli_heuristic"), _heuristic(rows)).otherwise(field_value(rows, ("raw_score", *BERTSCORE_FIELDS)))
    return _rewards(rows, CAPTION, value, kappa, calibrated=_weighted(rows, weights, bias))


def _numeric_deduped(rows: DataFrame, by_values: Column, order: tuple[str, ...]) -> DataFrame:
    """The first row of each case, pair and score: for NLI its four values count, else the score."""
    values = {f"_v{k}": F.when(by_values, raw_value(rows, n)).otherwise(M.num(F.col("score")) if k == 0 else F.lit(None).cast("double")) for k, n in enumerate(NLI_VALUES[:4])}
    keyed = rows.withColumns(values)
    keys = [c for c in ("case_id", "trace_id", "negative_type", "pair_type", "scorer", "score_field") if c in rows.columns]
    return deduped_first(keyed, [*keys, *values], [c for c in order if c in rows.columns]).drop(*values)


def collect_numeric(scores: DataFrame, kappa: float = 0.0, order: tuple[str, ...] = ("file", "line"), weights: dict[str, float] | None = None, bias: float = 0.0) -> DataFrame:
    """Numeric scores as reward rows; of repeated rows the first in order counts. With weights, those of collect_numeric_calibrated too, from the same rows: an NLI row has one score field, so both drop the same repeats."""
    rows = scores.withColumn("_field", F.col("score_field"))
    named = F.when(F.coalesce(F.col("_field"), F.lit("")) != "", F.array("_field"))
    fallback = F.when(F.col("scorer") == "bertscore", F.array(*[F.lit(n) for n in BERTSCORE_FIELDS])).otherwise(F.array(F.lit("raw_score")))
    rows = routed(rows, {"nli": ("nli_heuristic",), "bge_reranker": ("sigmoid_raw_score",)}, F.coalesce(named, fallback))
    rows = _numeric_deduped(rows, F.col("score_field") == "nli_heuristic", order)
    score = M.num(F.col("score"))
    value = F.when((F.col("scorer") == "nli") & (F.col("score_field") == "nli_heuristic"), _heuristic(rows)).when((F.col("scorer") == "bge_reranker") & (F.col("score_field") == "sigmoid_raw_score"), M.sigmoid(score)).when(F.col("_field") == F.col("score_field"), score)
    return _rewards(rows, NUMERIC, value, kappa, F.coalesce(column(rows, "dataset"), F.lit(NUMERIC_DATASET)), _weighted(rows, weights, bias))


def _calibrated_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"scorer": F.lit(CALIBRATED[0]), "score_field": F.lit(CALIBRATED[1])})


def collect_calibrated(predictions: DataFrame, kappa: float = 0.0) -> DataFrame:
    """Calibration predictions as reward rows; their path tells the source."""
    source = F.when(F.contains(F.coalesce("source_path", F.lit("")), F.lit(NUMERIC)), NUMERIC).otherwise(CAPTION)
    return _rewards(_calibrated_columns(predictions), source, M.num(F.col("calibrated_score")), kappa)


def collect_caption_calibrated(scores: DataFrame, weights: dict[str, float], bias: float, kappa: float = 0.0) -> DataFrame:
    """NLI rows of caption scores, scored by stored weights."""
    rows = scores.where("scorer = 'nli'")
    return _rewards(_calibrated_columns(rows), CAPTION, calibrated_value(rows, weights, bias), kappa)


def collect_numeric_calibrated(scores: DataFrame, weights: dict[str, float], bias: float, kappa: float = 0.0, order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """NLI rows of numeric scores, scored by stored weights; of repeated rows the first in order counts."""
    rows = _numeric_deduped(scores.where("scorer = 'nli'").withColumn("score_field", F.lit(CALIBRATED[1])), F.lit(True), order)
    return _rewards(_calibrated_columns(rows), NUMERIC, calibrated_value(rows, weights, bias), kappa, F.coalesce(column(rows, "dataset"), F.lit(NUMERIC_DATASET)))


def collected(caption: DataFrame, numeric: DataFrame, predictions: DataFrame | None = None, weights: dict[str, float] | None = None, bias: float = 0.0, kappa: float = 0.0) -> DataFrame:
    """Reward rows of all sources: calibrated ones from predictions if there are any, else by weights if given."""
    predicted = predictions is not None and not predictions.isEmpty()
    own = None if predicted else weights
    out = collect_caption(caption, kappa, own, bias).unionByName(collect_numeric(numeric, kappa, weights=own, bias=bias))
    return out.unionByName(collect_calibrated(predictions, kappa)) if predicted else out


def reward_tables(rewards: DataFrame) -> dict[str, DataFrame]:
    """The reward tables by their names, each sorted by its keys."""
    keys = {"reward_by_dataset": ["source", "dataset", "scorer", "score_field"], "reward_by_subcategory": ["source", "dataset", "subcategory", "scorer", "score_field"], "reward_by_scorer": ["scorer", "score_field"]}
    return {name: reward_means(rewards, k).orderBy(*k) for name, k in keys.items()}


def reward_levels(rewards: DataFrame) -> DataFrame:
    """The same tables as one, in one pass; `level` numbers them."""
    return reward_grouping_sets(rewards, [["source", "dataset", "scorer", "score_field"], ["source", "dataset", "subcategory", "scorer", "score_field"], ["scorer", "score_field"]])


def sensitivity_scores(caption: DataFrame, numeric: DataFrame, predictions: DataFrame | None = None, order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """Scores of all sources as rows for tau_sensitivity: (scorer, score_field, family, mode, pair_type, case_id, value, line).

    NLI has six fields and BERTScore three. Families: hn for ranking captions, neg for others, num for numeric rows.
    """
    rows = routed(caption, TAU_FIELDS)
    parts = [(rows, F.when(F.col("mode") == "ranking", "hn").otherwise("neg"), field_value(rows, ("raw_score", *BERTSCORE_FIELDS, *TAU_FIELDS["nli"])))]
    named = F.when(F.col("scorer") == "bge_reranker", "sigmoid_raw_score").otherwise(F.coalesce(F.nullif("score_field", F.lit("")), F.lit("score")))
    rows = numeric.withColumns({"score_field": named, "pair_type": M.pair_type(F.col("pair_type"))})
    rows = deduped_first(rows, ["case_id", "negative_type", "pair_type", "scorer", "score_field", "score"], [c for c in order if c in rows.columns])
    score = M.num(F.col("score"))
    parts.append((rows, F.lit("num"), F.when(F.col("score_field") == "sigmoid_raw_score", M.sigmoid(score)).otherwise(score)))
    if predictions is not None:
        rows = _calibrated_columns(predictions)
        family = F.when(F.contains(F.coalesce("source_path", F.lit("")), F.lit(NUMERIC)), "num").when(F.col("mode") == "ranking", "hn").otherwise("neg")
        parts.append((rows, family, M.num(F.col("calibrated_score"))))
    made = [r.select("scorer", "score_field", f.alias("family"), F.coalesce(column(r, "mode"), F.lit("")).alias("mode"), M.pair_type(F.col("pair_type")).alias("pair_type"), "case_id", v.alias("value"), column(r, "line", "long").alias("line")) for r, f, v in parts]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.where("value IS NOT NULL")


def sensitivity_table(scores: DataFrame, selected_tau: float | None = None, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """tau_sensitivity with the operating threshold of the calibrated scorer."""
    chosen = F.when(F.col("scorer") == CALIBRATED[0], F.lit(selected_tau).cast("double"))
    return tau_sensitivity(scores, taus).withColumn("selected_operating_tau", chosen)


def calibration_rows(scores: DataFrame, order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """NLI rows of score files (file, line, ...) as calibration rows with row_id, and error; of repeated good rows the first counts. Other scorers are left out."""
    rows = scores.where("scorer = 'nli'")
    text = lambda n: F.trim(F.coalesce(column(rows, n).cast("string"), F.lit("")))
    values = {n: M.finite(raw_value(rows, n, nested_first=False)) for n in NLI_VALUES}
    missing = F.array_join(F.filter(F.array(*[F.when(v.isNull(), F.lit(n)) for n, v in values.items()]), lambda x: x.isNotNull()), ",")
    kind = M.pair_type(text("pair_type"))
    label = F.when(kind == "positive", 1).when(kind == "negative", 0)
    error = F.when(label.isNull(), F.lit("Unsupported pair_type")).when(missing != "", F.concat(F.lit("Missing NLI fields: "), missing)).when((text("dataset") == "") | (text("case_id") == ""), F.lit("Missing dataset or case_id"))
    keys = [c for c in ("file", "dataset", "case_id", "mode", "pair_type", "negative_type", "negative_index", "text_a", "text_b") if c in rows.columns]
    rows = rows.withColumns({f"_x{k}": raw_value(rows, n, nested_first=False) for k, n in enumerate(NLI_VALUES)} | {"error": error, "_bad": F.when(error.isNotNull(), F.struct(*[F.col(c) for c in order]))})
    rows = deduped_first(rows, [*keys, *[f"_x{k}" for k in range(6)], "_bad"], list(order))
    return rows.select(
        *order, text("case_id").alias("case_id"), text("dataset").alias("dataset"), F.coalesce(F.nullif(text("subcategory"), F.lit("")), F.lit("unknown")).alias("subcategory"), F.coalesce(column(rows, "negative_type"), F.lit("")).alias("negative_type"),
        kind.alias("pair_type"), label.alias("label"), F.coalesce(F.nullif(text("mode"), F.lit("")), F.when(label == 1, "ranking").otherwise("separation")).alias("mode"), M.nli_features(*values.values()).alias("features"), column(rows, "negative_index", "int").alias("negative_index"), column(rows, "trace_id").alias("trace_id"), "error",
    )


def prediction_rows(rows: DataFrame, tau: float) -> DataFrame:
    """Scored calibration rows with their features apart, tau and whether they pass."""
    features = {n: F.col("features")[k] for k, n in enumerate(("E_ab", "E_ba", "C_max", "N_max"))}
    return rows.withColumns(features | {"tau": F.lit(tau), "predicted_compatible": F.col("calibrated_score") >= tau}).drop("features")
