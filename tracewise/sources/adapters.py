"""The driver's tables as the library's records: projections alone, so scans stay pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.functions import rewards as M

SCORERS = ("sbert", "nli", "bertscore", "cross_nli", "bge_reranker")
FIELDS = ("raw_score", "nli_heuristic", "bertscore_f1", "raw_score", "sigmoid_raw_score")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as scored pairs. `line` orders rows; it is the same for rows that are the same."""
    d, t = F.col("l_discount") * 10, F.col("l_tax") * 10
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_partkey").alias("trace_id"),
        F.col("l_returnflag").alias("dataset"),
        F.col("l_linestatus").alias("subcategory"),
        _at(SCORERS, F.col("l_linenumber") % 5).alias("scorer"),
        _at(FIELDS, F.col("l_linenumber") % 5).alias("score_field"),
        F.when(F.col("l_quantity") % 2 == 1, "positive_pair").otherwise("negative_pair").alias("pair_type"),
        F.when(F.col("l_quantity") % 2 == 0, _at(("value_flip", "entity_flip", "relation_flip"), F.col("l_suppkey") % 3)).alias("negative_type"),
        F.when(F.col("l_orderkey") % 2 == 0, "ranking").otherwise("separation").alias("mode"),
        d.alias("raw_score"),
        d.alias("E_ab"), t.alias("E_ba"), (0.8 - t).alias("C_ab"), ((1.0 - d) / 2).alias("C_ba"), (t / 2).alias("N_ab"), (d / 4).alias("N_ba"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1000000 + F.col("l_partkey") * 50 + F.col("l_quantity").cast("long")).alias("line"),
    )
    heuristic = M.nli_heuristic(*[F.col(c) for c in ("E_ab", "E_ba", "C_ab", "C_ba")])
    return rows.withColumn("value", M.reward_value(F.col("scorer"), F.col("score_field"), F.col("raw_score"), heuristic))


#: Weights of a stored calibration by feature.
NLI_WEIGHTS = {"E_ab": 1.5, "E_ba": 0.75, "C_max": -1.25, "N_max": -0.5}


def caption_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows as caption scores have them: a column for each score field, null where the scorer has none; some lack a value or have an odd pair type."""
    rows = score_rows(spark, sf_dir).drop("value")
    nli, bert = F.col("scorer") == "nli", F.col("scorer") == "bertscore"
    own = {"raw_score": ~nli & ~bert, "E_ab": nli, "E_ba": nli & (F.col("trace_id") % 50 != 0), "C_ab": nli, "C_ba": nli, "N_ab": nli, "N_ba": nli}
    d, t = F.col("raw_score"), F.col("E_ba")
    made = {"bertscore_precision": F.when(bert, d), "bertscore_recall": F.when(bert, t), "bertscore_f1": F.when(bert, (d + t) / 2), "nli_score_coverage": F.when(nli, d * 0.5), "nli_score_equiv": F.when(nli, t * 0.5), "pair_type": F.when(F.col("trace_id") % 31 == 0, "odd").otherwise(F.col("pair_type")), "file": F.lit("caption")}
    return rows.withColumns(made).withColumns({c: F.when(w, F.col(c)) for c, w in own.items()})


def numeric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows as numeric scores have them: long, with the NLI values nested, and every seventh trace twice."""
    rows = score_rows(spark, sf_dir).drop("value", "raw_score")
    values = F.when(F.col("scorer") == "nli", F.struct(*[F.col(c) for c in ("E_ab", "E_ba", "C_ab", "C_ba", "N_ab", "N_ba")]))
    rows = rows.select("case_id", "trace_id", F.when(F.col("trace_id") % 2 == 0, F.col("dataset")).alias("dataset"), "subcategory", "scorer", F.when(F.col("scorer") != "bge_reranker", F.col("score_field")).alias("score_field"), "pair_type", "negative_type", "mode", (F.col("E_ab") * 0.5 + F.col("E_ba") * 0.25).alias("score"), values.alias("all_raw_values"), "line", F.lit("numeric").alias("file"))
    return rows.withColumn("_twice", F.explode(F.when(F.col("trace_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_twice")


def calibration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NLI score rows with label and features."""
    rows = score_rows(spark, sf_dir).withColumn("pair_type", M.pair_type(F.col("pair_type")))
    features = M.nli_features(*[F.col(c) for c in ("E_ab", "E_ba", "C_ab", "C_ba", "N_ab", "N_ba")])
    return rows.withColumns({"label": (F.col("pair_type") == "positive").cast("int"), "features": features, "row_id": F.col("line")})


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of traces: source_sample_id, step_index, step, label."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = (F.get_json_object("props", "$.k").cast("int") % 3 - 1).alias("label")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source_sample_id"), (F.row_number().over(w) - 1).alias("step_index"), F.concat_ws(" ", "event_type", F.col("value").cast("decimal(12,2)").cast("string")).alias("step"), label)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trace with parallel arrays steps and step_labels. A trace is one source sample, of bounded length."""
    rows = steps(spark, sf_dir).groupBy("source_sample_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "step", "label"))).alias("s"))
    return rows.select("source_sample_id", F.concat(F.lit("Question of "), F.col("source_sample_id")).alias("question"), F.transform("s", lambda x: x["step"]).alias("steps"), F.transform("s", lambda x: x["label"]).alias("step_labels"))


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as judged steps."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pair_id"),
        F.col("event_type").alias("data_source"),
        F.concat(F.lit("model_"), (F.col("user_id") % 4).cast("string")).alias("policy_model"),
        (F.col("value") / 500).alias("p_positive"),
        (F.get_json_object("props", "$.k").cast("int") % 3 - 1).alias("compatibility_label"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as solutions with their truth."""
    price, size, k = F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 4
    solution = F.when(k == 0, F.concat(F.lit("so <answer> "), price, F.lit(" </answer>"))).when(k == 1, F.concat(F.lit("a #### 1 #### "), size)).when(k == 2, F.concat(F.lit("It is "), F.col("p_name"))).otherwise(F.lit(" "))
    truth = F.when(k == 0, F.when(F.col("p_partkey") % 8 == 0, price).otherwise((F.col("p_retailprice") * 1.01).cast("decimal(12,2)").cast("string"))).when(k == 1, F.concat(size, F.lit(".0"))).otherwise(F.concat(F.lit("IT is: "), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", solution.alias("solution"), truth.alias("truth"))


def symbolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows as short reasoning texts with numbers, letters and relations."""
    k = F.col("o_orderkey") % 4
    ops = _at(("=", "<=", ">", "+"), k)
    text = F.concat(F.lit("Given. Let x "), ops, F.lit(" "), F.col("o_custkey").cast("string"), F.lit(". So the total is "), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("; done\n- Step 2\nTherefore\n"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace_id"), text.alias("reasoning"))
