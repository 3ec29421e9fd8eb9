"""Registered queries: each applies one family of operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions import embedded
from tracewise.functions import rewards as M
from tracewise.functions import text as X
from tracewise.operators import aggregate as A
from tracewise.operators import calibrate as C
from tracewise.operators import collect as L
from tracewise.operators import evaluate as E
from tracewise.operators import generation as G
from tracewise.operators import normalise as N
from tracewise.operators import pairs as P
from tracewise.operators import sampling as B
from tracewise.operators import scorers as V
from tracewise.sources import adapters as D
from tracewise.sources import loaders
from tracewise.streaming import state as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Weights of a fitted calibration, as a report would store them.
WEIGHTS, BIAS, TAU = (1.5, 0.75, -1.25, -0.5), 0.1, 0.5


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    from tracewise.plans import stored  # noqa: F401  registers its queries

    return dict(_QUERIES)


def r6(*names: str) -> list[Column]:
    """Columns rounded to 6 places, as sums depend on their order beyond."""
    return [F.round(n, 6).alias(n) for n in names]


_MEANS = ("mean_pos", "mean_neg", "margin")


@query
def reward_by_dataset(spark, d):
    rows = A.reward_means(A.reward_rows(D.score_rows(spark, d), 0.1), ["dataset", "scorer", "score_field"])
    return rows.select("dataset", "scorer", "score_field", "n_pos", "n_neg", *r6(*_MEANS))


@query
def reward_grouping_sets(spark, d):
    rows = A.reward_grouping_sets(A.reward_rows(D.score_rows(spark, d)), [["dataset", "scorer"], ["dataset", "subcategory", "scorer"], ["scorer"]])
    return rows.select("level", "dataset", "subcategory", "scorer", "n_pos", "n_neg", *r6(*_MEANS))


@query
def reward_by_perturbation(spark, d):
    rows = A.reward_rows(D.score_rows(spark, d)).withColumn("negative_type", F.coalesce("negative_type", F.lit("")))
    return A.reward_means(rows, ["negative_type", "scorer"]).select("negative_type", "scorer", "n_pos", "n_neg", *r6(*_MEANS))


@query
def nli_scores(spark, d):
    parts = [F.col(c) for c in ("E_ab", "E_ba", "C_ab", "C_ba")]
    made = {"heuristic": M.nli_heuristic(*parts), "coverage": M.nli_coverage(*parts), "equiv": M.nli_equiv(*parts)}
    rows = D.score_rows(spark, d).where("scorer = 'nli'").withColumns(made)
    return rows.groupBy("dataset", "subcategory").agg(*[F.round(F.avg(c), 6).alias(c) for c in made], F.count("*").alias("n"))


@query
def score_unpivot(spark, d):
    rows = P.unpivoted(D.score_rows(spark, d).select("scorer", "raw_score", "E_ba", F.when(F.col("scorer") == "nli", F.col("C_ab")).alias("C_ab")), ["raw_score", "E_ba", "C_ab"], ["scorer"])
    return rows.groupBy("scorer", "score_field").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query
def dedupe_first(spark, d):
    rows = A.deduped_first(D.score_rows(spark, d), ["case_id", "scorer", "negative_type", "pair_type"], ["line", "value"])
    return rows.groupBy("scorer", "negative_type").agg(F.count("*").alias("n"), F.sum(F.col("line") % 1000003).alias("lines"))


def _families(spark, d):
    rows = D.score_rows(spark, d).withColumn("pair_type", M.pair_type(F.col("pair_type")))
    return rows.withColumn("family", F.when(F.col("trace_id") % 3 == 0, "num").when(F.col("mode") == "ranking", "hn").otherwise("neg"))


@query
def tau_sensitivity(spark, d):
    rows = A.tau_sensitivity(_families(spark, d))
    return rows.select("scorer", "score_field", "tau", *r6("hn_fpr", "neg_fpr", "num_fpr", "ranking_acc", "hn_ranking_acc", "num_ranking_acc"))


@query
def ranking_accuracy(spark, d):
    margins = A.ranking_margins(_families(spark, d), ["dataset", "scorer", "case_id"], "line", first=True)
    return A.ranking_accuracy(margins, ["dataset", "scorer"]).select("dataset", "scorer", "n_cases", *r6("ranking_acc"))


@query
def fpr_by_family(spark, d):
    negative = _families(spark, d).where("pair_type = 'negative'")
    return negative.groupBy("family", "scorer").agg(F.count("*").alias("n"), F.round(F.avg(A.passes(F.col("value"), F.lit(TAU))), 6).alias("fpr"))


@query
def case_mode(spark, d):
    rows = C.with_case_modes(D.calibration_rows(spark, d).drop("mode"))
    return rows.groupBy("dataset", "mode", "pair_type").agg(F.count("*").alias("n"))


@query
def sample_weights(spark, d):
    rows = C.with_sample_weights(D.calibration_rows(spark, d))
    return rows.groupBy("dataset", "label").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query
def case_counts_pivot(spark, d):
    return A.negative_type_counts(D.score_rows(spark, d), ["subcategory", "dataset"], ["value_flip", "entity_flip", "relation_flip"])


def _cases(spark, d):
    mode = F.when(F.col("p_partkey") % 3 == 0, "ranking").when(F.col("p_partkey") % 3 == 1, "separation").otherwise("other")
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("dataset"), mode.alias("mode"), F.col("p_name").alias("anchor"), F.col("p_type").alias("positive"), F.array("p_brand", F.concat("p_name", F.lit(" not"))).alias("negatives"))


@query
def case_counts(spark, d):
    return A.case_counts(_cases(spark, d), ["dataset", "mode"])


@query
def pair_explode(spark, d):
    return P.pair_rows(_cases(spark, d))


@query
def preview_first5(spark, d):
    rows = A.preview(D.table(spark, d, "events"), ["event_type"], ["ts", "event_id"])
    return rows.select("event_type", "event_id", "rank")


@query
def segments(spark, d):
    rows = D.table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")  # a file may have few row groups, and texts ask for much work
    rows = rows.select("doc_id", X.segments(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_segments"), F.md5(F.array_join("s", "|")).alias("digest"))


@query
def numeric_segments(spark, d):
    return P.segment_requests(D.symbolic(spark, d))


@query
def segment_flips(spark, d):
    rows = P.segment_requests(D.symbolic(spark, d)).select("case_id", "reference")
    return rows.select("case_id", X.flip_number(F.col("reference")).alias("value_flip"), X.flip_entity(F.col("reference")).alias("entity_flip"), X.flip_relation(F.col("reference")).alias("relation_flip"))


@query
def mock_cases(spark, d):
    rows = P.mock_cases(P.segment_requests(D.symbolic(spark, d)))
    return rows.select("case_id", F.explode("negatives").alias("n")).groupBy("n.type").agg(F.count("*").alias("n"))


@query
def answer_extract(spark, d):
    s = F.col("solution")
    return D.answers(spark, d).select("p_partkey", X.extract_answer(s).alias("answer"), X.normalize_answer(s).alias("normalized"), X.first_number(s).alias("number"))


@query
def answer_rewards(spark, d):
    s, t = F.col("solution"), F.col("truth")
    return D.answers(spark, d).select("p_partkey", M.accuracy_reward(s, t).alias("accuracy"), M.format_reward(s).alias("format"), M.composite_reward(s, t).alias("reward"))


@query
def last_assistant(spark, d):
    return P.supervised(D.table(spark, d, "conversations"))


@query
def training_rows(spark, d):
    """Conversations as training rows: every third names an image in its prompt and beside it, and every second ends in a tagged answer; both stay as they are."""
    k = F.col("conv_id")
    rows = P.supervised(D.table(spark, d, "conversations"))
    rows = rows.withColumns({"prompt": F.when(k % 3 == 0, F.concat(F.lit("<image> "), "prompt")).otherwise(F.col("prompt")), "response": F.when(k % 2 == 0, F.concat("response", F.lit(" <answer>4</answer> #### 4"))).otherwise(F.col("response"))})
    rows = P.training_rows(rows.withColumn("images", F.when(k % 3 == 0, F.array(F.concat(k.cast("string"), F.lit(".png"))))), "conversations")
    return rows.select("data_source", "ability", F.col("extra_info.conv_id").alias("conv_id"), F.element_at("prompt", 1)["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"), F.try_element_at("images", F.lit(1))["image"].alias("image"), F.col("extra_info.num_images").cast("long").alias("num_images"), F.col("extra_info.image_policy").alias("image_policy"))


@query
def turn_pairs(spark, d):
    return P.turn_pairs(D.table(spark, d, "conversations"))


@query
def conversation_steps(spark, d):
    """Traces written as labelled conversations, and parsed back."""
    tokens = F.create_map(F.lit(1), F.lit("+"), F.lit(-1), F.lit("-"), F.lit(0), F.lit("neutral"))
    said = lambda role, text: F.struct(F.lit(role).alias("from"), text.alias("value"))
    first = F.concat(F.lit("### Question: "), F.col("question"), F.lit(" ### Solution Process: "))
    turns = F.flatten(F.transform(F.arrays_zip("steps", "step_labels"), lambda s, i: F.array(said("human", F.concat(F.when(i == 0, first).otherwise(F.lit("")), s["steps"])), said("gpt", tokens[s["step_labels"]]))))
    rows = P.parsed_conversations(D.traces(spark, d).select("source_sample_id", turns.alias("conversations")))
    return rows.select("source_sample_id", "question", F.size("steps").cast("long").alias("n_steps"), F.md5(F.array_join("steps", "|")).alias("digest"), F.aggregate("step_labels", F.lit(0), lambda a, x: a + x).cast("long").alias("label_sum"), "error")


@query
def request_ids(spark, d):
    rows = P.generation_requests(D.traces(spark, d))
    return rows.withColumn("context_steps", F.array_join("context_steps", "|")).withColumn("step_index", F.col("step_index").cast("long"))


@query
def context_examples(spark, d):
    rows = P.context_examples(D.traces(spark, d))
    return rows.select("source_sample_id", F.col("step_index").cast("long").alias("step_index"), F.md5("anchor").alias("anchor"), "generated", "compatibility_label")


def _log(rows, pair_id):
    """Events as results of earlier runs, some failed."""
    number = F.get_json_object("props", "$.k").cast("int")
    failed = number % 5 == 0
    error = F.when(number % 2 == 0, '{"error_type":"PromptTooLong"}').otherwise('{"error_type":"Other"}')
    payload = F.to_json(F.struct("event_id", (number % 2).alias("compatibility_label")))
    log = rows.select(pair_id.alias("pair_id"), F.when(~failed, payload).alias("pair_json"), F.lit(None).cast("string").alias("raw_json"), F.when(failed, error).alias("error_json"), F.col("ts").alias("updated_at"))
    return S.recorded(log)


def state_log(spark, d):
    """All events, the later ones of a user and kind replacing the earlier."""
    return _log(D.table(spark, d, "events"), F.concat(F.lit("pair_"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_type")))


@query
def state_latest(spark, d):
    return S.latest(state_log(spark, d)).select("pair_id", "status", "pair_json", "error_json")


@query
def state_counts(spark, d):
    state = S.latest(state_log(spark, d))
    return S.counts(state).crossJoin(S.label_counts(state))  # a row each


@query
def state_errors(spark, d):
    return S.error_types(S.latest(state_log(spark, d)))


@query
def pending_requests(spark, d):
    """Of all events as requests, those that the log of an interrupted run, which had done clicks and views, does not hold."""
    pair_id = F.concat(F.lit("pair_"), F.col("event_id").cast("string"))
    requests = D.table(spark, d, "events").select(pair_id.alias("pair_id"), "event_type")
    return S.pending(requests, _log(D.table(spark, d, "events").where(F.col("event_type").isin("click", "view")), pair_id))


@query
def legacy_import(spark, d):
    """Files of an older run, by user, merged into a log that holds every user of one kind."""
    events = D.table(spark, d, "events")
    user, number = F.concat(F.lit("pair_"), F.col("user_id").cast("string")), F.get_json_object("props", "$.k").cast("int")
    log = S.latest(_log(events.where("event_type = 'signup'"), user))
    part = lambda kind, name: events.where(F.col("event_type") == kind).groupBy(user.alias("pair_id")).agg(F.max(number).cast("string").alias(name))
    merged = S.merge_legacy(log, part("view", "pair_json"), part("error", "error_json"), part("click", "raw_json"), F.lit("2024-01-01").cast("timestamp"))
    return merged.groupBy("status").agg(F.count("*").alias("n"), F.count("raw_json").alias("n_raw"), F.count("error_json").alias("n_errors"))


@query
def group_split(spark, d):
    rows = B.grouped_split(D.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_keys"), F.sum("o_custkey").alias("sum_keys"))


@query
def holdout_split(spark, d):
    rows = B.holdout_split(D.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.05)
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_keys"), F.sum("o_custkey").alias("sum_keys"))


@query
def calib_split(spark, d):
    rows = B.calibration_split(D.score_rows(spark, d).select("dataset", "case_id"))
    return rows.groupBy("dataset", "split").agg(F.count_distinct("case_id").alias("n_cases"), F.count("*").alias("n_rows"))


@query
def capped_sample(spark, d):
    return B.capped(D.table(spark, d, "customer"), ["c_mktsegment"], ["c_custkey"], 50).select("c_mktsegment", "c_custkey")


@query
def balanced_sample(spark, d):
    return B.balanced_sample(D.table(spark, d, "customer"), "c_mktsegment", "c_custkey", 123).select("c_mktsegment", "c_custkey")


@query
def ratio_sample(spark, d):
    return B.ratio_sample(D.table(spark, d, "customer"), "c_custkey", 0.1, 400).select("c_custkey")


@query
def head_split(spark, d):
    rows = B.head_split(D.table(spark, d, "supplier"), ["s_suppkey"], 0.1)
    return rows.select("s_suppkey", "split")


@query
def few_shots(spark, d):
    requests = P.generation_requests(D.traces(spark, d)).select("pair_id", "generation_type", "generation_seed")
    pool = D.table(spark, d, "benchmark").select(F.col("item_id").alias("example_id"), F.when(F.col("item_id") % 2 == 0, "hard_negative").otherwise("positive_paraphrase").alias("generation_type"))
    rows = B.per_request_sample(requests, pool, "generation_type", "pair_id", "example_id", 3)  # a pool of fewer than 3 is an error
    return rows.select("pair_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query
def split_leak_check(spark, d):
    rows = D.table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, "val").otherwise("train").alias("split"))
    return B.leaks(rows, "o_custkey")


def _judged(spark, d):
    return E.predictions(D.evaluation_rows(spark, d))


_SCORES = ("accuracy", "precision", "recall", "f1_positive", "f1_negative", "macro_f1")
_COUNTS = ("tp", "fp", "fn", "tn", "total_steps", "evaluated_steps", "neutral_steps")


@query
def eval_by_dimension(spark, d):
    return E.metrics_by_dimension(_judged(spark, d), ["data_source", "policy_model"]).select("dimension", "value", *_COUNTS, *r6(*_SCORES))


@query
def eval_overall(spark, d):
    return E.overall(_judged(spark, d)).select(*_COUNTS, *r6(*_SCORES, "evaluation_loss", "weighted_macro_f1"))


@query
def eval_auc(spark, d):
    return E.auc(_judged(spark, d), ["data_source"]).select("data_source", *r6("auc"))


@query
def eval_predictions(spark, d):
    rows = E.predictions(D.evaluation_rows(spark, d), 0.25)
    return rows.select("pair_id", F.round("probability_margin", 6).alias("probability_margin"), "predicted_label", "is_neutral", "correct")


def _calibrated(spark, d):
    rows = C.scored(D.calibration_rows(spark, d), list(WEIGHTS), BIAS)
    return rows.withColumn("split", F.when(F.col("case_id") % 5 == 0, "heldout").otherwise("calib"))


@query
def logistic_apply(spark, d):
    return _calibrated(spark, d).groupBy("dataset", "label").agg(F.count("*").alias("n"), F.round(F.avg("calibrated_score"), 6).alias("mean"))


@query
def tau_table(spark, d):
    return C.tau_table(_calibrated(spark, d), C.parse_tau_grid("0.3:0.9:0.05")).select("tau", *r6("tpr", "fpr", "balanced"))


@query
def choose_tau(spark, d):
    table = C.tau_table(_calibrated(spark, d), C.parse_tau_grid("0.3:0.9:0.05"))
    return C.choose_tau(table, target_tpr=0.8).select("tau", *r6("tpr", "fpr", "balanced", "selection_score"))


_METRICS = ("ranking_acc", "tpr_at_tau", "fpr_at_tau", "threshold_balanced_acc", "mean_positive_score", "mean_negative_score", "mean_margin", "component")


@query
def calibration_report(spark, d):
    rows = C.report(_calibrated(spark, d), TAU)
    return rows.select("table", "split", "dataset", "subcategory", "mode", "num_cases", "num_pairs", *r6(*_METRICS))


@query
def calibration_by_type(spark, d):
    rows = C.by_negative_type(_calibrated(spark, d), TAU)
    return rows.select("split", "dataset", "kind", "mode", "num_cases", "num_pairs", *r6(*_METRICS))


@query
def logistic_fit(spark, d):
    rows = C.with_sample_weights(D.calibration_rows(spark, d)).select("label", "features", "weight")
    weights, bias = C.fit_logistic(rows)
    return spark.createDataFrame([(f, round(w, 6)) for f, w in zip(("E_ab", "E_ba", "C_max", "N_max", "bias"), [*weights, bias])], "feature string, weight double")


@query
def cosine_pairs(spark, d):
    a = D.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = D.table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query
def path_resolve(spark, d):
    pages = D.table(spark, d, "pages")
    name = F.regexp_replace("url", "^[a-z]+://", "")
    members = pages.where("page_id % 3 <> 0").select(F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("images/"), name)).otherwise(name).alias("member"))
    return P.resolved_members(pages.select("page_id", "url"), members, ("", "images/"), "page_id", "url").select("page_id", "member")


@query
def label_reconcile(spark, d):
    k = F.col("c_custkey")
    fields = (F.when(k % 2 == 0, "correct").otherwise("incorrect"), F.when(k % 3 == 0, "+").when(k % 3 == 1, F.lit(None)).otherwise("-"), F.when(k % 7 == 0, "maybe"))
    rows = D.table(spark, d, "customer").select("c_custkey", P.reconciled_label(*fields).alias("r"))
    return rows.select("c_custkey", "r.label", "r.conflict")


@query
def text_coercion(spark, d):
    rows = D.table(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.concat(F.lit(" \t"), "p_type", F.lit("\n")).alias("a"), F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise(F.col("p_name")).alias("b"))
    a, b = F.col("a"), F.col("b")
    path = F.concat(F.lit("data/Images/"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat("p_brand", F.lit("\\"))), F.when(F.col("p_partkey") % 5 == 0, F.lit("_ .")).otherwise(F.col("p_name")), F.lit(".jsonl"))
    rows = rows.withColumn("path", path)
    path = F.when(F.startswith(F.col("path"), F.lit("data/")), F.substring("path", 6, 1000))
    return rows.select("p_partkey", X.first_text(b, a).alias("first"), F.array_join(X.collect_texts(F.array(a, b), F.array(b)), "|").alias("texts"), F.array_join(X.ordered_unique(F.array("b", "a"), F.array("a")), "|").alias("unique"), X.clean_label(a).alias("label"), X.clean_label(path).alias("path_label"), X.source_subcategory(path).alias("subcategory"))


@query
def bertscore(spark, d):
    """Token matching over embeddings as token vectors: eight to a text."""
    rows = D.table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 16).alias("pair")).agg(F.array_agg(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e"))).alias("t"))
    side = lambda odd: F.transform(F.filter("t", lambda x: x["vec_id"] % 2 == odd), lambda x: x["e"])
    m = V.token_match(side(0), side(1))
    return rows.select("pair", m.alias("m")).select("pair", F.round("m.precision", 6).alias("precision"), F.round("m.recall", 6).alias("recall"), F.round("m.f1", 6).alias("f1"))


@query
def json_in_text(spark, d):
    rows = D.table(spark, d, "events").select("event_id", F.concat(F.lit("noise {x "), F.col("props"), F.lit(" {\"generated_segment\": \" s"), F.col("event_id").cast("string"), F.lit(" \"} tail")).alias("t"))
    return rows.select("event_id", embedded.first_object("t").alias("object"), embedded.generated_segment("t").alias("segment"))


@query
def lexical_scorer(spark, d):
    pairs = P.pair_rows(_cases(spark, d)).select("case_id", "pair_type", "negative_index", "text_a", "text_b")
    return V.score_pairs(pairs, "lexical").select("case_id", "pair_type", "negative_index", F.round("raw_score", 6).alias("raw_score"), "error")


@query
def reward_levels(spark, d):
    """Caption, numeric and calibrated scores, collected to reward tables at three levels."""
    rewards = L.collected(D.caption_scores(spark, d), D.numeric_scores(spark, d), None, D.NLI_WEIGHTS, BIAS, 0.1)
    rows = L.reward_levels(rewards)
    return rows.select("level", "source", "dataset", "subcategory", "scorer", "score_field", "n_pos", "n_neg", *r6(*_MEANS))


@query
def sensitivity_fields(spark, d):
    """Threshold table over all score fields: NLI's six, BERTScore's three."""
    rows = L.sensitivity_table(L.sensitivity_scores(D.caption_scores(spark, d), D.numeric_scores(spark, d)), TAU)
    return rows.select("scorer", "score_field", "tau", *r6("hn_fpr", "neg_fpr", "num_fpr", "ranking_acc", "hn_ranking_acc", "num_ranking_acc"))


@query
def calibration_load(spark, d):
    """Score rows read as calibration rows: good ones by dataset and mode, bad ones by their error."""
    rows = L.calibration_rows(D.caption_scores(spark, d), ("line", "file"))
    return rows.groupBy("dataset", "subcategory", "mode", "error").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"), F.round(F.sum(F.col("features")[2]), 4).alias("c_max"))


@query
def calibration_predictions(spark, d):
    rows = L.prediction_rows(_calibrated(spark, d), TAU)
    return rows.groupBy("dataset", "label", "predicted_compatible").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("E_ab", "C_max", "N_max")])


@query
def fixed_tau(spark, d):
    table = C.tau_table(_calibrated(spark, d), C.parse_tau_grid("0.3:0.9:0.05"))
    return C.choose_tau(table, "fixed_tau", fixed_tau=0.6).select("tau", *r6("tpr", "fpr", "balanced", "selection_score"))


_CASE_COLUMNS = ("case_id", "dataset", "subcategory", "mode", "anchor", "positive")


def _case_table(cases):
    return cases.select(*_CASE_COLUMNS, F.array_join("negatives", "|").alias("negatives"))


def _captions(spark, d):
    k = F.col("p_partkey")
    return D.table(spark, d, "part").select(k.alias("key"), F.when(k % 4 == 0, F.lit("")).otherwise(k.cast("string")).alias("id"), F.concat(F.lit(" "), "p_name").alias("caption"), F.when(k % 7 == 0, F.lit(" ")).otherwise(F.col("p_type")).alias("caption2"), F.when(k % 5 != 0, F.concat(F.lit("no "), "p_name")).alias("negative_caption"), "p_brand", F.lit("a.jpg").alias("filename"))


@query
def separation_cases(spark, d):
    return _case_table(loaders.separation_cases(_captions(spark, d), "parts", F.col("p_brand"), "key", ["key"], 20))


@query
def ranking_cases(spark, d):
    placed, _ = B.placed_in_order(_captions(spark, d), ["key"])
    return _case_table(loaders.ranking_cases(placed.withColumn("place", F.col("_n") - 1), "parts", "types", "id", "place"))


@query
def choice_cases(spark, d):
    """Multiple-choice rows; every sixth names no answer and falls back to its named columns."""
    k = F.col("p_partkey")
    rows = D.table(spark, d, "part").select(k.alias("row"), F.when(k % 3 == 0, k.cast("string")).alias("image_id"), F.col("p_name").alias("caption_0"), F.col("p_type").alias("caption_1"), F.when(k % 4 != 0, F.col("p_brand")).alias("caption_10"), F.when(k % 6 == 0, "none").otherwise((k % 2).cast("string")).alias("correct_answer"), F.col("p_name").alias("option_0"), F.col("p_brand").alias("B"), F.col("p_brand").alias("neg_1"), F.col("p_type").alias("Hard_Negative_2"))
    return _case_table(loaders.choice_cases(rows, "choices", "parts", "file", ["row"]))


def _lines(rows, *fields, extra=""):
    """Rows as JSON lines: line and value. A row takes few bytes and much work, so rows are spread over all tasks, which the table's few bytes do not ask for."""
    return N.records(rows.repartition("line").select(F.col("line"), F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value")))


def _customer_pairs(spark, d):
    k = F.col("c_custkey")
    rows = D.table(spark, d, "customer").withColumns({"line": k, "anchor": F.when(k % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "c_name", F.lit("\n"))), "generated": F.when(k % 13 != 0, F.concat("c_mktsegment", F.lit(' "é"'))), "step": F.when(k % 3 == 0, k % 9)})
    return rows


@query
def evaluation_input(spark, d):
    """Pair records with their metadata as evaluation examples, and what is wrong with the bad ones."""
    k = F.col("c_custkey")
    meta = F.struct(F.when(k % 2 == 0, F.col("c_mktsegment")).alias("dataset"), (k % 3).alias("policy_model"), F.lit("c").alias("category"))
    rows = _lines(_customer_pairs(spark, d), "anchor", "generated", (k % 4).alias("compatibility_label"), F.col("step").alias("step_index"), F.when(k % 17 == 0, F.lit("")).otherwise(k.cast("string")).alias("pair_id"), meta.alias("metadata"))
    rows = N.pair_examples(rows)
    return rows.select("row_index", "anchor", "generated", "compatibility_label", "data_source", "policy_model", "pair_id", "step_index", F.col("metadata")["category"].alias("category"), "error")


@query
def normalized_pairs(spark, d):
    """Pair records, flat or nested, with labels in several fields, as rows with stable ids."""
    k = F.col("c_custkey")
    word = F.when(k % 2 == 0, "correct").otherwise("-")
    rows = _lines(_customer_pairs(spark, d), F.when(k % 2 == 0, F.col("anchor")).alias("anchor"), F.struct(F.when(k % 2 == 1, F.col("anchor")).alias("anchor"), "generated").alias("pair"), F.when(k % 5 < 3, word).alias("label"), F.when(k % 5 > 1, k % 3 - 1).alias("process_correctness"), F.col("step").alias("step_index"), F.when(k % 4 == 0, k).alias("source_sample_id"), F.col("c_mktsegment").alias("source_dataset"), F.lit("why?").alias("question"))
    rows = N.normalized_pairs(rows)
    return rows.select("line", F.when(F.col("error").isNull(), F.col("pair_id")).alias("pair_id"), "source_sample_id", "step_index", "data_source", "anchor", "generated", "compatibility_label", "error")


@query
def trace_rows(spark, d):
    """Records whose texts are strings, lists or objects, as traces."""
    k = F.col("o_orderkey")
    record = F.when(k % 4 == 0, F.to_json(F.struct(k.alias("uid"), F.col("o_orderstatus").alias("problem"), F.array(F.lit(" a "), F.col("o_orderpriority"), F.lit("")).alias("steps"), F.lit("raw/x y.jsonl").alias("file"))))
    record = record.when(k % 4 == 1, F.to_json(F.struct(F.struct(F.lit(" ").alias("text"), F.col("o_orderpriority").alias("solution")).alias("response"), F.col("o_orderstatus").alias("domain"))))
    record = record.when(k % 4 == 2, F.to_json(F.struct(k.alias("id"), F.struct(F.col("o_orderstatus").alias("z"), k.alias("a")).alias("reasoning"))))
    lines = D.table(spark, d, "orders").select(k.alias("line"), record.otherwise(F.lit("[1]")).alias("value"))
    return N.trace_rows(N.records(lines), "orders.jsonl").select("line", "trace_id", "question", "reasoning", "subcategory", "source", "error")


@query
def canonical_rows(spark, d):
    """Labelled conversations as canonical traces, with ids over their content."""
    said = lambda role, text: F.struct(F.lit(role).alias("from"), text.alias("value"))
    turns = F.flatten(F.transform(F.arrays_zip("steps", "step_labels"), lambda s: F.array(said("human", s["steps"]), said("gpt", F.when(s["step_labels"] > 0, "+").when(s["step_labels"] < 0, "-").otherwise("neutral")))))
    images = F.array(F.lit(" a.png"), F.lit(""), F.lit("b.png"), F.lit("a.png"))
    user = F.regexp_extract("source_sample_id", "[0-9]+", 0).cast("long")
    lines = D.traces(spark, d).select(user.alias("line"), F.to_json(F.struct("question", turns.alias("conversations"), images.alias("images"), F.when(user % 3 == 0, user).otherwise(F.lit(-1)).alias("id"))).alias("value"))
    rows = N.canonical_rows(N.records(lines), "events")
    return rows.select("line", "question", F.array_join("images", "|").alias("images"), F.size("steps").cast("long").alias("n_steps"), F.md5(F.array_join("steps", "|")).alias("digest"), "metadata.source_sample_id", "error")


@query
def step_label_counts(spark, d):
    return N.step_label_counts(D.traces(spark, d)).select("label", "n")


@query
def canonical_violations(spark, d):
    k = F.col("o_orderkey")
    steps = F.when(k % 7 == 0, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.col("o_orderstatus"), F.col("o_orderpriority")))
    labels = F.when(k % 5 == 0, F.array(F.lit(1))).when(k % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(-1), F.lit(0)))
    images = F.when(k % 11 != 0, F.array(F.lit("x")))
    value = F.to_json(F.struct(F.lit("q").alias("question"), images.alias("images"), steps.alias("steps"), labels.alias("step_labels"), F.lit("").alias("answer"), F.struct(F.when(k % 13 != 0, k).alias("source_sample_id")).alias("metadata")))
    rows = N.records(D.table(spark, d, "orders").select(k.alias("line"), value.alias("value")))
    return rows.select("line", N.canonical_violation().alias("violation"))


@query
def supervised_examples(spark, d):
    """Records with chat messages or with named fields as prompt, response and images."""
    k = F.col("c_custkey")
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.when(k % 3 == 0, F.array(said("system", F.lit(" be brief ")), said("user", F.col("c_name")), said("assistant", F.lit("no")), said("assistant", F.col("c_mktsegment"))))
    rows = _lines(D.table(spark, d, "customer").withColumn("line", k), messages.alias("messages"), F.when(k % 3 == 1, F.concat(F.lit("<image> "), "c_name")).alias("problem"), F.col("c_mktsegment").alias("solution"), F.array(F.lit("i.png"), F.lit("i.png")).alias("images"), F.lit("j.png").alias("image"))
    rows = N.supervised_examples(rows)
    chat = N.chat_messages(F.col("prompt"), F.col("response"), F.col("images"))
    return rows.select("line", "prompt", "response", F.array_join("images", "|").alias("images"), F.to_json(chat, {"ignoreNullFields": "true"}).alias("chat"), "error")


def _generations(spark, d):
    """Parts as segments with what a generator said, some of it of no use."""
    k = F.col("p_partkey")
    said = F.concat(F.lit('Sure: {"positive": "'), F.when(k % 6 == 0, " NULL ").otherwise(F.col("p_name")), F.lit('", "negative_value_flip": '), F.when(k % 2 == 0, F.concat(F.lit('"'), "p_type", F.lit('"'))).otherwise(F.lit("null")), F.lit(', "negative_relation_flip": "'), F.when(k % 3 == 0, F.lit("null")).otherwise(F.col("p_brand")), F.lit('"} done'))
    rows = D.table(spark, d, "part").select(k.alias("case_id"), (k % 10).alias("trace_id"), F.col("p_brand").alias("subcategory"), F.concat(F.lit(" "), "p_name").alias("reference"), F.when(k % 7 == 0, F.lit("{nothing")).otherwise(said).alias("output"))
    return N.cases_from_generations(rows)


@query
def generated_cases(spark, d):
    return _generations(spark, d).select("case_id", "positive", F.array_join(F.transform("negatives", lambda n: F.concat(n["type"], F.lit(":"), n["text"])), "|").alias("negatives"), "error")


@query
def numeric_pairs(spark, d):
    good, _ = N.split_errors(_generations(spark, d))
    return N.numeric_pair_rows(good).select("case_id", "trace_id", "dataset", "subcategory", "mode", "negative_type", "pair_type", "text_a", "text_b")


@query
def prompts(spark, d):
    """Prompts of requests with two examples, by digest, and of segments."""
    k = F.col("p_partkey")
    shots = F.when(k % 2 == 0, F.array(*[F.struct(F.col("p_type").alias("anchor"), F.col("p_brand").alias("generated"))] * 2))
    return D.table(spark, d, "part").select("p_partkey", F.md5(G.pair_prompt(F.when(k % 3 == 0, "hard_negative").otherwise("positive_paraphrase"), F.col("p_name"), shots)).alias("pair"), F.md5(G.segment_prompt(F.col("p_name"))).alias("segment"))


@query
def token_gates(spark, d):
    """Requests with token counts, gated by length and budget."""
    rows = D.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 300).cast("int").alias("anchor_tokens"), (F.col("o_orderkey") % 4200).cast("int").alias("prompt_tokens"))
    return G.gated(rows).select("o_orderkey", "max_output_tokens", "error_type")


@query
def profiles(spark, d):
    """Requests in the audit profile."""
    rows = P.generation_requests(D.traces(spark, d)).withColumns({"generated": F.upper("anchor"), "prompt": F.lit("p")})
    return N.profiled(rows, "audit").withColumn("step_index", F.col("step_index").cast("long"))


@query
def capped_cases(spark, d):
    rows = B.capped_groups(D.score_rows(spark, d).select("dataset", "case_id"), ["dataset"], "case_id", 100)
    return rows.groupBy("dataset").agg(F.count_distinct("case_id").alias("n_cases"), F.count("*").alias("n_rows"), F.sum("case_id").alias("sum_cases"))


@query
def sorted_rewards(spark, d):
    """The first rows of a reward table in the order of its keys: the report that is printed."""
    rewards = L.collect_caption(D.caption_scores(spark, d))
    return L.reward_tables(rewards)["reward_by_scorer"].limit(5).select("scorer", "score_field", "n_pos", "n_neg", *r6(*_MEANS))
