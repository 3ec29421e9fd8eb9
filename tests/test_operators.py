"""Operators against hand-computed tables and properties."""

import json
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.operators import aggregate as A
from tracewise.operators import calibrate as C
from tracewise.operators import evaluate as E
from tracewise.operators import pairs as P
from tracewise.operators import sampling as B
from tracewise.operators import scorers as V
from tracewise.sources import files
from tracewise.streaming import state as S

JUDGED = "compatibility_label int, p_positive double, data_source string, policy_model string"


def judged(spark, rows):
    return spark.createDataFrame([(a, p, "s", "m") for a, p in rows], JUDGED)


def test_neutral_steps_are_left_out(spark):
    rows = E.predictions(judged(spark, [(1, 0.9), (-1, 0.1), (0, 0.99)]))
    assert [(r["predicted_label"], r["correct"]) for r in rows.collect()] == [(1, True), (-1, True), (1, None)]
    m = E.overall(rows).first()
    assert (m["accuracy"], m["evaluated_steps"], m["neutral_steps"]) == (1.0, 2, 1)


def test_margin_is_strict(spark):
    rows = E.predictions(judged(spark, [(1, 0.75), (1, 0.7501)]), 0.5).collect()
    assert [r["predicted_label"] for r in rows] == [-1, 1]


def test_macro_f1(spark):
    m = E.overall(E.predictions(judged(spark, [(1, 0.9), (1, 0.9), (1, 0.1), (-1, 0.1)]))).first()
    assert (m["f1_positive"], m["f1_negative"], m["macro_f1"]) == (pytest.approx(0.8), pytest.approx(2 / 3), pytest.approx(11 / 15))
    assert m["weighted_macro_f1"] == pytest.approx(11 / 15)


def test_auc_and_empty_classes(spark):
    rows = E.predictions(judged(spark, [(1, 0.9), (1, 0.5), (-1, 0.5), (-1, 0.1)]))
    assert E.auc(rows, ["data_source"]).first()["auc"] == pytest.approx(0.875)
    assert E.auc(E.predictions(judged(spark, [(1, 0.9)])), ["data_source"]).first()["auc"] is None


def test_class_indices():
    assert E.class_indices(2, 1) == (0, 1) and E.class_indices(2, 0) == (1, 0)
    for bad in ((2, None), (3, 1)):
        with pytest.raises(ValueError):
            E.class_indices(*bad)


SCORES = "dataset string, case_id string, scorer string, pair_type string, negative_type string, mode string, value double, line long"


def test_reward_means(spark):
    rows = [(None, "a", "x", "positive_pair", None, "", 0.8, 1), (None, "a", "x", "negative", None, "", 0.2, 2), ("d", "a", "x", "negative", None, "", 0.5, 3), ("d", "a", "x", "other", None, "", 0.5, 4), ("d", "a", "x", "positive", None, "", None, 5)]
    got = {r["dataset"]: tuple(r)[1:] for r in A.reward_means(A.reward_rows(spark.createDataFrame(rows, SCORES)), ["dataset"]).collect()}
    assert got == {"": (1, 1, 0.8, 0.2, pytest.approx(0.6)), "d": (0, 1, None, 0.5, None)}


def test_grouping_sets_add_up(spark):
    rows = [(d, "a", s, t, None, "", v, 0) for n, (d, s, t, v) in enumerate([("p", "x", "positive", 0.1), ("p", "y", "negative", 0.2), ("q", "x", "negative", 0.3), ("q", "x", "positive", 0.4)])]
    rewards = A.reward_rows(spark.createDataFrame(rows, SCORES))
    got = A.reward_grouping_sets(rewards, [["dataset"], ["dataset", "scorer"]]).groupBy("level").agg(F.sum(F.col("n_pos") + F.col("n_neg")).alias("n")).collect()
    assert {r["level"]: r["n"] for r in got} == {0: 4, 1: 4}


def test_ranking_is_strict_and_takes_first_or_last(spark):
    rows = [("d", "a", "x", "positive", None, "ranking", 0.9, 1), ("d", "a", "x", "positive", None, "ranking", 0.95, 4), ("d", "a", "x", "negative", None, "ranking", 0.2, 2), ("d", "a", "x", "negative", None, "ranking", 0.9, 3)]
    df = spark.createDataFrame(rows, SCORES)
    for first, want in ((True, 0.0), (False, 1.0)):
        assert A.ranking_accuracy(A.ranking_margins(df, ["scorer", "case_id"], "line", first), ["scorer"]).first()["ranking_acc"] == want


def test_passes_is_inclusive_and_guards_nan(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (0.7,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(A.passes(F.col("v"), F.lit(0.5))).collect()] == [0.0, 1.0, 1.0, 0.0]


def test_dedupe_is_null_safe_and_idempotent(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, n int")
    once = A.deduped_first(df, ["k"], ["n"])
    assert sorted(r["n"] for r in once.collect()) == [1, 3] and A.deduped_first(once, ["k"], ["n"]).count() == 2


def test_sample_weights(spark):
    df = spark.createDataFrame([("d", 1), ("d", 0), ("d", 0), ("d", 0)], "dataset string, label int")
    got = [(r["label"], round(r["weight"], 4)) for r in C.with_sample_weights(df).collect()]
    assert sorted(got) == [(0, 0.6667)] * 3 + [(1, 2.0)]


def test_tau_grid():
    assert C.parse_tau_grid("0.1:0.3:0.1") == [0.1, 0.2, 0.3] and C.parse_tau_grid("0.5, 0.2,0.5") == [0.2, 0.5]
    for bad in ("0:2:0.5", "1:0:0.1", ""):
        with pytest.raises(ValueError):
            C.parse_tau_grid(bad)


def test_choose_tau_prefers_target_then_smallest(spark):
    table = spark.createDataFrame([(0.3, 0.97, 0.5, 0.7), (0.4, 0.97, 0.4, 0.7), (0.5, 0.97, 0.4, 0.7), (0.6, 0.5, 0.0, 0.9)], "tau double, tpr double, fpr double, balanced double")
    assert C.choose_tau(table).first()["tau"] == 0.4
    assert C.choose_tau(table, "balanced_threshold").first()["tau"] == 0.6
    assert C.choose_tau(table.where("tau > 0.55")).first()["selection_score"] == 0.5


def test_logistic_fit_separates(spark):
    rows = [("d", int(i % 2), [i % 2 + (i % 5) / 10, 0.1, 0.0, (i % 3) / 3]) for i in range(60)]
    df = C.with_sample_weights(spark.createDataFrame(rows, "dataset string, label int, features array<double>"))
    weights, bias = C.fit_logistic(df)
    got = C.scored(df, weights, bias).select("label", "calibrated_score").collect()
    assert all((r["calibrated_score"] > 0.5) == (r["label"] == 1) for r in got)
    with pytest.raises(ValueError):
        C.fit_logistic(df.where("label = 1"))


def test_splits_are_disjoint_and_exact(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("k"), F.col("id"))
    rows = B.grouped_split(df, "k")
    assert B.leaks(rows, "k").count() == 0
    assert {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count_distinct("k").alias("n")).collect()} == {"train": 78, "val": 10, "test": 9}
    assert sorted(map(tuple, B.grouped_split(df.repartition(9), "k").collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        B.grouped_split(df.where("k < 2"), "k")
    assert B.holdout_split(df.where("k = 1"), "k", 0.5).where("split = 'val'").count() == 0
    calib = B.calibration_split(df.withColumn("dataset", F.lit("d")), case="k").groupBy("split").agg(F.count_distinct("k").alias("n"))
    assert {r["split"]: r["n"] for r in calib.collect()} == {"calib": 82, "heldout": 15}


def test_samples(spark):
    df = spark.range(100).select(F.when(F.col("id") < 5, "small").when(F.col("id") < 40, "mid").otherwise("big").alias("g"), "id")
    assert Counter(r["g"] for r in B.balanced_sample(df, "g", "id", 25).collect()) == {"small": 5, "mid": 10, "big": 10}
    assert B.ratio_sample(df, "id", 0.001).count() == 1 and B.ratio_sample(df, "id", 0.5, 7).count() == 7
    assert Counter(r["split"] for r in B.head_split(df, ["id"], 0.1).collect()) == {"val": 10, "train": 90}
    assert Counter(r["split"] for r in B.head_split(df.limit(1), ["id"], 0.1).collect()) == {"val": 1, "train": 1}
    assert B.capped(df, ["g"], ["id"], 6).count() == 17


def test_pair_ids_and_seeds(spark):
    df = spark.createDataFrame([("s1", ["bad", "fine", "so so", "next"], [-1, 1, 0, 1])], "source_sample_id string, steps array<string>, step_labels array<int>")
    rows = sorted(P.generation_requests(df).collect(), key=lambda r: r["step_index"])
    assert [r["step_index"] for r in rows] == [0, 1, 3] and rows[0]["pair_id"] == "pair_958f70cdc2a09b03b770" and rows[0]["generation_seed"] == 1834630183
    assert rows[2]["context_steps"] == ["fine", "so so"] and rows[0]["context_steps"] == []
    done = spark.createDataFrame([(rows[0]["pair_id"],)], "pair_id string")
    assert P.generation_requests(df, done=done).count() == 2


def test_context_excludes_the_step_itself(spark):
    df = spark.createDataFrame([("q", ["one", " ", "two"], [1, 0, -1])], "question string, steps array<string>, step_labels array<int>")
    rows = sorted(P.context_examples(df).collect(), key=lambda r: r["step_index"])
    assert [(r["step_index"], r["anchor"]) for r in rows] == [(0, "Question:\nq"), (2, "Question:\nq\n\nPrevious response steps:\n1. one")]
    bad = spark.createDataFrame([("q", [" "], [1])], "question string, steps array<string>, step_labels array<int>")
    with pytest.raises(Exception, match="empty non-neutral"):
        P.context_examples(bad).collect()


@pytest.mark.parametrize(("turns", "error"), [
    ([("human", "### Question: Q ### Solution Process: a"), ("gpt", "+"), ("human", "b"), ("gpt", "Incorrect")], None),
    ([("human", "a"), ("human", "b")], "step before its label"), ([("human", "a"), ("gpt", "?")], "unknown label"), ([("human", "a")], "last step without label"),
    ([("human", "a"), ("gpt", "+")], "missing question"), ([("system", "x")], "missing question"), ([], "missing question"),
    ([("human", "### Question: Q ### Solution Process: a"), ("gpt", "+"), ("human", "### Question: R ### Solution Process: a")], "conflicting questions"),
])
def test_conversations(spark, turns, error):
    df = spark.createDataFrame([("i", turns)], T.StructType.fromDDL("id string, conversations array<struct<from:string,value:string>>"))
    r = P.parsed_conversations(df).first()
    assert r["error"] == error
    if not error:
        assert (r["question"], r["steps"], r["step_labels"]) == ("Q", ["a", "b"], [1, -1])


def test_labels_and_pairs(spark):
    df = spark.createDataFrame([("+", None, 1), ("correct", "0", 0), ("x", None, None), (None, None, None)], "a string, b string, c int")
    got = [tuple(r["r"]) for r in df.select(P.reconciled_label(F.col("a"), F.col("b"), F.col("c")).alias("r")).collect()]
    assert got == [(1, False), (None, True), (None, True), (None, False)]
    cases = spark.createDataFrame([("a", "ranking", "r", "p", ["n", "m"]), ("b", "separation", "r", "p", ["n"]), ("c", "other", "r", "p", ["n"])], "case_id string, mode string, anchor string, positive string, negatives array<string>")
    assert sorted((r["case_id"], r["pair_type"][:3], r["text_a"], r["text_b"]) for r in P.pair_rows(cases).collect()) == [("a", "neg", "r", "m"), ("a", "neg", "r", "n"), ("a", "pos", "r", "p"), ("b", "neg", "p", "n")]


def test_scorers(spark):
    pairs = spark.createDataFrame([("a b", "b c"), (None, "")], "text_a string, text_b string")
    assert [(r["raw_score"], r["error"]) for r in V.score_pairs(pairs, "lexical").collect()] == [(pytest.approx(1 / 3), None), (0.0, None)]
    assert "unknown scorer" in V.score_pairs(pairs, "nope").first()["error"]
    vec = lambda *rows: F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    m = spark.range(1).select(V.token_match(vec((1, 0), (0, 1)), vec((1, 0))).alias("m"), V.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s")).first()
    assert tuple(m["m"]) == (1.0, 0.5, pytest.approx(2 / 3)) and m["s"] == [0.5, 0.5]


STATE = [("a", "{}", None, "2024-01-01"), ("a", None, '{"error_type":"PromptTooLong"}', "2024-01-02"), ("b", '{"x":1}', None, "2024-01-01")]


def results(spark, rows=STATE):
    return spark.createDataFrame(rows, "pair_id string, pair_json string, error_json string, t string").selectExpr("pair_id", "pair_json", "CAST(NULL AS STRING) AS raw_json", "error_json", "CAST(t AS TIMESTAMP) AS updated_at")


def test_state(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    assert S.load(spark, log).count() == 0
    S.append(results(spark), log)
    now = S.latest(S.load(spark, log))
    assert {r["pair_id"]: r["status"] for r in now.collect()} == {"a": "error", "b": "ok"}
    assert tuple(S.counts(now).first()) == (2, 1, 1, 1)
    ask = spark.createDataFrame([("a",), ("b",), ("c",)], "pair_id string")
    assert {r[0] for r in S.pending(ask, now).collect()} == {"c"} and {r[0] for r in S.pending(ask, now, retry_errors=True).collect()} == {"a", "c"}
    with pytest.raises(Exception, match="pair or an error"):
        S.recorded(results(spark, [("z", None, None, "2024-01-01")])).collect()
    with pytest.raises(ValueError):
        S.check_resume({"seed": 1}, {"seed": 2}, ("seed",))


def test_state_stream(spark, tmp_path):
    source, log, mark = (f"{tmp_path}/{n}" for n in ("in", "log", "mark"))
    for n, rows in enumerate((STATE[:1], STATE[1:])):
        results(spark, rows).write.mode("append").json(source)
        assert S.ingest(spark, source, log, mark).awaitTermination(60)
        assert S.load(spark, log).count() == (1, 3)[n]


def test_files(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"k": "a", "n": 1}\n\n[1]\n{bad\n{"k": "b", "n": 2}\n')
    fields = T.StructType.fromDDL("k string, n int")
    rows, errors = files.read_objects(spark, [str(good)], fields)
    assert sorted((r["line"], r["k"], r["n"]) for r in rows.collect()) == [(1, "a", 1), (5, "b", 2)] and sorted(r["line"] for r in errors.collect()) == [3, 4]
    assert [r["row_id"] for r in files.with_row_ids(rows).orderBy("line").collect()] == ["row_000000000001", "row_000000000002"]
    assert files.read_jsonl(spark, str(tmp_path / "none"), fields).count() == 0
    (tmp_path / "named.json").write_text(json.dumps({"x": {"k": "a", "n": 1}}))
    (tmp_path / "listed.json").write_text(json.dumps([{"k": "a", "n": 1}]))
    assert files.read_records(spark, str(tmp_path / "named.json"), fields).first()["key"] == "x" and files.read_records(spark, str(tmp_path / "listed.json"), fields).first()["k"] == "a"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.jsonl", "2\n\n3\n")
        z.writestr("a.jsonl", "1")
        z.writestr("i.png", b"\x89")
    assert [(r["member"], r["line"], r["value"]) for r in files.read_zip_lines(spark, str(tmp_path / "z.zip")).collect()] == [("a.jsonl", 1, "1"), ("b.jsonl", 1, "2"), ("b.jsonl", 3, "3")]
    assert files.read_zip_members(spark, str(tmp_path / "z.zip")).count() == 3
    table = spark.createDataFrame([("a", None, 0.5)], "x string, y string, z double")
    files.write_csv(table, str(tmp_path / "csv"), ["z", "y", "w", "x"])
    assert next((tmp_path / "csv").glob("part-*")).read_text() == "z,y,w,x\n0.5,,,a\n"
    assert files.markdown(table, ["x", "y", "z"]) == "| x | y | z |\n| --- | --- | --- |\n| a |  | 0.5 |\n"
    files.write_jsonl(table, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_jsonl(table, str(tmp_path / "out"))


def test_tasks_by_key_follow_from_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "KEY_ROWS", 100)
    rows = spark.range(1000).select((F.col("id") % 2).alias("dataset"), F.floor(F.col("id") / 2).alias("case_id"))
    assert B.together(rows, "case_id").rdd.getNumPartitions() == 10 and B.together(rows.limit(0), "case_id").rdd.getNumPartitions() == 1
    split = B.calibration_split(rows)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and split.groupBy("dataset", "split").count().count() == 4 and split.count() == 1000


def test_a_fit_counts_same_rows_once(spark, monkeypatch):
    seen = []

    class Fit(C.LogisticRegression):
        def fit(self, data):
            seen.append((data.count(), data.rdd.getNumPartitions()))
            return super().fit(data)

    monkeypatch.setattr(C, "LogisticRegression", Fit)
    monkeypatch.setattr(C, "FIT_ROWS", 2)
    rows = spark.range(600).select((F.col("id") % 2).cast("int").alias("label"), F.array((F.col("id") % 3).cast("double")).alias("features"), F.lit(1.0).alias("weight"))
    weights, bias = C.fit_logistic(rows)
    assert seen == [(6, 3)] and abs(weights[0]) < 1e-6 and abs(bias) < 1e-6
    with pytest.raises(ValueError):
        C.fit_logistic(rows.where("label = 1"))
