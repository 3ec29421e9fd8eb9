"""Text and reward functions against hand-computed values."""

import random

import pytest
from pyspark.sql import functions as F

from tracewise.functions import embedded
from tracewise.functions import rewards as M
from tracewise.functions import text as X
from tracewise.plans import queries


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items())) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("a = 1. B is 2; c: 3", ["a = 1.", "B is 2;", "c:"]), ("Given.\n\n- Step 2\r\nx  y\t z", ["x y z"]), ("", []), (None, []), ("***", []), ("step 3a", [])])
def test_segments(spark, text, want):
    assert one(spark, X.segments(F.col("t")), t=text) == want


def test_eligible_segments_keep_their_index(spark):
    assert [(r["index"], r["segment"]) for r in one(spark, X.eligible_segments(F.col("t")), t="plain words. x = y. Then 4.")] == [(2, "x = y."), (3, "Then 4.")]


@pytest.mark.parametrize(("f", "text", "want"), [
    (X.flip_number, "a 9 b 9", "a 10 b 9"), (X.flip_number, "1.5x", "2.5x"), (X.flip_number, "99999999.5", "100000000.5"), (X.flip_number, "none", None),
    (X.flip_entity, "let y be x", "let x be x"), (X.flip_entity, "a is", "y is"), (X.flip_entity, "word", None),
    (X.flip_relation, "x = 3", "x != 3"), (X.flip_relation, "x <= 3 = y", "x >= 3 = y"), (X.flip_relation, "1 + 2", "1 - 2"), (X.flip_relation, "x", None),
])
def test_flips(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("x #### 1 #### 42", "42"), ("<final> a </final> <answer>\n b </answer>", "b"), ("<CONCLUSION>C</CONCLUSION>", "C"), ("<answer></answer>", ""), (" plain ", "plain"), (None, "")])
def test_extract_answer(spark, text, want):
    assert one(spark, X.extract_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize(("solution", "truth", "want"), [("<answer>4.0</answer>", "4", 1.0), ("The YES!", "the yes", 1.0), ("100", "100.5", 0.0), ("100", "100.005", 1.0), ("", "4", 0.0), ("4", None, 0.0)])
def test_accuracy(spark, solution, truth, want):
    assert one(spark, M.accuracy_reward(F.col("s"), F.col("t")), s=solution, t=truth) == want


@pytest.mark.parametrize(("text", "want"), [("plain text", 0.5), ("", 0.0), (None, 0.0), ("<final>1</final>", 1.0), ("#### x", 1.0), ("####", 0.5)])
def test_format(spark, text, want):
    assert one(spark, M.format_reward(F.col("t")), t=text) == want


def test_composite(spark):
    assert one(spark, M.composite_reward(F.col("s"), F.col("t")), s="4", t="4") == 0.75
    assert one(spark, M.composite_reward(F.col("s"), F.col("t"), ()), s="4", t="4") == 0.0
    with pytest.raises(ValueError, match="unknown"):
        M.composite_reward(F.lit("a"), F.lit("a"), ("speed",))


@pytest.mark.parametrize(("value", "kappa", "want"), [(0.7, 0.5, 0.4), (0.4, 0.5, 0.0), (None, 0.5, None), (float("nan"), 0.0, 0.0)])
def test_scale(spark, value, kappa, want):
    got = spark.createDataFrame([(value,)], "v double").select(M.scale_reward(F.col("v"), kappa).alias("x")).first()["x"]
    assert got == (None if want is None else pytest.approx(want))


def test_kappa_range():
    with pytest.raises(ValueError):
        M.scale_reward(F.lit(1.0), 1.0)


def test_nli_formulas(spark):
    parts = [F.lit(v) for v in (0.8, 0.6, 0.1, 0.2)]
    assert one(spark, M.nli_heuristic(*parts)) == pytest.approx(0.5)
    assert one(spark, M.nli_coverage(*parts)) == pytest.approx(0.64)
    assert one(spark, M.nli_equiv(*parts)) == pytest.approx(0.6)
    assert one(spark, M.nli_heuristic(*parts[:3], F.lit(None).cast("double"))) is None
    assert one(spark, M.nli_features(*parts, F.lit(0.3), F.lit(0.4))) == [0.8, 0.6, 0.2, 0.4]


def test_numbers(spark):
    assert one(spark, M.num(F.col("t")), t="x") is None and one(spark, M.finite(F.lit(float("inf")))) is None
    assert one(spark, M.sigmoid(F.lit(-1000.0))) == 0.0 and one(spark, M.sigmoid(F.lit(1000.0))) == 1.0
    assert M.max_steps(1_000_000, 4096) == 245
    assert one(spark, M.noisy_or(F.array(F.lit(0.5), F.lit(0.5)))) == 0.75
    assert one(spark, M.f_beta(F.lit(0.0), F.lit(0.0))) == 0.0


def test_texts_and_labels(spark):
    assert one(spark, X.first_text(F.col("a"), F.col("b")), a="  ", b=" x ") == "x"
    assert one(spark, X.collect_texts(F.col("a"), F.col("b")), a=["", " y"], b=["z"]) == ["y", "z"]
    assert one(spark, X.context_anchor(F.lit("q"), F.array(F.lit("a"), F.lit("b")))) == "Question:\nq\n\nPrevious response steps:\n1. a\n2. b"
    assert one(spark, X.context_anchor(F.lit("q"), F.array().cast("array<string>"))) == "Question:\nq"


def test_embedded_json(spark):
    text = 'noise {bad {"a": [1]} {"generated_segment": "  "} {"generated_segment": " s "}'
    df = spark.createDataFrame([(text,), ("none",), (None,)], "t string").select(embedded.first_object("t").alias("o"), embedded.generated_segment("t").alias("g"))
    assert [tuple(r) for r in df.collect()] == [('{"a":[1]}', "s"), (None, None), (None, None)]


def test_segments_by_plain_rules(spark):
    draw = random.Random(5)
    parts = [" ", "  ", "\t", "　", " \x85", "\n", "\r\n", ". ", ".", "! \n", "a", "Step 2", "final - answer", "x=1", ":", "é", "a long sentence of words", "-", "9" * 20]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(X.segments(F.col("t"))).collect()]
    inner = F.regexp_replace("t", rf"[{X.SPACE}&&[^\r\n]]+", " ")
    plain = F.filter(F.transform(F.split(inner, r"(?<=[.!?;:])[ \r\n]+|[\r\n]+"), lambda s: F.trim(s)), lambda s: ~F.trim(F.regexp_replace(s, "[^A-Za-z0-9 ]+", "")).rlike(X._MARKER))
    assert got == [r[0] for r in df.select(plain).collect()]


def test_segments_are_spread_over_tasks(spark, sf):
    plan = queries.queries()["segments"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in plan
