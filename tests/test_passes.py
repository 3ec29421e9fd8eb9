"""Steps that work their values out once and read their rows in one pass."""

from pyspark.sql import functions as F

from tracewise.functions import text as X
from tracewise.operators import aggregate as A
from tracewise.operators import collect as L
from tracewise.sources import adapters as D
from tracewise.sources import loaders

WEIGHTS = {"E_ab": 1.5, "E_ba": 0.75, "C_max": -1.25, "N_max": -0.5}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_calibrated_scores_come_with_the_others(spark, sf):
    """Own and calibrated scores are one pass of each source, with the rows that the collectors give one by one, and a score's sigmoid is worked out once."""
    caption, numeric = D.caption_scores(spark, sf), D.numeric_scores(spark, sf)
    both = L.collected(caption, numeric, None, WEIGHTS, 0.1, 0.1)
    parts = [L.collect_caption(caption, 0.1), L.collect_numeric(numeric, 0.1), L.collect_caption_calibrated(caption, WEIGHTS, 0.1, 0.1), L.collect_numeric_calibrated(numeric, WEIGHTS, 0.1, 0.1)]
    apart = parts[0]
    for p in parts[1:]:
        apart = apart.unionByName(p)
    assert both.exceptAll(apart).isEmpty() and apart.exceptAll(both).isEmpty() and both.where(F.col("scorer") == L.CALIBRATED[0]).count() > 0
    plan = _plan(both)
    assert (plan.count("Relation"), plan.count("Window ["), plan.count("EXP(")) == (2, 1, 4)


def test_first_rows_by_a_digest_of_keys(spark):
    """Keys that are equal meet whatever their form: nulls, both zeros, both kinds of NaN, structs."""
    rows = [(None, 0.0, 3), (None, -0.0, 2), ("a", float("nan"), 5), ("a", -float("nan"), 4), ("a", None, 1), ("a", None, 0)]
    df = spark.createDataFrame(rows, "k string, v double, n int").withColumn("s", F.struct("v"))
    for keys in (["k", "v"], ["k", "s"]):
        first = A.deduped_first(df, keys, ["n"])
        assert sorted(r["n"] for r in first.collect()) == [0, 2, 4] and first.columns == df.columns
        assert "_digest" in _plan(first)


def test_traces_are_one_pass(spark, tmp_path):
    """Good and bad traces come from one parse and one call for texts, numbers are counted once, and parts do not change what traces and errors are."""
    lines = ["[1]", "{cut off", '{"id": "a", "steps": ["x", "y"], "domain": "x y"}', '{"question": "q"}', '{"solution": {"text": " z "}, "question": " q "}']
    rows = spark.createDataFrame([("d/f 1.jsonl", 3 * i, t) for i, t in enumerate(lines)] + [("d/g.jsonl", 250_000, lines[4])], "file string, line long, value string")
    numbered = loaders.numbered_by_file(rows)
    assert _plan(numbered).count("Window [row_number") == 1
    found = loaders.trace_table(numbered, by_file=True)
    got = {(r["file"], r["row_index"]): (r["trace_id"], r["reasoning"], r["subcategory"], r["error"]) for r in found.collect()}
    assert got == {
        ("d/f 1.jsonl", 1): (None, "", None, "not a JSON object"), ("d/f 1.jsonl", 2): (None, "", None, "invalid JSON"), ("d/f 1.jsonl", 3): ("a", "x\ny", "x_y", None),
        ("d/f 1.jsonl", 4): ("f_1_visualprm_000004", "", "f_1", "Missing reasoning text"), ("d/f 1.jsonl", 5): ("f_1_visualprm_000005", "z", "f_1", None), ("d/g.jsonl", 1): ("g_visualprm_000001", "z", "g", None),
    }
    good, errors = loaders.traces(numbered, by_file=True)
    assert good.count() == 3 and {(r["row_index"], r["error_message"]) for r in errors.collect()} == {(1, "not a JSON object"), (2, "invalid JSON"), (4, "Missing reasoning text")}
    assert _plan(good).count("parseJson") == 1 and _plan(good).count("texts(") == 1


def test_labels_and_ends_of_texts(spark):
    """White space and underscores only within a text, or of any length, and paths that end in slashes."""
    texts = {"": "", " \t": "", "a b/": "a_b", "//": "unknown", "x/y.json//": "y", "__a_": "a", "é": "unknown", "a/b c .txt": "b_c", " a\r\n": "a", "_" * 50 + "b": "b", "a/" + "_" * 9: "unknown"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert dict(map(tuple, df.select("t", X.clean_label(F.col("t"))).collect())) == texts
    ends = {" a  b  ": "a  b", "a": "a", "  ": "", "a  b\n\n": "a  b", "　": "", "x" + " " * 100_000 + "y": "x" + " " * 100_000 + "y"}
    df = spark.createDataFrame([(t,) for t in ends], "t string")
    assert dict(map(tuple, df.select("t", X.strip(F.col("t"))).collect())) == ends
