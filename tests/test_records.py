"""Loaders, record normalisation, score collection, generation planning and reports."""

import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewise.functions import embedded
from tracewise.functions import text as X
from tracewise.operators import calibrate as C
from tracewise.operators import collect as L
from tracewise.operators import evaluate as E
from tracewise.operators import generation as G
from tracewise.operators import normalise as N
from tracewise.operators import sampling as B
from tracewise.sources import files, loaders, reports
from tracewise.streaming import state as S


def lines(spark, *records):
    return N.records(spark.createDataFrame([(n, r if isinstance(r, str) else json.dumps(r)) for n, r in enumerate(records, 1)], "line long, value string"))


def jsonl(path, *records):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))
    return str(path)


def test_nested_texts(spark):
    cases = {'" a "': "a", '["x", {"content": "y"}, null, ["z"]]': "x\ny\nz", '{"value": "", "solution": "s"}': "s", '{"b": 1, "a": "é"}': '{"a": "é", "b": 1}', "1.50": "1.5", "true": "True", "null": ""}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert [r[0] for r in df.select(embedded.nested_text("v")).collect()] == list(cases.values())


def test_labels_and_folders(spark):
    labels = {"a/b/ c d!.jsonl": "c_d", "x.y-z_": "x.y-z", "  ": "", "/.json": "unknown", "A": "A", "!!": "unknown"}
    folders = {"VisualPRM400K-v1/images/Train/geo set/1.PNG": "geo_set", "images/a.png": "a.png", "raw\\math\\x": "math", "": ""}
    df = spark.createDataFrame([(k,) for k in [*labels, *folders]], "v string")
    got = df.select(X.clean_label(F.col("v")), X.source_subcategory(F.col("v"))).collect()
    assert [r[0] for r in got[: len(labels)]] == list(labels.values()) and [r[1] for r in got[len(labels) :]] == list(folders.values())


def test_flips_of_any_length(spark):
    df = spark.createDataFrame([("x " + "9" * 45,), ("007",), ("a 1234567890123456789012345678901234567890123",), ("0",)], "t string")
    assert [r[0] for r in df.select(X.flip_number(F.col("t"))).collect()] == ["x 1" + "0" * 45, "8", "a 1234567890123456789012345678901234567890124", "1"]


def test_segments_and_markers(spark):
    text = "Given:\r\n  Step 2.\n**Final  - Answer**\nx = 1. So\ty;\n\n- thus!\nT-hus\nstep twelve\n12b\n z　w."
    assert spark.createDataFrame([(text,)], "t string").select(X.segments(F.col("t"))).first()[0] == ["x = 1.", "So y;", "step twelve", "z w."]


def test_pair_examples(spark):
    good = {"anchor": " a ", "generated": "b", "compatibility_label": 1, "policy_model": " m ", "metadata": {"data_source": 7, "pair_id": 5, "category": ["x", 1], "error_type": {"no": 1}}, "step_index": 2}
    bad = [good | {"anchor": 3}, good | {"generated": " "}, good | {"compatibility_label": True}, good | {"compatibility_label": 2}, good | {"step_index": "1"}, good | {"pair_id": ""}, good | {"source_sample_id": 1.5}, "[1]", "{"]
    rows = N.pair_examples(lines(spark, good, *bad)).orderBy("row_index").collect()
    r = rows[0]
    assert (r["anchor"], r["compatibility_label"], r["data_source"], r["policy_model"], r["pair_id"], r["step_index"], r["metadata"], r["error"]) == ("a", 1, "7", "m", "5", 2, {"category": '["x",1]'}, None)
    assert [x["error"] for x in rows[1:]] == ["no non-empty string 'anchor'", "no non-empty string 'generated'", *["invalid 'compatibility_label'"] * 2, "invalid 'step_index'", "invalid 'pair_id'", "invalid 'source_sample_id'", "not a JSON object", "invalid JSON"]
    with pytest.raises(Exception, match="anchor"):
        N.strict(N.pair_examples(lines(spark, bad[0]))).collect()
    kept, errors = N.split_errors(N.pair_examples(lines(spark, good, bad[0])), ["row_index"])
    assert kept.count() == 1 and tuple(errors.first()) == (2, "ValueError", "no non-empty string 'anchor'")


def test_normalized_pairs(spark):
    base = {"anchor": "a", "generated": "b"}
    rows = [base | {"label": " Correct "}, {"pair": base, "process_correctness": -1}, base | {"process_correctness": 0}, base | {"label": "+", "process_correctness": -1}, base | {"label": True}, base | {"label": "maybe"}, base, base | {"label": -1}, {"response": {"steps": [], "process_correctness": []}}, base | {"label": None, "compatibility_label": "0"}]
    got = {r["line"]: (r["compatibility_label"], r["error"]) for r in N.normalized_pairs(lines(spark, *rows)).collect()}
    assert got == {1: (1, None), 2: (0, None), 4: (0, "conflicting labels"), 5: (None, "unsupported label"), 6: (None, "unsupported label"), 7: (None, "no label field"), 8: (None, "unsupported label"), 9: (None, "a raw record without a pair"), 10: (0, None)}
    assert N.normalized_pairs(lines(spark, rows[2]), neutral="error").first()["error"] == "neutral label"
    good, _ = N.split_errors(N.normalized_pairs(lines(spark, *rows)))
    assert tuple(N.pair_summary(good).first()) == (3, 1, 2, ["UNKNOWN"])


def test_canonical_rows(spark):
    turns = [{"from": "human", "value": "### Question: q? ### Solution Process: s1"}, {"role": "GPT", "content": "+"}, {"from": "human", "text": "s2"}, {"from": "gpt", "value": "-"}]
    good = {"conversations": turns, "image": {"path": " p.png "}, "answer": " 4 ", "id": -1}
    rows = N.canonical_rows(lines(spark, good, good | {"id": "own"}, {"conversations": turns[:1]}), "d").orderBy("line").collect()
    r = rows[0]
    assert (r["question"], r["steps"], r["step_labels"], r["images"], r["answer"]) == ("q?", ["s1", "s2"], [1, -1], ["p.png"], "4")
    import hashlib

    payload = json.dumps({"question": "q?", "images": ["p.png"], "steps": ["s1", "s2"]}, ensure_ascii=False, sort_keys=True)
    assert r["metadata"]["source_sample_id"] == "visualprm_" + hashlib.sha256(payload.encode()).hexdigest()[:20]
    assert rows[1]["metadata"]["source_sample_id"] == "own" and rows[2]["error"]
    assert {x["label"]: x["n"] for x in N.step_label_counts(N.split_errors(N.canonical_rows(lines(spark, good), "d"))[0]).collect()} == {1: 1, -1: 1}


def test_violations(spark):
    whole = {c: "x" for c in N.PROVENANCE} | {"compatibility_label": 1}
    rows = lines(spark, whole, {k: v for k, v in whole.items() if k != "anchor"}, whole | {"generated": " "}, whole | {"compatibility_label": 5})
    assert [r[0] for r in rows.select(N.pair_violation()).collect()] == [None, "row 2 is missing fields: anchor", "row 3 has invalid generated text", "row 4 has a non-binary compatibility_label"]
    rows = N.reward_examples(lines(spark, whole, whole | {"source_sample_id": ""}))
    assert [r["error"] for r in rows.collect()] == [None, "Invalid source_sample_id"]


def test_supervised_examples(spark):
    chat = {"messages": [{"role": "user", "content": [{"type": "image"}, {"type": "text", "text": " hi "}, "you"]}, {"role": "assistant", "content": "first"}, {"role": "model", "content": "last "}], "image": ["a", None, "a", "b"]}
    rows = N.supervised_examples(lines(spark, chat, {"messages": [], "input": " p ", "output": "o"}, {"x": 1})).orderBy("line").collect()
    assert [(r["prompt"], r["response"], r["images"]) for r in rows[:2]] == [("hi\nyou", "last", ["a", "b"]), ("p", "o", [])] and rows[2]["error"]


def test_generations_to_pairs(spark):
    said = {"positive": "p", "negative_value_flip": "null", "negative_entity_flip": " e "}
    df = spark.createDataFrame([("c1", "t", " ref ", json.dumps(said)), ("c2", "t", "r", "no"), ("c3", "t", "r", '{"positive": "p"}')], "case_id string, trace_id string, reference string, output string")
    cases = N.cases_from_generations(df)
    assert [r["error"] for r in cases.orderBy("case_id").collect()] == [None, "No valid JSON object found in generation", "Generation has no valid negatives"]
    rows = N.numeric_pair_rows(N.split_errors(cases)[0]).orderBy("pair_type").collect()
    assert [(r["pair_type"], r["negative_type"], r["text_a"], r["text_b"], r["dataset"]) for r in rows] == [("negative", "entity_flip", "ref", "e", "visualprm"), ("positive", None, "ref", "p", "visualprm")]


def test_generators_and_prompts(spark):
    df = spark.createDataFrame([("a", "positive_paraphrase"), ("b", "hard_negative")], "prompt string, kind string")
    rows = G.generated(df, lambda: lambda texts: [t.upper() for t in texts]).collect()
    assert [(r["output"], r["error"]) for r in rows] == [("A", None), ("B", None)]
    assert {r["error"] for r in G.generated(df, lambda: lambda texts: []).collect()} == {"ValueError: 0 outputs for 1 prompts"} or "ValueError" in G.generated(df, lambda: lambda texts: []).first()["error"]
    text = df.select(G.pair_prompt(F.col("kind"), F.col("prompt"))).first()[0]
    assert text.startswith("Paraphrase the anchor faithfully.") and text.endswith("\n\nAnchor:\na") and "Examples" not in text
    with pytest.raises(ValueError):
        G.pair_prompt(F.col("kind"), F.col("prompt"), version="v9")
    with pytest.raises(ValueError):
        N.profiled(df, "all")


SCORE = {"case_id": "c", "dataset": "d", "scorer": "nli", "pair_type": "positive_pair", "mode": "ranking", "E_ab": 0.8, "E_ba": 0.6, "C_ab": 0.1, "C_ba": 0.2, "N_ab": 0.1, "N_ba": 0.1}


def test_calibration_rows_and_errors(spark, tmp_path):
    nested = {k: v for k, v in SCORE.items() if len(k) > 4 or k == "mode"} | {"case_id": "n", "mode": "", "all_raw_values": {k: 0.5 for k in ("E_ab", "E_ba", "C_ab", "C_ba", "N_ab", "N_ba")}}
    path = jsonl(tmp_path / "s.jsonl", SCORE, SCORE, SCORE | {"pair_type": "other"}, SCORE | {"C_ab": None, "case_id": "x"}, SCORE | {"case_id": " "}, SCORE | {"scorer": "sbert"}, "{bad", nested | {"pair_type": "negative"})
    rows, errors = loaders.load_scores(spark, [path, str(tmp_path / "none.jsonl")])
    assert sorted((r["line"], r["error_type"]) for r in errors.collect()) == [(0, "FileNotFoundError"), (7, "ValueError")]
    got = L.calibration_rows(rows).orderBy("line").collect()
    assert [(r["line"], r["error"]) for r in got] == [(1, None), (3, "Unsupported pair_type"), (4, "Missing NLI fields: C_ab"), (5, "Missing dataset or case_id"), (8, None)]
    assert got[0]["features"] == [0.8, 0.6, 0.2, 0.1] and got[4]["features"] == [0.5] * 4 and got[4]["mode"] == "separation"


def test_loaders_and_registry(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"7": {"caption": "a", "negative_caption": "b"}, "8": {"caption": "", "negative_caption": "b"}}))
    jsonl(tmp_path / "two.jsonl", {"id": "i", "caption": "a", "caption2": "b", "negative_caption": "c"}, {"caption": "a", "caption2": "b", "negative_caption": "c"})
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "mcq.csv").write_text("caption_0,caption_1,caption_2,correct_answer,positive,neg_x\na,b,,1,p,\nq,,,9,p,n\n")
    wanted = {
        "sep": ("separation", {"paths": {"s": str(tmp_path / "one.json"), "gone": str(tmp_path / "x.json")}}),
        "rank": ("ranking", {"paths": {"r": str(tmp_path / "two.jsonl")}}),
        "mcq": ("choices", {"names": {"m": ["none.csv", "mcq.csv"], "no": ["no.csv"]}, "roots": [str(tmp_path)]}),
        "odd": ("unheard", {}),
    }
    cases, errors = loaders.load_cases(spark, wanted)
    assert [(r["case_id"], r["mode"], r["positive"], r["negatives"]) for r in cases.collect()] == [
        ("mcq::m::mcq::0", "separation", "b", ["a"]), ("mcq::m::mcq::1", "separation", "p", ["n"]), ("rank::r::1", "ranking", "b", ["c"]), ("rank::r::i", "ranking", "b", ["c"]), ("sep::s::7", "separation", "a", ["b"]),
    ]
    assert sorted((r["dataset"], r["subcategory"], r["error_type"]) for r in errors.collect()) == [("mcq", "no", "FileNotFoundError"), ("odd", "", "KeyError"), ("sep", "gone", "FileNotFoundError")]
    counts, first = reports.previews(cases)
    assert [tuple(r)[3:] for r in counts.collect()] == [(2, 2), (2, 2), (1, 1)] and first.count() == 5


def test_evaluation_inputs(spark, tmp_path):
    pairs = jsonl(tmp_path / "p.jsonl", {"anchor": "a", "generated": "b", "compatibility_label": 0}, "", {"anchor": "a", "generated": "c", "compatibility_label": 1})
    rows = loaders.load_evaluation(spark, pairs)
    assert [(r["row_index"], r["compatibility_label"]) for r in rows.orderBy("row_index").collect()] == [(1, -1), (3, 1)]
    assert loaders.load_evaluation(spark, pairs, max_samples=1).first()["row_index"] == 1
    steps = jsonl(tmp_path / "c.jsonl", {"question": "q", "response": {"steps": ["s", "t"], "process_correctness": [1, 0]}, "data_source": "d"})
    rows = loaders.load_evaluation(spark, steps, "context").orderBy("step_index").collect()
    assert [(r["generated"], r["compatibility_label"], r["data_source"]) for r in rows] == [("s", 1, "d"), ("t", 0, "d")]
    for wrong in ({"mode": "x"}, {"max_samples": 0}):
        with pytest.raises(ValueError):
            loaders.load_evaluation(spark, pairs, **wrong)
    assert loaders.load_reward_examples(spark, jsonl(tmp_path / "r.jsonl", {"anchor": "a", "generated": "b", "compatibility_label": 1, "source_sample_id": 3, "more": 1})).collect()[0].asDict() == {"anchor": "a", "generated": "b", "compatibility_label": 1, "source_sample_id": "3"}
    traces, errors = loaders.load_traces(spark, [jsonl(tmp_path / "t.jsonl", {"problem": "p", "steps": ["x", "y"]}, {"question": "q"})])
    assert [(r["trace_id"], r["reasoning"], r["subcategory"]) for r in traces.collect()] == [("visualprm_000001", "x\ny", "t")] and errors.first()["error_message"] == "Missing reasoning text"


def test_rebuilt_tables(spark, tmp_path):
    caption = jsonl(tmp_path / "c.jsonl", SCORE, SCORE | {"pair_type": "negative_pair", "E_ab": 0.1}, {"scorer": "bge_reranker", "raw_score": 0, "pair_type": "positive", "case_id": "b", "dataset": "d", "mode": "ranking"})
    numeric = jsonl(tmp_path / "n.jsonl", *[{"case_id": "n", "trace_id": "t", "scorer": "sbert", "score_field": "raw_score", "score": 0.5, "pair_type": "negative", "mode": "ranking"}] * 2)
    (tmp_path / "best.json").write_text(json.dumps({"weights": {"E_ab": 1, "E_ba": 1, "C_max": -1, "N_max": -1}, "bias": 0, "tau": 0.6}))
    paths = reports.rebuild_tables(spark, [caption], [numeric], str(tmp_path / "run"), best=str(tmp_path / "best.json"))
    rows = spark.read.option("header", True).csv(paths["reward_by_dataset"]).collect()
    assert {(r["source"], r["dataset"], r["scorer"]): (r["n_pos"], r["n_neg"]) for r in rows} == {("caption_negation", "d", "nli"): ("1", "1"), ("caption_negation", "d", "bge_reranker"): ("1", "0"), ("caption_negation", "d", "nli_calibrated_logistic"): ("1", "1"), ("visualprm_numeric", "visualprm", "sbert"): ("0", "1")}
    assert Path(f"{paths['tau_sensitivity']}.md").read_text().startswith("| scorer | score_field |") and "tables" in (tmp_path / "run/logs/run.log").read_text()
    with pytest.raises(FileExistsError):
        reports.create_layout(str(tmp_path / "run"))
    with pytest.raises(ValueError):
        reports.rebuild_tables(spark, [caption], [numeric], str(tmp_path / "x"), kappa=1.0)
    assert loaders.load_calibration_weights(spark, str(tmp_path / "no.json")) is None and loaders.load_selected_tau(spark, str(tmp_path / "best.json")) == 0.6
    predicted = spark.createDataFrame([("d", "s", "positive", "x/visualprm_numeric/y", 0.9), ("d", "s", "negative", None, 0.3)], "dataset string, subcategory string, pair_type string, source_path string, calibrated_score double")
    both = L.collected(*[loaders.load_scores(spark, [p])[0] for p in (caption, numeric)], predicted, {"E_ab": 1.0}, 0.0)
    assert sorted((r["source"], r["reward"]) for r in both.where("scorer = 'nli_calibrated_logistic'").collect()) == [("caption_negation", 0.3), ("visualprm_numeric", 0.9)]


def test_calibration_tables(spark, tmp_path):
    rows = [("calib", "d", f"s{i % 2}", str(i // 2), "positive" if i % 2 else "negative", None, i % 2, "ranking", i / 10, i) for i in range(8)]
    df = spark.createDataFrame(rows, "split string, dataset string, subcategory string, case_id string, pair_type string, negative_type string, label int, mode string, calibrated_score double, row_id long")
    report = C.report(df, 0.35)
    got = {r["table"]: r for r in report.where("`table` <> 'subcategory'").collect()}
    assert (got["overall"]["num_cases"], got["overall"]["ranking_acc"], got["overall"]["tpr_at_tau"], got["overall"]["fpr_at_tau"]) == (4, 1.0, 0.5, 0.5) and got["dataset"]["mean_margin"] == pytest.approx(0.1)
    assert {r["mode"] for r in report.where("`table` = 'subcategory'").collect()} == {"separation", "positive_only"}
    filled = lambda t: reports.calibration_table(t, [1.0, 2.0, 3.0, 4.0], 0.5, 0.35, "fixed_tau", 0.96)
    paths = reports.save_calibration(filled(report), filled(C.by_negative_type(df, 0.35)), str(tmp_path))
    overall = spark.read.option("header", True).csv(paths[0])
    assert tuple(overall.columns) == reports.CALIBRATION_COLUMNS and overall.first()["dataset"] == "ALL" and overall.first()["weight_C_max"] == "3.0"
    assert spark.read.option("header", True).csv(paths[3]).columns[0] == "negative_type"


def test_grid_and_layout(tmp_path):
    assert reports.parameter_grid(a=[1, 2], b=["x"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    assert reports.run_stamp().startswith("run_2") and reports.now().endswith("+00:00")
    assert (reports.create_layout(str(tmp_path / "r")) / "tables").is_dir()
    store = f"file://{tmp_path}/store"  # a root as Spark names it
    assert (reports.create_layout(store) / "logs").is_dir()
    reports.log_line(store, "one")
    reports.log_line(store, "two")
    assert [x.split("] ")[1] for x in (tmp_path / "store" / "logs" / "run.log").read_text().splitlines()] == ["one", "two"]
    with pytest.raises(FileExistsError):
        reports.create_layout(store)


def test_orders_and_places(spark):
    df = spark.createDataFrame([(i * 37 % 101, f"k{i % 7}é") for i in range(101)] + [(None, "x")], "v long, t string").repartition(5)
    for order in (["v"], ["t", "v"]):
        got, n = B.placed_in_order(df, order, 8)
        rows = sorted((r for r in got.collect()), key=lambda r: r["_n"])
        want = sorted(((r["v"], r["t"]) for r in df.collect()), key=lambda r: tuple((r[{"v": 0, "t": 1}[c]] is not None, (r[{"v": 0, "t": 1}[c]] or "").encode() if c == "t" else r[0] or 0) for c in order))
        assert n == 102 and [(r["v"], r["t"]) for r in rows] == want and [r["_n"] for r in rows] == list(range(1, 103))
    assert B.ratio_sample(df, "v", 0.25).count() == 25 and B.ratio_sample(df, "v", 0.001).count() == 1
    assert sorted(r["v"] for r in B.shuffled(df, ["v"]).where("v IS NOT NULL").collect()) == list(range(101))


def test_auc_of_ranges(spark):
    rows = [((i * 13) % 97 / 97, 1 if (i * 7) % 5 < 2 else -1) for i in range(300)] + [(1.0, 1), (0.0, -1), (0.0, 1)]
    df = E.predictions(spark.createDataFrame([("s", p, y) for p, y in rows], "data_source string, p_positive double, compatibility_label int"))
    pos, neg = [p for p, y in rows if y == 1], [p for p, y in rows if y == -1]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    for ranges in (1, 10, 4096):
        assert E.auc(df, ["data_source"], ranges).first()["auc"] == pytest.approx(want)


def test_zip_rows_by_index(spark, tmp_path):
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("m/2.jsonl", '{"x": 3}\n\n{"x": 4}\n')
            z.writestr("m/1.jsonl", '{"x": 1}\n{"x": 2}\n')
            z.writestr("m/z.txt", "no")
    rows = files.indexed_zip_lines(spark, str(tmp_path))
    assert [(r["row_index"], r["member"], r["value"]) for r in rows.orderBy("row_index").collect()][:4] == [(0, "m/1.jsonl", '{"x": 1}'), (1, "m/1.jsonl", '{"x": 2}'), (2, "m/2.jsonl", '{"x": 3}'), (3, "m/2.jsonl", '{"x": 4}')]
    assert files.count_zip_rows(rows).agg(F.sum("n")).first()[0] == 8
    wanted = spark.createDataFrame([(5, 0), (1, 1)], "row_index long, position int")
    assert [r["row_index"] for r in files.rows_by_index(rows, wanted).collect()] == [5, 1]


def test_lines_of_split_files(spark, tmp_path):
    text = "".join(f'{{"i": {i}}}\r\n' if i % 3 else f'\n{{"i": {i}}}\n' for i in range(5000)) + '{"i": 5000}'
    (tmp_path / "f.jsonl").write_bytes(text.encode())
    (tmp_path / "e.jsonl").write_bytes(b"")
    want = [(n, x.rstrip("\r")) for n, x in enumerate(text.split("\n"), 1) if x.strip()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = files.read_lines(spark, [str(tmp_path / "f.jsonl"), str(tmp_path / "e.jsonl")]).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["line"], r["value"]) for r in got] == want


def test_state_extras(spark):
    log = S.recorded(spark.createDataFrame([("a", '{"compatibility_label":1}', None, None, "2024-01-01"), ("a", None, None, '{"error_type":"X"}', "2024-01-01"), ("b", None, None, '{"error_type":"X"}', "2024-01-01")], "pair_id string, pair_json string, raw_json string, error_json string, t string").withColumn("updated_at", F.col("t").cast("timestamp")))
    state = S.latest(log)
    assert {r["pair_id"]: r["status"] for r in state.collect()} == {"a": "ok", "b": "error"}  # of equal times, the success
    assert tuple(S.label_counts(state).first()) == (1, 0) and [tuple(r) for r in S.error_types(state).collect()] == [("X", 1)]
    one = lambda c, *ids: spark.createDataFrame([(i, "{}") for i in ids], f"pair_id string, {c} string")
    merged = S.merge_legacy(state, one("pair_json", "a", "c"), one("error_json", "c", "d"), one("raw_json", "d", "e"), F.current_timestamp())
    assert {(r["pair_id"], r["status"], r["raw_json"]) for r in merged.collect()} == {("a", "ok", None), ("b", "error", None), ("c", "ok", None), ("d", "error", "{}")}
    rows, seen = S.discovered(state, "found")
    rows.collect()
    assert seen.get == {"requests": 2, "samples": 2}


def test_stream_of_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, status in enumerate(("bad", "good")):
        row = {"pair_id": "a", "updated_at": f"2024-01-0{n + 1}T00:00:00Z"} | ({"error_json": "{}"} if status == "bad" else {"pair_json": "{}"})
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(row) + "\n")
        S.ingest_latest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), 1).awaitTermination()
    log = spark.read.schema(S.STATE).parquet(str(tmp_path / "out"))
    assert log.count() == 2 and S.latest(log).first()["status"] == "ok"


def test_threshold_modes_and_segment_rewards(spark):
    from tracewise.functions import rewards as M

    df = spark.createDataFrame([(0.8,), (0.5,), (None,)], "s double")
    got = df.select(*[M.tau_score(F.col("s"), 0.6, m).alias(m) for m in ("none", "hard", "scaled")]).collect()
    assert [tuple(r) for r in got] == [(0.8, 0.8, pytest.approx(0.5)), (0.5, 0.0, 0.0), (None, None, None)]
    grid = spark.createDataFrame([([[0.5, 0.5], [1.0, 0.0], [0.0, 0.0]],), ([],)], "w array<array<double>>")
    rows = grid.select(M.coverage_recall(F.col("w")).alias("r"), M.support_precision(F.col("w")).alias("p")).collect()
    assert (rows[0]["r"], rows[0]["p"]) == (pytest.approx(1.75 / 3), 0.75) and tuple(rows[1]) == (0.0, 0.0)
    for wrong in (lambda: M.tau_score(F.col("s"), 1.0), lambda: M.tau_score(F.col("s"), 0.5, "x"), lambda: M.ratio("0"), lambda: M.positive_int("-1"), lambda: M.unit_interval("tau", 1.0, True)):
        with pytest.raises(ValueError):
            wrong()


def test_reward_function_contract(spark):
    from tracewise.functions import rewards as M

    df = spark.createDataFrame([("d", "<answer>4</answer>", "4", (["accuracy"],)), ("d", "5", "4", (None,)), ("d", "x", "x", ([],))], "data_source string, solution string, truth string, extra struct<components:array<string>>")
    cols = [F.col(c) for c in ("data_source", "solution", "truth")]
    assert [r[0] for r in df.select(M.compute_score(*cols, F.col("extra"))).collect()] == [1.0, 0.25, 0.0]
    assert [r[0] for r in df.select(M.compute_score(*cols)).collect()] == [1.0, 0.25, 0.75]
    bad = df.withColumn("extra", F.struct(F.array(F.lit("wit")).alias("components")))
    with pytest.raises(Exception, match="unknown reward component"):
        bad.select(M.compute_score(*cols, F.col("extra"))).collect()


def test_model_free_scorers(spark):
    from tracewise.operators import scorers as V

    pairs = spark.createDataFrame([("a b", "b a"), ("a", "c"), ("", "")], "text_a string, text_b string")
    assert [round(r["raw_score"], 6) for r in V.score_pairs(pairs, "hashed_cosine").collect()] == [1.0, 0.0, 0.0]
    assert [r["bertscore_f1"] for r in V.score_pairs(pairs, "token_overlap").collect()] == [1.0, 0.0, 0.0]
    names = {0: "CONTRADICTION", 1: "neutral", 2: "Entailment"}
    V.register("toy_nli", V.both_ways(lambda a, b: [[0.1, 0.2, 0.7] if len(x) >= len(y) else [0.6, 0.3, 0.1] for x, y in zip(a, b)], names), V.NLI_FIELDS)
    rows = spark.createDataFrame([("p", "long text", "short")], "pair_id string, anchor string, generated string")
    r = V.nli_cache(rows, "toy_nli", ("pair_id", "anchor", "generated")).first()
    assert [r[c] for c in V.NLI_FIELDS] == [0.7, 0.1, 0.1, 0.6, 0.2, 0.3] and (r["nli_model"], r["error"]) == ("toy_nli", None)
    with pytest.raises(ValueError):
        V.label_map({0: "yes", 1: "no"})


def test_staged_data_and_command_line(spark, tmp_path, capsys):
    from tracewise import cli

    path = jsonl(tmp_path / "d.jsonl", {"a": 1, "b": "x"})
    assert files.load_staged(spark, path, "a long, b string", ["a"]).collect()[0].asDict() == {"a": 1}
    with pytest.raises(ValueError):
        files.load_staged(spark, path)
    assert cli.main(["tables", "--output", "o", "--config-only"]) == 0 and json.loads(capsys.readouterr().out)["stage"] == "tables"
    scores = jsonl(tmp_path / "s.jsonl", SCORE, "{")
    cli.main(["tables", "--caption", scores, "--output", "o", "--validate-data-only"])
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1]) == {"rows": 1, "errors": 1}
    examples = jsonl(tmp_path / "e.jsonl", *[{"anchor": "a", "generated": "b", "compatibility_label": 1, "source_sample_id": i} for i in range(20)])
    cli.main(["split", "--data", examples, "--output", str(tmp_path / "split")])
    assert spark.read.json(str(tmp_path / "split")).groupBy("split").count().count() == 3
    assert files.split_list(" a, ,b") == ["a", "b"] and files.zip_uri("x.zip", "m") == "zip://x.zip::m"


def test_filters_do_not_repeat_records(spark):
    parsed = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson")
    for rows in (N.normalized_pairs(lines(spark, "{}")), N.split_errors(N.pair_examples(lines(spark, "{}")))[0]):
        assert parsed(rows) == 1


def test_strip(spark):
    white = "\t\n\x0b\x0c\r \x85\xa0      　"
    texts = [f"{white}a{white}b{white}", white, "", "a\r\n", "\x1ca\x1c", "\na \n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip(F.col("t"))).collect()]
    assert got == [f"a{white}b", "", "", "a", "\x1ca\x1c", "a"]


def test_calibration_groups_without_sorting_or_more_exchanges(spark):
    rows = [("calib", "d", "s", "c", "ranking", "positive", None, 7, 1, 0.9), ("calib", "d", "s", "c", "ranking", "positive", None, 7, 1, 0.4), ("calib", "d", "t", "c", "ranking", "negative", "x", 1, 0, 0.3), ("calib", "d", "s", None, "ranking", "negative", "x", 1, 0, 0.2)]
    df = spark.createDataFrame(rows, "split string, dataset string, subcategory string, case_id string, mode string, pair_type string, negative_type string, row_id long, label int, calibrated_score double")
    for report in (C.report(df, 0.35), C.by_negative_type(df, 0.35)):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "case_id" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "REPARTITION" not in x)
    got = {(r["table"], r["subcategory"]): (r["num_cases"], r["num_pairs"], r["mean_margin"] and round(r["mean_margin"], 6)) for r in C.report(df, 0.35).collect()}
    assert got == {("overall", None): (1, 4, 0.1), ("dataset", None): (1, 4, 0.1), ("subcategory", "s"): (1, 3, None), ("subcategory", "t"): (1, 1, None)}  # the lower of two scores of one row_id; a case without an id is none
    assert C.by_negative_type(df, 0.35).select("num_cases", "num_pairs").collect() == [(1, 4)]
