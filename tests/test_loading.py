"""Loaders keep every record as a row or an error, in the order of its file; texts of any shape take linear time."""

import json
import random
import re
import time
import zipfile

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from tracewise.functions import embedded
from tracewise.functions import text as X
from tracewise.operators import normalise as N
from tracewise.operators import pairs as P
from tracewise.plans import queries
from tracewise.sources import loaders, ranges


def jsonl(path, *records):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))
    return str(path)


def judged(steps=("a", "b"), labels=(1, -1), **more):
    return {"question": " why? ", "response": {"steps": list(steps), "process_correctness": list(labels)}} | more


def test_context_records(spark, tmp_path):
    good = judged([" a ", "", "c"], [1, 0, -1], data_source="d", metadata={"policy_model": "m", "category": "x"}, image="i.png")
    bad = [judged(["a", "b"], [1]), judged(labels=[1, 7]), judged(labels=[1, True]), {"question": "q", "response": {"steps": "text", "process_correctness": [1]}}, judged([], []), judged(["a", " "], [1, 1]), judged(["a", 3], [1, 1]), {"question": "q"}, {"response": {}}, judged(source_sample_id=" "), "[1]", "{cut"]
    path = jsonl(tmp_path / "c.jsonl", good, "", judged(source_sample_id=7), *bad)
    rows = loaders.evaluation_rows(spark, path, "context").orderBy("row_index", "step_index").collect()
    fine = [r for r in rows if r["error"] is None]
    assert [(r["row_index"], r["step_index"], r["generated"], r["compatibility_label"]) for r in fine] == [(1, 0, "a", 1), (1, 2, "c", -1), (3, 0, "a", 1), (3, 1, "b", -1)]
    assert fine[1]["anchor"] == "Question:\nwhy?\n\nPrevious response steps:\n1. a" and fine[0]["policy_model"] == "m" and fine[0]["metadata"] == {"category": '"x"'} and fine[2]["data_source"] == "UNKNOWN"
    assert fine[0]["source_sample_id"] == fine[1]["source_sample_id"] and fine[0]["source_sample_id"].startswith("vpb_") and fine[2]["source_sample_id"] == "7" and len({r["pair_id"] for r in fine}) == 4
    assert [(r["row_index"], r["error"]) for r in rows if r["error"]] == [
        (4, "step/label length mismatch"), (5, "invalid process_correctness at step index 1"), (6, "invalid process_correctness at step index 1"), (7, "response.steps must be a list"), (8, "no response steps"), (9, "an empty non-neutral response step at index 1"),
        (10, "an invalid step at index 1"), (11, "no response object"), (12, "no non-empty string 'question'"), (13, "invalid 'source_sample_id'"), (14, "not a JSON object"), (15, "invalid JSON"),
    ]
    with pytest.raises(Exception, match="length mismatch"):
        loaders.load_evaluation(spark, path, "context").collect()
    whole = jsonl(tmp_path / "w.jsonl", good, judged())
    assert [r["generated"] for r in loaders.load_evaluation(spark, whole, "context", 3).collect()] == ["a", "c", "a"]
    with pytest.raises(FileNotFoundError):
        loaders.load_evaluation(spark, str(tmp_path / "none"), "context")


def caption(k, **more):
    return {"caption": f"c{k}", "caption2": f"d{k}", "negative_caption": f"n{k}"} | more


def test_ranking_files_keep_bad_lines_and_places(spark, tmp_path):
    path = jsonl(tmp_path / "r.jsonl", "", caption(0), "", "{broken", caption(1, caption2=""), caption(2), caption(3, id="own"), "[]")
    cases, errors = loaders.load_ranking(spark, {"s": path, "t": path}, "d")
    assert sorted(r["case_id"] for r in cases.where("subcategory = 's'").collect()) == ["d::s::0", "d::s::3", "d::s::own"]
    assert sorted((r["subcategory"], r["error_message"].rpartition("/")[2]) for r in errors.collect()) == [(s, f"r.jsonl:{n}: not a JSON object") for s in "st" for n in (4, 8)]
    assert [r["case_id"] for r in loaders.load_ranking(spark, {"s": path}, "d", 2)[0].orderBy("case_id").collect()] == ["d::s::0", "d::s::3"]


def test_documents_that_are_none(spark, tmp_path):
    whole = json.dumps([caption(k) for k in range(12)])
    for name, text in {"whole": whole, "cut": whole[:-30], "number": "3", "empty": "", "named": json.dumps({f"k{k}": caption(k) if k % 5 else 1 for k in range(20, 0, -1)})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    cases, errors = loaders.load_separation(spark, {n: str(tmp_path / f"{n}.json") for n in ("whole", "cut", "number", "empty", "named", "gone")}, "d", 3)
    got = {}
    for r in cases.collect():
        got.setdefault(r["subcategory"], []).append(r["case_id"].rpartition("::")[2])
    assert {k: sorted(v) for k, v in got.items()} == {"whole": ["0", "1", "2"], "named": ["k17", "k18", "k19"]}
    assert sorted((r["subcategory"], r["error_type"], r["error_message"].rpartition("/")[2]) for r in errors.collect()) == [("cut", "ValueError", "cut.json: invalid JSON"), ("gone", "FileNotFoundError", "gone.json"), ("number", "ValueError", "number.json: neither a list nor an object of records")]


def test_choices_keep_the_first_rows(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("caption_0,caption_1,correct_answer\n" + "".join(f"{name}{k},no,0\n" for k in range(12)))
    roots, names = [str(tmp_path)], {"s": ["b.csv", "a.csv"]}
    cases, _ = loaders.load_choices(spark, names, roots, "d", 3)
    assert [r["positive"] for r in cases.collect()] == ["b0", "b1", "b2"]
    cases, _ = loaders.load_choices(spark, names, roots, "d", 14, frozenset("s"))
    assert [r["positive"] for r in cases.collect()] == [*[f"b{k}" for k in range(12)], "a0", "a1"]


def test_traces_of_several_files(spark, tmp_path):
    one = jsonl(tmp_path / "one x.jsonl", {"steps": ["s"]}, "", "  ", {"solution": "t", "source": "own"}, "[1]", {"question": "q"}, "{cut")
    two = jsonl(tmp_path / "two.jsonl", {"answer": "u"}, {"id": 5, "answer": "v"})
    rows, errors = loaders.load_traces(spark, [one, two])
    assert sorted((r["trace_id"], r["source"].replace("%20", " "), r["subcategory"].replace("20x", "x"), r["row_index"]) for r in rows.collect() if r["source"] != "own") == sorted([(next(r["trace_id"] for r in rows.collect() if r["reasoning"] == "s"), "one x.jsonl", next(r["subcategory"] for r in rows.collect() if r["reasoning"] == "s").replace("20x", "x"), 1), ("5", "two.jsonl", "two", 2), ("two_visualprm_000001", "two.jsonl", "two", 1)])
    ids = [r["trace_id"] for r in rows.collect()]
    assert len(set(ids)) == 4 and sum(i.endswith("visualprm_000001") for i in ids) == 2 and sum(i.endswith("visualprm_000002") for i in ids) == 1
    assert [(r["row_index"], r["error_message"], r["trace_id"] is None) for r in errors.orderBy("row_index").collect()] == [(3, "not a JSON object", True), (4, "Missing reasoning text", False), (5, "invalid JSON", True)]
    rows, _ = loaders.load_traces(spark, [one])
    assert {r["trace_id"] for r in rows.collect()} == {"visualprm_000001", "visualprm_000002"}


def test_traces_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/b c.jsonl", '{"steps": ["s"]}\n\n{"id": 7, "answer": "t", "image": "i.png"}\n{"answer": "u", "image": 3}\n')
        z.writestr("x/a.jsonl", '{"question": "q"}\n{cut\n[1]\n{"answer": "v"}\n')
    (tmp_path / "b.zip").write_bytes(b"none")
    rows, errors = loaders.load_archived_traces(spark, str(tmp_path))
    assert sorted((r["row_index"], r["trace_id"], r["source"], r["subcategory"], r["reasoning"]) for r in rows.collect()) == [(4, "a_visualprm_000004", "a.jsonl", "a", "v"), (5, "b_c_visualprm_000005", "b c.jsonl", "b_c", "s"), (6, "b_c_7", "b c.jsonl", "b_c", "t")]
    assert sorted((r["row_index"] or 0, r["error_message"], r["trace_id"]) for r in errors.collect()) == [(0, "BadZipFile: no ZIP archive", None), (1, "Missing reasoning text", "a_visualprm_000001"), (2, "invalid JSON", None), (3, "not a JSON object", None), (7, "image is not a text", None)]
    rows, errors = loaders.load_archived_traces(spark, str(tmp_path / "a.zip"), 5)
    assert rows.count() == 2 and errors.count() == 3


def test_training_rows_keep_whole_texts(spark):
    df = spark.createDataFrame([("<image> p", "so <answer>4</answer> done", ["a.png", "b.png"], 1), ("q", "r #### 5", None, 2)], "prompt string, response string, images array<string>, k int")
    a, b = P.training_rows(df, "d").orderBy("extra_info.k").collect()
    assert a["prompt"][0]["content"] == "<image> p" and a["reward_model"]["ground_truth"] == "so <answer>4</answer> done" and [i["image"] for i in a["images"]] == ["a.png", "b.png"] and a["extra_info"]["num_images"] == 2
    assert b["reward_model"]["ground_truth"] == "r #### 5" and b["images"] is None and b["extra_info"]["image_policy"] == "omitted_from_verl_parquet"
    assert P.training_rows(df.drop("images"), "d").count() == 2


def test_plans(spark, sf):
    plan = queries.queries()["trace_rows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[(.*?)\]", plan)) == 1 and len(re.findall(r"texts\(", re.findall(r"ArrowEvalPython \[(.*?)\], ", plan)[0])) == 1
    plan = queries.queries()["ranking_cases"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "partitionSpec" not in plan and "windowspecdefinition(types" not in plan


def test_deep_and_unclosed_records(spark):
    deep = "[" * 300 + '"x"' + "]" * 300
    rows = spark.createDataFrame([(1, f'{{"steps": {deep}, "id": 1}}'), (2, '{"steps": ["a", {"content": {"text": "b"}}], "id": null}'), (3, '{"steps": [' * 50)], "line long, value string")
    got = {r["line"]: r for r in N.trace_rows(N.records(rows), "f").collect()}
    assert got[1]["error"] is None and "x" in got[1]["reasoning"] and got[2]["reasoning"] == "a\nb" and got[2]["trace_id"] == "visualprm_000002" and got[3]["error"] == "invalid JSON"


def test_segments_of_long_signs(spark):
    long = {"signs": "*-" * 500_000 + "x", "spaced": "- " * 500_000 + "Given", "digits": "1" * 1_000_000, "steps": "step " * 200_000, "letters": "g-i-v-e-n" + "-" * 1_000_000}
    df = spark.createDataFrame(list(long.items()), "k string, t string").cache()
    df.count()
    began = time.perf_counter()
    got = dict(map(tuple, df.select("k", F.size(X.segments(F.col("t")))).collect()))
    assert time.perf_counter() - began < 5 and got == {"signs": 1, "spaced": 0, "digits": 0, "steps": 1, "letters": 0}



def plain_objects(text):
    """Tries to decode at every brace."""
    for m in re.finditer(r"\{", text):
        try:
            value, _ = json.JSONDecoder().raw_decode(text, m.start())
        except ValueError:
            continue
        yield value


def test_objects_in_text_against_every_brace():
    draw = random.Random(3)
    parts = ["{", "}", '"', "a", '"a"', ":", "1", ",", "\\", '\\"', "[", "]", " ", '"b":', '{"a":', '{"b":1}', '{"a":{"a":2},"a":{"c":[{}]}}', "null", "{}", "\\\\", '{"x":"{"', '}"}']
    for _ in range(30_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))
        assert list(embedded.objects(text)) == list(plain_objects(text)), text


@pytest.mark.parametrize("text", ["{" * 1_000_000, '{"a":' * 200_000, '{"a":' * 100_000 + "1" + "}" * 100_000, ('{"a":' * 400 + "1" + "}" * 400) * 500, '{"a":{"b":"' + "x" * 1_000_000, "}{" * 500_000, '"{"}' * 250_000, '{"a":' + "[" * 500_000 + "}"])
def test_objects_take_linear_time(text):
    began = time.perf_counter()
    sum(1 for _ in embedded.objects(text))
    assert time.perf_counter() - began < 4


def test_first_lines_read_little(spark, tmp_path, monkeypatch):
    """Samples come from the first ranges of a file: what is behind them is neither parsed nor read."""
    path = tmp_path / "f.jsonl"
    record = lambda k: json.dumps({"anchor": f"a{k}", "generated": "g" * (k % 90 + 1), "compatibility_label": k % 2})
    path.write_text("\n" + "\n\n".join(record(k + 1) for k in range(3000)) + "\n{broken\n" + "x" * 400_000)
    read = []
    real = DataFrameReader.options

    def seen(self, **options):
        if "first" in options:
            read.append((options["first"], options["last"]))
        return real(self, **options)

    monkeypatch.setattr(DataFrameReader, "options", seen)
    for wanted in (1, 7, 100, 2000):
        read.clear()
        rows = ranges.first_lines(spark, str(path), wanted, 4096).orderBy("line").collect()
        assert [(r["line"], json.loads(r["value"])["anchor"]) for r in rows] == [(2 * k, f"a{k}") for k in range(1, wanted + 1)]
        assert max(b for _, b in read) * 4096 <= 4096 * 4 + 3 * sum(len(record(k + 1)) + 2 for k in range(wanted))
    assert [r["anchor"] for r in loaders.load_evaluation(spark, str(path), max_samples=5).collect()] == [f"a{k}" for k in range(1, 6)]
    plan = loaders.load_evaluation(spark, str(path), max_samples=5)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    with pytest.raises(Exception, match="invalid JSON"):
        loaders.load_evaluation(spark, str(path), max_samples=4000).collect()
    short = tmp_path / "s.jsonl"
    short.write_text("a\r\n\n \nb")
    assert [tuple(r)[1:] for r in ranges.first_lines(spark, str(short), 9, 2).orderBy("line").collect()] == [(1, "a"), (4, "b")]
    (tmp_path / "none.jsonl").write_text("")
    assert ranges.first_lines(spark, str(tmp_path / "none.jsonl"), 9).count() == 0
