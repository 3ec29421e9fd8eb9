"""Tokenizers as plug-ins: ids, truncation, training pairs and gates; and scorers over a table's file."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewise.operators import generation as G
from tracewise.operators import normalise as N
from tracewise.operators import scorers as V
from tracewise.operators import tokenised as K

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_ids_lengths_and_truncation(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = ["a plain text of some words", None, "", "é 日本語 \n\n x", "word " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    got = {r["k"]: r for r in K.tokenised(df, path, "t", 4).collect()}
    for k, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert (got[k]["ids"], got[k]["n_tokens"], got[k]["truncated"], got[k]["error"]) == (ids[:4], len(ids), len(ids) > 4, None)
    whole = K.tokenised(df, public_tokenizers.path("piece_bpe_32k.model"), "t").where("k = 4").first()
    assert len(whole["ids"]) == whole["n_tokens"] >= 500 and not whole["truncated"]
    assert K.tokenised(df.limit(0), path, "t").count() == 0


def test_failures_are_rows(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "t string")
    for path, said in (("/none.json", "Exception"), ("x.unknown", "no tokenizer for x.unknown")):
        rows = K.tokenised(df, path, "t").collect()
        assert len(rows) == 2 and all(r["ids"] is None and said in r["error"] for r in rows)
    rows = K.gated_texts(df.select(F.col("t").alias("anchor"), F.col("t").alias("prompt")), "words", "x.unknown").collect()
    assert all("no tokenizer" in r["error_type"] and r["prompt_tokens"] is None for r in rows)
    K.register("short", lambda path: lambda texts: [[1]])
    assert "1 results for 2 texts" in K.tokenised(df.coalesce(1), "short", "t").first()["error"]


def longest_first(a, b, room):
    """One token after the other: of the longer side, and of two as long of the second."""
    while a + b > room:
        if a > b:
            a -= 1
        else:
            b -= 1
    return a, b


def test_the_longer_text_is_cut_first():
    for room in range(12):
        for a in range(15):
            for b in range(15):
                assert K.pair_lengths(a, b, room) == longest_first(a, b, room), (a, b, room)


def test_training_pairs(spark):
    df = spark.createDataFrame([("a b c", "d", 1), ("a " * 9, "b " * 9, 0), (None, "", 1)], "x string, y string, l long")
    rows = K.training_pairs(df, "words", "x", "y", 8, "l", ([101], [102], [102]), 7).collect()
    assert [(len(r["input_ids"]), sum(r["attention_mask"]), r["n_tokens"], r["truncated"], r["labels"]) for r in rows] == [(8, 7, 7, False, 1), (8, 8, 21, True, 0), (8, 3, 3, False, 1)]
    assert rows[2]["input_ids"] == [101, 102, 102, 7, 7, 7, 7, 7] and rows[0]["input_ids"][-1] == 7 and rows[0]["error"] is None
    with pytest.raises(ValueError):
        K.training_pairs(df, "words", "x", "y", 2, "l", ([1], [2], [3]))


def test_gates_of_texts(spark):
    df = spark.createDataFrame([(1, "a b", "p " * 10), (2, "a " * 300, "p"), (3, "a", "p " * 4090), (4, "a " * 100, "p " * 3990)], "k int, anchor string, prompt string")
    got = {r["k"]: (r["anchor_tokens"], r["prompt_tokens"], r["max_output_tokens"], r["error_type"]) for r in K.gated_texts(df, "words", "words").collect()}
    assert got == {1: (2, 10, 64, None), 2: (300, 1, 346, "DebertaAnchorTooLong"), 3: (1, 4090, 6, "QwenContextOverflow"), 4: (100, 3990, 106, None)}
    pairs = K.pair_gate(df.select("k", "anchor", F.col("prompt").alias("generated")), "words", max_pair=303)
    assert {r["k"]: (r["pair_tokens"], r["error_type"]) for r in pairs.where("k < 3").collect()} == {1: (15, None), 2: (304, "DebertaPairTooLong")}


def test_tables_of_word_vectors(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "word string, vector array<double>")
    table.coalesce(1).write.parquet(str(tmp_path / "t"))
    path = spark.read.parquet(str(tmp_path / "t")).inputFiles()[0]
    V.register_table("abc", path)
    df = spark.createDataFrame([("A", "a a"), ("a b", "a"), ("a", "c"), ("x", "a"), (None, "a"), ("a", "b")], "text_a string, text_b string")
    assert [round(r["raw_score"], 4) for r in V.score_pairs(df.coalesce(1), "abc").collect()] == [1.0, 0.7071, -1.0, 0.0, 0.0, 0.0]
    V.register_table("gone", str(tmp_path / "none.parquet"))
    rows = V.score_pairs(df, "gone").collect()
    assert len(rows) == 6 and all(r["raw_score"] is None and "FileNotFoundError" in r["error"] for r in rows)
    V.SCORERS.pop("abc"), V.SCORERS.pop("gone")


def test_lexical_stays_in_the_engine(spark):
    texts = [("a B c", "b\u3000C d"), ("", None), (None, "x"), ("same same", "same"), ("é Ä", "ä é")]
    df = spark.createDataFrame(texts, "text_a string, text_b string")
    rows = V.score_pairs(df, "lexical")
    assert [r["raw_score"] for r in rows.collect()] == V.lexical(*[[t or "" for t in side] for side in zip(*texts)])["raw_score"]
    assert "Arrow" not in rows._jdf.queryExecution().executedPlan().toString() and rows.columns == ["text_a", "text_b", "scorer", "raw_score", "error"]


def test_error_profiles_and_chat_templates(spark):
    rows = spark.createDataFrame([("p", "s", 1, 300, 10), ("q", "s", 2, 5, 4090), ("r", "s", 3, 5, 10)], "pair_id string, source_sample_id string, step_index int, anchor_tokens int, prompt_tokens int")
    errors = G.gate_errors(rows)
    got = {r["pair_id"]: r for r in N.profiled_errors(errors).collect()}
    assert (got["p"]["error_type"], got["p"]["observed_tokens"], got["p"]["limit"], got["p"]["prompt_tokens"]) == ("DebertaAnchorTooLong", 300, 224, None)
    assert (got["q"]["error_message"], got["q"]["prompt_tokens"], got["q"]["max_output_tokens"], got["q"]["min_output_tokens"], got["q"]["limit"]) == ("Prompt and output budget do not fit the context window", 4090, 6, 64, 4096) and "r" not in got
    assert "step_index" not in N.profiled_errors(errors).columns and N.profiled_errors(errors, "audit").columns[-2:] == ["source_sample_id", "step_index"]
    with pytest.raises(ValueError):
        N.profiled_errors(errors, "all")
    prompts = spark.createDataFrame([("hi",), ("you",)], "prompt string")
    template = lambda: lambda messages: "".join(f"<{m['role']}>{m['content']}" for m in messages) + "<assistant>"
    assert [r["rendered"] for r in G.rendered(prompts, template).collect()] == ["<user>hi<assistant>", "<user>you<assistant>"]
    assert [(r["rendered"], r["error"]) for r in G.rendered(prompts).collect()] == [("hi", None), ("you", None)]
    assert all("KeyError" in r["error"] and r["rendered"] is None for r in G.rendered(prompts, lambda: lambda m: m[0]["none"]).collect())


def test_counts_hold_a_slice_at_once(monkeypatch):
    held = []
    monkeypatch.setattr(K, "SLICE_CHARS", 100)
    got = K._counts(lambda texts: (held.append(sum(map(len, texts))), [t.split() for t in texts])[1], pa.array(["a b "] * 90 + [None, "x " * 500, "", "y"]))
    assert got.to_pylist() == [2] * 90 + [0, 500, 0, 1] and sum(held) == 1361 and sorted(held)[-2] <= 104
    split = K._words("words")
    split([" ".join(map(str, range(3 * K.KNOWN_WORDS)))])
    assert len(split.__closure__[0].cell_contents.__closure__[0].cell_contents) <= K.KNOWN_WORDS + 1


def test_gates_are_one_pass(spark):
    df = spark.createDataFrame([("a b", None)], "anchor string, prompt string")
    rows = K.gated_texts(df, "words", "words")
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert (rows.first()["anchor_tokens"], rows.first()["prompt_tokens"]) == (2, 0)
