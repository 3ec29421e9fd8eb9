"""The pipeline against brute force, stage by stage, and the numbered queries against SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_neardup import brute
from tests.llm.test_texts import leaks
from tracewise.llm import queries, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TABLES = "documents benchmark pages labels embeddings".split()


@pytest.fixture(scope="module")
def run(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        docs = spark.createDataFrame(got.collect(), got.schema)
        out.append((name, docs.collect(), docs.columns))
    return out


def test_stages_return_documents(spark, sf, run):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [c for _, _, c in run[:-1]] == [columns] * 4 and run[-1][2][: len(columns)] == columns


def test_each_stage_against_brute_force(spark, sf, run):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = [r for r in docs.collect() if model.score([(r["text"] or "").encode()])[0] >= 0.5]
    first, second, third, fourth, fifth = (rows for _, rows, _ in run)
    assert sorted(r["doc_id"] for r in first) == sorted(r["doc_id"] for r in good)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in first}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.97 * len(labels)

    group, _ = brute([(r["doc_id"], r["text"]) for r in first], 5)
    assert sorted(r["doc_id"] for r in second) == sorted({g for g in group.values()})

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    after = {r["doc_id"]: r for r in third}
    for r in second:
        words, hit, _, _ = leaks(r["text"], items, 10)
        if hit and len(hit) == len(words):
            assert r["doc_id"] not in after
        elif not hit:
            assert after[r["doc_id"]] == r
        else:
            assert len(after[r["doc_id"]]["text"]) < len(r["text"]) and after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])

    size = {r["doc_id"]: len(r["text"].split()) for r in third}
    source = {r["doc_id"]: r["source"] for r in third}
    times = Counter(r["doc_id"] for r in fourth)
    assert set(times) <= set(size) and max(times.values()) <= 2
    taken = sum(size[i] * n for i, n in times.items())
    assert abs(taken - 1.5 * sum(size.values())) <= len(set(source.values())) * max(size.values()) / 2 + 1

    assert Counter(r["doc_id"] for r in fifth) == times
    for s in range(16):
        slots = sorted(r["slot"] for r in fifth if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_run_gives_the_last_stage(spark, sf, run):
    got = corpus_pipeline.run(spark, sf)
    key = lambda rows: sorted((r["doc_id"], r["shard"]) for r in rows)
    assert key(got.collect()) == key(run[-1][1])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(tuple(r) for r in got.collect()) == plain(want)


def test_near_dedup_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, own = brute([tuple(r) for r in rows], 2)
    got = queries.queries()["op2_near_dedup"](spark, sf).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (c, len(own[i])) for i, c in want.items()}


def test_plans_of_native_queries_have_no_python(spark, sf):
    for name in ("op1_sharding", "op7_license_scan", "op8_mixing"):
        plan = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_query_columns(spark, sf):
    rows = queries.queries()["op9_quality"](spark, sf)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.where(F.col("held_out").isNull()).count() == 0
