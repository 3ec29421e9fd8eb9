"""Places in an order and in digest order: ranges that grow with rows, ties that are parted, and CPython's shuffle."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.operators import sampling as B
from tracewise.operators import scorers as V


def test_one_value_is_several_ranges(spark, tmp_path):
    """A first column that is the same in all rows, and rows that are the same in all columns."""
    rows = spark.range(60_000).select(F.lit("same").alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 100).alias("c")).repartition(6)
    placed, n = B.placed_in_order(rows, ["a", "b"], 5_000)
    assert n == 60_000 and placed.columns == ["a", "b", "c", "_n"]
    got = placed.orderBy("_n").select("b", "_n").toPandas()
    assert (got["_n"].to_numpy() == np.arange(1, n + 1)).all() and (np.diff(got["b"]) >= 0).all()
    files = [spark.read.parquet(f).count() for f in placed.inputFiles()]
    assert len(files) >= 11 and max(files) < 15_000
    constant = spark.range(20_000).select(F.lit(1).alias("a")).repartition(4)
    placed, _ = B.placed_in_order(constant, ["a"], 2_000)
    assert max(spark.read.parquet(f).count() for f in placed.inputFiles()) < 8_000 and placed.select("_n").distinct().count() == 20_000


def test_places_of_few_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "b"), (2, None), (None, "a"), (1, "é")], "v long, t string")
    placed, n = B.placed_in_order(rows, ["v", "t"])
    assert n == 4 and [(r["v"], r["t"]) for r in placed.orderBy("_n").collect()] == [(None, "a"), (None, "b"), (1, "é"), (2, None)]
    assert B.placed_in_order(rows.limit(0), ["v"])[1] == 0 and B.placed_in_order(rows.limit(0), ["v"])[0].count() == 0
    odd = rows.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    assert B.placed_in_order(odd, ["t"])[0].count() == 4
    assert sorted(r["split"] for r in B.head_split(rows, ["v"], 0.5).collect()) == ["train", "train", "val", "val"]


def test_ranges_of_digests_grow(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    want = {(r["g"], r["k"]): (r["_n"], r["_of"]) for r in B.ranked_groups(rows, ["g"], "k", 7).collect()}
    sample = {r["k"] for r in B.ratio_sample(rows, "k", 0.1).collect()}
    assert B._digits(rows) == 2 and len(sample) == 300
    monkeypatch.setattr(B, "RANGE_ROWS", 1)
    assert B._digits(rows) == 3
    assert {(r["g"], r["k"]): (r["_n"], r["_of"]) for r in B.ranked_groups(rows, ["g"], "k", 7).collect()} == want
    assert {r["k"] for r in B.ratio_sample(rows, "k", 0.1).collect()} == sample


@pytest.mark.parametrize("seed", [0, 7, 42])
def test_legacy_order_is_the_interpreters(spark, seed, monkeypatch):
    ids = [f"id é{k * 7919 % 1000}" for k in range(500)]
    rows = spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], "id string").repartition(5)
    want = sorted(set(ids))
    random.Random(seed).shuffle(want)
    got = B.legacy_order(rows, "id", seed).orderBy("_n").collect()
    assert [r["id"] for r in got] == want and [r["_n"] for r in got] == list(range(1, len(want) + 1))
    monkeypatch.setattr(B, "LEGACY_IDS", 499)
    with pytest.raises(ValueError, match="at most 499"):
        B.legacy_order(rows, "id", seed)


def test_shuffle_is_dealt_by_digest(spark):
    rows = spark.range(2000).repartition(7)
    got = [r["id"] for r in B.shuffled(rows, ["id"], 5, 6).collect()]
    again = [r["id"] for r in B.shuffled(spark.range(2000), ["id"], 5, 6).collect()]
    assert got == again and sorted(got) == list(range(2000)) and got != [r["id"] for r in B.shuffled(rows, ["id"], 6, 6).collect()]
    plan = B.shuffled(rows, ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "rangepartitioning" not in plan
    assert Counter(x < 1000 for x in got[:1000])[True] in range(400, 600)


def test_token_match_by_products(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 7)
    draw = np.random.default_rng(2)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(draw.normal(size=(n, 16)))
    pairs = [(unit(20), unit(33)), (unit(1), unit(1)), (unit(9), unit(7))]
    rows = [(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(pairs)] + [(3, [], [[1.0]]), (4, None, [[1.0]]), (5, [[1.0], [1.0, 2.0]], [[1.0]]), (6, [[1.0]], [[1.0, 0.0]]), (7, [[1.0], None], [[1.0]])]
    df = spark.createDataFrame(rows, "k long, a array<array<double>>, b array<array<double>>").repartition(3)
    got = {r["k"]: r["m"] for r in df.select("k", V.token_match(F.col("a"), F.col("b")).alias("m")).collect()}
    for k, (a, b) in enumerate(pairs):
        sims = a @ b.T
        p, r = sims.max(axis=0).mean(), sims.max(axis=1).mean()
        assert (got[k]["precision"], got[k]["recall"], got[k]["f1"]) == pytest.approx((p, r, 2 * p * r / (p + r)))
    assert tuple(got[3]) == (0.0, 0.0, 0.0) and [got[k] for k in (4, 5, 6, 7)] == [None] * 4
