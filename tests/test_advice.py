"""Whole jobs: what earlier versions of operators and queries left out."""

from hashlib import sha256
from pathlib import Path

import pytest

from tracewise.operators import sampling as B
from tracewise.plans import queries


def test_few_shots_of_small_and_large_pools(spark):
    """Each request draws distinct items of its kind, the same on every run; a kind with too few raises, or gives what it has."""
    items = [(i, "ab"[i % 3 == 0]) for i in range(60)] + [(7, "a")] * 2 + [(None, "a")]
    asked = [(f"r{i}", "ab"[i % 2], i // 4) for i in range(20)] + [("no seed", "a", None), ("none", "c", 1)]
    pool, requests = spark.createDataFrame(items, "item long, kind string"), spark.createDataFrame(asked, "pair_id string, kind string, generation_seed long")
    place = {k: {i: n for n, i in enumerate(sorted({i for i, x in items if x == k and i is not None}, key=lambda i: (sha256(f"42:{k}:{i}".encode()).hexdigest(), i)), 1)} for k in "ab"}

    def drawn(kind, seed, k):
        out = []
        for j in range(k):
            left = sorted(set(place[kind].values()) - set(out))
            out.append(left[int(sha256(f"{seed or 0}:{j}".encode()).hexdigest()[:12], 16) % len(left)])
        back = {n: i for i, n in place[kind].items()}
        return [back[n] for n in out]

    for k in (3, 20):
        got = {r["pair_id"]: r["items"] for r in B.per_request_sample(requests.repartition(3), pool, "kind", "pair_id", "item", k, short="drop").collect()}
        assert got == {r: drawn(kind, seed, k) for r, kind, seed in asked if kind != "c"}
        assert all(len(set(v)) == k for v in got.values())
    assert len(B.per_request_sample(requests.where("pair_id = 'r1'"), pool, "kind", "pair_id", "item", 30, short="drop").first()["items"]) == 20
    for few in (requests, requests.where("kind = 'b'")):
        with pytest.raises(Exception, match="asked of the pool"):
            B.per_request_sample(few, pool, "kind", "pair_id", "item", 30 if few is not requests else 3).collect()
    many = spark.range(10_001).selectExpr("id AS item", "'a' AS kind")
    assert len(set(B.per_request_sample(requests.where("pair_id = 'r0'"), many, "kind", "pair_id", "item", 3).first()["items"])) == 3


def test_few_shots_takes_the_whole_benchmark(spark, sf, tmp_path):
    for t in Path(sf).glob("*.parquet"):
        if t.stem != "benchmark":
            (tmp_path / t.name).symlink_to(t)
    spark.range(1200).selectExpr("id AS item_id", "'x' AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries.queries()["few_shots"](spark, str(tmp_path)).collect()
    assert max(int(i) for r in rows for i in r["items"].split(",")) >= 1000
