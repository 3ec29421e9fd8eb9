"""Sharding and mixing."""

from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tracewise.llm import mixing, sharding

DOCS = "doc_id long, text string, source string, shard string, size string"


def docs(spark, n=300):
    rows = [(i, None if i % 50 == 3 else "é" * (i % 97) + " w" * (i % 13), None if i % 41 == 0 else f"s{i % 4 if i % 3 else 0}", "old", "x") for i in range(n)]
    return spark.createDataFrame([*rows, *rows[:5], (None, "no id", "s1", "old", "x"), (None, None, None, "old", "x")], DOCS)


def test_shards_are_even_gapless_and_whole(spark):
    d = docs(spark)
    got = sharding.shard(d, shards=4).collect()
    assert len(got) == d.count()
    places, load = defaultdict(list), Counter()
    for r in got:
        text = (r["text"] or "").encode()
        assert r["_shard_size"] == len(text) + 1 and r["_shard_crc"] == crc32(text)
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["_shard_size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values())
    assert "old" not in {r["shard"] for r in got}


def test_shards_of_no_rows(spark):
    assert sharding.shard(docs(spark).limit(0)).count() == 0


def test_map_versions_and_edits(spark, tmp_path):
    store = f"file://{tmp_path}/map"
    sharding.shard(docs(spark), shards=4, store=store).count()
    v0, v1 = (sharding.load_map(spark, store, v) for v in (0, 1))
    assert v0.count() == v1.count() == sharding.SLOTS
    assert v0.agg(F.sum("rows")).first()[0] == docs(spark).count()
    weights = [(i * 7919) % 1000 for i in range(sharding.SLOTS)]
    owner = sharding.rebalanced(sharding.first_map(16), weights, 16)
    load = Counter()
    for o, w in zip(owner, weights):
        load[o] += w
    heaviest = max(load, key=load.get)
    assert max(load.values()) - min(load.values()) <= min(w for o, w in zip(owner, weights) if o == heaviest and w)
    grown = sharding.rebalanced(owner, weights, 17)
    assert sum(a != b for a, b in zip(owner, grown)) < 2 * sharding.SLOTS / 17
    assert {o for o in sharding.rebalanced(owner, weights, 15)} == set(range(15))
    assert sharding.rebalanced([0] * sharding.SLOTS, [0] * sharding.SLOTS, 4) == [0] * sharding.SLOTS


def poured(sizes, share=1.5, most=2.0):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def test_mix_meets_targets(spark):
    d = docs(spark)
    got = mixing.mix(d, mixing.n_words(F.col("text"))).collect()
    assert len(got) == d.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = poured(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    again = mixing.mix(d.repartition(7), mixing.n_words(F.col("text")))
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert key(got) == key(again.collect())


def test_mix_whole_rows_and_edges(spark):
    d = docs(spark)
    mixed = mixing.mix(d, mixing.n_words(F.col("text")), whole=True)
    rows = mixed.collect()
    assert all(r["size"] == 0 or r["taken"] % r["size"] == 0 for r in rows)
    assert mixing.repeated(mixed).count() == sum(r["taken"] // r["size"] if r["size"] else 1 for r in rows)
    assert mixing.mix(d.limit(0), mixing.n_words(F.col("text"))).count() == 0
    empty = mixing.mix(d.where("text IS NULL"), mixing.n_words(F.col("text"))).collect()
    assert empty and all(r["taken"] == 0 and r["target"] == 0 for r in empty)
