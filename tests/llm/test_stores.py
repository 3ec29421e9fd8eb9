"""WARC archives, the quality classifier and nearest neighbours."""

import base64
import hashlib
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.llm import ann, quality, warc

PAGES = "page_id long, url string, html string, archive string"


def pages(n=700):
    rows = [(i, f"http://h{i % 3}.example.org/p?{i % 40}", f"<p>é {i % 50}</p>" if i % 7 else None, "x") for i in range(n)]
    return [*rows, (n, None, "", "x"), (n + 1, "http://[bad", "z" * 300_000, "x"), (n + 2, "http://a.b/ c\r\nd", "\r\n\r\nWARC/1.1\r\n", "x"), (5, "http://again.org", "<p>é 5</p>", "x"), (None, "http://n.org", "<p>é 5</p>", "x")]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    rows = pages()
    archive = warc.write(spark.createDataFrame(rows, PAGES).repartition(5))
    got = warc.lookup(archive, archive.captures.select("url_key", "page_id").distinct()).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = sorted(((i, h or "") for i, _, h, _ in rows), key=str)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    said = {(r["page_id"], r["payload_digest"]): r for r in got}
    assert len(got) == len(rows) and sorted((r["page_id"], r["payload_bytes"]) for r in got if r["page_id"] is not None) == sorted((i, len(h.encode())) for i, h in want if i is not None)
    for i, h in want:
        r = said[i, digest(h)]
        later = i is not None and i > first[h]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h]) if later else ("response", None))
        assert r["payload"] == (None if later else h.encode())


def test_lookup_reads_only_what_is_asked(spark):
    archive = warc.write(spark.createDataFrame(pages(), PAGES))
    ask = spark.createDataFrame([(warc.url_key("http://h1.example.org/p?1"), 1), ("nowhere", 1), (warc.url_key("http://h1.example.org/p?1"), 2)], "url_key string, page_id long")
    assert [r["page_id"] for r in warc.lookup(archive, ask).collect()] == [1]


def test_no_pages(spark):
    archive = warc.write(spark.createDataFrame([], PAGES))
    assert warc.lookup(archive, archive.captures.select("url_key", "page_id")).count() == 0


def test_url_keys():
    assert warc.url_key("https://M.Example.com:8080/a?b=1#c") == "com,example,m:8080)/a?b=1#c"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad x") == "http://[badx"


def labelled(n=600):
    good = lambda i: " ".join(f"word{(i * 7 + j) % 90}" for j in range(30)) + ".\nAnd more of it here."
    bad = lambda i: " ".join(f"W{(i + j) % 4}$$$ %%%" for j in range(30))
    return [(i, good(i) if i % 4 else bad(i), "x") for i in range(n)], [(i, int(i % 4 > 0), 0) for i in range(n)]


def test_quality_on_held_out_rows(spark):
    texts, labels = labelled()
    docs = spark.createDataFrame([*texts, (900, None, "x"), (901, "", "x"), (5, texts[5][1], "x"), (None, "some text", "x"), (902, "long words here. " * 20_000, "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (900, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fitted(docs, marks, rows=300)
    rows = quality.scored(docs, model).withColumn("out", quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert all(crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held) and len(held) > 100
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 > 0) for r in held]) > 0.95
    again = quality.scored(docs.repartition(3), quality.fitted(docs.repartition(6), marks, rows=300)).collect()
    assert sorted(r["score"] for r in again) == pytest.approx(sorted(r["score"] for r in rows))


def test_quality_without_two_classes(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(9)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.scored(docs, quality.fitted(docs, none)).collect()} == {0.5}
    assert quality.scored(docs.limit(0), quality.Constant(0.5)).count() == 0


def test_pairwise_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    stats, *sparse = quality.features([b"a b c a", b"d e"])
    m = quality.Machine(quality.Steps(stats), 0.3)
    m.linear = rng.normal(size=m.linear.shape)
    got, _ = m.raw(m.steps(stats), *sparse)
    for d in range(2):
        x = np.zeros(len(m.linear))
        own = sparse[0] == d
        x[sparse[1][own]] = sparse[2][own]
        x[quality.WORD_SLOTS :] = m.steps(stats)[d]
        on = np.flatnonzero(x)
        pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for n, i in enumerate(on) for j in on[n + 1 :])
        assert got[d] == pytest.approx(0.3 + m.linear @ x + pairs)


VECTORS = "vec_id long, embedding array<float>, rank string"


def exact(rows, limit=20):
    own = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    ids = np.array(sorted(own))
    x = np.stack([own[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ own[q]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:limit]
        out[int(q)] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=24) * (1 + i % 3)).tolist()) for i in range(3000)]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(*r, "x") for r in rows], VECTORS), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    own = dict(rows)
    for q, v in got.items():
        assert [s for _, s in v] == sorted((s for _, s in v), reverse=True)
        for i, s in v:
            assert s == pytest.approx(float(np.dot(np.float32(own[q]).astype(float), np.float32(own[i]).astype(float))))


def test_copies_ties_and_unfit_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    rows = [(i, base[0].tolist() if i < 50 else base[i % 40].tolist()) for i in range(120)]
    bad = [(200, None), (220, []), (240, [0.0] * 8), (260, [float("nan")] * 8), (280, [1.0, float("inf")] + [0.0] * 6), (300, [None] + [1.0] * 7), (320, [1.0] * 5), (None, [1.0] * 8)]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(*r, "x") for r in rows + bad], VECTORS), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in v] for q, v in exact(rows).items()}


def test_few_vectors(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    got = ann.nearest(frame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 0.5), (2, -1.0)]
    assert ann.nearest(frame([(0, [1.0, 0.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(frame([]), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_that_share_an_id(spark):
    """Rows of one id are candidates of each other, and queries each."""
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame([(*r, "x") for r in rows], VECTORS), F.col("vec_id") % 20 == 0).collect()
    near = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 4)) for r in got)
    assert near == sorted([(0, 1, 0, 0.9), (0, 2, 1, 0.5), (0, 3, 1, 0.5), (0, 4, 2, -1.0), (0, 1, 0, 0.9), (0, 2, 1, 0.5), (0, 3, 1, 0.5), (0, 4, 2, -0.9)])


@pytest.mark.parametrize("n", [1200, 2400])
def test_recall_on_clusters_with_many_leaves(spark, monkeypatch, n):
    """Clustered vectors, a third of all rows one vector, and trees of many leaves, so that rounds and hops do the work, at two sizes."""
    monkeypatch.setattr(ann, "LEAF", 64)
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(25, 16))
    rows = [(i, centres[0].tolist() if i % 3 == 1 else (centres[i % 25] + rng.normal(scale=0.4, size=16)).tolist()) for i in range(n)]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(*r, "x") for r in rows], VECTORS), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
