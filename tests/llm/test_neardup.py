"""Near duplicates against brute force."""

import random
import re
from math import comb

import numpy as np
import pytest

from tracewise.llm import neardup
from tracewise.llm.components import components

DOCS = "doc_id long, text string, n_shingles string"


def sets(rows, k):
    out = {}
    for i, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.setdefault(i, set()).update({tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    return out


def brute(rows, k, percent=80):
    s = sets(rows, k)
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, s


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice((1, 2, 5, 40, 120)))]
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, max(0, len(base) // 8))):
                text[rng.randrange(len(text))] = word()
            rows.append((n, rng.choice((" ", "\n", "\t ")).join(text).upper() if n % 3 == 0 else " ".join(text)))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One"), (n + 4, "one"), (n + 5, "x " * 40_000)]


@pytest.mark.parametrize("k", [2, 5])
def test_groups_match_brute_force(spark, k):
    rows = corpus(k)
    random.Random(1).shuffle(rows)
    want, own = brute(rows, k)
    got = neardup.groups(spark.createDataFrame([(i, t, "old") for i, t in rows], DOCS), k=k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(own[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])


def test_star_of_edited_copies_in_blocks(spark, monkeypatch):
    """Copies that are near the base and not near each other, over several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(100, " ".join(base))]
    for i in range(40):
        text = list(base)
        for j in rng.sample(range(200), 10):
            text[j] = f"e{i}x{j}"
        rows.append((i, " ".join(text)))
    want, _ = brute(rows, 2)
    got = neardup.groups(spark.createDataFrame([(i, t, "") for i, t in rows], DOCS), k=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_repeated_null_and_empty(spark):
    rows = [(7, "a b c d e f g", ""), (7, "a b c d e f g", ""), (None, "a b c d e f g", ""), (9, "a  b c d e f G", ""), (None, None, "")]
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in neardup.groups(spark.createDataFrame(rows, DOCS), k=2).collect())
    assert got == [("7", 7, True), ("7", 7, True), ("9", 7, False), ("None", None, None), ("None", None, None)]
    kept = neardup.deduped(spark.createDataFrame(rows, DOCS), k=2)
    assert kept.columns == ["doc_id", "text", "n_shingles"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["7", "None", "None"]
    none = spark.createDataFrame([], DOCS)
    assert neardup.groups(none).count() == 0 and neardup.deduped(none).count() == 0


def test_posterior_bounds():
    least = neardup.least_matches(80, miss=1e-6)
    assert list(least) == list(range(neardup.BATCH, neardup.VALUES + 1, neardup.BATCH))
    for n, m in least.items():
        tail = lambda m: sum(comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(m + 1))
        assert tail(m - 1) < 1e-6 <= tail(m)


def test_signatures_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[:800], (np.arange(5000, 5100, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)])
    sig = neardup.signatures([np.sort(a), np.sort(b)])
    assert abs((sig[0] == sig[1]).mean() - 800 / 1100) < 0.12
    assert (neardup.signatures([np.sort(np.tile(a, 80))])[0] == sig[0]).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 300), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
