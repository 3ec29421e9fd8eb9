"""Token counts, decontamination, line dedup and license scans."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewise.llm import decontamination as dc
from tracewise.llm import licenses, lines, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counts():
    return tokens.Counts(PATH)


def test_whole_tokens_are_proved(counts):
    some = sorted(counts.whole)[::211]
    assert all(len(counts.tokenizer.encode(s, add_special_tokens=False).ids) == 1 for s in some) and len(counts.whole) > 40_000


def test_counts_match_the_library(counts):
    rng = random.Random(2)
    pool = "ab Ze's'  \n\t\x0b\x1c\x1f\x85 \xa0　éñ漢一²½ªº<|endoftext|>!?.…​😀ǅⅣ'reI'llɐɏ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) + ("<|endoftext|>x" if i % 9 == 0 else "") for i in range(3000)]
    texts += ["", " ", "word " * 20_000, "a" * 5000, "<|endoftext|>" * 3]
    assert counts.count(texts) == [len(e.ids) for e in counts.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pattern_agrees_on_all_characters(counts):
    """Character classes of the modules and the library: a sample of all code points, and all of the low ones."""
    chars = [chr(c) for c in [*range(1, 0x3100), *range(0x3100, 0x110000, 37)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}!{c}{c} {c}b" for c in chars]
    assert counts.count(texts) == [len(e.ids) for e in counts.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_counted_rows(spark):
    df = spark.createDataFrame([(1, "héllo <|endoftext|>", "x"), (2, None, "y"), (2, None, "y")], "doc_id long, text string, n_tokens string")
    got = tokens.counted(df, PATH).collect()
    assert [(r["n_bytes"], r["n_tokens"]) for r in got][1:] == [(0, 0), (0, 0)] and got[0]["n_bytes"] == 20
    assert tokens.counted(df.limit(0), PATH).count() == 0


def test_fm_index_against_scan():
    rng = random.Random(4)
    for _ in range(150):
        seq = [rng.randint(1, 4) for _ in range(rng.randint(1, 90))]
        index = dc.FMIndex(np.array(seq), 5)
        patterns = [[rng.randint(2, 4) for _ in range(rng.randint(1, 5))] for _ in range(5)]
        wide = np.zeros((5, 5), dtype=np.int64)
        for i, p in enumerate(patterns):
            wide[i, -len(p) :] = p
        low, high = index.search(wide, np.array([len(p) for p in patterns]))
        for i, p in enumerate(patterns):
            assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == [j for j in range(len(seq) - len(p) + 1) if seq[j : j + len(p)] == p]


WORD = rb"[0-9a-z\x80-\xff]+"


def leaks(text, items, window):
    found = list(re.finditer(WORD, (text or "").encode().lower()))
    words = [m.group() for m in found]
    hit, ids = set(), set()
    for item, t in items:
        own = re.findall(WORD, (t or "").encode().lower())
        for i in range(max(1, len(own) - window + 1) if own else 0):
            w = own[i : i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    ids.add(str(item))
    return words, hit, sorted(ids), found


def leak_case():
    rng = random.Random(8)
    word = lambda: rng.choice(("a", "bé", "c1", "dd", "e-e"))
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 3, 4, 6, 9))))) for i in range(2, 30, 2)] + [(30, None), (31, ""), (32, "..."), (2, "zz yy xx ww vv")]
    items = [x for x in items if x[1] is None or len(re.findall(WORD, x[1].encode().lower())) != 1] + [(40, "uniq")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "zz YY, xx. ww! vv", "q uniq q", "x " * 30_000 + "zz yy xx ww"]
    return items, texts


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 60])
def test_decontamination_against_scan(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    items, texts = leak_case()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit("old"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in dc.find(docs, bench, window=4, clean=True).collect():
        words, hit, ids, found = leaks(r["text"], items, 4)
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(words), len(hit), ids)
        assert {w for s in r["spans"] for w in range(s["first_word"], s["end_word"])} == hit
        raw = (r["text"] or "").encode()
        for s in r["spans"]:
            assert (s["first_byte"], s["end_byte"]) == (found[s["first_word"]].start(), found[s["end_word"] - 1].end())
        if r["text"] is not None:
            assert re.findall(WORD, r["clean_text"].encode().lower()).__len__() <= len(words) and len(r["clean_text"].encode()) == len(raw) - sum(s["end_byte"] - s["first_byte"] for s in r["spans"])


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find(docs, none).first()["n_hit"] == 0
    assert dc.find(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def kept_lines(rows):
    key = lambda x: x.strip(b" \t\n\r\x0b\x0c").lower()
    first, docs = {}, {}
    for i, t in rows:
        for x in (t or "").encode().split(b"\n"):
            if i is not None and len(key(x).decode()) >= 10:
                docs.setdefault(key(x), set()).add(i)
    first = {k: min(v) for k, v in docs.items() if len(v) > 1}
    out = []
    for i, t in rows:
        own = (t or "").encode().split(b"\n")
        kept = [x for x in own if i is None or first.get(key(x), i) == i]
        out.append((i, len(own), len(own) - len(kept), b"\n".join(kept).decode()))
    return sorted(out, key=str)


def line_rows(seed=1, first=0, n=60):
    rng = random.Random(seed)
    pool = ["short", "exactly ten", "ten chars!", "ééééééééé", "éééééééééé", "", "  A Line of Text \t", "a line of text", "another line that repeats", "ANOTHER line that repeats\r"]
    return [(first + i, "\n".join(rng.choice([*pool, f"unique line number {rng.random()}"]) for _ in range(rng.randint(1, 8)))) for i in range(n)]


def test_lines_against_plain_code(spark):
    rows = [*line_rows(), (200, None), (201, ""), (3, "a line of text\nsomething else here"), (None, "a line of text"), (202, "y" * 100_000 + "\n" * 1000)]
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, kept_text string")
    store = lines.LineStore(spark, shards=4)
    store.insert(df)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.deduped(df, store).collect()), key=str)
    assert got == kept_lines(rows)


def test_lines_are_reversible(spark):
    one, two = line_rows(1), line_rows(2, first=100, n=40)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    view = lambda store, rows: sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.deduped(frame(rows), store).collect()), key=str)
    store = lines.LineStore(spark, shards=4)
    store.insert(frame(one))
    store.insert(frame(two))
    assert view(store, one + two) == kept_lines(one + two)
    gone = [(i, t) for i, t in one if i < 30]
    store.delete(frame(gone))
    rest = [x for x in one + two if x not in gone]
    assert view(store, rest) == kept_lines(rest)
    keys = store.references()
    assert keys.where("refs < 1").count() == 0 and store.known(keys.select("shard", "hi", "lo")).where("NOT maybe").count() == 0
    store.insert(frame(gone))
    assert view(store, one + two) == kept_lines(one + two)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    hi, lo = (rng.integers(-(1 << 63), 1 << 63, 20_000) for _ in range(2))
    f = lines.CuckooFilter(20_000)
    assert f.insert(hi, lo) and f.has(hi, lo).all()
    other = rng.integers(-(1 << 63), 1 << 63, 20_000)
    assert f.has(other, lo[::-1].copy()).mean() < 0.01
    f.delete(hi[:10_000], lo[:10_000])
    assert f.has(hi[10_000:], lo[10_000:]).all() and f.has(hi[:10_000], lo[:10_000]).mean() < 0.01
    back = lines.CuckooFilter.loaded(f.dumped())
    assert (back.table == f.table).all()


MIT = """MIT License

Copyright (c) 2020 Someone

{}

{}

{}
"""


def test_licenses(spark):
    s = licenses.SENTENCES
    full = MIT.format(s["mit-grant"].replace(" copy of", "\ncopy of"), s["mit-notice"], s["mit-warranty"])
    rows = [(1, full), (2, "Text. released under the MIT license! More.\nLicensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "The word license alone."), (6, "x. " * 20_000 + s["gpl3-ref"]), (6, s["apache-ref"]), (7, s["mit-grant"] + "\n" + s["mit-warranty"])]
    got = licenses.scanned(spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, matches string")).collect()
    found = [(r["doc_id"], [(m["license"], licenses.RULES[m["rule"]][1][0]) for m in r["matches"]]) for r in got]
    assert found == [(1, [("MIT", "mit-grant")]), (2, [("MIT", "mit-ref"), ("CC-BY-NC-4.0", "cc-by-nc-ref")]), (3, []), (4, []), (5, []), (6, [("GPL-3.0", "gpl3-ref")]), (6, [("Apache-2.0", "apache-ref")]), (7, [])]
    assert got[0]["n_known"] == 4 and got[2]["n_sentences"] == 0
    assert hashlib.md5(b"").hexdigest() and licenses.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
