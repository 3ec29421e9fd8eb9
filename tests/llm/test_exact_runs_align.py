"""Exact deduplication, periodic runs and token alignment against brute force, and at the edges."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from zlib import crc32

import public_tokenizers
import pytest
from tracewise.llm import align, exact, queries, runs
from tracewise.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, Keep_ID string, `a.b` string, Runs string, groups string, _node string, _numbers string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "d", "r", "g", "n", "u") for i, t in rows], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def exact_rows():
    long = "same beginning of two very long texts " * 8_000
    rows = [(1, "Copy"), (2, "cOPY"), (3, "copy "), (4, None), (5, ""), (6, long), (7, long.upper()), (8, long + "x"), (9, "É"), (10, "é"), (11, "x" * 64), (12, "x" * 64), (13, "x" * 65), (None, "copy"), (None, None), (None, "alone"), (1, "Copy"), (1, "copy")]
    return [*rows, *[(100 + i, "k" * (i % 400)) for i in range(900)], (None, "twice"), (None, "twice")]


def test_exact_groups_against_a_dictionary(spark):
    docs = frame(spark, exact_rows()).repartition(5)
    got = exact.groups(docs).collect()
    assert len(got) == docs.count()
    groups = defaultdict(list)
    for i, t in exact_rows():
        groups[lower(t)].append(i)
    rows = Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got)
    want = Counter((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert rows == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert got[0].__fields__ == ["doc_id", "a.b", "Runs", "groups", "_node", "_numbers", "keep_id", "group_size", "kept"]
    kept = exact.deduped(docs)
    assert kept.columns == [c for c in docs.columns if c != "Keep_ID"] and kept.count() == len(groups)
    assert {lower(r["text"]) for r in kept.collect()} == set(groups)
    assert exact.groups(docs.limit(0)).count() == 0


def test_exact_groups_that_hold_most_rows(spark, monkeypatch):
    """Hot groups at several depths, with short digits and a low bound, so that broadcast and exchange both take part."""
    monkeypatch.setattr(exact, "LEAST_HOT", 20)
    monkeypatch.setattr(exact, "FIRST", 2)
    monkeypatch.setattr(exact, "WIDEST", 16)
    rows = [(i, "hot text that many rows hold" if i % 3 else f"hot text that {i % 40} rows hold") for i in range(600)]
    rows += [(7, "hot text that many rows hold")] * 90
    got = exact.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter((i, max(g), len(g)) for g in groups.values() for i in g)
    assert sum(r["kept"] for r in got) == len(groups)
    many = [(1, "repeated row")] * 300
    got = exact.groups(spark.createDataFrame(many, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == 300 and sum(r["kept"] for r in got) == 1 and {r["group_size"] for r in got} == {300}


def brute_runs(w, least, times):
    n, out = len(w), set()
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            e = i + p
            if e - s >= max(least, times * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.add((s, e - s, p))
    return sorted(out)


def test_runs_against_brute_force():
    draw = random.Random(5)
    for _ in range(4000):
        w = [draw.randrange(draw.choice([1, 2, 2, 3, 5])) for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.6 and len(w) > 6:
            u = w[: draw.randint(1, 7)]
            w = w[:3] + u * draw.randint(2, 9) + w[3:]
        for least, times in ((2, 2), (5, 2), (8, 3), (24, 3)):
            assert runs.maximal_runs(w, least, times) == brute_runs(w, least, times), (w, least, times)


def test_runs_compare_few_words():
    def fibonacci(n):
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return b[:n]

    n = 40_000
    words = {
        "one word": (["a"] * n, 3), "period": (list("aab" * (n // 3)), 3), "period, then larger": ([*"abcabd" * (n // 6), "z"], 3), "growing blocks": ([x for k in range(1, 280) for x in [0] * k + [1]], 3),
        "shrinking blocks": ([x for k in range(280, 0, -1) for x in [0] * k + [1]], 4), "random": ([random.Random(1).randrange(2) for _ in range(n)], 3), "fibonacci": (fibonacci(n), 10), "thue-morse": ([i.bit_count() & 1 for i in range(n)], 10),
    }
    for name, (w, most) in words.items():
        count = [0]
        runs.maximal_runs(list(w), 24, 3, count)
        assert count[0] <= most * len(w), (name, count[0] / len(w))


def test_runs_of_documents(spark):
    rows = [(1, "a b " * 20), (2, None), (3, ""), (4, " \n"), (5, "start " + "x y z\n" * 9 + "end"), (6, "x y " * 11), (7, "w " * 60_000 + "z"), (1, "a b " * 20), (8, "é  " * 30)]
    docs = frame(spark, rows)
    got = runs.found(docs).collect()
    assert runs.found(docs).columns == [*[c for c in docs.columns if c != "Runs"], "n_words", "runs", "collapsed"]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and [tuple(x) for x in by[1]["runs"]] == [(0, 40, 2)] and by[1]["collapsed"] == "a b"
    assert [by[i]["n_words"] for i in (2, 3, 4)] == [0, 0, 0] and by[2]["collapsed"] == "" and by[2]["text"] is None
    assert [tuple(x) for x in by[5]["runs"]] == [(1, 27, 3)] and by[5]["collapsed"] == "start x y z end"
    assert by[6]["runs"] == [] and by[7]["collapsed"] == "w z" and by[8]["collapsed"] == "é "
    assert runs.found(docs.limit(0)).count() == 0


def words_of_op13(doc_id, text):
    words, h = (text or "").encode().split(), crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_op13_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got, some = queries.op13_runs(spark, sf).collect(), 0
    assert len(got) == len(texts)
    for r in got:
        words = words_of_op13(r["doc_id"], texts[r["doc_id"]])
        mine = brute_runs(words, 24, 3) if len(words) < 600 else runs.maximal_runs(words)
        best = min(mine, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        gone = {k for s, n, p in mine for k in range(s + p, s + n)}
        some += len(mine)
        assert r["n_runs"] == len(mine)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in mine).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
    assert some > 10


@pytest.fixture(scope="module")
def aligned():
    """Whole texts aligned one by one: tokens, cuts, groups and links, with the counts of pairs over all of them."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: k for k, c in enumerate(byte_letters())}
    bytes_a = {i: bytes(back[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
    bytes_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())}

    def one(text):
        if not text:
            return None
        ids, sides, whole = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)), [], f" {text}".encode()
        for side, of in zip(ids, (bytes_a, bytes_b)):
            if b"".join(of[i] for i in side) != whole:
                return None
            end, ends = 0, []
            for i in side:
                end += len(of[i])
                ends.append(end)
            sides.append(dict(zip(ends, side)))
        cuts = sorted(sides[0].keys() & sides[1].keys())
        groups = [([], []) for _ in cuts]
        for k in (0, 1):
            for end, i in sides[k].items():
                groups[bisect_left(cuts, end)][k].append(str(i))
        return len(ids[0]), len(ids[1]), [(sides[0][c], sides[1][c]) for c in cuts], ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)

    def every(rows):
        found = [(i, one(t)) for i, t in rows]
        counts, highest = Counter(p for _, f in found if f for p in f[2]), Counter()
        for (x, y), n in counts.items():
            highest[y] = max(highest[y], n)
        return counts, [(i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, f[0], f[1], len(f[2]), len(f[2]), sum(counts[p] == highest[p[1]] for p in f[2]), sum(counts[p] for p in f[2]), f[3]) for i, f in found]

    return every


ODD_TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "  a  b ", "a\n b", "a \n b\t  c\n\n  d", "tabs\t and  spaces　 of all kinds", "<|endoftext|> <s>x</s> <0x41> it's we'll", "▁ not aligned", "\x00 \x1c b", "\U0001f600 日本語の文 é́ ﻿",
    "word " * 3000, "x" * 5000, "日本" * 3000, "ends in spaces    ", "12345 67890 !!! ??? --- a-b", "a b c a b c a b c",
]


def test_alignment_of_odd_texts(spark, aligned, monkeypatch):
    draw = random.Random(3)
    rows = list(enumerate(ODD_TEXTS)) + [(100 + k, "".join(draw.choice(["a", "B", " ", " ", "\n", "the", "é", "日", ".", "'s", " "]) for _ in range(draw.randint(1, 60)))) for k in range(300)] + [(None, "no id"), (5, "a")]
    counts, want = aligned(rows)
    docs = frame(spark, rows).repartition(3)
    for block, pairs in ((align.OCCURRENCES, align.PAIRS), (200, 0)):
        monkeypatch.setattr(align, "OCCURRENCES", block)
        monkeypatch.setattr(align, "PAIRS", pairs)
        got = align.align(docs, A, B)
        assert got.documents.columns == ["doc_id", "Keep_ID", "a.b", "Runs", "_node", "_numbers", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        found = got.documents.collect()
        assert Counter((r["doc_id"], *r[6:]) for r in found) == Counter(want)
        assert {(r["a_id"], r["b_id"]): r["count"] for r in got.pairs.collect()} == counts
    none = align.align(docs.limit(0), A, B)
    assert none.documents.count() == 0 and none.pairs.count() == 0


def test_op11_against_whole_texts(spark, sf, aligned):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[1] else "") for w in aligned(rows)[1]]
    assert Counter(map(tuple, queries.op11_alignment(spark, sf).collect())) == Counter(want)


def test_alignment_refuses_other_files(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        align.align(docs, public_tokenizers.path("word_bpe_49k.json"), B)


def test_relations_of_alignment_are_planned_by_the_engine(spark, monkeypatch):
    """Tokens, ends and cuts are exploded rows, windows and joins, and buckets save their shuffles."""
    plans = []
    real = align._bucketed

    def seen(df, name, buckets):
        plans.append(df._jdf.queryExecution().toString())
        return real(df, name, buckets)

    monkeypatch.setattr(align, "_bucketed", seen)
    got = align.align(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), A, B)
    assert got.documents.first()["groups"]
    assert "posexplode" in plans[1] and "Window" in plans[1] and "Join" in plans[1] and "Exchange hashpartitioning" not in plans[1]


def test_encoding_takes_from_the_block_before(monkeypatch):
    """Dictionaries of one block after another are encoded as each alone, in short texts, and what the block before had is not encoded again."""
    import numpy as np
    import public_tokenizers

    from tracewise.llm import align

    own = align._of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    asked, plain = [], own.encoded
    monkeypatch.setattr(own, "encoded", lambda parts: asked.append(list(parts)) or plain(parts))
    monkeypatch.setattr(align, "ROW", 4)
    encoder = align._Encoder(own)
    for block, fresh in ((["a", "the", "été\n", "x1", "Word,", "end "], 6), (["the", "new", "x1", "é", "a", "old\t", "Word,"], 3), (["é", "the"], 0), ([], 0), (["é", "a"], 1)):
        asked.clear()
        got = list(encoder.encoded({p: i for i, p in enumerate(block)}))
        assert sum(map(len, asked)) == fresh and [k for k, _ in got] == list(range(0, len(block), 4))
        for k, sides in got:
            for x, y, lengths in zip(sides, plain(block[k : k + 4]), (own.lengths_a, own.lengths_b), strict=True):
                assert all(np.array_equal(a, b) for a, b in zip(x, y, strict=True))
                assert all(np.array_equal(x[1][i:j], np.cumsum(lengths[x[0][i:j]])) for i, j in zip(x[2], x[2][1:]))
    texts = []
    monkeypatch.setattr(own, "b", type("B", (), {"encode": lambda _, t, num_threads, b=own.b: texts.extend(t) or b.encode(t, num_threads=num_threads)})())
    plain([f"w{i}" for i in range(2 * align.RUN + 1)])
    assert [t.count(" ") + 1 for t in texts] == [align.RUN, align.RUN, 1]


def test_ends_come_with_the_tokens(spark):
    from tracewise.llm import align

    rows = spark.createDataFrame([(0, None, 0, [2], [[5, 6]], [[1, 3]], [[7]], [[3]])], align._BLOCK)
    links = align._links(rows)
    assert [tuple(r[c] for c in ("unit", "end", "a", "b", "times", "group")) for r in links.collect()] == [(0, 3, 6, 7, 2, 0)]
    assert links._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_known_stretches_are_encoded_once(monkeypatch):
    """A task keeps the tokens of the first stretches, up to bounds, and gives the same with them as without."""
    import numpy as np
    import public_tokenizers

    from tracewise.llm import align

    monkeypatch.setattr(align, "KNOWN", 8)
    monkeypatch.setattr(align, "KNOWN_TOKENS", 40)
    own = align._Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    asked, plain = [], own._encode
    monkeypatch.setattr(own, "_encode", lambda parts: asked.append(list(parts)) or plain(parts))
    for parts, fresh in ((["a", "the", "x1", "I", "été"], 5), (["the", "new", "a", "Wörd,qq"], 2), (["x1", "I", "a"], 0), (["y" * 300 + "é"], 1), (["y" * 300 + "é", "new"], 1), (["k", "l"], 2), (["l", "k"], 2)):
        asked.clear()
        got = own.encoded(parts)
        assert sum(map(len, asked)) == fresh
        for x, y in zip(got, plain(parts), strict=True):
            assert all(np.array_equal(a, b) for a, b in zip(x, y, strict=True))


def test_stretches_of_blocks_keep_their_order():
    """Texts cut at each space and texts that are not are numbered together, in order."""
    import numpy as np

    from tracewise.llm import align

    texts = [None, "a b  a", " a", "b c", "", "a\n b", "c", "x ", "\u2581 no", "a a"]
    block = align._Block()
    for part in (texts, texts[::-1], [None], ["only plain", "a b"]):
        got = block.add(part).to_pylist()
        words = list(block.numbers)
        assert [[words[i] for i in np.frombuffer(x, np.int32)] for x in got] == [align.stretches(t) if t and align.SPACE not in t else [] for t in part]
    assert block.total == block.counts.sum() and len(block.counts) == len(block.numbers)


def test_steps_take_no_tokenizers_along(spark):
    """Steps of alignment are sent without the driver's tokenizers, which they would load again beside their own."""
    from pyspark import cloudpickle
    from pyspark.sql import types as T

    from tracewise.llm import align

    align._of(A, B)
    sent = []
    docs = type("Docs", (), {"sparkSession": spark, "schema": T.StructType([T.StructField("_text", T.StringType())]), "mapInArrow": lambda _, f, s: sent.append(f)})()
    align._blocks(docs, A, B)
    assert len(cloudpickle.dumps(sent[0])) < 100_000
