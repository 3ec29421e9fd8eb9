"""Edge cases of the pipeline's stages and operators, and the numbered queries without SQL against brute force."""

from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewise.llm import components, decontamination, licenses, lines, mixing, neardup, quality, queries, sharding, tokens

corpus_pipeline = pytest.importorskip("corpus_pipeline")

#: Names that operators make themselves or use inside, some in another case, some with signs in them.
ODD = ["Score", "predicted", "SIZE", "target", "Shard", "slot", "a.b", "`q`", "_rest", "spans", "N_Words", "items", "n_tokens", "_src", "_key", "_row", "rep", "band", "component_id", "Kept_Text", "matches", "c0", "key", "_n"]
LONG = "many different words " * 30_000 + " ".join(f"w{i}" for i in range(20_000))


def odd_docs(spark, rows):
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in ODD])


def edge_rows():
    plain = [(i, f"this is text number {i} with its own words {' '.join(f'v{(i * 31 + j * 7) % 997}' for j in range(40))}.", "en", f"s{i % 3}", 1) for i in range(60)]
    copies = [(100 + i, plain[3][1], "en", "s1", 1) for i in range(20)]
    return [*plain, *copies, *plain[:4], *plain[:4], (200, None, "en", "s0", None), (201, "", "en", None, 0), (202, " \n\t", None, "", 3), (203, LONG, "en", "s2", len(LONG)), (None, plain[5][1], "en", "s0", 1), (None, None, None, None, None)]


def same(rows, docs):
    """Rows hold the odd columns that their documents had."""
    for r in rows:
        for c in docs.columns:
            if c in ODD:
                assert r[docs.columns.index(c)] == f"{c}-{'null' if r['doc_id'] is None else r['doc_id']}"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_at_the_edges(spark, sf, name, stage):
    docs = odd_docs(spark, edge_rows())
    got = stage(spark, docs, sf)
    rows = got.collect()
    if name == "sharding":
        made = ["shard", "slot", "virtual_slot", "map_version"]
        kept = [c for c in docs.columns if c.lower() not in made]
        assert got.columns == [*kept, *made] and len(rows) == docs.count()
        same(rows, docs.select([F.col(f"`{c.replace('`', '``')}`") for c in kept]))
        assert all(sorted(r["slot"] for r in rows if r[len(kept)] == s) == list(range(sum(r[len(kept)] == s for r in rows))) for s in range(16))
    else:
        assert got.columns == docs.columns
        same(rows, docs)
        assert {r["doc_id"] for r in rows} <= {r[0] for r in edge_rows()}
    if name == "near-duplicate removal":
        ids = Counter(r["doc_id"] for r in rows)
        assert ids[3] == 1 and not any(ids[100 + i] for i in range(20)) and ids[0] == 1 and ids[None] == 2 and ids[200] == ids[201] == ids[202] == ids[203] == 1
    if name == "benchmark decontamination":
        assert len(rows) == docs.count() and all(r["text"] == t for r in rows for i, t, *_ in edge_rows() if i == r["doc_id"] and i is not None)
    if name == "source mixing":
        assert Counter(r["doc_id"] for r in rows if not (r["text"] or "").split()) == Counter(i for i, t, *_ in edge_rows() if not (t or "").split())
    none = stage(spark, docs.limit(0), sf)
    assert none.count() == 0 and none.columns == got.columns


def test_quality_stage_without_two_classes(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs(spark, edge_rows())
    assert corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).count() == docs.count()


def test_leaks_go_and_clean_texts_stay(spark, tmp_path):
    item = " ".join(f"b{i}" for i in range(14))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_docs(spark, [(1, f"before {item.upper()}, after", "en", "s", 1), (2, item, "en", "s", 1), (3, "b0 b1 b2", "en", "s", 8), (4, None, "en", "s", None), (5, "", "en", "s", 0)])
    rows = {r["doc_id"]: r for r in corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path)).collect()}
    assert {i: (r["text"], r["n_chars"]) for i, r in rows.items()} == {1: ("before , after", 14), 3: ("b0 b1 b2", 8), 4: (None, None), 5: ("", 0)}
    same(rows.values(), docs)


def test_operators_keep_odd_columns(spark):
    docs = odd_docs(spark, edge_rows())
    bench = spark.createDataFrame([(1, "text number")], "item_id long, text string")
    store = lines.LineStore(spark)
    store.insert(docs)
    made = {
        "tokens": (tokens.counted(docs, public_tokenizers.path("byte_bpe_50k.json")), ("n_bytes", "n_tokens")),
        "quality": (quality.scored(docs, quality.Constant(0.5)), ("score", "predicted")),
        "leaks": (decontamination.find(docs, bench), ("n_words", "n_hit", "items", "spans")),
        "lines": (lines.deduped(docs, store), ("n_lines", "n_dropped", "kept_text")),
        "licenses": (licenses.scanned(docs), ("n_sentences", "n_known", "matches")),
        "mixing": (mixing.mix(docs, mixing.n_words(F.col("text"))), ("size", "source_size", "target", "taken")),
        "sharding": (sharding.shard(docs, 4), ("shard", "slot", "virtual_slot", "map_version", "_shard_size", "_shard_crc")),
        "near": (neardup.deduped(docs), ()),
    }
    for name, (got, new) in made.items():
        kept = [c for c in docs.columns if c.lower() not in new]
        assert got.columns == [*kept, *new], name
        rows = got.collect()
        assert len(rows) == docs.count() or name == "near"
        same(rows, docs.select([F.col(f"`{c.replace('`', '``')}`") for c in kept]))


def test_components_without_nodes(spark):
    edges = spark.createDataFrame([(1, None), (None, 2), (3, 3), (4, 5), (5, 4)], "a long, b long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(5, 4), (4, 4)}


def test_hot_star_is_broadcast(spark, monkeypatch):
    """A centre with more edges than a task should hold, and a chain."""
    monkeypatch.setattr("tracewise.llm.shared.LEAST_HOT", 10)
    edges = [(7, i) for i in range(100, 400)] + [(i, i + 1) for i in range(1000, 1030)] + [(399, 1030)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert set(got.values()) == {7} and len(got) == 1 + 300 + 31


def test_stored_map_is_edited(spark, tmp_path):
    """Growth of data and of shards through one store: versions follow, and few slots move."""
    store = f"file://{tmp_path}/maps"
    frame = lambda n: spark.createDataFrame([(i, "x" * (i % 50)) for i in range(n)], "doc_id long, text string")
    at = lambda rows: {r["doc_id"]: (r["virtual_slot"], r["shard"]) for r in rows.collect()}
    first = at(sharding.shard(frame(4000), 8, store=store))
    more = sharding.shard(frame(5000), 8, store=store)
    assert sharding.newest_version(spark, store) == 2 and more.first()["map_version"] == 2
    second = at(more)
    assert all(first[i][0] == second[i][0] for i in first) and sum(first[i] != second[i] for i in first) < 0.2 * len(first)
    third = sharding.shard(frame(5000), 9, store=store)
    load = Counter()
    for r in third.collect():
        load[r["shard"]] += r["_shard_size"]
    assert len(load) == 9 and max(load.values()) < 1.05 * min(load.values())
    moved = sum(second[i][1] != s for i, (_, s) in at(third).items())
    assert 0.05 * 5000 < moved < 0.25 * 5000
    assert sharding.rebalance(spark, store, 3) == 4 and set(sharding.owners(spark, store, 4)) == {0, 1, 2}


def test_long_and_null_rows_are_sharded_and_mixed(spark):
    docs = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    rows = {(r["doc_id"], r["_shard_size"]) for r in sharding.shard(docs, 4).collect()}
    assert (203, len(LONG) + 1) in rows and (200, 1) in rows and (None, 1) in rows
    mixed = mixing.mix(docs, mixing.n_words(F.col("text")), tie=F.md5(F.coalesce("text", F.lit("")))).collect()
    assert {r["size"] for r in mixed if r["doc_id"] == 203} == {len(LONG.split())}
    size, taken, target = Counter(), Counter(), {}
    for r in mixed:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)


def test_ties_at_a_cut(spark):
    """Rows of one id and size at the cut of their source are taken one by one."""
    docs = spark.createDataFrame([(7, f"a b c d {i}", "s") for i in range(50)] + [(7, "a b c d 1", "s")] * 50 + [(8, "x", "t")], "doc_id long, text string, source string")
    for whole in (False, True):
        rows = [r for r in mixing.mix(docs, mixing.n_words(F.col("text")), whole=whole, most=1.35).collect() if r["source"] == "s"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= (2.5 if whole else 1)
        assert len({r["taken"] for r in rows}) <= 3


def test_store_opens_again_and_skips_what_it_holds(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    store = lines.LineStore(spark, path)
    store.insert(frame([(1, "a line that repeats\nunique to one"), (2, "a line that repeats")]))
    again = lines.LineStore(spark, path)
    assert (again.version, again.shards, again.min_chars) == (1, store.shards, 10)
    again.insert(frame([(1, "another text, skipped"), (3, "A line that repeats"), (3, "A line that repeats"), (4, "wholly new line")]))
    refs = {r["refs"] for r in again.references().where("first_doc < last_doc").collect()}
    assert refs == {3} and again.posted().where("doc_id = 1").count() == 2 and again.references().count() == 3
    assert again.known(again.references()).where("NOT maybe").count() == 0
    again.delete(frame([(1, ""), (99, "")]))
    third = lines.LineStore(spark, path)
    got = {r["doc_id"]: r["kept_text"] for r in lines.deduped(frame([(2, "a line that repeats"), (3, "A line that repeats")]), third).collect()}
    assert got == {2: "a line that repeats", 3: ""} and third.version == 3
    third.insert(frame([(1, "a line that repeats")]))
    got = {r["doc_id"]: r["kept_text"] for r in lines.deduped(frame([(1, "a line that repeats"), (2, "a line that repeats")]), third).collect()}
    assert got == {1: "a line that repeats", 2: ""}


def test_filters_grow_and_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 200)
    store = lines.LineStore(spark, shards=2)
    frame = lambda a, b: spark.range(a, b).selectExpr("id AS doc_id", "concat('a line of its own ', id) AS text")
    for a, b in ((0, 100), (100, 400), (400, 3000)):
        store.insert(frame(a, b))
        keys = store.references()
        assert keys.count() == b and store.known(keys).where("NOT maybe").count() == 0
    assert store.shards > 2 and store.filters().agg(F.sum("n")).first()[0] == 3000


def test_a_text_with_very_many_words_trains_whole(spark):
    words = " ".join(f"u{i}" for i in range(40_000))
    stats, text_of, slots, values = quality.features([words.encode()])
    assert len(slots) > 4000
    docs = spark.createDataFrame([(i, words if i % 2 else "short") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    model = quality.fitted(docs, labels)
    assert np.count_nonzero(np.abs(model.linear[: quality.WORD_SLOTS]) > 0) >= len(slots)


def test_unsupported_tokenizers_are_refused():
    with pytest.raises(ValueError, match="do not support"):
        tokens.Counts(public_tokenizers.path("word_bpe_49k.json"))


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_op1_against_its_law(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf, "documents").collect()}
    rows = queries.queries()["op1_sharding"](spark, sf).collect()
    load, places = Counter(), defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, crc32(texts[r["doc_id"]]), "bytes", None)
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and set(load) == set(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= max(map(len, texts.values())) + 1


def test_op3_against_the_library(spark, sf):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.queries()["op3_tokens"](spark, sf).collect()}
    want = {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert got == {i: (len(texts[i].encode()), n, n > 512) for i, n in want.items()}


def test_op9_on_held_out_labels(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    rows = queries.queries()["op9_quality"](spark, sf).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert held and sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_op10_against_exact_search(spark, sf):
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float32).astype(float) for r in table(spark, sf, "embeddings").collect()}
    ids = np.array(sorted(x))
    every = np.stack([x[i] for i in ids])
    got = defaultdict(list)
    for r in queries.queries()["op10_nearest"](spark, sf).orderBy("query_id", "rank").collect():
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]))
        got[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = np.where(ids == q, -np.inf, every @ x[q])
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & set(got[int(q)]))
        assert len(got[int(q)]) == 20
    assert set(got) == {int(q) for q in ids if q % 20 == 0} and hits >= 0.9 * 20 * len(got)
