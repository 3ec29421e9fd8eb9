"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. Documents with equal word sequences form a class, known by a 128-bit digest. Only the smallest
   id of a class goes on, its representative; copies take its component at the end.
2. Each document gets VALUES MinHash values of its shingle set: the first BANDS * ROWS as
   band hashes, and all as a signature of one byte per value.
3. Representatives that share a band are candidates. A band's hub is the member that shares bands
   with most others; the members of all bands of one hub form its cluster, so a document goes
   to a cluster once, however many bands it shares with the hub's other members. Counts and hubs
   are partial aggregates, and joins on bands and digests broadcast the few keys that hold a large
   share of all rows (shared.spread_join), so no band or class is a hot task.
4. In a cluster, signatures are compared a batch at a time. After each batch the posterior of the
   similarity (a Beta distribution) gives the chance that it reaches the threshold; a pair below
   MISS is dropped. Members with a partner left are likely.
5. Likely members get their full shingle sets, and pairs left by 4 are verified exactly. A pair in
   one component already is not compared, so a cluster gives out a spanning forest, never all
   pairs. The links give components.
6. A cluster of more than BLOCK members is dealt out in blocks, each with the hub. Members that
   their block does not link with the hub, the strays, are compared with all
   of its members: 4 and 5 follow for each block and each BLOCK strays. So no count of partners is
   capped, no cluster meets in one task, and what is shipped grows with members plus strays times
   blocks, not with the square of the cluster unless most of its members are strays.

A pair at the threshold shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, 1.4e-7.

Words: `[^\\x20\\x09-\\x0D]+` with ASCII letters lower-cased. Shingles are distinct runs of k
words, held as 64-bit hashes; with fewer words, the whole sequence is one.

Defined results: a null text or one without words has an empty set, is linked with nothing and is
its own component; of rows with equal ids and different texts each has the component of its own
text; a row with a null id has a null component and is always kept by deduped; repeated
rows get the same answer each; ties (equal sets) are links; a very long text makes a numpy pass of its own,
of about 60 bytes for each byte of it; an empty table gives an empty result; groups leaves extra
columns out, and deduped keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.components import components
from tracewise.llm.shared import NOT_SPACE, chunks, drop_written, giving_back, held, mix64, small_batches, spread_join, word_table, written

BANDS, ROWS, VALUES = 40, 5, 200
#: Signature values that a batch adds, and the chance of dropping a pair at the threshold that is accepted.
BATCH, MISS = 40, 1e-6
#: Members of a cluster that meet in a task, about.
BLOCK = 512

_rng = np.random.default_rng(20240229)
_FACTOR = (_rng.integers(0, 1 << 32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFT = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_FOLD = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    words, of, _, _ = word_table(texts, NOT_SPACE)
    begins = np.searchsorted(of, np.arange(len(texts) + 1))
    n = len(words) - k + 1
    runs = words[: max(n, 0)].copy()
    for j in range(1, k):
        runs = runs * _FOLD + words[j : j + len(runs)]
    runs = mix64(runs)
    out = []
    for d in range(len(texts)):
        a, b = int(begins[d]), int(begins[d + 1])
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
            continue
        whole = np.zeros(min(1, b - a), dtype=np.uint64)
        for w in words[a:b]:
            whole = whole * _FOLD + w
        out.append(mix64(whole + np.uint64(b - a)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, a row each."""
    out = np.empty((len(sets), len(_FACTOR)), dtype=np.uint32)
    sizes = np.array([len(s) for s in sets])
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if sets else np.zeros(0, dtype=np.uint32)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + 8192, side="right")))
        a, b = int(ends[first] - sizes[first]), int(ends[last - 1])
        if b - a > 65536:  # one very large set, in parts
            out[first] = np.min([(low[i : i + 8192, None] * _FACTOR + _SHIFT).min(axis=0) for i in range(a, b, 8192)], axis=0)
        else:
            out[first:last] = np.minimum.reduceat(low[a:b, None] * _FACTOR + _SHIFT, ends[first:last] - sizes[first:last] - a, axis=0)
        first = last
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A hash for each band of each signature; equal values in different bands hash apart."""
    parts = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for j in range(ROWS):
        h = h * _FOLD + parts[:, :, j] + np.uint64(1)
    return mix64(h).view(np.int64)


def least_matches(percent: int, batch: int = BATCH, total: int = VALUES, miss: float = MISS) -> dict[int, int]:
    """By values compared: matches below which the posterior chance of the threshold is below miss.

    With a uniform prior, the similarity after m matches of n is Beta(m + 1, n - m + 1), and its
    chance of being at least t is that of at most m hits in n + 1 draws of chance t.
    """
    t, out = percent / 100, {}
    for n in range(batch, total + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def described(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, bands, sig); bands and sig are null for empty sets."""
    schema = "doc_id long, digest binary, n_shingles long, bands array<long>, sig binary"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            done = 0
            for part in chunks(texts):
                sets = shingle_sets(part, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full])
                bands, small = band_hashes(sig), sig.astype(np.uint8)
                band_of: list = [None] * len(part)
                sig_of: list = [None] * len(part)
                for row, i in enumerate(full):
                    band_of[i], sig_of[i] = bands[row], small[row].tobytes()
                digests = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(part)), pa.array(digests, type=pa.binary()), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(band_of, type=pa.list_(pa.int64())), pa.array(sig_of, type=pa.binary())],
                    names=["doc_id", "digest", "n_shingles", "bands", "sig"],
                )
                done += len(part)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(giving_back(describe), schema)


_RUN = ["hub", "x", "y"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """The rows of each (hub, x, y), the first three columns of rows that are sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            own = tuple(keys[:, a].tolist())
            if own != held_key:
                if held:
                    yield held_key, pa.Table.from_batches(held)
                held, held_key = [], own
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)


def _columns(key: tuple[int, int, int], rows: pa.Table) -> tuple[np.ndarray, ...]:
    """doc_id, component, block, n_shingles and sig of a run, with the hub first."""
    doc, comp, block, size = (rows.column(c).to_numpy() for c in ("doc_id", "c", "block", "n_shingles"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint8).reshape(len(doc), VALUES)
    order = np.argsort(doc != key[0], kind="stable")
    return order, doc[order], comp[order], block[order], size[order], sig[order]


def _partners(i: int, rest: np.ndarray, percent: int, least: dict[int, int], size: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Those of rest that sizes and signatures do not rule out as links of i."""
    rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
    matches = np.zeros(len(rest), dtype=np.int64)
    for n, m in least.items():
        if not len(rest):
            break
        matches += (sig[rest, n - BATCH : n] == sig[i, n - BATCH : n]).sum(axis=1)
        go = matches >= m
        rest, matches = rest[go], matches[go]
    return rest


def _likely(percent: int):
    """Over runs: the members that may have a link to another component."""
    least = least_matches(percent)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _runs(batches):
            order, doc, comp, block, size, sig = _columns(key, rows)
            found = np.zeros(len(doc), dtype=bool)
            for i in range(len(doc) - 1):
                rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
                if key[1] != key[2]:
                    rest = rest[block[rest] != block[i]]
                if found[i]:
                    rest = rest[~found[rest]]
                partners = _partners(i, rest, percent, least, size, sig)
                if len(partners):
                    found[i] = found[partners] = True
            if found.any():
                kept = np.sort(order[found])
                for batch in rows.select([*_RUN, "doc_id", "c", "block"]).take(pa.array(kept)).combine_chunks().to_batches():
                    yield batch

    return mark


def _linker(percent: int):
    """Over runs with full sets: where verified links join components, a link of each member that changed its component to one that did not. The component of the hub, named by its id, does not."""
    least = least_matches(percent)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _runs(batches):
            order, doc, comp, block, size, sig = _columns(key, rows)
            packed = rows.column("shingles").to_pylist()
            sets = [np.frombuffer(packed[k], dtype=np.uint64) for k in order]
            joined = comp.copy()
            for i in range(len(doc) - 1):
                rest = np.flatnonzero(joined[i + 1 :] != joined[i]) + i + 1
                if key[1] != key[2]:
                    rest = rest[block[rest] != block[i]]
                for part in np.array_split(rest, max(1, len(rest) // 64)):
                    partners = _partners(i, part[joined[part] != joined[i]], percent, least, size, sig)
                    if not len(partners):
                        continue
                    own, others = sets[i], np.concatenate([sets[j] for j in partners])
                    at = np.searchsorted(own, others)
                    at[at == len(own)] = 0
                    both = np.add.reduceat(own[at] == others, np.cumsum([0, *size[partners[:-1]]]), dtype=np.int64)
                    for j in partners[100 * both >= percent * (size[i] + size[partners] - both)].tolist():
                        kept, gone = (joined[i], joined[j]) if joined[j] != key[0] else (joined[j], joined[i])  # the hub's component keeps its name
                        joined[joined == gone] = kept
            root = {int(c): int(d) for c, d, j in zip(comp[::-1], doc[::-1], joined[::-1], strict=True) if c == j}  # a member that kept its component's name
            new = np.flatnonzero(joined != comp)
            if len(new):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), key[0])), pa.array(doc[new]), pa.array([root[c] for c in joined[new].tolist()], type=pa.int64())], names=["hub", "a", "b"])

    return link


def _packed_sets(k: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in chunks([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                sets = shingle_sets(part, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                small = signatures([sets[i] for i in full]).astype(np.uint8)
                columns = [batch.column(0).slice(done, len(part)), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([s.tobytes() for s in sets], type=pa.binary())]
                sigs: list = [None] * len(part)
                for row, i in enumerate(full):
                    sigs[i] = small[row].tobytes()
                made = pa.RecordBatch.from_arrays([*columns, pa.array(sigs, type=pa.binary())], names=["doc_id", "n_shingles", "shingles", "sig"])
                yield made.take(pa.array(full, type=pa.int64()))
                done += len(part)

    return pack


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_RUN).sortWithinPartitions(*_RUN)


def _linked(runs: DataFrame, base: DataFrame, docs: DataFrame, k: int, percent: int, key: str, text: str) -> DataFrame:
    """Links (hub, a, b) in runs (hub, x, y, doc_id, c, block), written."""
    about = base.where("sig IS NOT NULL").select("doc_id", "n_shingles", "sig")
    marked = _dealt(runs.join(about.hint("merge"), "doc_id").select(*_RUN, "doc_id", "c", "block", "n_shingles", "sig"))
    likely = written(marked.mapInArrow(giving_back(_likely(percent)), "hub long, x int, y int, doc_id long, c long, block int").distinct(), "likely")
    ends = likely.select("doc_id").distinct()
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).join(ends, "doc_id", "left_semi")
    sets = texts.mapInArrow(giving_back(_packed_sets(k)), "doc_id long, n_shingles long, shingles binary, sig binary")
    whole = _dealt(likely.join(sets, "doc_id").select(*_RUN, "doc_id", "c", "block", "n_shingles", "sig", "shingles"))
    links = written(whole.mapInArrow(giving_back(_linker(percent)), "hub long, a long, b long"), "links")
    drop_written(likely)
    return links


def _rows(docs: DataFrame, k: int, percent: int, key: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    small_batches(docs.sparkSession)
    base = written(described(docs, k, key, text), "described")
    n = base.count()
    full = base.where("doc_id IS NOT NULL AND sig IS NOT NULL")
    classes = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes", n)
    own = full.join(classes.select("rep").distinct().hint("merge"), F.col("doc_id") == F.col("rep"), "left_semi")
    entries = own.select("doc_id", F.explode("bands").alias("band"))
    bands = written(entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands", BANDS * n)
    entries = written(spread_join(entries, bands, "band", "n", hint="merge").distinct(), "entries", BANDS * n)

    weight = entries.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    hubs = entries.join(weight, "doc_id").groupBy("band").agg(F.min(F.struct(-F.col("weight"), "doc_id"))["doc_id"].alias("hub"), F.count("*").alias("m"))
    members = written(spread_join(entries.select("band", "doc_id"), written(hubs, "hubs", BANDS * n), "band", "m").select("hub", "doc_id").distinct(), "members", BANDS * n)
    sizes = written(members.groupBy("hub").agg(F.count("*").alias("size")), "sizes", n)
    members = spread_join(members, sizes, "hub", "size").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    members = members.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("x", F.explode(F.when(F.col("doc_id") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    links = _linked(dealt.withColumn("y", F.col("x")).withColumn("c", F.col("doc_id")), base, docs, k, percent, key, text)

    strays = _strays(members, links, BANDS * n)
    if strays is not None:
        links = links.unionByName(_linked(strays, base, docs, k, percent, key, text))

    found = components(links).withColumnRenamed("node", "rep")
    classes = written(classes.join(found, "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("component")), "class-components", n)
    rows = spread_join(base.select("doc_id", "digest", "n_shingles"), classes, "digest", "copies", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return rows.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _strays(members: DataFrame, links: DataFrame, n: int) -> DataFrame | None:
    """Runs (hub, x, y, doc_id, c, block) that hold each stray of a crowded hub, a member that its block does not link with the hub, with each member of the hub: x is a block of members, y less than 0 a part of the strays, whose block is -1. None if no hub is crowded or none has strays."""
    own = links.groupBy("hub", F.col("a").alias("doc_id")).agg(F.min("b").alias("c"))
    large = members.where("blocks > 1").join(own, ["hub", "doc_id"], "left").withColumn("c", F.when(F.col("doc_id") == F.col("hub"), F.col("hub")).otherwise(F.coalesce("c", "doc_id")))
    large = written(large, "large", n)
    parts = large.groupBy("hub").agg(F.count("*").alias("n"), F.count_if(F.col("c") != F.col("hub")).alias("strays")).where("strays > 0")
    parts = written(parts.select("hub", "n", F.ceil(F.col("strays") / BLOCK).cast("int").alias("parts")), "strays", n)
    if parts.isEmpty():
        return None
    rows = spread_join(large, parts, "hub", "n")
    whole = rows.select("hub", F.col("block").alias("x"), F.explode(F.sequence(F.lit(1), "parts")).alias("y"), "doc_id", "c", "block")
    stray = rows.where("c <> hub").withColumn("y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int") + 1)
    stray = stray.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), "y", "doc_id", "c", F.lit(-1).alias("block"))
    return whole.unionByName(stray).withColumn("y", (-F.col("y")).cast("int"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links) and kept (doc_id is that id)."""
    rows, _ = held(docs, {"doc_id": key, "text": text}, packed=False)
    rows = _rows(rows, k, percent, "doc_id", "text")
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduped(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each group. Of rows that share the kept id, that with the smallest text stays; rows with a null id all stay.

    Texts are shuffled once, to meet the ids that go. Rows that share a kept id are found by ids alone
    and reduced by a partial aggregate.
    """
    rows, back = held(docs, {"doc_id": key, "text": text})
    slim, _ = held(docs, {"doc_id": key, "text": text}, packed=False)
    found = written(_rows(slim, k, percent, "doc_id", "text").select("doc_id", "component_id"), "found")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    rows = rows.join(gone.hint("merge"), "doc_id", "left_anti")  # ids that go grow with the rows: one shuffle of texts at any size
    twice = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1"), "repeated")
    if twice.isEmpty():
        return rows.select(*back)
    ids = twice.select("doc_id")
    whole = F.struct(*[c for c in rows.columns if c != "doc_id"])
    first = rows.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct(F.col("text").isNull(), F.col("text"))).alias("_row"))
    return rows.join(ids, "doc_id", "left_anti").unionByName(first.select("doc_id", "_row.*")).select(*back)
