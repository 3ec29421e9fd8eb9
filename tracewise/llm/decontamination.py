"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of documents inside a task. Its words become symbols of one sequence, kept only
where benchmark words follow each other for at least the shortest window: no window can occur
elsewhere. The sequence gets a suffix array, its Burrows-Wheeler transform a wavelet matrix, and
all windows are backward-searched together through its ranks. Occurrences are located by walking
to sampled suffix positions and merged into spans per document. Documents are never shuffled and
no group of copies meets in a task.

The benchmark is dealt by hash into blocks of about BLOCK_BYTES of text. Tasks turn each block into
packed windows, written to the shared folder; the driver gets only the names of the blocks. There is one
pass over the documents at any size of the benchmark: a task holds one block at a time, and with several blocks
takes HELD_BYTES of text through all of them before it goes on.

Words: ASCII letters lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window: `window`
consecutive item words, or the whole item if it has fewer but not none.

Defined results: a null or empty text has no words and no hits; an item without words has no
window; an item without id has the id of an empty text; repeated rows and ties get the same answer each; items
with equal ids count once; a very long text is a shard of its own, of about 100 bytes of arrays for each byte
of it; an empty table gives an empty result; an empty benchmark hits nothing; extra columns are
kept, whatever their names, and columns named n_words, n_hit, items, spans or clean_text (in any case) are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.shared import chunks, giving_back, held, new_path, quoted, small_batches, word_table

#: Text bytes of a benchmark block, and of a training shard.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
#: Text bytes that a task takes through all blocks at a time, if there are several.
HELD_BYTES = 64 << 20
#: One in so many suffix positions is kept for locating.
SAMPLE = 8

_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_MADE = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "spans": "array<struct<first_word:int,end_word:int,first_byte:bigint,end_byte:bigint>>"}


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    n, h = len(seq), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:-h] = rank[h:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, dtype=np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        h *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence; a level per bit."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            zero = (seq >> b) & 1 == 0
            upto = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(zero, out=upto[1:])
            self.zeros.append(upto)
            seq = np.concatenate([seq[zero], seq[~zero]])
        self.origin = self._walk(np.arange(n_symbols), np.zeros(n_symbols, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, upto in enumerate(self.zeros):
            zero = (symbol >> (self.bits - 1 - level)) & 1 == 0
            before = upto[at]
            at = np.where(zero, before, upto[-1] + at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._walk(symbol, at) - self.origin[symbol]


class FMIndex:
    """Of a sequence of symbols from 1; 0 is added as its end."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        seq = np.append(seq, 0)
        order = suffix_array(seq)
        self.last = seq[order - 1]
        self.starts = np.zeros(n_symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(seq, minlength=n_symbols), out=self.starts[1:])
        self.wavelet = WaveletMatrix(self.last, n_symbols)
        self.sampled = order % sample == 0
        self.samples = order[self.sampled]
        self.sample_at = np.cumsum(self.sampled) - 1

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.starts[symbol] + self.wavelet.rank(symbol, row)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, which end at the last column of their row."""
        symbol = patterns[:, -1]
        low, high = self.starts[symbol].copy(), self.starts[symbol + 1].copy()
        for j in range(2, patterns.shape[1] + 1):
            on = np.flatnonzero((lengths >= j) & (low < high))
            if not len(on):
                break
            symbol = patterns[on, -j]
            low[on], high[on] = self.step(symbol, low[on]), self.step(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows' suffixes."""
        found = np.zeros(len(rows), dtype=np.int64)
        open_, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            hit = self.sampled[rows]
            found[open_[hit]] = self.samples[self.sample_at[rows[hit]]] + steps
            open_, rows = open_[~hit], rows[~hit]
            rows = self.step(self.last[rows], rows)
            steps += 1
        return found


class Windows:
    """A block of the benchmark: its vocabulary, distinct windows and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        hashes, of, _, _ = word_table([t for _, t in items], _WORD_BYTES)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        symbols += 2  # 0 ends a sequence, 1 parts its runs
        owners: dict[tuple[int, ...], set[str]] = {}
        for k, (first, end) in enumerate(zip(np.searchsorted(of, np.arange(len(items))), np.searchsorted(of, np.arange(len(items)), side="right"), strict=True)):
            own = symbols[first:end].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + window]), set()).add(items[k][0])
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.patterns = np.zeros((len(owners), int(self.lengths.max(initial=1))), dtype=np.int64)
        for k, w in enumerate(owners):
            self.patterns[k, -len(w) :] = w
        self.owners = [sorted(x) for x in owners.values()]

    def find(self, hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in a shard's words: window, first word, end word (of all the shard's words)."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.owners) or not len(hashes):
            return none, none, none
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[at] == hashes)
        if not len(known):
            return none, none, none
        new_run = np.ones(len(known), dtype=bool)
        new_run[1:] = (np.diff(known) > 1) | (np.diff(of[known]) > 0)
        run = np.cumsum(new_run) - 1
        known = known[np.bincount(run)[run] >= self.lengths.min()]
        if not len(known):
            return none, none, none
        new_run = np.ones(len(known), dtype=bool)
        new_run[1:] = (np.diff(known) > 1) | (np.diff(of[known]) > 0)
        place = np.arange(len(known)) + np.cumsum(new_run) - 1
        seq = np.ones(place[-1] + 1, dtype=np.int64)
        word = np.full(place[-1] + 1, -1, dtype=np.int64)
        seq[place], word[place] = at[known] + 2, known
        index = FMIndex(seq, len(self.vocabulary) + 2)
        low, high = index.search(self.patterns, self.lengths)
        which = np.repeat(np.arange(len(low)), high - low)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        first = word[index.locate(rows)]
        return which, first, first + self.lengths[which]


def _search_shard(texts: list[bytes], prior: list, windows: Windows, n: int) -> list[tuple]:
    hashes, of, first_byte, end_byte = word_table(texts, _WORD_BYTES)
    which, first, end = windows.find(hashes, of)
    begins = np.searchsorted(of, np.arange(n + 1))
    step = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, end, -1)
    items: dict[int, set[str]] = {}
    for d, w in set(zip(of[first].tolist(), which.tolist(), strict=True)):
        items.setdefault(d, set()).update(windows.owners[w])
    for d, (_, spans) in enumerate(prior):
        for s in spans or ():
            step[begins[d] + s["first_word"]] += 1
            step[begins[d] + s["end_word"]] -= 1
    hit = np.cumsum(step[:-1]) > 0
    edges = hit.copy()
    edges[1:] &= ~hit[:-1]
    inner = begins[1:-1]
    starts = begins[:-1][begins[:-1] < len(hit)]
    edges[starts] = hit[starts]
    ends = hit.copy()
    ends[:-1] &= ~hit[1:]
    last = inner[(inner > 0)] - 1
    ends[last] = hit[last]
    span_first, span_end = np.flatnonzero(edges), np.flatnonzero(ends) + 1
    hits = np.bincount(of[hit], minlength=n) if len(of) else np.zeros(n, dtype=np.int64)
    spans: dict[int, list] = {}
    for a, b in zip(span_first.tolist(), span_end.tolist(), strict=True):
        d = int(of[a])
        spans.setdefault(d, []).append({"first_word": a - int(begins[d]), "end_word": b - int(begins[d]), "first_byte": int(first_byte[a]), "end_byte": int(end_byte[b - 1])})
    return [(int(begins[d + 1] - begins[d]), int(hits[d]), sorted({*(prior[d][0] or ()), *items.get(d, ())}), spans.get(d, [])) for d in range(n)]


def cut(text: bytes, spans: list[dict]) -> bytes:
    """text without its spans."""
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : s["first_byte"]])
        at = s["end_byte"]
    return b"".join([*kept, text[at:]])


def _block_writer(store: str, window: int):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        files, root = fs.FileSystem.from_uri(store)
        name = f"block-{pdf['b'].iloc[0]:06d}-{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(f"{root}/{name}", compression=None) as f:
            f.write(pickle.dumps(Windows([(i, t.encode()) for i, t in zip(pdf["i"], pdf["t"], strict=True)], window)))
        return pd.DataFrame({"name": [name]})

    return write


_loaded: dict[str, Windows] = {}


def _block(store: str, name: str) -> Windows:
    """A block's windows. A process keeps the last one."""
    if name not in _loaded:
        files, root = fs.FileSystem.from_uri(store)
        _loaded.clear()
        with files.open_input_stream(f"{root}/{name}", compression=None) as f:
            _loaded[name] = pickle.loads(f.read())
    return _loaded[name]


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", clean: bool = False) -> DataFrame:
    """docs with n_words, n_hit, items (ids of the items with occurring windows) and spans (merged, of words and of UTF-8 bytes); with clean also clean_text, the text without its spans."""
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.coalesce(F.col(quoted(item_id)).cast("string"), F.lit("")).alias("i"), F.col(quoted(item_text)).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    blocks = max(1, -(-(bench.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0) // BLOCK_BYTES))
    store = new_path(spark, "benchmark")
    files, root = fs.FileSystem.from_uri(store)
    files.create_dir(root, recursive=True)
    dealt = bench.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    names = sorted(r["name"] for r in dealt.groupBy("b").applyInPandas(_block_writer(store, window), "name string").collect())  # one row per block

    made = dict(_MADE) | ({"clean_text": "string"} if clean else {})
    rows, back = held(docs, {"text": text}, (*_MADE, "clean_text"))
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(", ".join(f"{a} {b}" for a, b in made.items())).fields])
    return rows.mapInArrow(giving_back(_searcher(store, names, window, tuple(made))), schema).select(*back, *made)


def _searcher(store: str, names: list[str], window: int, made: tuple[str, ...]):
    span = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))
    types = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": span}

    def searched(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [b.column(0).cast(pa.binary()).to_pylist() for b in batches]
        texts = [x or b"" for c in columns for x in c]
        rows: list[tuple] = [(0, 0, None, None)] * len(texts)
        for windows in (_block(store, n) for n in names) if names else [Windows([], window)]:
            at = 0
            for part in chunks(texts, SHARD_BYTES):
                rows[at : at + len(part)] = _search_shard(part, [r[2:] for r in rows[at : at + len(part)]], windows, len(part))
                at += len(part)
        at = 0
        for batch, column in zip(batches, columns, strict=True):
            own = rows[at : at + len(column)]
            at += len(column)
            arrays = [pa.array([r[k] for r in own], type=t) for k, t in enumerate(types.values())]
            if "clean_text" in made:
                arrays.append(pa.array([None if t is None else cut(t, r[3]).decode() for t, r in zip(column, own, strict=True)], type=pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *made])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if len(names) < 2 or sum(b.nbytes for b in waiting) >= HELD_BYTES:
                yield from searched(waiting)
                waiting = []
        if waiting:
            yield from searched(waiting)

    return search
