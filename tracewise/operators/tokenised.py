"""Token ids of texts by a tokenizer's file, and what follows from them: lengths, truncated pairs for training, and the gates of generation.

A tokenizer is named by a path, whose ending says how it is loaded; a worker loads it once. Texts are tokenised in Arrow batches, whole, and
rows keep their columns; a batch whose tokenizer fails has its error on each row. Files must be at the same place on every executor.
Other kinds are registered by their users.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.operators import generation as G

Tokenizer = Callable[[list[str]], Sequence[Sequence[int]]]


#: Words whose numbers a worker keeps, and characters of texts that it holds the tokens of at once; a longer text is alone.
KNOWN_WORDS = 100_000
SLICE_CHARS = 1 << 20


def _json(path: str) -> Tokenizer:
    from tokenizers import Tokenizer as Library

    own = Library.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def _model(path: str) -> Tokenizer:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: own.encode(texts, num_threads=1)


def _words(path: str) -> Tokenizer:
    """Words between white space of ASCII, with ids of 16 bits of their digest: a tokenizer without a file."""
    split, known = re.compile(r"[^\x20\x09-\x0D]+").findall, {}

    def number(word: str) -> int:
        if len(known) > KNOWN_WORDS:
            known.clear()
        if word not in known:
            known[word] = int(hashlib.md5(word.encode()).hexdigest()[:4], 16)
        return known[word]

    return lambda texts: [[number(w) for w in split(t)] for t in texts]


#: How a tokenizer is loaded, by the ending of its path.
KINDS: dict[str, Callable[[str], Tokenizer]] = {".json": _json, ".model": _model, "words": _words}

_loaded: dict[str, Tokenizer] = {}


def register(ending: str, load: Callable[[str], Tokenizer]) -> None:
    """Adds a kind of tokenizer: load gets the path and gives a function from texts to ids. It is called once a worker."""
    KINDS[ending] = load


def _of(path: str, kinds: dict[str, Callable[[str], Tokenizer]]) -> Tokenizer:
    if path not in _loaded:
        found = [load for ending, load in kinds.items() if path.endswith(ending)]
        if not found:
            raise ValueError(f"no tokenizer for {path}")
        _loaded[path] = found[0](path)
    return _loaded[path]


def _ids(tokenizer: Tokenizer, texts: list[str | None]) -> list[Sequence[int]]:
    got = list(tokenizer([t or "" for t in texts]))
    if len(got) != len(texts):
        raise ValueError(f"{len(got)} results for {len(texts)} texts")
    return got


def _mapped(rows: DataFrame, made: list[T.StructField], run: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """rows with columns that run makes of each batch, and error."""
    schema = T.StructType([*rows.schema.fields, *made, T.StructField("error", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in made]
        for batch in batches:
            error = None
            try:
                columns = run(batch)
            except Exception as e:  # noqa: BLE001  errors are data here
                error, columns = f"{type(e).__name__}: {e}", [pa.nulls(batch.num_rows, t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[c.cast(t) for c, t in zip(columns, types, strict=True)], pa.array([error] * batch.num_rows, pa.string())], names=schema.names)

    return rows.mapInArrow(work, schema)


def _lists(rows: Sequence[Sequence[int]]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int32), *[np.asarray(r, np.int32) for r in rows]])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def _counts(tokenizer: Tokenizer, texts: pa.Array) -> pa.Array:
    """Tokens of each text, of which a slice is held at once: texts become Python's and ids are made only for SLICE_CHARS."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes) - sizes) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    counts = np.zeros(len(texts), np.int32)
    for a, b in zip(cuts, cuts[1:]):
        counts[a:b] = [len(g) for g in _ids(tokenizer, texts.slice(a, b - a).to_pylist())]
    return pa.array(counts)


def counted(rows: DataFrame, texts: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with the number of tokens of texts, in one pass, and error: the first of the tokenizers' that failed. texts: the new column, by it the tokenizer's path and the text. A null text is empty."""
    at, kinds = {n: (p, rows.columns.index(c)) for n, (p, c) in texts.items()}, dict(KINDS)
    made = [T.StructField(n, T.IntegerType()) for n in texts]
    schema = T.StructType([*rows.schema.fields, *made, T.StructField("error", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, errors = [], []
            for path, c in at.values():
                try:
                    columns.append(_counts(_of(path, kinds), batch.column(c)))
                except Exception as e:  # noqa: BLE001  errors are data here
                    columns.append(pa.nulls(batch.num_rows, pa.int32()))
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([*errors, None][:1] * batch.num_rows, pa.string())], names=schema.names)

    return rows.mapInArrow(work, schema)


def tokenised(rows: DataFrame, path: str, text: str, max_length: int | None = None) -> DataFrame:
    """rows with ids (the first max_length), n_tokens (of the whole text), truncated, and error. A null text is empty."""
    at, kinds = rows.columns.index(text), dict(KINDS)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        got = _ids(_of(path, kinds), batch.column(at).to_pylist())
        sizes = np.array([len(g) for g in got], np.int32)
        kept = got if max_length is None else [g[:max_length] for g in got]
        return [_lists(kept), pa.array(sizes), pa.array([False] * len(got) if max_length is None else sizes > max_length)]

    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("truncated", T.BooleanType())]
    return _mapped(rows, made, run)


def pair_lengths(a: int, b: int, room: int) -> tuple[int, int]:
    """Of two lengths, how many tokens of each stay in room: the longer is cut first, and of two as long the second."""
    if a + b <= room:
        return a, b
    half = room // 2
    if a <= b:
        return (a, room - a) if a <= half else (room - half, half)
    return (room - b, b) if b <= half else (room - half, half)


def training_pairs(rows: DataFrame, path: str, a: str, b: str, max_length: int, label: str, special: tuple[list[int], list[int], list[int]] = ([], [], []), pad: int = 0) -> DataFrame:
    """rows of text pairs as a judge is trained on them: input_ids and attention_mask of max_length, n_tokens (of the whole pair), truncated, labels, and error.

    special: ids before, between and after the texts. The longer text is cut first.
    """
    before, between, after = special
    at, room, kinds = (rows.columns.index(a), rows.columns.index(b)), max_length - sum(map(len, special)), dict(KINDS)
    if room < 0:
        raise ValueError("max_length has no room for the special tokens")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        own = _of(path, kinds)
        ids, sizes, cut = [], [], []
        for x, y in zip(*(_ids(own, batch.column(c).to_pylist()) for c in at), strict=True):
            n, m = pair_lengths(len(x), len(y), room)
            ids.append([*before, *x[:n], *between, *y[:m], *after])
            sizes.append(max_length - room + len(x) + len(y))
            cut.append(n + m < len(x) + len(y))
        padded = np.full((len(ids), max_length), pad, np.int32)
        mask = np.zeros((len(ids), max_length), np.int32)
        for k, row in enumerate(ids):
            padded[k, : len(row)], mask[k, : len(row)] = row, 1
        return [_lists(list(padded)), _lists(list(mask)), pa.array(sizes, pa.int32()), pa.array(cut, pa.bool_())]

    ints = T.ArrayType(T.IntegerType())
    made = [T.StructField("input_ids", ints), T.StructField("attention_mask", ints), T.StructField("n_tokens", T.IntegerType()), T.StructField("truncated", T.BooleanType())]
    return _mapped(rows, made, run).withColumn("labels", F.col(label).cast("int"))


def gated_texts(requests: DataFrame, anchor_path: str, prompt_path: str, anchor: str = "anchor", prompt: str = "prompt", **limits: int) -> DataFrame:
    """requests with anchor_tokens and prompt_tokens of their texts, max_output_tokens and error_type: the judge's tokenizer counts anchors, the generator's prompts. A tokenizer that fails is error_type too."""
    rows = counted(requests, {"anchor_tokens": (anchor_path, anchor), "prompt_tokens": (prompt_path, prompt)})
    gated = G.gated(rows, **limits)
    return gated.withColumn("error_type", F.coalesce("error", "error_type")).drop("error")


def pair_gate(pairs: DataFrame, path: str, a: str = "anchor", b: str = "generated", special_tokens: int = 3, max_pair: int = 256) -> DataFrame:
    """pairs with pair_tokens, special ones counted, and error_type for those that are too long for the judge."""
    rows = counted(pairs, {"_a": (path, a), "_b": (path, b)}).withColumnRenamed("error", "_error")
    tokens = F.col("_a") + F.col("_b") + special_tokens
    return rows.withColumn("pair_tokens", tokens).withColumn("error_type", F.coalesce("_error", F.when(F.col("pair_tokens") > max_pair, "DebertaPairTooLong"))).drop("_a", "_b", "_error")
