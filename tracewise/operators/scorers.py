"""Pair scorers: a registry of functions over batches of text pairs, run in Arrow batches.

A scorer takes two lists of texts and returns a dictionary of score lists. Pairs never leave
their row, so scores cannot be matched wrongly; a scorer that fails gives an error on the batch's rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.functions import text as X

Scorer = Callable[[list[str], list[str]], dict[str, list[float]]]


def lexical(a: list[str], b: list[str]) -> dict[str, list[float]]:
    """Share of words in common: a deterministic scorer without a model."""
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = set(x.lower().split()), set(y.lower().split())
        out.append(len(p & q) / len(p | q) if p | q else 0.0)
    return {"raw_score": out}


def _hashed(text: str, size: int = 256) -> dict[int, float]:
    out: dict[int, float] = {}
    for word in text.lower().split():
        k = zlib.crc32(word.encode()) % size
        out[k] = out.get(k, 0.0) + 1.0
    return out


def hashed_cosine(a: list[str], b: list[str]) -> dict[str, list[float]]:
    """Cosine of word counts in hashed slots: what an embedding scorer returns, without its model."""
    out = []
    for x, y in zip(map(_hashed, a), map(_hashed, b), strict=True):
        size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        out.append(sum(v * y.get(k, 0.0) for k, v in x.items()) / size if size else 0.0)
    return {"raw_score": out}


def token_overlap(a: list[str], b: list[str]) -> dict[str, list[float]]:
    """Precision, recall and f1 of words that both texts have: what a token matcher returns, without its model."""
    fields: dict[str, list[float]] = {"bertscore_precision": [], "bertscore_recall": [], "bertscore_f1": []}
    for x, y in zip(a, b, strict=True):
        p, q = x.lower().split(), y.lower().split()
        hits, back = sum(w in set(p) for w in q), sum(w in set(q) for w in p)
        precision, recall = hits / len(q) if q else 0.0, back / len(p) if p else 0.0
        for f, v in zip(fields, (precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0), strict=True):
            fields[f].append(v)
    return fields


def label_map(names: dict[int, str]) -> dict[str, int]:
    """The places of entailment, contradiction and neutral among a model's label names; ValueError if one is missing."""
    found = {want: int(i) for i, name in names.items() for want in ("entailment", "contradiction", "neutral") if want in str(name).lower()}
    if missing := sorted({"entailment", "contradiction", "neutral"} - set(found)):
        raise ValueError(f"no labels {missing} in {names}")
    return found


def both_ways(predict: Callable[[list[str], list[str]], list[list[float]]], names: dict[int, str]) -> Scorer:
    """A scorer of entailment, contradiction and neutral probabilities in both directions, from a model of (premises, hypotheses)."""
    at = label_map(names)

    def score(a: list[str], b: list[str]) -> dict[str, list[float]]:
        there, back = predict(a, b), predict(b, a)
        return {f"{k}_{way}": [row[at[name]] for row in rows] for way, rows in (("ab", there), ("ba", back)) for k, name in (("E", "entailment"), ("C", "contradiction"), ("N", "neutral"))}

    return score


NLI_FIELDS = ("E_ab", "E_ba", "C_ab", "C_ba", "N_ab", "N_ba")


def nli_cache(pairs: DataFrame, name: str, provenance: tuple[str, ...]) -> DataFrame:
    """Pairs (anchor, generated, provenance) with the six probabilities of a registered scorer, its name and error: rows to calibrate on."""
    return score_pairs(pairs.select(*provenance), name, "anchor", "generated").withColumnRenamed("scorer", "nli_model")


#: Scorers by name, with their fields. Those with models are registered by their users; these need none.
SCORERS: dict[str, tuple[Scorer, tuple[str, ...]]] = {
    "lexical": (lexical, ("raw_score",)),
    "hashed_cosine": (hashed_cosine, ("raw_score",)),
    "token_overlap": (token_overlap, ("bertscore_precision", "bertscore_recall", "bertscore_f1")),
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"[{X.SPACE}]+"), lambda w: w != "")


def lexical_columns(a: Column, b: Column) -> dict[str, Column]:
    """lexical as expressions, so that no row leaves the JVM."""
    p, q = _words(a), _words(b)
    return {"raw_score": F.coalesce(F.try_divide(F.size(F.array_intersect(p, q)).cast("double"), F.size(F.array_union(p, q)).cast("double")), F.lit(0.0))}


#: Scorers that are expressions: they take two columns and give a column for each field.
EXPRESSIONS: dict[str, Callable[[Column, Column], dict[str, Column]]] = {"lexical": lexical_columns}


def register(name: str, scorer: Scorer, fields: tuple[str, ...]) -> None:
    """Adds a scorer with the fields that it returns. Load a model on first call, so a worker holds one."""
    EXPRESSIONS.pop(name, None)
    SCORERS[name] = (scorer, fields)


#: Bytes of a table's file, at most: each worker holds one.
TABLE_BYTES = 1 << 30
_tables: dict[str, tuple[dict[str, int], np.ndarray]] = {}


class TableScorer:
    """Cosine of the sums of word vectors from a table's file: Parquet with word and vector, loaded once a worker. Words that it does not know count for nothing; a text without known words scores 0."""

    def __init__(self, path: str, word: str = "word", vector: str = "vector"):
        self.path, self.word, self.vector = path, word, vector

    def _table(self) -> tuple[dict[str, int], np.ndarray]:
        if self.path not in _tables:
            from pyarrow import parquet

            from tracewise.sources.archives import opened

            files, name = opened(self.path)
            if (size := files.get_file_info(name).size or 0) > TABLE_BYTES:
                raise ValueError(f"a table has at most {TABLE_BYTES} bytes, not {size}")
            rows = parquet.read_table(name, columns=[self.word, self.vector], filesystem=files)
            _tables[self.path] = {w: k for k, w in enumerate(rows[self.word].to_pylist())}, np.array(rows[self.vector].to_pylist(), dtype=float)
        return _tables[self.path]

    def _sums(self, texts: list[str]) -> np.ndarray:
        places, vectors = self._table()
        found = [[places[w] for w in t.lower().split() if w in places] for t in texts]
        flat = np.array([k for f in found for k in f], dtype=np.int64)
        out = np.zeros((len(texts), vectors.shape[1] if vectors.ndim == 2 else 0))
        np.add.at(out, np.repeat(np.arange(len(texts)), [len(f) for f in found]), vectors[flat] if len(flat) else out[:0])
        return out

    def __call__(self, a: list[str], b: list[str]) -> dict[str, list[float]]:
        x, y = self._sums(a), self._sums(b)
        size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        return {"raw_score": np.divide((x * y).sum(axis=1), size, out=np.zeros(len(a)), where=size > 0).tolist()}


def register_table(name: str, path: str, word: str = "word", vector: str = "vector") -> None:
    """Adds a scorer over a table of word vectors. A table that cannot be read is an error on the rows that it should score."""
    register(name, TableScorer(path, word, vector), ("raw_score",))


def score_pairs(pairs: DataFrame, name: str, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """pairs with scorer, its fields and error (null if the batch was scored). An unknown scorer gives errors."""
    scorer, fields = SCORERS.get(name, (None, ("raw_score",)))
    if name in EXPRESSIONS:
        made = EXPRESSIONS[name](F.col(a), F.col(b))
        return pairs.select("*", F.lit(name).alias("scorer"), *[made[f].alias(f) for f in fields], F.lit(None).cast("string").alias("error"))
    schema = T.StructType([*pairs.schema.fields, T.StructField("scorer", T.StringType()), *[T.StructField(f, T.DoubleType()) for f in fields], T.StructField("error", T.StringType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, error, got = batch.num_rows, None, {}
            try:
                if scorer is None:
                    raise KeyError(f"unknown scorer: {name}")
                texts = [[t or "" for t in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in (a, b)]
                got = scorer(*texts)
            except Exception as e:  # noqa: BLE001  errors are data here
                error = f"{type(e).__name__}: {e}"
            columns = [pa.array(got.get(f, [None] * n), type=pa.float64()) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([name] * n), *columns, pa.array([error] * n, type=pa.string())], names=[*batch.schema.names, "scorer", *fields, "error"])

    return pairs.mapInArrow(score, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, null if one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


#: Rows of one side that are compared with all of the other at once.
BLOCK = 1024
_MATCH = pa.struct([(c, pa.float64()) for c in ("precision", "recall", "f1")])


def _vectors(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's token vectors as a matrix; null for a null, and where vectors are null or differ in length."""
    rows = column.offsets.to_numpy()
    tokens = column.values
    begins, values = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False)
    for i, (x, y) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        sizes = np.diff(begins[x : y + 1])
        if not column[i].is_valid or len(sizes) and ((sizes != sizes[0]).any() or tokens.null_count and tokens[x:y].null_count):
            yield None
        else:
            yield values[begins[x] : begins[y]].reshape(y - x, sizes[0] if len(sizes) else 0)


def _matched(x: np.ndarray | None, y: np.ndarray | None) -> dict | None:
    if x is None or y is None or len(x) and len(y) and x.shape[1] != y.shape[1]:
        return None
    if not len(x) or not len(y):
        return {"precision": 0.0, "recall": 0.0, "f1": 0.0}
    of_x, of_y = np.full(len(x), -np.inf), np.full(len(y), -np.inf)
    for k in range(0, len(x), BLOCK):
        sims = x[k : k + BLOCK] @ y.T
        of_x[k : k + BLOCK] = sims.max(axis=1)
        np.maximum(of_y, sims.max(axis=0), out=of_y)
    p, r = float(of_y.mean()), float(of_x.mean())
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("precision", "recall", "f1")]))
def _token_match(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_matched(x, y) for x, y in zip(_vectors(a), _vectors(b), strict=True)], _MATCH)


def token_match(a: Column, b: Column) -> Column:
    """(precision, recall, f1) of two arrays of unit token vectors: mean best similarity of b's and of a's tokens; 0 if one is empty, null if one is null or vectors differ in length. A matrix product a pair, in Arrow batches."""
    vectors = "array<array<double>>"
    return _token_match(a.cast(vectors), b.cast(vectors))
