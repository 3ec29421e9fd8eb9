"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words hashed into WORD_SLOTS (square roots of counts, of length 1), and
structure statistics: shares of character kinds, lengths of words and lines, and how often words
and lines repeat, each put into STEPS overlapping steps between quantiles of the sample. The only
metadata is the text's length in bytes, taken from the text itself. The model is w0 + sum w_i x_i +
sum over pairs <v_i, v_j> x_i x_j; the pairwise term is summed in linear time as half of
|sum v_i x_i|^2 - sum |v_i|^2 x_i^2. It is fitted by Adam on the driver, on at most FIT_ROWS
labelled rows taken by a hash of their id. The driver gets all features of those rows and no others:
at most WORD_SLOTS pairs of 6 bytes a row, so at most 100 MB at any input size. Every row is scored
on its whole text, in tasks, without a shuffle.

Defined results: a null or empty text has zero features and still a score; rows without a label or
with a null text do not train; labels of one id that differ count as the larger; of texts of one id the
smallest trains; a score of exactly 0.5 is predicted 1; if fewer than two classes can train,
every score is the share of good rows, or 0.5 without any; repeated rows score alike; a very long
text is a numpy pass of its own, of about 60 bytes for each byte of it; an empty table gives an
empty result; extra columns are kept, whatever their names, and columns named score or predicted
(in any case) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.shared import NOT_SPACE, chunks, giving_back, held, quoted, small_batches, word_table

WORD_SLOTS = 1 << 12
RANK = 8
STEPS = 8
#: Labelled rows that the model is fitted on at most.
FIT_ROWS = 4000
EPOCHS, BATCH_ROWS, RATE, DECAY = 12, 128, 0.02, 1e-4

_CLASSES = np.zeros(256, dtype=np.uint8)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 mark of a sentence, 6 beyond ASCII
_CLASSES[0x61:0x7B], _CLASSES[0x41:0x5B], _CLASSES[0x30:0x3A], _CLASSES[0x80:] = 1, 2, 3, 6
_CLASSES[[0x20, *range(0x09, 0x0E)]] = 4
_CLASSES[[ord(c) for c in ".,;:!?"]] = 5
STATS = 16


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics (a row for each text), and of all distinct word slots of a text: text number, slot, value."""
    words, of, first, end = word_table(texts, NOT_SPACE)
    n = len(texts)
    stats = np.zeros((n, STATS))
    begins = np.searchsorted(of, np.arange(n + 1))
    slot = (words % np.uint64(WORD_SLOTS)).astype(np.int64)
    pairs, counts = np.unique(of * WORD_SLOTS + slot, return_counts=True)
    text_of, slots = pairs // WORD_SLOTS, pairs % WORD_SLOTS
    norm = np.maximum(np.bincount(text_of, weights=counts, minlength=n), 1)
    values = np.sqrt(counts / norm[text_of])
    lengths = end - first
    for d, t in enumerate(texts):
        if not t:
            continue
        raw = np.frombuffer(t, dtype=np.uint8)
        kinds = np.bincount(_CLASSES[raw], minlength=7) / len(raw)
        a, b = begins[d], begins[d + 1]
        w = words[a:b]
        m = max(1, b - a)
        lines = t.split(b"\n")
        distinct = len(np.unique(w))
        common = np.unique(w, return_counts=True)[1].max() if b > a else 0
        stats[d] = [
            *kinds,
            np.log1p(len(raw)),
            np.log1p(b - a),
            lengths[a:b].mean() if b > a else 0,
            lengths[a:b].std() if b > a else 0,
            distinct / m,
            common / m,
            (w[1:] == w[:-1]).sum() / m,
            1 - len(set(lines)) / len(lines),
            np.log1p(len(raw) / len(lines)),
        ]
    return stats, text_of, slots, values


class Steps:
    """Statistics as overlapping steps: how far each is past each of STEPS quantiles."""

    def __init__(self, stats: np.ndarray):
        self.at = np.quantile(stats, np.linspace(0.02, 0.98, STEPS), axis=0)
        self.wide = np.maximum(np.quantile(stats, 0.9, axis=0) - np.quantile(stats, 0.1, axis=0), 1e-3) / STEPS

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats[:, None, :] - self.at) / self.wide, -1, 1).reshape(len(stats), -1) / np.sqrt(STATS * STEPS)


class Machine:
    """The factorisation machine. Its inputs: WORD_SLOTS word slots, then STATS * STEPS steps."""

    def __init__(self, steps: Steps, bias: float):
        rng = np.random.default_rng(7)
        size = WORD_SLOTS + STATS * STEPS
        self.steps, self.bias = steps, np.array([bias])
        self.linear = np.zeros(size)
        self.factors = rng.normal(0, 0.05, (size, RANK))

    def raw(self, dense: np.ndarray, text_of: np.ndarray, slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the factor sums of each text."""
        n = len(dense)
        v = self.factors[slots] * values[:, None]
        sums = np.stack([np.bincount(text_of, weights=v[:, r], minlength=n) for r in range(RANK)], axis=1) + dense @ self.factors[WORD_SLOTS:]
        squares = np.bincount(text_of, weights=(v**2).sum(axis=1), minlength=n) + dense**2 @ (self.factors[WORD_SLOTS:] ** 2).sum(axis=1)
        linear = np.bincount(text_of, weights=self.linear[slots] * values, minlength=n) + dense @ self.linear[WORD_SLOTS:]
        return self.bias[0] + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, texts: list[bytes]) -> np.ndarray:
        stats, *sparse = features(texts)
        return 1 / (1 + np.exp(-np.clip(self.raw(self.steps(stats), *sparse)[0], -35, 35)))

    def fit(self, dense: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        params = [self.bias, self.linear, self.factors]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
        turn = 0
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH_ROWS)):
                turn += 1
                text_of = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                slots, values = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
                x = dense[batch]
                raw, sums = self.raw(x, text_of, slots, values)
                g = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y[batch]) * weight[batch] / len(batch)
                gl, gf = np.zeros_like(self.linear), np.zeros_like(self.factors)
                np.add.at(gl, slots, g[text_of] * values)
                gl[WORD_SLOTS:] = x.T @ g
                own = g[text_of, None] * values[:, None] * (sums[text_of] - self.factors[slots] * values[:, None])
                np.add.at(gf, slots, own)
                gf[WORD_SLOTS:] = x.T @ (g[:, None] * sums) - self.factors[WORD_SLOTS:] * (x**2).T.dot(g)[:, None]
                for p, d, m, s in zip(params, (np.array([g.sum()]), gl + DECAY * self.linear, gf + DECAY * self.factors), first, second, strict=True):
                    m *= 0.9
                    m += 0.1 * d
                    s *= 0.999
                    s += 0.001 * d * d
                    p -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)


class Constant:
    def __init__(self, share: float):
        self.share = share

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_SAMPLE = "stats binary, slots binary, amounts binary, y double"


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for part in chunks([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]):
            stats, text_of, slots, values = features(part)
            ends = np.searchsorted(text_of, np.arange(len(part) + 1))
            rows = []
            for d in range(len(part)):
                own = slice(ends[d], ends[d + 1])
                rows.append((stats[d].tobytes(), slots[own].astype(np.int16).tobytes(), values[own].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], type=pa.binary()) for k in range(3)], batch.column(1).slice(done, len(part))], names=["stats", "slots", "amounts", "y"])
            done += len(part)


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Machine | Constant:
    """A model of the labels, from rows that are not held out."""
    small_batches(docs.sparkSession)
    key, text, label = quoted(key), quoted(text), quoted(label)
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_q_id")).agg(F.max(label).cast("double").alias("y"))
    own = own.where(~held_out(F.col("_q_id"))).orderBy(F.md5(F.col("_q_id").cast("string")), "_q_id").limit(rows)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_q_doc"), F.col(text).alias("t"))
    one = texts.join(F.broadcast(own), F.col("_q_doc") == F.col("_q_id")).groupBy("_q_id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    sample = one.select("t", "y").mapInArrow(giving_back(_sampled), _SAMPLE)
    got = sorted((tuple(r) for r in sample.collect()), key=lambda r: (bytes(r[0]), bytes(r[1]), r[3]))
    y = np.array([r[3] for r in got])
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    stats = np.array([np.frombuffer(r[0]) for r in got])
    steps = Steps(stats)
    model = Machine(steps, float(np.log(y.mean() / (1 - y.mean()))))
    model.fit(steps(stats), [(np.frombuffer(r[1], dtype=np.int16).astype(np.int64), np.frombuffer(r[2], dtype=np.float32).astype(float)) for r in got], y)
    return model


def scored(docs: DataFrame, model: Machine | Constant, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from a score of 0.5)."""
    small_batches(docs.sparkSession)
    rows, back = held(docs, {"text": text}, ("score", "predicted"))
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            got = np.concatenate([np.zeros(0), *[model_.value.score(part) for part in chunks(texts)]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(giving_back(score), schema).select(*back, "score", "predicted")
