"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without outer ASCII white space and with ASCII letters lower-cased; keys
of at least min_chars code points take part. A store holds, in a folder, versions of

- postings: (hi, lo, doc_id), one for each document and key that a version brought;
- references: (hi, lo, refs, first_doc, last_doc), the exact counts of keys that a version touched;
- filters: for each shard that a version touched, a cuckoo filter of its keys;
- gone: (doc_id), documents that a version took out.

Each insert or delete writes what it changes as the next version and marks it complete at the end,
so an attempt that fails leaves the store as it was, and a store can be opened again by its path.
The newest row of a key or shard counts.

Inserting documents probes the filters first: a key that its filter does not know is new and needs no
look into the exact table; only the rest is settled exactly, and new keys go into the loaded filters
of their shards. Deleting documents recounts only the keys that they held, and takes keys without
references out of the filters, so a later document keeps the lines that the deleted one had
kept. Keys are 128-bit hashes, and each is counted before rows meet at a shard, so a line that
a third of all documents hold is one row there. Shards are derived from the number of keys, about
SHARD_KEYS each, and are dealt anew when they have grown to four times that.

Defined results: a null or empty text is one empty line; repeated lines in the keeping document
all stay; rows with equal ids in one insert are one document; inserting an id that the store holds
changes nothing (delete it first to replace its text); deleting an unknown id changes nothing; rows with a
null id keep all lines; ties cannot be, as ids differ; a very long text is split in one task, about 200 bytes for
each of its lines; an empty table gives an empty result; extra columns are kept, whatever their names,
and columns named n_lines, n_dropped or kept_text (in any case) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.shared import held, new_path, small_batches, spread_join, written

#: Keys of a shard, about: 100 bytes each while its filter is in a task.
SHARD_KEYS = 250_000
_KEY = ["hi", "lo"]


class CuckooFilter:
    """16-bit fingerprints in buckets of 4, all steps on arrays. Never misses a key it holds."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / 4 / 0.85))))
        self.table = np.zeros((buckets, 4), dtype=np.uint16) if table is None else table

    @classmethod
    def loaded(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, dtype=np.uint16).reshape(-1, 4).copy())

    def dumped(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = ((lo.view(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (hi.view(np.uint64) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ ((mark.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hi, lo)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if it is too full; the filter must then be rebuilt with more room."""
        mark, at, _ = self._places(hi, lo)
        for turn in range(500):
            if not len(mark):
                return True
            order = np.unique(at, return_index=True)[1]  # one key for each bucket and round
            b, m = at[order], mark[order]
            free = self.table[b] == 0
            slot = np.where(free.any(axis=1), free.argmax(axis=1), (turn + b) % 4 if turn else 0)
            out = self.table[b, slot].copy()
            full = out != 0
            if turn == 0:  # first try the second bucket before any is put out
                put = ~full
                self.table[b[put], slot[put]] = m[put]
                stay = np.ones(len(mark), dtype=bool)
                stay[order[put]] = False
                again = np.zeros(len(mark), dtype=bool)
                again[order[full]] = True
                at = np.where(again, self._other(at, mark), at)
                mark, at = mark[stay], at[stay]
                continue
            self.table[b, slot] = m
            stay = np.ones(len(mark), dtype=bool)
            stay[order] = False
            mark, at = np.concatenate([mark[stay], out[full]]), np.concatenate([at[stay], self._other(b[full], out[full])])
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Only for keys that were inserted."""
        for m, one, two in zip(*self._places(hi, lo), strict=True):
            for b in (one, two):
                slot = np.flatnonzero(self.table[b] == m)
                if len(slot):
                    self.table[b, slot[0]] = 0
                    break


def _keys(text: bytes | None, min_chars: int) -> list[bytes]:
    """A key digest of each line, empty where the line takes no part."""
    out = []
    for line in (text or b"").split(b"\n"):
        k = line.strip()
        if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode()) < min_chars):
            out.append(b"")
        else:
            out.append(xxhash.xxh3_128_digest(k.lower()))
    return out


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(hi, lo, doc_id): the distinct keys of each row with an id."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = set(_keys(t, min_chars))
                own.discard(b"")
                digests += own
                ids += [i] * len(own)
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(ids, type=pa.int64())], names=["hi", "lo", "doc_id"])

    rows, _ = held(docs, {"doc_id": key, "text": text}, packed=False)
    return rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(explode, _SCHEMAS["postings"])


def _counted(posted: DataFrame) -> DataFrame:
    return posted.groupBy(*_KEY).agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def _filter_of(pdf: pd.DataFrame) -> bytes:
    """A filter with room for twice the keys."""
    room = max(64, 2 * len(pdf))
    while True:
        f = CuckooFilter(room)
        if f.insert(pdf["hi"].to_numpy(), pdf["lo"].to_numpy()):
            return f.dumped()
        room *= 2


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [_filter_of(pdf)], "n": [len(pdf)]})


def _joined(own: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter with new keys; null where it has no room."""
    if not len(own):
        return pd.DataFrame({"shard": [], "filter": [], "n": []}).astype({"shard": "int32", "n": "int64"})
    shard, n = int(own["shard"].iloc[0]), len(own) + (int(kept["n"].iloc[0]) if len(kept) else 0)
    if not len(kept):
        return pd.DataFrame({"shard": [shard], "filter": [_filter_of(own)], "n": [n]})
    f = CuckooFilter.loaded(kept["filter"].iloc[0])
    fits = n <= 0.85 * f.table.size and f.insert(own["hi"].to_numpy(), own["lo"].to_numpy())
    return pd.DataFrame({"shard": [shard], "filter": [f.dumped() if fits else None], "n": [n]})


def _stripped(own: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter without keys that it holds."""
    if not len(kept) or not len(own):
        return kept.iloc[:0]
    f = CuckooFilter.loaded(kept["filter"].iloc[0])
    f.delete(own["hi"].to_numpy(), own["lo"].to_numpy())
    return pd.DataFrame({"shard": kept["shard"], "filter": [f.dumped()], "n": kept["n"] - len(own)})


def _probed(own: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    if len(own):
        own["maybe"] = CuckooFilter.loaded(kept["filter"].iloc[0]).has(own["hi"].to_numpy(), own["lo"].to_numpy()) if len(kept) else False
    else:
        own["maybe"] = pd.Series(dtype=bool)
    return own


_SCHEMAS = {
    "postings": "hi long, lo long, doc_id long",
    "references": "hi long, lo long, refs long, first_doc long, last_doc long",
    "filters": "shard int, filter binary, n long",
    "gone": "doc_id long",
    "documents": "doc_id long",
}


class LineStore:
    """A store below path; version is its newest complete version, 0 for a new one. A store has one writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = 10, shards: int | None = None):
        """shards: a number to begin with; else it follows from the first insert's keys."""
        small_batches(spark)
        self.spark, self.path, self.min_chars, self.shards, self.version = spark, path or new_path(spark, "line-store"), min_chars, shards, 0
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/complete")
        files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if files.exists(root):
            done = [tuple(map(int, f.getPath().getName().split("-"))) for f in files.listStatus(root)]
            self.version, self.shards, self.min_chars = max(done)

    def _complete(self) -> None:
        self.version += 1
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/complete/{self.version}-{self.shards}-{self.min_chars}")
        mark.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).create(mark, True).close()

    def _put(self, what: str, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/{what}/version={self.version + 1}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_SCHEMAS[what]).parquet(path)

    def _read(self, what: str) -> DataFrame:
        """All rows of complete versions, with their version."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(root):
            return self.spark.createDataFrame([], f"{_SCHEMAS[what]}, version int")
        return self.spark.read.schema(f"{_SCHEMAS[what]}, version int").parquet(f"{self.path}/{what}").where(F.col("version") <= self.version)

    def _shard(self) -> Column:
        return F.pmod(F.shiftrightunsigned("hi", 32), F.lit(self.shards)).cast("int").alias("shard")

    def _standing(self, what: str) -> DataFrame:
        """Rows of postings or documents whose document was not taken out since."""
        rows, gone = self._read(what), self._read("gone")
        if not self._deleted():
            return rows.drop("version")
        gone = gone.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("version").alias("_at"))
        return rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("version") < F.col("_at")), "left_anti").drop("version")

    def _deleted(self) -> bool:
        return not self._read("gone").isEmpty()

    def posted(self) -> DataFrame:
        """(hi, lo, doc_id) of the documents that the store holds."""
        return self._standing("postings")

    def _current(self) -> DataFrame:
        """(hi, lo, refs, first_doc, last_doc) of all keys ever held; refs is 0 for those that no document holds now."""
        rows = self._read("references")
        if self.version == 1:
            return rows.drop("version")
        return rows.groupBy(*_KEY).agg(F.max(F.struct("version", "refs", "first_doc", "last_doc")).alias("_r")).select(*_KEY, "_r.refs", "_r.first_doc", "_r.last_doc")

    def references(self) -> DataFrame:
        """(shard, hi, lo, refs, first_doc, last_doc): the documents of each key, exactly."""
        return self._current().where("refs > 0").select(self._shard(), "*")

    def filters(self) -> DataFrame:
        """(shard, filter, n): the newest filter of each shard, and its keys."""
        rows = self._read("filters")
        newest = rows.groupBy("shard").agg(F.max("version").alias("version"))
        return rows.join(newest, ["shard", "version"]).drop("version")

    def known(self, keys: DataFrame) -> DataFrame:
        """keys (shard, hi, lo, ...) with `maybe`: whether the shard's filter may hold the key. False is certain."""
        schema = T.StructType([*keys.schema.fields, T.StructField("maybe", T.BooleanType())])
        return keys.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(_probed, schema)

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Adds the documents whose ids the store does not hold yet."""
        ids, _ = held(docs, {"doc_id": key}, packed=False)
        ids = ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).groupBy("doc_id").agg(F.count("*").alias("n"))
        new = postings(docs, key, text, self.min_chars)
        if self.version:
            there = self._standing("documents")
            ids, new = ids.join(there, "doc_id", "left_anti"), new.join(there, "doc_id", "left_anti")
        ids = written(ids, "ids")
        self._put("documents", ids.select("doc_id"))
        if not ids.where("n > 1").isEmpty():
            new = new.distinct()
        counted = _counted(self._put("postings", new))
        if not self.version:
            fresh = self._put("references", counted)
            if self.shards is None:
                self.shards = max(16, 1 << (fresh.count() // SHARD_KEYS).bit_length())
            self._put("filters", self._rebuilt(fresh))
        else:
            probed = written(self.known(counted.select(self._shard(), "*")), "probed").drop("shard")
            old = self._current().select(*_KEY, *[F.col(c).alias(f"old_{c}") for c in ("refs", "first_doc", "last_doc")])
            settled = probed.where("maybe").join(old, _KEY, "left").withColumn("new", F.coalesce("old_refs", F.lit(0)) == 0)
            both = {"refs": F.col("refs") + F.coalesce("old_refs", F.lit(0)), "first_doc": F.least("first_doc", "old_first_doc"), "last_doc": F.greatest("last_doc", "old_last_doc")}
            settled = written(settled.select(*_KEY, *[F.when(F.col("new"), F.col(c)).otherwise(e).alias(c) for c, e in both.items()], "new"), "settled")
            sure = probed.where("NOT maybe").drop("maybe")
            self._put("references", sure.unionByName(settled.drop("new")))
            self._widened(sure.select(*_KEY).unionByName(settled.where("new").select(*_KEY)))
        self._complete()

    def _rebuilt(self, references: DataFrame) -> DataFrame:
        return references.select(self._shard(), *_KEY).groupBy("shard").applyInPandas(_built, _SCHEMAS["filters"])

    def _widened(self, fresh: DataFrame) -> None:
        """Puts new keys into the filters of their shards. Filters without room are built anew from the exact table, as are all when shards have grown fourfold."""
        made = written(fresh.select(self._shard(), *_KEY).groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(_joined, _SCHEMAS["filters"]), "filters")
        largest = made.agg(F.max("n")).first()[0] or 0
        full = made.where("filter IS NULL").select("shard")
        if largest <= 4 * SHARD_KEYS and full.isEmpty():
            self._put("filters", made)
            return
        self.version += 1  # the exact table of this version is written
        now = self._current().where("refs > 0")
        self.version -= 1
        if largest > 4 * SHARD_KEYS:
            self.shards *= 1 << (largest // SHARD_KEYS).bit_length()
            self._put("filters", self._rebuilt(now))
        else:
            again = now.select(self._shard(), *_KEY).join(F.broadcast(full), "shard", "left_semi")
            self._put("filters", made.where("filter IS NOT NULL").unionByName(again.groupBy("shard").applyInPandas(_built, _SCHEMAS["filters"])))

    def delete(self, ids: DataFrame, key: str = "doc_id") -> None:
        """Takes documents out: as if they had never been inserted."""
        ids, _ = held(ids, {"doc_id": key}, packed=False)
        ids = written(ids.select(F.col("doc_id").cast("long")).distinct().join(self._standing("documents"), "doc_id", "left_semi"), "ids")
        posted = self.posted()
        touched = written(posted.join(ids, "doc_id", "left_semi").select(*_KEY).distinct(), "touched")
        counted = _counted(posted.join(ids, "doc_id", "left_anti").join(touched, _KEY, "left_semi"))
        counted = touched.join(counted, _KEY, "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
        self._put("gone", ids)
        empty = self._put("references", counted).where("refs = 0").select(self._shard(), *_KEY)
        self._put("filters", empty.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(_stripped, _SCHEMAS["filters"]))
        self._complete()

    def drops(self) -> DataFrame:
        """(doc_id, drop): for each document the key digests that an earlier document holds."""
        shared = written(self._current().where("first_doc < last_doc").select(*_KEY, "first_doc", "refs"), "shared")
        pairs = spread_join(self.posted(), shared, _KEY, "refs").where("doc_id <> first_doc")
        return pairs.groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("drop"))


def deduped(docs: DataFrame, store: LineStore, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs of the store with n_lines, n_dropped and kept_text."""
    made, min_chars = ("n_lines", "n_dropped", "kept_text"), store.min_chars
    rows, back = held(docs, {"_line_doc": key, "_line_text": text}, made)
    drops = store.drops().select(F.col("doc_id").alias("_line_of"), F.col("drop").alias("_line_drop"))
    marked = rows.join(drops, F.col("_line_doc") == F.col("_line_of"), "left").drop("_line_of")
    schema = T.StructType([*marked.schema.fields[:-1], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, kept = [], [], []
            for t, d in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                own = (t or b"").split(b"\n")
                lines.append(len(own))
                if not d:
                    dropped.append(0)
                    kept.append((t or b"").decode())
                    continue
                gone = {np.array([x["hi"], x["lo"]], dtype="<i8").tobytes() for x in d}
                rest = [x for x, k in zip(own, _keys(t, min_chars), strict=True) if k not in gone]
                dropped.append(len(own) - len(rest))
                kept.append(b"\n".join(rest).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lines, type=pa.int64()), pa.array(dropped, type=pa.int64()), pa.array(kept, type=pa.string())], names=[*batch.schema.names[:-1], *made])

    return marked.mapInArrow(keep, schema).select(*back, *made)
