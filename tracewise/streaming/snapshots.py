"""A keyed state that stays small: a snapshot with a row a key, and the batches that came after it.

    state/manifest-<version>.json           which snapshot holds, and the last batch of each stream in it
    state/snapshot-<version>-<id>/bucket=…   a row a key, in buckets of the key's hash
    state/delta/<stream>/batch=<n>           rows of a batch, the last of each key

A batch is written whole under its number, so one that runs again replaces itself, and one that a snapshot holds already is left out.
Every `keep` batches they are merged with the snapshot into the next one. A reader takes the snapshot that the highest manifest names and the
batches behind it, so what it reads grows with keys and recent batches, not with the log. A manifest is put in place by a rename that
fails if its version is there, so of two writers one is told to try again. The snapshot before the last is kept for readers that began
with it; older files go. A crash leaves at most files that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.streaming.state import STATE, latest


class Conflict(RuntimeError):
    """Another writer has put the next version in place."""


class StateTable:
    """Rows of schema by key under root; of rows of one key the last in order counts. buckets must stay the same."""

    def __init__(self, spark: SparkSession, root: str, key: str = "pair_id", order: tuple[str, ...] = ("updated_at",), schema: T.StructType = STATE, keep: int = 8, buckets: int = 64):
        self.spark, self.root, self.key, self.order, self.schema, self.keep, self.buckets = spark, root.rstrip("/"), key, order, schema, keep, buckets
        self._jvm = spark._jvm
        self._store = self._path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._store.listStatus(path)) if self._store.exists(path) else []

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> dict:
        """version, snapshot (a folder's name, null before the first) and merged, the last batch of each stream in it."""
        versions = [int(n[9:-5]) for n in self._names(self.root) if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return {"version": 0, "snapshot": None, "merged": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifest-{max(versions):012d}.json", wholetext=True).first()[0])

    def batches(self, manifest: dict | None = None) -> dict[str, list[int]]:
        """Numbers of the batches of each stream that no snapshot holds yet, in order."""
        merged = (manifest or self.manifest())["merged"]
        found = {s: sorted(int(n[6:]) for n in self._names(f"{self.root}/delta/{s}") if n.startswith("batch=")) for s in self._names(f"{self.root}/delta")}
        return {s: left for s, ns in found.items() if (left := [n for n in ns if n > merged.get(s, -1)])}

    def append(self, rows: DataFrame, stream: str, n: int) -> None:
        """Adds batch n of a stream, and merges batches once there are keep of them. Batches of a stream come in order."""
        manifest = self.manifest()
        if n <= manifest["merged"].get(stream, -1):
            return
        latest(rows.select(*self.schema.fieldNames()), self.key, self.order).write.mode("overwrite").parquet(f"{self.root}/delta/{stream}/batch={n}")
        if sum(map(len, self.batches(manifest).values())) >= self.keep:
            self.compact()

    def _rows(self, manifest: dict, keys: list[int] | None = None) -> DataFrame:
        parts = [self.spark.createDataFrame([], self.schema)]
        bucket = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        if manifest["snapshot"]:
            snapshot = self.spark.read.schema(bucket).parquet(f"{self.root}/{manifest['snapshot']}")
            parts.append((snapshot if keys is None else snapshot.where(F.col("bucket").isin(keys))).drop("bucket"))
        paths = [f"{self.root}/delta/{s}/batch={n}" for s, ns in self.batches(manifest).items() for n in ns]
        if paths:
            deltas = self.spark.read.schema(self.schema).parquet(*paths)
            parts.append(deltas if keys is None else deltas.where(self._bucket().isin(keys)))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return latest(rows, self.key, self.order)

    def read(self) -> DataFrame:
        """The last row of each key."""
        return self._rows(self.manifest())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The last rows of keys (key); only the snapshot's buckets that hold one are read."""
        wanted = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # at most buckets numbers
        return self._rows(self.manifest(), wanted).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def compact(self) -> None:
        """Merges the snapshot and all batches into the next snapshot."""
        manifest = self.manifest()
        batches = self.batches(manifest)
        if not batches:
            return
        version = manifest["version"] + 1
        name = f"snapshot-{version:012d}-{uuid.uuid4().hex[:12]}"
        rows = self._rows(manifest).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}")
        self._commit({"version": version, "snapshot": name, "merged": manifest["merged"] | {s: ns[-1] for s, ns in batches.items()}})
        self._remove({name, manifest["snapshot"]}, batches)

    def _commit(self, manifest: dict) -> None:
        target, draft = self._path(f"{self.root}/manifest-{manifest['version']:012d}.json"), self._path(f"{self.root}/.draft-{uuid.uuid4().hex}")
        out = self._store.create(draft)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._store.exists(target) or not self._store.rename(draft, target):
            self._store.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is there already")

    def _remove(self, kept: set, batches: dict[str, list[int]]) -> None:
        for name in self._names(self.root):
            if name.startswith("snapshot-") and name not in kept:
                self._store.delete(self._path(f"{self.root}/{name}"), True)
        for stream, ns in batches.items():
            for n in ns:
                self._store.delete(self._path(f"{self.root}/delta/{stream}/batch={n}"), True)


def ingest(spark: SparkSession, source: str, table: StateTable, checkpoint: str, stream: str = "results", files_at_once: int = 100):
    """A stream that takes new result files (JSON lines of the table's schema without status) of source into the table, and ends when none are left."""
    from tracewise.streaming.state import recorded

    rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_at_once).json(source)
    put = lambda batch, n: table.append(recorded(batch), stream, n)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
