"""Sharding by fixed virtual slots.

Each record hashes into one of SLOTS virtual slots for good. Bytes are summed per slot, and a
versioned table maps slots to shards. Rebalancing never rehashes records: it edits the newest
map, moving as few slots as even sizes need, and writes the result as the next version. Only
DataFrame functions touch records; the map has SLOTS rows at any input size, so editing it on
the driver and broadcasting it are bounded.

A record's place is the rows of its shard in earlier virtual slots, plus those of its slot in earlier
parts (PARTS by further bits of its hash), plus its rank in its part. So a task sorts 1 of
SLOTS * PARTS shares of the records, and the offsets have at most SLOTS * PARTS rows.

Defined results: a null text counts as no bytes; a null key hashes by its text; ties (equal keys and
texts) are alike, and which of them comes first is open; repeated rows each get a place of their
own, but hash alike, so they share a shard; a very long text is one record, measured by built-in
functions without a copy of it in Python, and makes its shard heavier by its own bytes at most; an
empty table gives an empty result and an even map; extra columns are kept, whatever their names,
and columns named as those made here (in any case) are replaced.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.shared import held, new_path, written

#: Virtual slots, and the parts of each in which rows are ranked: fixed for the life of a dataset.
SLOTS, PARTS = 4096, 16

_MAP = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("first_place", T.LongType())])


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _shard_size (UTF-8 bytes plus 1), _shard_crc, _shard_vslot and _shard_part."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return (
        docs.withColumn("_shard_size", (F.octet_length(body) + 1).cast("long"))
        .withColumn("_shard_crc", F.crc32(body.cast("binary")))
        .withColumn("_shard_hash", F.xxhash64(F.col(key), F.col("_shard_crc")))
        .withColumn("_shard_vslot", F.pmod("_shard_hash", F.lit(SLOTS)).cast("int"))
        .withColumn("_shard_part", F.pmod(F.shiftright("_shard_hash", 12), F.lit(PARTS)).cast("int"))
        .drop("_shard_hash")
    )


def slot_sums(parts: DataFrame) -> list[tuple[int, int]]:
    """Bytes and rows of each virtual slot: SLOTS pairs. parts: (_shard_vslot, b, n)."""
    sums = [(0, 0)] * SLOTS
    for r in parts.groupBy("_shard_vslot").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect():
        sums[r["_shard_vslot"]] = (r["b"], r["n"])
    return sums


def first_map(shards: int) -> list[int]:
    """Version 0: slots dealt round, before any bytes are known."""
    return [s % shards for s in range(SLOTS)]


def rebalanced(owner: list[int], weights: list[int], shards: int, tolerance: float = 0.0) -> list[int]:
    """An edit of owner: while it helps, the heaviest shard gives the lightest the slot nearest to half their difference.

    Slots move only between shards 0 to shards - 1; tolerance is the share of the mean that the
    heaviest and lightest may differ by. With more shards than owner uses, new shards fill up from
    the others; with fewer, the slots of the dropped ones go to the lightest first.
    """
    owner = list(owner)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    homeless = []
    for s, o in enumerate(owner):
        if o >= shards:
            homeless.append(s)
            continue
        load[o] += weights[s]
        if weights[s]:
            held[o].append((weights[s], s))
    for h in held:
        h.sort()
    light = [(load[o], o) for o in range(shards)]
    heapq.heapify(light)
    for s in sorted(homeless, key=lambda s: (-weights[s], s)):
        _, o = heapq.heappop(light)
        owner[s] = o
        load[o] += weights[s]
        if weights[s]:
            insort(held[o], (weights[s], s))
        heapq.heappush(light, (load[o], o))
    allowed = tolerance * sum(load) / shards
    while True:
        low, high = min(range(shards), key=lambda o: (load[o], o)), max(range(shards), key=lambda o: (load[o], -o))
        gap = load[high] - load[low]
        if gap <= allowed:
            return owner
        at = bisect_left(held[high], (gap / 2, -1))
        near = [held[high][i] for i in (at - 1, at) if 0 <= i < len(held[high]) and held[high][i][0] < gap]
        if not near:
            return owner
        w, s = min(near, key=lambda x: (abs(x[0] - gap / 2), x[1]))
        held[high].remove((w, s))
        insort(held[low], (w, s))
        load[high] -= w
        load[low] += w
        owner[s] = low


def save_map(spark: SparkSession, store: str, version: int, owner: list[int], sums: list[tuple[int, int]]) -> DataFrame:
    """Writes one version of the map. first_place: rows of the shard in its earlier slots."""
    places: dict[int, int] = {}
    rows = []
    for s, (o, (b, n)) in enumerate(zip(owner, sums, strict=True)):
        rows.append((s, o, b, n, places.get(o, 0)))
        places[o] = places.get(o, 0) + n
    spark.createDataFrame(rows, _MAP).coalesce(1).write.parquet(f"{store}/version={version}")
    return load_map(spark, store, version)


def load_map(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.schema(_MAP).parquet(f"{store}/version={version}")


def newest_version(spark: SparkSession, store: str) -> int | None:
    """The highest map version in a store, None if it has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = files.listStatus(path) if files.exists(path) else []
    names = [f.getPath().getName() for f in found]
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=None)


def owners(spark: SparkSession, store: str, version: int) -> list[int]:
    """The shard of each virtual slot in a stored map: SLOTS rows."""
    owner = [0] * SLOTS
    for r in load_map(spark, store, version).select("virtual_slot", "shard").collect():
        owner[r["virtual_slot"]] = r["shard"]
    return owner


def rebalance(spark: SparkSession, store: str, shards: int, sums: list[tuple[int, int]] | None = None) -> int:
    """Edits the newest stored map for a number of shards, and for new sums of slots if given, and stores it as the next version, which is returned. A new store begins with version 0, even by slot count."""
    version = newest_version(spark, store)
    if version is None:
        version = 0
        save_map(spark, store, 0, first_map(shards), sums or [(0, 0)] * SLOTS)
    if sums is None:
        sums = [(0, 0)] * SLOTS
        for r in load_map(spark, store, version).collect():
            sums[r["virtual_slot"]] = (r["bytes"], r["rows"])
    save_map(spark, store, version + 1, rebalanced(owners(spark, store, version), [b for b, _ in sums], shards), sums)
    return version + 1


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", store: str | None = None) -> DataFrame:
    """docs, the whole dataset as it is now, with `shard`, `slot` (place in its shard, gapless from 0), `virtual_slot`, `map_version`, `_shard_size` and `_shard_crc`.

    The newest map in store is edited for the bytes of docs and stored as the next version, so
    with the same store more documents or another number of shards move only the slots that even
    sizes need.
    """
    spark = docs.sparkSession
    store = store or new_path(spark, "slot-map")
    made = ("shard", "slot", "virtual_slot", "map_version", "_shard_size", "_shard_crc")
    rows, back = held(docs, {"_shard_key": key, "_shard_text": text}, made)
    slim, _ = held(docs, {"_shard_key": key, "_shard_text": text}, packed=False)
    parts = written(measured(slim, "_shard_key", "_shard_text").groupBy("_shard_vslot", "_shard_part").agg(F.sum("_shard_size").alias("b"), F.count("*").alias("n")), "slot-sums")
    version = rebalance(spark, store, shards, slot_sums(parts))
    slots = load_map(spark, store, version).select(F.col("virtual_slot").alias("_shard_vslot"), "shard", "first_place")
    earlier = Window.partitionBy("_shard_vslot").orderBy("_shard_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.join(F.broadcast(slots), "_shard_vslot").select(
        F.col("_shard_vslot").alias("_v"), F.col("_shard_part").alias("_p"), F.col("shard").alias("_to"), (F.col("first_place") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("_place")
    )
    within = Window.partitionBy("_shard_vslot", "_shard_part").orderBy(F.col("_shard_key").asc_nulls_first(), "_shard_crc", "_shard_size")
    placed = measured(rows, "_shard_key", "_shard_text").withColumn("_row", F.row_number().over(within))
    placed = placed.join(offsets.hint("merge"), (F.col("_shard_vslot") == F.col("_v")) & (F.col("_shard_part") == F.col("_p")))  # rows lie by slot and part already
    new = {"shard": F.col("_to"), "slot": (F.col("_place") + F.col("_row") - 1).cast("long"), "virtual_slot": F.col("_shard_vslot"), "map_version": F.lit(version), "_shard_size": F.col("_shard_size"), "_shard_crc": F.col("_shard_crc")}
    return placed.select(*back, *[c.alias(name) for name, c in new.items()])
