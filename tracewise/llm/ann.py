"""Approximate nearest neighbours by NN-descent, largest inner product first.

Rows are numbered, so rows that share an id stay apart. Equal vectors form a class, of which the row of smallest id is the node and the LIMIT + 1
rows of smallest id are kept; an answer never needs more of them. The graph gives each node its DEGREE best
neighbours. It begins from random projections: nodes are range-sorted on each of TREES
directions and compared within leaves of LEAF neighbours on the line. Rounds of NN-descent follow:
each node, with its neighbours and up to REVERSE nodes that newly list it, is an owner whose members
are compared with each other where one of the two is new to it; owners without news are left out; a member gets the candidates better than
its worst neighbour. Owners, members and lists meet by joins and exchanges on node ids; a
round's lists are written to the shared folder. Rounds go on, LEAST_ROUNDS at least, until fewer than SETTLED of
all list places change. Lists only get better, so they settle.

A query searches greedily: it begins with its node's list and keeps a pool of the POOL best nodes; of
the WIDE best, BEAM unexpanded ones a hop are joined with the graph, whose rows carry the
neighbours' vectors, until no query has one left. Search and
graph use vectors of one byte per component; the pool is scored again in double precision on the
original vectors. Reverse lists and leaves bound the work per node; what they miss is measured
as recall in the tests.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component,
vectors of another length than most, and rows with a null id take no part, neither as query nor
as candidate; rows with equal ids are candidates each, also of each other, and queries each, whose answers share a query_id; ties go to the
smaller id; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.shared import HOT_SHARE, LEAST_HOT, TASK_ROWS, drop_written, small_batches, written

DEGREE, REVERSE, LEAF, TREES = 56, 32, 2048, 8
LEAST_ROUNDS, SETTLED = 2, 0.01
POOL, WIDE, BEAM = 128, 96, 32
#: Rows (query, node) of a hop that are broadcast at most, 16 bytes each; more of them are joined by an exchange.
BROADCAST_ROWS = 500_000
LIMIT = 20
#: Candidates that an owner gives a member in a round at most.
GIVEN = 24

_IDS = "array<struct<vec_id:bigint,row:bigint>>"
_LISTS = "node long, ids array<long>, sims array<float>, fresh array<boolean>"


def _by_key(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df with rows of one key together and in order, in as many tasks as so many rows ask for, whatever the session's shuffle partitions are."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS)
    return df.repartition(key).coalesce(tasks).sortWithinPartitions(key)


def _met(rows: DataFrame, key: str, table: DataFrame, n: int) -> DataFrame:
    """n rows joined with table, which has a row for each node, on key. Long vectors are in nearly every list: nodes of more than 1 / HOT_SHARE of all rows are broadcast, HOT_SHARE of them at most, and their rows stay where they are."""
    least = max(LEAST_HOT, n // HOT_SHARE)
    hubs = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select(key)
    hubs = written(hubs, "hubs", HOT_SHARE)
    table = table.withColumnRenamed("node", key)
    if hubs.isEmpty():
        return rows.join(table, key)
    near = rows.join(F.broadcast(table.join(F.broadcast(hubs), key, "left_semi")), key)
    return near.unionByName(rows.join(F.broadcast(hubs), key, "left_anti").join(table, key))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _short(x: np.ndarray) -> np.ndarray:
    """Vectors as a scale and a byte per component."""
    scale = (np.abs(x).max(axis=1) / 127).astype("<f4")
    whole = np.rint(x / np.maximum(scale[:, None], np.finfo("f4").tiny)).clip(-127, 127).astype(np.int8)
    return np.concatenate([scale[:, None].view(np.uint8).reshape(len(x), 4), whole.view(np.uint8)], axis=1)


def _long(column, dim: int) -> np.ndarray:
    raw = _matrix(column, "u1", dim + 4)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def _list(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0), type=kind))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of equal first column, of rows that are sorted by it."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if keys[a] != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                held, key = [], keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _parts(rows: Iterator[tuple], size: int = 4096) -> Iterator[list[tuple]]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def valid(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(row, vec_id, vec, digest) of the vectors that take part, vec their doubles as bytes; and their length."""
    rows = table.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = common["d"] if common else 1

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)  # a null is NaN
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            kept = [v.tobytes() for v in x[good]]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(kept, type=pa.binary()), pa.array(map(xxhash.xxh3_128_digest, kept), type=pa.binary())], names=["vec_id", "vec", "digest"])

    rows = rows.where(F.size("v") == dim).mapInArrow(check, "vec_id long, vec binary, digest binary")
    return rows.withColumn("row", F.monotonically_increasing_id()), dim


def _nodes(rows: DataFrame, dim: int, limit: int) -> DataFrame:
    """(node, vec, short, ids): a row for each distinct vector; ids are its first rows (vec_id, row)."""
    near = Window.partitionBy("digest").orderBy("vec_id", "row")
    ids = rows.select("digest", "vec_id", "row").withColumn("n", F.row_number().over(near)).where(F.col("n") <= limit + 1).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    firsts = rows.join(ids.select(F.col("ids")[0]["row"].alias("row"), "ids"), "row")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [s.tobytes() for s in _short(_matrix(batch.column(1), "f8", dim))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(short, type=pa.binary()), batch.column(2)], names=["node", "vec", "short", "ids"])

    return firsts.select("row", "vec", "ids").mapInArrow(shorten, f"node long, vec binary, short binary, ids {_IDS}")


def _best(node: int, ids: np.ndarray, sims: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """The best distinct ids, ties to the smaller."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    first = np.sort(np.unique(ids, return_index=True)[1])
    first = first[ids[first] != node][:degree]
    return ids[first], sims[first]


def _first_lists(nodes: DataFrame, dim: int) -> DataFrame:
    """Lists from leaves of random projections."""
    directions = np.random.default_rng(5).normal(size=(dim, TREES)).astype(np.float32)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _long(batch.column(1), dim) @ directions
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(p.astype(float).ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(n), TREES))), batch.column(1).take(pa.array(np.repeat(np.arange(n), TREES)))], names=["tree", "p", "node", "short"])

    def leaf(nodes: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        k = min(DEGREE // 2, len(nodes) - 1)
        if k < 1:
            return
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        for i in range(len(nodes)):
            yield nodes[i], nodes[top[i]], sims[i, top[i]]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(done: bool) -> Iterator[tuple]:
            nonlocal held
            while held and (done or sum(b.num_rows for b in held) >= 2 * LEAF):
                rows = pa.Table.from_batches(held)
                tree = rows.column("tree").to_numpy()
                same = int(np.searchsorted(tree, tree[0], side="right"))
                size = same if same < 2 * LEAF and (same < len(tree) or done) else min(LEAF, same)
                own = rows.slice(0, size)
                yield from leaf(own.column("node").to_numpy(), _long(own.column("short"), dim))
                held = rows.slice(size).to_batches() if size < len(tree) else []

        def all_rows() -> Iterator[tuple]:
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                yield from cut(False)
            yield from cut(True)

        for part in _parts(all_rows()):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], type=pa.int64()), _list([r[1] for r in part], pa.int64()), _list([r[2] for r in part], pa.float32())], names=["node", "ids", "sims"])

    lines = nodes.select("node", "short").mapInArrow(project, "tree int, p double, node long, short binary")
    return lines.repartitionByRange("tree", "p").sortWithinPartitions("tree", "p").mapInArrow(leaves, "node long, ids array<long>, sims array<float>")


def _merged(lists: DataFrame, n: int) -> DataFrame:
    """Of rows (node, ids, sims, old), some for each of n nodes, each node's best list, fresh where the old list lacks an id."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for node, own in _groups(batches):
                ids, sims = own.column("ids").combine_chunks(), own.column("sims").combine_chunks()
                before = ids.filter(own.column("old").combine_chunks()).flatten().to_numpy()
                best, at = _best(node, ids.flatten().to_numpy(), sims.flatten().to_numpy(), DEGREE)
                yield node, best, at, ~np.isin(best, before)

        for part in _parts(rows()):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], type=pa.int64()), _list([r[1] for r in part], pa.int64()), _list([r[2] for r in part], pa.float32()), _list([r[3] for r in part], pa.bool_())], names=["node", "ids", "sims", "fresh"])

    return _by_key(lists, "node", n * TREES).mapInArrow(merge, _LISTS)


def _offers(lists: DataFrame, nodes: DataFrame, dim: int, n: int) -> tuple[DataFrame, DataFrame]:
    """One round: (node, ids, sims) of candidates better than a node's worst neighbour, and the table that they are made from, for which there is no use afterwards."""
    worst = F.when(F.size("ids") >= DEGREE, F.element_at("sims", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    about = lists.join(nodes.select("node", "short"), "node").withColumn("worst", worst)
    about = written(about, "about", n)
    fresh = F.filter(F.arrays_zip("ids", "fresh"), lambda e: e["fresh"])
    back = about.select("node", "short", "worst", F.explode(F.transform(fresh, lambda e: e["ids"])).alias("owner"))
    back = back.select("owner", "node", F.lit(True).alias("fresh"), "short", "worst")
    busy = about.where(F.exists("fresh", lambda f: f)).select("node").unionByName(back.select(F.col("owner").alias("node"))).distinct()
    edges = lists.join(busy, "node", "left_semi").select(F.col("node").alias("owner"), F.explode(F.arrays_zip("ids", "fresh")).alias("e"))
    edges = edges.select("owner", F.col("e.ids").alias("node"), F.col("e.fresh").alias("fresh"))
    forward = _met(edges, "node", about.select("node", "short", "worst"), n * DEGREE).select("owner", "node", "fresh", "short", "worst")
    order = Window.partitionBy("owner").orderBy(F.xxhash64("owner", "node"))
    back = back.withColumn("n", F.row_number().over(order)).where(F.col("n") <= REVERSE).drop("n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, own in _groups(batches):
                fresh = own.column("fresh").to_numpy()
                if not fresh.any():
                    continue
                node, first = np.unique(own.column("node").to_numpy(), return_index=True)
                fresh = np.isin(node, own.column("node").to_numpy()[fresh])
                x, low = _long(own.column("short").take(pa.array(first)), dim), own.column("worst").to_numpy()[first]
                sims = x @ x.T
                np.fill_diagonal(sims, -np.inf)
                sims[np.ix_(~fresh, ~fresh)] = -np.inf
                sims[sims <= low[:, None]] = -np.inf
                k = min(GIVEN, len(node))
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                got = np.take_along_axis(sims, top, axis=1)
                for i in np.flatnonzero((got > -np.inf).any(axis=1)):
                    use = got[i] > -np.inf
                    yield node[i], node[top[i][use]], got[i][use]

        for part in _parts(rows()):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], type=pa.int64()), _list([r[1] for r in part], pa.int64()), _list([r[2] for r in part], pa.float32())], names=["node", "ids", "sims"])

    met = _by_key(forward.unionByName(back), "owner", n * (DEGREE + REVERSE))
    return met.mapInArrow(compare, "node long, ids array<long>, sims array<float>"), about


def graph(nodes: DataFrame, dim: int) -> DataFrame:
    """(node, ids, sims, fresh): lists of all nodes that have a neighbour, best first; written."""
    size = nodes.count()
    lists = written(_merged(_first_lists(nodes, dim).withColumn("old", F.lit(False)), size), "lists", size)
    for n in count(1):
        offers, about = _offers(lists, nodes, dim, size)
        offers = offers.withColumn("old", F.lit(False))
        after = written(_merged(lists.select("node", "ids", "sims", F.lit(True).alias("old")).unionByName(offers), size), "lists", size)
        drop_written(lists)
        drop_written(about)
        lists = after
        changed = lists.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("ids"))).first()
        if n >= LEAST_ROUNDS and (changed[0] or 0) <= SETTLED * (changed[1] or 0):
            return lists


def search(lists: DataFrame, nodes: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """(query_id, node, vec, query_vec): the pools of queries (query_id, start, query_vec), start a node of the graph; lists are removed at the end."""
    back = lists.select(F.col("node").alias("n"), F.explode(F.arrays_zip("ids", "sims")).alias("e")).select(F.col("e.ids").alias("node"), "n", F.col("e.sims").alias("sim"))
    back = back.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "n"))).where(F.col("k") <= REVERSE // 2)
    edges = lists.select("node", F.explode("ids").alias("next")).unionByName(back.select("node", F.col("n").alias("next")))
    n = nodes.count() * (DEGREE + REVERSE // 2)
    around = written(_met(edges, "next", nodes.select("node", "short"), n).select("node", "next", "short"), "around", n)
    n_pool = queries.count() * POOL
    begun = queries.select("query_id", F.col("start").alias("node"), F.lit(float("inf")).cast("float").alias("sim"), F.lit(False).alias("done"), F.lit(True).alias("go"))
    near = queries.select("query_id", F.col("start").alias("node")).join(lists, "node").select("query_id", F.posexplode(F.arrays_zip("ids", "sims")).alias("at", "e"))
    near = near.select("query_id", F.col("e.ids").alias("node"), F.col("e.sims").alias("sim"), F.lit(False).alias("done"), (F.col("at") < BEAM - 1).alias("go"))
    pools = written(begun.unionByName(near), "pools", n_pool)
    wide = queries.select(F.col("query_id"), "query_vec")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for query, own in _groups(batches):
                node, sim, done, order = (own.column(c).to_numpy() for c in ("node", "sim", "done", "kind"))
                keep, new = order == 0, order == 1
                fresh = new & ~np.isin(node, node[keep])
                if fresh.any():
                    at = np.flatnonzero(fresh)
                    at = at[np.unique(node[at], return_index=True)[1]]
                    q = np.frombuffer(next(v for v in own.column("query_vec").to_pylist() if v is not None))
                    got = _long(own.column("short").take(pa.array(at)), dim) @ q.astype(np.float32)
                    ids, sims, seen = np.concatenate([node[keep], node[at]]), np.concatenate([sim[keep], got]), np.concatenate([done[keep], np.zeros(len(at), bool)])
                else:
                    ids, sims, seen = node[keep], sim[keep], done[keep]
                best = np.lexsort((ids, -sims))[:POOL]
                go = np.zeros(len(best), dtype=bool)
                go[np.flatnonzero(~seen[best][:WIDE])[:BEAM]] = True
                for i, g in zip(best, go, strict=True):
                    yield query, ids[i], sims[i], seen[i], g

        for part in _parts(rows(), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float32(), pa.bool_(), pa.bool_()))], names=["query_id", "node", "sim", "done", "go"])

    while True:  # pools only get better, so a query comes to have expanded its WIDE best
        ask = pools.where("go").select("query_id", "node")
        if not (asked := ask.count()):
            break
        found = around.join(F.broadcast(ask) if asked <= BROADCAST_ROWS else ask, "node")
        found = found.select("query_id", F.col("next").alias("node"), "short", F.lit(None).cast("binary").alias("query_vec"), F.lit(0).cast("float").alias("sim"), F.lit(False).alias("done"), F.lit(1).alias("kind"))
        none = F.lit(None).cast("binary")
        kept = pools.select("query_id", "node", none.alias("short"), none.alias("query_vec"), "sim", (F.col("done") | F.col("go")).alias("done"), F.lit(0).alias("kind"))
        own = wide.select("query_id", F.lit(-1).cast("long").alias("node"), none.alias("short"), "query_vec", F.lit(0).cast("float").alias("sim"), F.lit(True).alias("done"), F.lit(2).alias("kind"))
        met = _by_key(found.unionByName(kept).unionByName(own), "query_id", n_pool + asked * DEGREE)
        after = written(met.mapInArrow(score, "query_id long, node long, sim float, done boolean, go boolean"), "pools", n_pool)
        drop_written(pools)
        pools = after
    drop_written(around)
    drop_written(lists)
    return pools.join(nodes.select("node", "vec", "ids"), "node").join(wide, "query_id")


def nearest(table: DataFrame, is_query, limit: int = LIMIT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for the rows where is_query (a condition on key) holds."""
    small_batches(table.sparkSession)
    rows, dim = valid(table, key, vector)
    rows = written(rows, "vectors")
    size = rows.count()
    nodes = written(_nodes(rows, dim, limit), "nodes", size)
    lists = graph(nodes, dim)
    starts = nodes.select(F.col("node").alias("start"), F.col("vec").alias("v"))
    queries = rows.where(is_query).join(starts, F.col("vec") == F.col("v")).select(F.col("row").alias("query_id"), F.col("vec_id").alias("query_vec_id"), "start", F.col("vec").alias("query_vec"))
    queries = written(queries, "queries", size)
    pools = search(lists, nodes, queries, dim)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.einsum("ij,ij->i", _matrix(batch.column(2), "f8", dim), _matrix(batch.column(3), "f8", dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "ids", "score"])

    scored = pools.select("query_id", "ids", "vec", "query_vec").mapInArrow(exact, f"query_id long, ids {_IDS}, score double")
    hits = scored.select("query_id", "score", F.explode("ids").alias("hit")).where("hit.row <> query_id").select("query_id", "score", "hit.vec_id", "hit.row")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row"))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= limit)
    return hits.join(queries.select("query_id", "query_vec_id"), "query_id").select(F.col("query_vec_id").alias("query_id"), "rank", "vec_id", "score")
