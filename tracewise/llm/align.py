"""Alignment of the tokens of two tokenizers, by relations over token ends.

Both tokenizers cut a text at a space that follows anything but white space: byte-level BPE because its pre-tokens hold a space
only in front, sentence-piece BPE because no piece of the vocabulary holds a space behind another character (both files are
checked). So tokens, ends, cuts, groups and links of a stretch between two such cuts are the same wherever it stands, and each
distinct stretch is aligned once:

1. Tasks split documents into stretches and give each document as numbers of stretches in a dictionary of its block, with the ids of each
   stretch's tokens and the running sums of their bytes, which are their ends. A block is a run of one task's documents of about OCCURRENCES stretches, so its dictionary is bounded. The
   table is bucketed by block, and as a task makes whole blocks that takes no shuffle.
2. posexplode gives a row a token with its end, and an equi-join on stretch and end gives the cuts, which are the links;
   their running count numbers the groups. All keys begin with the block, so buckets are read in place and nothing is shuffled.
3. Links times the count of their stretch sum to the count of each pair of ids, and the highest of each B id is marked. Links meet their
   pair again: up to PAIRS pairs are broadcast; more meet by a shuffle, but for pairs that hold a large share of all links
   (shared.spread_join).
4. A block's links meet its documents. A token's group is the first cut that is not before its end, and documents are put together from
   the groups of their stretches.

A text without such spaces is one stretch, and all of its tokens are rows of it.

Defined results: a null or empty text, and one that holds U+2581, which B's pieces cannot give back, has no tokens: zeros and an
empty text of groups, and it counts for no pair; strings of special tokens are plain text; texts are whole, of any length;
repeated rows and ties (ids of equal highest count are all best) count each; an empty table gives empty results; the text itself is left
out, other columns are kept, whatever their names, and columns named n_a, n_b, n_groups, n_links, n_best, count_sum or groups (in any case) are replaced.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, count, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.shared import giving_back, held, new_path, release, small_batches, spread_join, written
from tracewise.llm.tokens import byte_letters, check_supported

#: A block of documents ends after so many stretches, or bytes of distinct ones, and the batch that reaches it.
OCCURRENCES, DICTIONARY_BYTES = 400_000, 32 << 20
#: Pairs of ids that are broadcast, at most: about 100 MB.
PAIRS = 2_000_000
#: Stretches that are encoded as one text, at most: the tokenizers' queues of merges grow with a text, and its cost by more than its length.
RUN = 300
#: Stretches whose tokens a task keeps for its blocks to come, at most, and their tokens of a side: about 100 MB.
KNOWN, KNOWN_TOKENS = 400_000, 2_600_000
#: Buckets of the tables of blocks, at most: the engine's own bound.
MOST_BUCKETS = 100_000
SPACE = "▁"

_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_MADE = (*_COUNTS, "groups")


@dataclass(frozen=True)
class Alignment:
    """documents: docs with the counts and groups (`a1,a2|b1;a3|b2,b3`: ids of each group in order). pairs: a_id, b_id, count and best."""

    documents: DataFrame
    pairs: DataFrame


def _plain(text: str) -> bool:
    return not text.endswith(" ") and not text.startswith(" ") and not re.search(r"\s ", text)


def stretches(text: str) -> list[str]:
    """The parts of a text, with a space in front, between cuts; each stands without the space that it begins with."""
    if _plain(text):
        return text.split(" ")
    parts = re.split(r"(?<=\S)(?= +[^ ])", " " + text)
    return [p[1:] for p in parts]


def _dealt(text: str | None) -> str | list[str]:
    """The text itself if it is cut at each of its spaces, else its stretches; none of a text without tokens."""
    if not text or SPACE in text:
        return []
    return text if _plain(text) else stretches(text)


class _Tokenizers:
    """Ids and ends of a stretch's tokens by both files."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        check_supported(self.a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_a = {i: bytes(back[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
        piece = self.b.id_to_piece
        self.bytes_b = {i: bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace(SPACE, " ").encode() for i in range(self.b.vocab_size())}

        self.lengths_a = _lengths(self.bytes_a)
        self.lengths_b = _lengths(self.bytes_b)
        self.known: dict[str, int] = {}  # the first stretches that came, which are the frequent ones
        self.kept = [(np.empty(KNOWN_TOKENS, np.int32), np.empty(KNOWN_TOKENS, np.int32), np.zeros(KNOWN + 1, np.int64)) for _ in "ab"]

    def encoded(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As _encode, but for what is known."""
        at = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        fresh = at < 0
        if not fresh.any():
            return _merged(self.kept, at, fresh, [_NONE] * 2)
        some = list(compress(parts, fresh.tolist()))
        new = self._encode(some)
        out = new if fresh.all() else _merged(self.kept, at, fresh, new)
        n = len(self.known)
        if n + len(some) <= KNOWN and all(edges[n] + len(ids) <= KNOWN_TOKENS for (_, _, edges), (ids, _, _) in zip(self.kept, new, strict=True)):
            for (ids, ends, edges), (ids_new, ends_new, edges_new) in zip(self.kept, new, strict=True):
                ids[edges[n] : edges[n] + len(ids_new)] = ids_new
                ends[edges[n] : edges[n] + len(ids_new)] = ends_new
                edges[n + 1 : n + len(edges_new)] = edges[n] + edges_new[1:]
            self.known.update(zip(some, range(n, n + len(some)), strict=True))
        return out

    def _encode(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of both tokenizers: the ids of all parts in order, the byte of its part that each token ends at, and where each part's tokens end. Parts are encoded together, and cut where they end."""
        texts: list[str] = []  # runs of parts as one text; a part that ends in white space ends its run, as only the end of a document is one
        run: list[str] = []
        for part in parts:
            run.append(part)
            if part[-1].isspace() or len(run) == RUN:
                texts.append(" ".join(run))
                run = []
        if run:
            texts.append(" ".join(run))
        ids_a = chain.from_iterable([e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)])
        ids_b = chain.from_iterable(self.b.encode(texts, num_threads=1))
        whole = f" {' '.join(texts)}".encode()
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        out = []
        for ids, of, lengths in ((ids_a, self.bytes_a, self.lengths_a), (ids_b, self.bytes_b, self.lengths_b)):
            flat = np.fromiter(ids, np.int32)
            if b"".join(map(of.__getitem__, flat.tolist())) != whole:
                raise ValueError(f"the tokenizers do not give back {whole[:40]!r}")
            token_ends = np.cumsum(lengths[flat])
            last = np.searchsorted(token_ends, ends)
            if not np.array_equal(token_ends[last], ends):
                raise ValueError("a token goes on beyond a cut")
            edges = np.concatenate([[0], last + 1])
            within = token_ends - np.repeat(ends - np.diff(ends, prepend=0), np.diff(edges))
            out.append((flat, within.astype(np.int32), edges))
        return out


_Sides = list[tuple[np.ndarray, np.ndarray, np.ndarray]]
_NONE = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64))


def _merged(old: _Sides, at: np.ndarray, fresh: np.ndarray, new: _Sides) -> _Sides:
    """The sides of parts in order: the fresh ones are those of new, the others are in old at their place."""
    out = []
    for (ids, ends, edges), (ids_new, ends_new, edges_new) in zip(old, new, strict=True):
        begins = edges[at[~fresh]]
        sizes_old = edges[at[~fresh] + 1] - begins
        take = np.repeat(begins - np.cumsum(sizes_old) + sizes_old, sizes_old) + np.arange(sizes_old.sum())
        sizes = np.empty(len(fresh), np.int64)
        sizes[fresh], sizes[~fresh] = np.diff(edges_new), sizes_old
        is_new = np.repeat(fresh, sizes)
        made = []
        for x, y in ((ids, ids_new), (ends, ends_new)):
            one = np.empty(len(is_new), np.int32)
            one[is_new], one[~is_new] = y, x[take]
            made.append(one)
        out.append((*made, np.concatenate([[0], np.cumsum(sizes)])))
    return out


class _Encoder:
    """Encodes the dictionaries of one block after another: stretches that the block before had are taken from it, as many come again."""

    def __init__(self, own: _Tokenizers):
        self.own = own
        self.numbers: dict[str, int] = {}
        self.sides: _Sides = [_NONE] * 2

    def _some(self, parts: list[str]) -> _Sides:
        """As _Tokenizers.encoded."""
        at = np.fromiter(map(self.numbers.get, parts, repeat(-1)), np.int64, len(parts))
        fresh = at < 0
        if fresh.all():
            return self.own.encoded(parts)
        return _merged(self.sides, at, fresh, self.own.encoded(list(compress(parts, fresh.tolist()))) if fresh.any() else [_NONE] * 2)

    def encoded(self, numbers: dict[str, int]) -> Iterator[tuple[int, _Sides]]:
        """The stretches of a block by ROW, with the number of the first."""
        parts, made = list(numbers), []
        for k in range(0, len(parts), ROW):
            made.append(self._some(parts[k : k + ROW]))
            yield k, made[-1]
        joined = []
        for side in zip(*made, strict=True):
            sizes = [np.diff(edges) for _, _, edges in side]
            joined.append((np.concatenate([x[0] for x in side]), np.concatenate([x[1] for x in side]), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])))
        if made:
            self.numbers, self.sides = numbers, joined


def _lengths(of: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(of) + 1, np.int64)
    out[list(of)] = [len(t) for t in of.values()]
    return out


def check_pieces(path: str) -> None:
    """Raises ValueError unless a sentence-piece file is BPE with byte fallback that adds a space in front, changes no text, and has no piece with a space behind another character."""
    from sentencepiece import sentencepiece_model_pb2 as form

    model = form.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    trained, normal = model.trainer_spec, model.normalizer_spec
    wrong = []
    if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
        wrong.append("a model other than BPE with byte fallback")
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
        wrong.append("a normalizer that changes texts, or none that adds a space")
    if any(SPACE in p.piece.lstrip(SPACE) or p.type == p.USER_DEFINED for p in model.pieces):
        wrong.append("pieces with a space behind another character, or defined by a user")
    if wrong:
        raise ValueError(f"alignment does not support {', '.join(wrong)}")


#: The setting by which a join takes partitions by some of its keys.
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"

_loaded: dict[tuple[str, str], _Tokenizers] = {}


def _of(path_a: str, path_b: str) -> _Tokenizers:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = _Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def _forget() -> None:
    """Drops this process's tokenizers. Steps call it by name: a step that named _loaded itself would get a copy of the driver's, tokenizers and all."""
    _loaded.clear()
    release()


class _Block:
    """Numbers of the stretches of a block's documents."""

    def __init__(self):
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.counts = np.zeros(0, np.int64)
        self.total = self.bytes = 0

    def add(self, texts: list[str | None]) -> pa.Array:
        """The numbers of each text's stretches, as bytes of 32-bit integers."""
        before = len(self.numbers)
        each = [_dealt(t) for t in texts]
        flat, sizes = self._numbered(each)
        self.bytes += sum(map(len, islice(self.numbers, before, None)))
        grown = np.bincount(flat, minlength=len(self.numbers))
        grown[: len(self.counts)] += self.counts
        self.counts, self.total = grown, self.total + len(flat)
        offsets = pa.py_buffer((np.concatenate([[0], np.cumsum(sizes)]) * 4).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(flat)])

    def _numbered(self, each: list[str | list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all stretches in order, and how many each text has. A text as such is cut at its spaces."""
        lists = pc.split_pattern(pa.array([t if isinstance(t, str) else None for t in each], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()  # a word of many occurrences is numbered once
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        words = _joined(coded.dictionary, np.array([0, len(coded.dictionary)]), " ")[0].as_py().split(" ") if len(coded) else []
        plain = self._of(words)[coded.indices.to_numpy()]
        odd = [k for k, t in enumerate(each) if not isinstance(t, str)]
        if not odd:
            return plain, sizes
        at, parts, done = np.cumsum(sizes), [], 0
        for k in odd:
            parts += [plain[done : at[k]], self._of(each[k])]
            done, sizes[k] = at[k], len(each[k])
        return np.concatenate([*parts, plain[done:]]), sizes

    def _of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))  # a new one gets the next number

    def full(self) -> bool:
        return self.total >= OCCURRENCES or self.bytes >= DICTIONARY_BYTES


_IDS = T.ArrayType(T.ArrayType(T.IntegerType()))
#: A document's row has its numbers; a row of the dictionary has the number of its first stretch, and of each stretch the count and both sides' ids and ends.
_BLOCK = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_numbers", T.BinaryType()), T.StructField("_first", T.IntegerType()), T.StructField("_times", T.ArrayType(T.LongType())), *[T.StructField(n, _IDS) for n in ("_a", "_a_ends", "_b", "_b_ends")]])
_ARROW = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.list_(pa.int32()))] * 4]
#: Stretches in a row of the dictionary.
ROW = 10_000


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a document with its numbers, and rows of ROW stretches of each block's dictionary with their tokens, both with their block."""
    small_batches(docs.sparkSession, "2m")
    rest = [f for f in docs.schema.fields if f.name != "_text"]
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in rest], *_BLOCK.fields])  # null in a dictionary

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, encoder = TaskContext.get().partitionId() << 32, _Block(), _Encoder(_of(path_a, path_b))
        kept: list[pa.DataType] = []

        def dictionary() -> Iterator[pa.RecordBatch]:
            for k, sides in encoder.encoded(block.numbers):
                one = pa.array([0, len(sides[0][2]) - 1], pa.int32())
                lists = [pa.ListArray.from_arrays(one, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x))) for ids, ends, edges in sides for x in (ids, ends)]
                times = pa.ListArray.from_arrays(one, pa.array(block.counts[k : k + ROW], pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in kept], pa.array([number], _ARROW[0]), pa.nulls(1, _ARROW[1]), pa.array([k], _ARROW[2]), times, *lists], names=out.names)

        for batch in batches:
            n, columns = batch.num_rows, batch.columns[1:]
            kept = [c.type for c in columns]
            rows = block.add(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([number] * n, _ARROW[0]), rows, *[pa.nulls(n, t) for t in _ARROW[2:]]], names=out.names)
            if block.full():
                yield from dictionary()
                number, block = number + 1, _Block()
        yield from dictionary()
        _forget()  # else an idle worker holds tokenizers and known stretches while the last step runs

    return docs.mapInArrow(giving_back(deal), out)


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df written into the shared folder in buckets by block, and read back."""
    spark, table = df.sparkSession, f"tracewise_{name}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").option("path", new_path(spark, name)).bucketBy(buckets, "_block").saveAsTable(table)
    return spark.table(table)


_UNIT = ["_block", "unit"]


def _tokens(dictionary: DataFrame, side: str, *more: str) -> DataFrame:
    """The tokens of a side: stretch, end, id and more."""
    stretches = dictionary.select("_block", "_first", "_times", f"_{side}_ends", F.posexplode(f"_{side}").alias("at", "ids"))
    rows = stretches.select("_block", (F.col("_first") + F.col("at")).alias("unit"), *[F.get("_times", F.col("at")).alias(c) for c in more], F.get(f"_{side}_ends", F.col("at")).alias("ends"), F.posexplode("ids").alias("pos", side))
    return rows.select(*_UNIT, F.get("ends", F.col("pos")).alias("end"), side, *more)


def _links(dictionary: DataFrame) -> DataFrame:
    """The cuts of each stretch: group (the running count of cuts before it), end, the ids a and b of the tokens that end there, and times (the count of the stretch)."""
    cuts = _tokens(dictionary, "a", "times").join(_tokens(dictionary, "b"), [*_UNIT, "end"])
    before = Window.partitionBy(*_UNIT).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return cuts.withColumn("group", F.count("a").over(before).cast("int"))


def _strings(ids: np.ndarray, unit: np.ndarray, lengths: np.ndarray, names: pa.Array, cuts: np.ndarray) -> pa.Array:
    """The ids of each group, over some stretches in order: cuts are stretch << 32 | end, and a token's group is the first cut that is not before its end."""
    sums = np.concatenate([[0], np.cumsum(lengths[ids])])
    ends = sums[1:] - sums[np.searchsorted(unit, unit)]
    groups = np.searchsorted(cuts, (unit.astype(np.int64) << 32) + ends)
    return _joined(names.take(pa.array(ids)), np.searchsorted(groups, np.arange(len(cuts) + 1)), ",")


def _joined(texts: pa.Array, edges: np.ndarray, sign: str) -> pa.Array:
    """Runs of texts, each joined by a sign; run k is from edges[k] to edges[k + 1]."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), texts), pa.scalar(sign, texts.type))


def _put_together(blocks: DataFrame, links: DataFrame, lengths_a: np.ndarray, lengths_b: np.ndarray) -> DataFrame:
    """The documents of blocks with the sums of their stretches' counts, and their groups in order."""
    rest = [f for f in blocks.schema.fields if f.name not in _BLOCK.names]
    out = T.StructType([*rest, *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("groups", T.StringType())])

    def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in order, and the stretch that each is of."""
        each = [c.flatten() for c in lists.chunks]
        sizes = np.concatenate([np.zeros(0, np.int32), *[pc.list_value_length(e).to_numpy() for e in each]])
        return np.concatenate([np.zeros(0, np.int32), *[e.flatten().to_numpy() for e in each]]), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def join(rows: pa.Table, links: pa.Table) -> pa.Table:
        _forget()  # a worker that has encoded needs its tokenizers no more
        is_doc = pc.is_null(rows["_first"])
        docs, own = rows.filter(is_doc), rows.filter(pc.invert(is_doc))
        own = own.take(pc.sort_indices(own, [("_first", "ascending")]))
        (a, unit_a), (b, unit_b) = flat(own["_a"]), flat(own["_b"])
        n = int(unit_a[-1]) + 1 if len(unit_a) else 0
        cuts, counts = links["cut"].to_numpy(), links["counts"].to_numpy()
        if np.any(cuts[1:] < cuts[:-1]):
            order = np.argsort(cuts, kind="stable")
            cuts, counts = cuts[order], counts[order]
        edges = np.searchsorted(cuts, np.arange(n + 1) << 32)
        by_unit = {"n_a": np.bincount(unit_a, minlength=n), "n_b": np.bincount(unit_b, minlength=n), "n_groups": np.diff(edges), "n_links": np.diff(edges)}
        for name, values in (("n_best", counts & 1), ("count_sum", counts >> 1)):
            sums = np.concatenate([[0], np.cumsum(values)])
            by_unit[name] = sums[edges[1:]] - sums[edges[:-1]]
        names = pa.array(list(map(str, range(max(len(lengths_a), len(lengths_b))))), pa.large_string())
        made_texts: list[pa.Array] = []
        for k in range(0, n, ROW):  # some stretches at a time, so that their groups take little memory
            end = min(n, k + ROW)
            some = cuts[edges[k] : edges[end]]
            sides = [_strings(ids[x:y], unit[x:y], lengths, names, some) for ids, unit, lengths in ((a, unit_a, lengths_a), (b, unit_b, lengths_b)) for x, y in [np.searchsorted(unit, (k, end))]]
            made_texts.append(_joined(pc.binary_join_element_wise(*sides, pa.scalar("|", names.type)), edges[k : end + 1] - edges[k], ";"))
        texts = pa.concat_arrays(made_texts or [pa.array([], pa.large_string())])
        del names, made_texts
        lists = [np.frombuffer(x, np.int32) for x in docs["_numbers"].to_pylist()]
        begins = np.cumsum([0, *map(len, lists)])
        numbers = np.concatenate([np.zeros(0, np.int32), *lists])
        made = []
        for c in _COUNTS:
            sums = np.concatenate([[0], np.cumsum(by_unit[c][numbers])]).astype(np.int64)
            made.append(pa.array(sums[begins[1:]] - sums[begins[:-1]], pa.int64()))
        parts = [_joined(texts.take(pa.array(numbers[begins[k] : begins[end]])), begins[k : end + 1] - begins[k], ";").cast(pa.string()) for k in range(0, len(lists), 500) for end in [min(len(lists), k + 500)]]
        whole = pa.chunked_array(parts, pa.string())
        return pa.table([*[docs[f.name] for f in rest], *made, whole], names=out.names)

    blocks = blocks.select("_block", "_first", "_numbers", "_a", "_b", *[f.name for f in rest])
    cut = F.shiftleft(F.col("unit").cast("long"), 32).bitwiseOR(F.col("end"))
    links = links.select(F.col("_block").alias("_of"), cut.alias("cut"), (F.col("count") * 2 + F.col("best").cast("int")).alias("counts"))
    return blocks.groupBy("_block").cogroup(links.groupBy("_of")).applyInArrow(join, out)


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> Alignment:
    """path_a: a byte-level BPE file of the tokenizers library, that encodes a space and the text; path_b: a sentence-piece BPE model, that adds the space. Both at the same place on the driver and every executor."""
    spark = docs.sparkSession
    check_pieces(path_b)
    own = _of(path_a, path_b)
    rows, back = held(docs, {"_text": text}, _MADE)
    names = [c for c in docs.columns if c.lower() not in _MADE]
    back = [b for b, c in zip(back, names, strict=True) if c.lower() != text.lower()]
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, 4 * rows.rdd.getNumPartitions()))
    blocks = _bucketed(_blocks(rows, path_a, path_b), "blocks", buckets)
    asked = spark.conf.get(_CO_PARTITION)
    spark.conf.set(_CO_PARTITION, "false")  # buckets by block are enough for joins on block, number and end
    try:
        links = _bucketed(_links(blocks.where("_first IS NOT NULL")), "links", buckets)
        pairs = links.groupBy("a", "b").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("rows"))
        best = F.col("count") == F.max("count").over(Window.partitionBy("b"))  # at most one row for each A id
        pairs = written(pairs.withColumn("best", best), "align-pairs")
    finally:
        spark.conf.set(_CO_PARTITION, asked)
    met = links.join(F.broadcast(pairs), ["a", "b"]) if pairs.count() <= PAIRS else spread_join(links, pairs, ["a", "b"], "rows")
    documents = _put_together(blocks, met, own.lengths_a, own.lengths_b).select(*back, *_MADE)
    return Alignment(documents, pairs.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), "count", "best"))
