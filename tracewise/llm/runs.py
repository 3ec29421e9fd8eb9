"""Periodic runs in word sequences, after Ellert and Fischer: Lyndon arrays over an ordered alphabet, without suffix structures or hashes.

A run is a stretch of words with smallest period p, as long as it can be, that holds its period at least `times` times and has at
least `least` words. For one of the two orders of the alphabet (a word order and its reverse), some period of a run is a Lyndon
word that starts in the run's first p words, and the next smaller suffix begins p words behind it. So every run shows
as an entry i -> i + p of one of two Lyndon arrays, and how far both suffixes agree gives its end.

An array is built from the last word to the first. The suffix at i is compared with the next one, then with that one's next smaller
suffix, and so on, until one is smaller. What was matched before is used again:

- Along the chain the match with i never shrinks. The next link's own stored match is shorter (then it is the answer), longer (then the
  match stays as it is), or equal, and only then words are compared, from that place on.
- Once the match with j reaches j itself, both start with one and the same Lyndon word, and the rest was stored when j was built: with j's
  next smaller suffix, or with the one that j took over.

So words are compared again only within the shorter of two parts that are joined. Tests count comparisons: under 3 a word on
periodic and random words at any length, and under 10 on Fibonacci and Thue-Morse words of 80,000, where they grow with the logarithm. The
alphabet is ordered by first occurrence in the text; nothing else is asked of words than whether they are equal.

A document is one row of one task, and nothing is shuffled. A row needs about 400 bytes of memory a word.

Defined results: a null or empty text, or one without words, has 0 words, no runs and an empty collapsed text; texts are whole, of any
length; repeated rows and ties count each; an empty table gives an empty result; extra columns are kept, whatever their names,
and columns named n_words, runs or collapsed (in any case) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewise.llm.shared import held, small_batches

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
MADE = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def lyndon_roots(ranks: list[int], n: int, least: int, times: int, count: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Of ranks[:n], with ranks[n] below all others: (i, p, m) where i + p begins the next smaller suffix of i, both agree in m words, and a run of that period may be long enough.

    count: its first entry is raised by the words that were found equal beyond the first of a suffix.
    """
    following = [n] * (n + 1)  # the next smaller suffix of each
    match = [0] * (n + 1)  # how far it agrees with it
    taken: dict[int, tuple[int, int]] = {}  # a suffix that was not smaller: by whom it was met last, and how far both agree
    found, compared = [], 0
    for i in range(n - 1, -1, -1):
        first, j = ranks[i], i + 1
        other = ranks[j]
        while first < other:
            j = following[j]
            other = ranks[j]
        if first > other:
            following[i] = j
            continue
        m = 1
        while True:
            p, began = j - i, m
            while m < p and ranks[i + m] == ranks[j + m]:
                m += 1
            compared += m - began
            if m < p:
                smaller = ranks[j + m] < ranks[i + m]
            elif following[j] == j + p:
                smaller, m = True, p + match[j]
            else:
                smaller = False
                by, known = taken.get(j + p, (-1, 0))
                if by == j:
                    m = max(m, p + known)
                else:
                    began = m
                    while ranks[i + m] == ranks[j + m]:
                        m += 1
                    compared += m - began
            if smaller:
                break
            while True:  # i is smaller than the suffix at j
                taken[j] = (i, m)
                known, j = match[j], following[j]
                if known <= m:
                    break
            if known < m:
                m = known
                break
        following[i], match[i] = j, m
        p = j - i
        if m and m + 2 * p - 1 >= max(least, times * p):
            found.append((i, p, m))
    if count is not None:
        count[0] += compared
    return found


def maximal_runs(words: list, least: int = 24, times: int = 3, count: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of words, by start, then period. times: 2 or more."""
    n = len(words)
    if n < least:
        return []
    rank: dict = {}
    ranks = [rank.setdefault(w, len(rank)) for w in words]
    last = len(rank) - 1
    if last == n - 1:  # all words differ
        return []
    runs = set()
    for order in ([*ranks, -1], [*(last - r for r in ranks), -1]):
        for i, p, m in lyndon_roots(order, n, least, times, count):
            start, lowest = i, max(0, i - p)
            while start > lowest and ranks[start - 1] == ranks[start - 1 + p]:
                start -= 1
            if i - start == p:  # the same period begins one earlier, which gives the run
                continue
            length = i + p + m - start
            if length >= max(least, times * p):
                runs.add((start, length, p))
    return sorted(runs)


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words but those that a run holds after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def found(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """docs with n_words, runs (by start, then period) and collapsed: the words between white space that no run repeats, joined by one space."""
    if least < 2 or times < 2:
        raise ValueError("a run has at least two words and holds its period at least twice")
    small_batches(docs.sparkSession)
    names = [f.name for f in MADE]
    rows, back = held(docs, {"_text": text}, tuple(names))
    schema = T.StructType([*rows.schema.fields, *MADE])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for t in batch.column(0).cast(pa.binary()):
                words = (t.as_py() or b"").split()  # bytes split at 0x20 and 0x09 to 0x0D
                mine = maximal_runs(words, least, times)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                texts.append(b" ".join(without_repeats(words, mine)))
            made = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return rows.mapInArrow(find, schema).select(*back, *names)
