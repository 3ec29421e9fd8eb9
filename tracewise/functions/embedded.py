"""JSON objects inside free text. Scanning for them needs a decoder, so these run in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Objects within each other that are decoded; one that holds more levels is none.
LEVELS = 500

_STRUCTURE = re.compile(r'\\[\\"]|["{}]')


class _Object(dict):
    """An object with all of its values in order, also those whose key comes again."""

    def __init__(self, pairs: list[tuple[str, object]]):
        super().__init__(pairs)
        self.all = [v for _, v in pairs]


_DECODER = json.JSONDecoder(object_pairs_hook=_Object)


def _spans(text: str) -> list[tuple[int, int, int, int]]:
    """Braces that open, in order: place, place of the brace that closes it, parity of the quotes before it, and levels within.

    From a brace on, text is outside of strings where the quotes before it have the brace's own parity, so
    braces of either parity match among themselves.
    """
    parity, open_, spans = 0, ([], []), []
    for m in _STRUCTURE.finditer(text):
        sign = m.group()
        if sign == '"':
            parity ^= 1
        elif sign == "{":
            open_[parity].append([m.start(), 0])
        elif sign == "}" and open_[parity]:
            first, levels = open_[parity].pop()
            spans.append((first, m.end(), parity, levels + 1))
            if open_[parity]:
                above = open_[parity][-1]
                above[1] = max(above[1], levels + 1)
    return sorted(spans)


def _within(value: _Object) -> Iterator[_Object]:
    """An object and those in it, by where they begin."""
    left: list = [value]
    while left:
        value = left.pop()
        if isinstance(value, _Object):
            yield value
            left.extend(reversed(value.all))
        elif isinstance(value, list):
            left.extend(reversed(value))


def objects(text: str) -> Iterator[dict]:
    """The objects that begin at some brace of the text, in order, in time that grows with the text.

    Only balanced spans are decoded. Where one fails, those in it that hold the same place fail too; where one succeeds, those
    in it were decoded with it.
    """
    failed, known = [-1, -1], ([], [])  # of each parity: the last place that was no JSON, and objects that were decoded with another
    until = [-1, -1]
    for first, end, parity, levels in _spans(text):
        if first < until[parity]:
            yield known[parity].pop()
        elif first < failed[parity] < end or levels > LEVELS:
            continue
        else:
            try:
                value, end = _DECODER.raw_decode(text, first)
            except RecursionError:
                continue
            except ValueError as e:
                failed[parity] = getattr(e, "pos", first)  # a number of too many digits names no place
                continue
            until[parity] = end
            known[parity][:] = list(_within(value))[:0:-1]
            yield value


@pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first JSON object in a text, compact; null without one."""
    found = (next(objects(t), None) if t else None for t in texts)
    return pd.Series([None if o is None else json.dumps(o, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for o in found], dtype=object)


@pandas_udf(StringType())
def generated_segment(texts: pd.Series) -> pd.Series:
    """The first non-empty generated_segment of the objects in a text; null without one."""
    out = []
    for t in texts:
        hits = (o.get("generated_segment") for o in objects(t or ""))
        out.append(next((h.strip() for h in hits if isinstance(h, str) and h.strip()), None))
    return pd.Series(out, dtype=object)


#: Keys of an object that may hold its text, in the order they are tried.
TEXT_KEYS = ("text", "content", "value", "response", "reasoning", "solution")


#: Lists and objects within each other that are walked; what is deeper counts as its JSON text.
DEPTH = 100


def _compact(value: object) -> str:
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        return ""


def _plain(value: object, depth: int = 0) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value.strip()
    if depth == DEPTH and isinstance(value, list | dict):
        return _compact(value)
    if isinstance(value, list):
        return "\n".join(t for t in (_plain(x, depth + 1) for x in value) if t)
    if isinstance(value, dict):
        texts = (_plain(value.get(k), depth + 1) for k in TEXT_KEYS)
        return next((t for t in texts if t), None) or _compact(value)
    return str(value).strip()


@pandas_udf(StringType())
def nested_text(values: pd.Series) -> pd.Series:
    """The text of a JSON value: a list's by line, an object's first of TEXT_KEYS, else the object; null for null."""
    return pd.Series([None if v is None else _plain(json.loads(v)) for v in values], dtype=object)


def first_texts(record: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """Of a variant: a struct with the text of the first of each name's fields that has one, else empty. All names are one call, of a struct of the fields that they ask for."""
    schema = StructType([StructField(n, StringType()) for n in names])
    fields = list(dict.fromkeys(f for of in names.values() for f in of))

    @pandas_udf(schema)
    def texts(values: pd.DataFrame) -> pd.DataFrame:
        found = {f: [None if v is None else _plain(json.loads(v)) for v in values[f]] for f in fields}
        return pd.DataFrame({n: [next((t for t in row if t), "") for row in zip(*(found[f] for f in of), strict=True)] for n, of in names.items()}, dtype=object)

    value = lambda f: F.try_variant_get(record, f'$["{f}"]', "variant")
    known = lambda f: F.when(~F.is_variant_null(value(f)), F.to_json(value(f)))  # noqa: E731  a null counts as missing
    return texts(F.struct(*[known(f).alias(f) for f in fields]))


def _scalar(value: object) -> str:
    if value is None:
        return ""
    return value.strip() if isinstance(value, str) else str(value) if isinstance(value, (int, float)) else json.dumps(value, sort_keys=True)


def _content(value: object) -> str:
    if not isinstance(value, list):
        return _scalar(value)
    parts = (_scalar(x.get("text")) if isinstance(x, dict) else _scalar(x) for x in value if not isinstance(x, dict) or "text" in x or x.get("type") == "text")
    return "\n".join(p for p in parts if p).strip()


@pandas_udf(ArrayType(StringType()))
def content_texts(values: pd.Series) -> pd.Series:
    """The texts of a list of chat messages as JSON, one for each, empty for what is no message; null for null or no list."""
    out = []
    for v in values:
        said = None if v is None else json.loads(v)
        out.append([_content(m.get("content", m.get("value", ""))) if isinstance(m, dict) else "" for m in said] if isinstance(said, list) else None)
    return pd.Series(out, dtype=object)
