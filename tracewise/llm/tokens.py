"""Token counts with a whole-token shortcut.

Offline, each string of the vocabulary is encoded alone; those that give exactly one token are
whole. Texts are split into pre-tokens as the tokenizer does, and whole ones
count as one directly. Only the rest are merged, through the tokenizer, with the counts kept in
a bounded cache. Nothing is shuffled.

A tokenizer file is checked when it is loaded: the split and the shortcut hold for byte-level BPE with
the usual pre-tokens, without normalizer, prefix space or special flags of added tokens. Any other
file raises ValueError, so no count is silently wrong.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; strings of special
tokens inside a text are one token each, as the library's default has it; texts are whole, of any
length (a very long one is split into pre-tokens at once, about 60 bytes for each byte of it); repeated rows
and ties count each; an empty table gives an empty result; extra columns are kept, whatever their
names, and columns named n_bytes or n_tokens (in any case) are replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewise.llm.shared import chunks, held, small_batches

#: Pre-tokens of byte-level BPE: a fixed pattern of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same over characters up to U+024F, its classes spelled out for the faster standard module.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \u0085\u00a0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Merged pre-tokens whose counts a task remembers.
CACHE = 1_000_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable bytes are themselves, others follow from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def whole_tokens(tokenizer) -> frozenset[str]:
    """The proof: vocabulary strings, as text, that the tokenizer encodes alone as the one token they name."""
    back = {c: b for b, c in enumerate(byte_letters())}
    strings: list[str] = []
    ids: list[int] = []
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            strings.append(bytes(back[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
        ids.append(i)
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, i, e in zip(strings, ids, encoded, strict=True) if e.ids == [i])


def check_supported(tokenizer) -> None:
    """Raises ValueError unless the file is of the form that PATTERN and whole_tokens are right for."""
    form = json.loads(tokenizer.to_str())
    pre, model = form.get("pre_tokenizer") or {}, form.get("model") or {}
    wrong = []
    if form.get("normalizer"):
        wrong.append("a normalizer")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        wrong.append(f"the pre-tokenizer {pre.get('type')}")
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        wrong.append(f"the model {model.get('type')} with its options")
    for t in form.get("added_tokens") or ():
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") and form.get("normalizer"):
            wrong.append(f"the added token {t.get('content')!r}")
    if wrong:
        raise ValueError(f"token counts do not support {', '.join(wrong)}")


class Counts:
    """Counts tokens of texts with one tokenizer file."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        """whole: the proof, if it was made already."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        check_supported(self.tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = whole_tokens(self.tokenizer) if whole is None else whole
        self.cost = dict.fromkeys(self.whole, 1)
        self.split, self.latin_split = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.beyond_latin = re.compile("[^\x00-\u024f]").search
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings stood between them."""
        split = self.split if self.beyond_latin(text) else self.latin_split
        if not self.special or not self.special.search(text):
            return split(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in split(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        if len(self.cost) > CACHE:
            self.cost = dict.fromkeys(self.whole, 1)
        found = [self._pieces(t) for t in texts]
        rest = list(set().union(*(p for p, _ in found)).difference(self.cost))
        self.cost.update(zip(rest, map(len, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        of = self.cost.__getitem__
        return [sum(map(of, p)) + n for p, n in found]


_loaded: dict[str, Counts] = {}


def _of(path: str, whole: frozenset[str] | None = None) -> Counts:
    if path not in _loaded:
        _loaded[path] = Counts(path, whole)
    return _loaded[path]


def counted(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens. path: the tokenizer's file, at the same place on the driver and every executor. The proof is made once, on the driver, and broadcast: at most the vocabulary."""
    small_batches(docs.sparkSession)
    rows, back = held(docs, {"text": text}, ("n_bytes", "n_tokens"))
    proof = docs.sparkSession.sparkContext.broadcast(_of(path).whole)
    schema = T.StructType([*rows.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of(path, proof.value)
        for batch in batches:
            texts = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
            tokens = [n for part in chunks(texts) for n in own.count([x.decode() for x in part])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, texts), type=pa.int64()), pa.array(tokens, type=pa.int64())], names=[*batch.schema.names, "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, schema).select(*back, "n_bytes", "n_tokens")
