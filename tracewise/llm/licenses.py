"""License scans by sentence rules.

A text's sentences are normalised and looked up, by hash and then by text, among known license
sentences; runs of their identifiers are then matched against ordered rules, the longest rule first,
without overlaps. All of it is array functions on the row, so nothing is shuffled and no group of
copies meets.

Known are SENTENCES, the short notices, and every sentence of the whole licenses in `license_texts`, which
are read and split when the module is loaded: about a thousand. Rules are RULES, then the runs of each
whole license.

A sentence ends at `.`, `!` or `?` before white space, at a blank line, and at a newline unless the next
line goes on with a lower-case letter (a wrapped line). Normalised: ASCII letters
lower-cased, each run of other characters than ASCII letters and digits a space, trimmed; empty
sentences do not count.

A known sentence may also go over lines that begin with indentation, comment marks, digits or
capitals, though not over a blank line: its pieces are joined to one sentence, as many of them as it has words.
Its first line must hold its first two words. A list number or
letter before it (`1.`, `2)`, `(a)`) is not a sentence of its own. All other sentences stay as above.
Comment marks are signs; words such as `dnl` or `REM` are not taken for marks.

Defined results: a null or empty text has no sentences; repeated rows and ties get the same answer each; of known
sentences that begin at one line the longest counts; a very long text is an array of its pieces, of about 100 bytes for
each, in one task; an empty table gives an empty result; extra columns are kept, whatever their names, and
columns named n_sentences, n_known or matches (in any case) are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.shared import held

#: Known sentences by identifier, as licenses have them.
SENTENCES = {
    "mit-ref": "Released under the MIT License.",
    "mit-ref-2": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc0-ref": "Licensed under CC0 1.0.",
}

#: A rule is a license and the identifiers of its sentences, in order. Of the rules that match at a
#: sentence, the first in the list wins; a longer rule stands before its parts.
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-title-2", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("Apache-2.0", ("apache-header", "apache-copy", "apache-url", "apache-warranty", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-copy", "apache-url")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str) -> str:
    """A known sentence as texts' sentences are normalised."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split())


#: Sentences that a run of a whole license must have to be a rule.
LEAST_RUN = 3
#: Sentences of a part of a long run, and lists that the beginnings of known sentences are looked up in.
PART, BUCKETS = 8, 64


def sentences_of(text: str) -> list[str]:
    """A license text's normalised sentences in order: paragraphs are joined and split after . ! ? and white space; list numbers before a sentence are cut."""
    out = []
    for block in re.split(r"\n[^A-Za-z0-9\n]*\n\s*", text):
        for part in re.split(r"[.!?]\s", " ".join(block.split()) + " "):
            plain = re.sub(r"^\W*(?:[0-9]{1,2}|[A-Za-z])[.)] ", "", part.strip())
            out.append(normalised(plain))
    return out


def catalogue() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Identifiers by normalised sentence, and rules: the fixed ones, the runs of whole licenses, then parts of long runs, so that a changed or cut copy is found too.

    A sentence of one word is none and parts runs; a list number goes with the sentence after it.
    """
    known, rules, parts = {normalised(v): k for k, v in SENTENCES.items()}, list(RULES), []
    for path in sorted(resources.files("tracewise.llm").joinpath("license_texts").iterdir(), key=lambda p: p.name):
        name, run, runs = path.name.removesuffix(".txt"), [], []
        for n, sentence in enumerate(s for s in sentences_of(path.read_text(encoding="utf-8")) if s and not re.fullmatch("[0-9]{1,2}|[a-z]", s)):
            if " " in sentence:
                run.append(known.setdefault(sentence, f"{name}/{n}"))
            elif run:
                runs.append(run)
                run = []
        runs = [r for r in [*runs, run] if r]
        runs = [r for r in runs if len(r) >= LEAST_RUN] or runs
        rules += [(name, tuple(r)) for r in runs]
        parts += [(name, tuple(r[i : i + PART])) for r in runs for i in range(0, len(r) - PART + 1, PART) if len(r) > PART]
    return known, rules + parts


KNOWN, ALL_RULES = catalogue()


def _pieces(text: Column) -> Column:
    """Normalised pieces between ends of sentences and lines; a piece that a known sentence may go on from ends in mark 2, and one that begins with a list number in mark 3.

    Marks: 1 the end of a sentence, 2 a line end that only a known sentence goes over, 3 a list number.
    """
    lines = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\u0001\u0002\u0003", "\n  ")
    lines = F.regexp_replace(lines, r"\n(?=[^A-Za-z0-9\n]*(?:\n|\z))", "\u0001")
    lines = F.regexp_replace(lines, r"\n(?=[^a-z]|\z)", "\u0002")
    lines = F.regexp_replace(lines, r"(?<![^\n\x01\x02])([^A-Za-z0-9\n\x01\x02]*)([0-9]{1,2}|[A-Za-z])(?=[.)][\x20\x09])", "$1\u0003$2")
    ends = F.regexp_replace(lines, r"[.!?][\x20\x09-\x0D\x02]", "\u0001")
    plain = F.regexp_replace(F.translate(ends, _UPPER, _LOWER), "[^a-z0-9\u0001-\u0003]+", " ")
    plain = F.regexp_replace(plain, r"[ \x02]*\x01[ \x01\x02]*", "\u0001")
    plain = F.regexp_replace(plain, r" ?\x02[ \x02]*", "\u0002\u0001")
    return F.filter(F.transform(F.split(plain, "\u0001"), lambda s: F.trim(s)), lambda s: ~s.isin("", "\u0002"))


def _text(piece: Column, first: bool) -> Column:
    """A piece without its marks; as a first piece also without its list number."""
    plain = F.translate(piece, "\u0002\u0003", "")
    return F.when(piece.startswith("\u0003"), F.trim(F.regexp_replace(piece, "^\u0003[a-z0-9]{1,2}|\u0002", ""))).otherwise(plain) if first else plain


def _constant(value: list, kind: str) -> Column:
    """A list as one literal: the optimizer folds it, where an expression for each entry would make plans large."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _key(sentence: Column) -> Column:
    return F.crc32(sentence.cast("binary"))


def _found(pieces: Column) -> Column:
    """For each piece the known sentence that begins there, as (sentence number from 1, pieces), else null. The longest counts."""
    names = list(KNOWN)
    table: dict[int, list[int]] = {}
    for n, s in enumerate(names, 1):
        table.setdefault(zlib.crc32(s.encode()), []).append(n)
    keys = _constant(list(table), "array<bigint>")
    numbers = _constant([ns[0] for ns in table.values()], "array<int>")
    if any(len(ns) > 1 for ns in table.values()):
        raise ValueError("two known sentences share a key")
    texts = _constant(names, "array<string>")
    words: dict[int, int] = {}  # of sentences that begin with two words, the most words: each line of one holds at least a word
    for s in names:
        key = zlib.crc32(" ".join(s.split(" ")[:2]).encode())
        words[key] = max(words.get(key, 0), len(s.split(" ")))
    begun = [[k for k in sorted(words) if k % BUCKETS == b] for b in range(BUCKETS)]
    starts, lengths = _constant(begun, "array<array<bigint>>"), _constant([[words[k] for k in ks] for ks in begun], "array<array<int>>")
    longest = max(map(len, names))

    def looked_up(sentence: Column) -> Column:
        """The number of a known sentence; null for any other."""
        n = F.element_at(numbers, F.array_position(keys, _key(sentence)).cast("int"))
        return F.when(F.array_contains(keys, _key(sentence)) & (F.char_length(sentence) <= longest), F.when(F.element_at(texts, n) == sentence, n))

    def at(piece: Column, i: Column) -> Column:
        first = _text(piece, True)
        key = _key(F.substring_index(first, " ", 2))
        bucket = (key % BUCKETS).cast("int")
        most = F.element_at(F.get(lengths, bucket), F.array_position(F.get(starts, bucket), key).cast("int"))
        near = F.slice(pieces, i + 1, most)
        open_ = F.coalesce(F.nullif(F.array_position(F.transform(near, lambda p: ~F.endswith(p, F.lit("\u0002"))), True), F.lit(0).cast("long")), F.size(near).cast("long")).cast("int")
        tries = F.transform(F.sequence(open_, F.lit(1), F.lit(-1)), lambda k: F.struct(looked_up(F.concat_ws(" ", first, F.when(k > 1, F.array_join(F.transform(F.slice(near, 2, k - 1), lambda p: _text(p, False)), " ")))).alias("n"), k.alias("k")))
        best = F.try_element_at(F.filter(tries, lambda t: t["n"].isNotNull()), F.lit(1))
        return F.when(F.array_contains(F.get(starts, bucket), key), best)

    return F.transform(pieces, at)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_sentences, n_known (known sentences) and matches: license, rule (its place in ALL_RULES), first and end sentence."""
    made = ("n_sentences", "n_known", "matches")
    number = {s: n for n, s in enumerate(KNOWN.values(), 1)}

    rules = _constant([{"license": name, "rule": n, "parts": [number[p] for p in parts]} for n, (name, parts) in enumerate(ALL_RULES)], "array<struct<license:string,rule:int,parts:array<int>>>")

    def at(ids: Column, i: Column) -> Column:
        """The first rule that matches at sentence i, else null."""
        hits = F.filter(rules, lambda r: (F.get(r["parts"], 0) == F.get(ids, i)) & (F.slice(ids, i + 1, F.size(r["parts"])) == r["parts"]))
        return F.get(F.transform(hits, lambda r: F.struct(r["license"].alias("license"), r["rule"].alias("rule"), i.cast("int").alias("first"), (i + F.size(r["parts"])).cast("int").alias("end"))), 0)

    rows, back = held(docs, {"_lic_text": text}, made)
    rows = rows.withColumn("_lic_pieces", _pieces(F.col("_lic_text")))
    rows = rows.withColumn("_lic_found", _found(F.col("_lic_pieces")))
    # pieces that a known sentence before them goes over are none of their own, nor is a bare list number before one
    found, pieces = F.col("_lic_found"), F.col("_lic_pieces")
    wide = F.filter(F.transform(found, lambda f, i: F.struct(i.alias("at"), (i + f["k"]).alias("end"))), lambda x: x["end"] > x["at"] + 1)
    rows = rows.withColumn("_lic_wide", wide)
    over = lambda i: F.exists("_lic_wide", lambda x: (x["at"] < i) & (x["end"] > i))
    bare = lambda p, i: p.rlike("^\u0003[a-z0-9]{1,2}\\z") & F.get(found, i + 1).isNotNull()
    ids = F.filter(F.transform(pieces, lambda p, i: F.when(over(i) | bare(p, i), F.lit(-1)).otherwise(F.coalesce(F.get(found, i)["n"], F.lit(0)))), lambda n: n >= 0)
    any_ = F.exists(found, lambda f: f.isNotNull())
    rows = rows.withColumn("_lic_ids", F.when(any_, ids)).withColumn("n_sentences", F.when(any_, F.size("_lic_ids")).otherwise(F.size("_lic_pieces")).cast("long"))
    rows = rows.withColumn("n_known", F.when(any_, F.size(F.filter("_lic_ids", lambda n: n > 0))).otherwise(0).cast("long"))
    hits = F.filter(F.transform("_lic_ids", lambda n, i: F.when(n > 0, at(F.col("_lic_ids"), i))), lambda m: m.isNotNull())
    none = F.array().cast("array<struct<license:string,rule:int,first:int,end:int>>")
    apart = F.aggregate(hits, none, lambda done, m: F.when(F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) <= m["first"], F.concat(done, F.array(m))).otherwise(done))
    return rows.withColumn("matches", F.when(any_, apart).otherwise(none)).select(*back, *made)
