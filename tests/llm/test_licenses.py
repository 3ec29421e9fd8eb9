"""License scans of whole texts, as they are wrapped in the wild."""

import pytest

from tracewise.llm import licenses

GPL = """Copyright (C) 2020 Someone

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
WHOLE = {"GPL-3.0-or-later": (GPL, 3), "Apache-2.0": (APACHE, 5), "MIT": (MIT, 3), "BSD-2-Clause": (BSD2 + DISCLAIMER, 3), "BSD-3-Clause": (BSD3 + DISCLAIMER, 4)}
DRESS = {
    "plain": lambda t: t, "indented": lambda t: t.replace("\n", "\n    "), "hash": lambda t: "# " + t.replace("\n", "\n# ") + "\nimport x\n", "slashes": lambda t: "// " + t.replace("\n", "\n// "),
    "block": lambda t: "/*\n * " + t.replace("\n", "\n * ") + "\n */\nint x;", "crlf": lambda t: t.replace("\n", "\r\n"), "brackets": lambda t: t.replace("1. ", "(1) ").replace("2. R", "b) R").replace("3. N", "c. N"), "tight": lambda t: t.replace("\n\n", "\n"),
}


@pytest.mark.parametrize("dress", DRESS)
def test_whole_licenses_as_they_are_wrapped(spark, dress):
    rows = [(name, DRESS[dress](text)) for name, (text, _) in WHOLE.items()]
    got = licenses.scanned(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [[(m["license"], m["end"] - m["first"]) for m in r["matches"]] for r in got] == [[(name, n)] for name, (_, n) in WHOLE.items()]


def test_other_sentences_stay(spark):
    texts = ["1. one\n2. two\n(a) three", "\x02a\x03b\n\n\nc\n D. e", "Redistributions of source code must retain the above copyright notice, this\n\n list of conditions and the following disclaimer.", "a MIT License", "1. Licensed under CC BY 4.0. 2. Text"]
    got = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()
    assert [(r["n_sentences"], r["n_known"]) for r in got] == [(5, 0), (4, 0), (2, 0), (1, 0), (3, 1)]


@pytest.mark.parametrize("dress", ("plain", "indented", "hash", "crlf"))
def test_whole_license_files(spark, dress):
    """Each license of the catalogue is found in its own text, as one run or several, and so is a copy with a sentence changed."""
    from importlib import resources

    texts = {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in resources.files("tracewise.llm").joinpath("license_texts").iterdir()}
    rows = [(n, DRESS[dress](t)) for n, t in texts.items()] + [(n, DRESS[dress](t.replace("warranty", "warrantee"))) for n, t in texts.items() if len(t) > 15_000]
    got = licenses.scanned(spark.createDataFrame(rows, "name string, text string")).collect()
    for r in got:
        assert r["name"] in {m["license"] for m in r["matches"]} and r["n_known"] >= 0.6 * r["n_sentences"], r["name"]


def test_catalogue():
    known, rules = licenses.catalogue()
    assert len(known) > 900 and len(rules) > 100 and all(" " in s for s in known)
    assert {p for _, parts in rules for p in parts} <= set(known.values()) and rules[: len(licenses.RULES)] == licenses.RULES


@pytest.mark.parametrize("width", [16, 24])
def test_sentences_over_any_number_of_lines(spark, width):
    """Paragraphs wrapped to two words a line or so: the grants go over some forty lines, and are known as they are over five."""
    import textwrap

    def narrow(text):
        return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))

    rows = [(name, "# " + narrow(text).replace("\n", "\n# ")) for name, (text, _) in WHOLE.items() if name in ("MIT", "GPL-3.0-or-later")]
    assert max(t.count("\n") for _, t in rows) > 50
    got = licenses.scanned(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [[(m["license"], m["end"] - m["first"]) for m in r["matches"]] for r in got] == [[(name, WHOLE[name][1])] for name, _ in rows]
