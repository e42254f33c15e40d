from __future__ import annotations

import textwrap
import time

import pytest

from trustlens.llm import license_rules
from llm_fixtures import make_docs, shipped  # noqa: F401

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.
See the License for the specific language governing permissions and limitations under the License."""


def _scan(docs):
    return {r["doc_id"]: (r["licenses"], r["unmatched"], r["sentence_ids"]) for r in license_rules.scan(docs).collect()}


def test_known_notices(make_docs):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3."), (2, "Licensed under CC BY-NC 4.0."),
        (3, "intro\nReleased under the MIT License.\nmore"), (4, "Licensed under the Apache License, Version 2.0."),
        (5, MIT), (6, APACHE), (7, "// SPDX-License-Identifier: GPL-2.0-or-later"),
        (8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
        (9, "He lost his driving licence yesterday. The warranty ended."), (10, "All rights reserved."),
        (11, "Distributed under the Strange Home License."), (12, "Licensed under CC BY-SA 4.0.\nReleased under the MIT License."),
    ]
    got = {i: v[0] for i, v in _scan(make_docs(rows)).items()}
    assert got == {
        1: ["GPL-3.0"], 2: ["CC-BY-NC"], 3: ["MIT"], 4: ["Apache-2.0"], 5: ["MIT"], 6: ["Apache-2.0"], 7: ["GPL-2.0"],
        8: ["GPL-3.0-or-later"], 9: [], 10: ["Proprietary"], 11: [], 12: ["MIT", "CC-BY-SA"],
    }


def test_full_texts_use_up_their_sentences(make_docs):
    got = _scan(make_docs([(1, MIT), (2, APACHE), (3, MIT + "\n" + APACHE), (4, MIT.split("\n")[1]), (5, "Distributed under the Strange Home License.")]))
    assert [got[i][1] for i in (1, 2, 3)] == [[]] * 3 and got[3][0] == ["Apache-2.0", "MIT"]
    assert got[4][0] == [] and got[4][1] == ["mit-condition"] and got[5][1] == ["other-grant"]
    assert got[1][2] == ["mit-permission", "mit-condition", "mit-disclaimer", "mit-liability"]


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def _wrap(text, width=60):
    return "\n\n".join(textwrap.fill(x, width) for x in text.split("\n"))


def test_wrapped_notices_in_comments(make_docs):
    notices = [
        (_wrap(MIT), "MIT"), (_wrap(APACHE), "Apache-2.0"), (GPL.format(";", ";", 2), "GPL-2.0-or-later"),
        (GPL.format(":", ",", 3), "GPL-3.0-or-later"), (GPL.format(";", ";", 2).replace("2 of the License", "2"), "GPL-2.0-or-later"), (BSD, "BSD-2-Clause"), (BSD + ENDORSE, "BSD-3-Clause"), (ISC, "ISC"),
        ("Licensed under the Apache\nLicense, Version 2.0.", "Apache-2.0"), ("Released into the public\ndomain.", "Public-Domain"),
        ("Licensed under Creative Commons Attribution\nNonCommercial 4.0.", "CC-BY-NC"),
    ]
    rows, want = [], {}
    for text, name in notices:
        one_line = " ".join(text.split())
        lines = text.split("\n")
        starred = "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */"
        forms = [text, starred, text.replace("\n", "\r\n"), *("\n".join(f"{c} {x}".rstrip() for x in lines) for c in ("#", "//", ";;", "--"))]
        for form in forms + ([one_line] if name.startswith("GPL") else []):
            want[len(rows)] = ([name], [])
            rows.append((len(rows), form))
    got = {i: v[:2] for i, v in _scan(make_docs(rows)).items()}
    assert got == want


def test_lines_without_a_full_stop_stay_apart(make_docs):
    rows = [
        (1, "A title\nReleased under the MIT License\nLicensed under CC BY-SA 4.0\nmore"),
        (2, "Copyright 2020 A\nReleased under the MIT License\nAll rights reserved"),
        (3, "Copyright 2020 A Company of Many\nWords, all rights reserved"), (4, "Copyright 2020\n" * 20_000),
    ]
    got = {i: v[2] for i, v in _scan(make_docs(rows)).items()}
    assert got == {1: ["mit-grant", "cc-by-sa-grant"], 2: ["mit-grant", "all-rights"], 3: ["all-rights"], 4: []}


def test_order_matters(make_docs):
    turned = "\n".join(reversed(MIT.split("\n")))
    assert _scan(make_docs([(1, turned)]))[1][0] == []


def test_cases(make_docs):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "Released under the MIT License."), (4, "Released under the MIT License.\n" * 3), (4, "x")]
    got = license_rules.scan(make_docs(rows, extra=["sentences", "ids", "left"])).collect()
    assert len(got) == 6
    assert sorted(r["licenses"] for r in got) == [[], [], [], [], ["MIT"], ["MIT"]]
    assert [len(r["sentence_ids"]) for r in got if r["doc_id"] == 4 and r["sentence_ids"]] == [3]
    assert license_rules.scan(make_docs([])).count() == 0


@pytest.mark.parametrize("name, ids", license_rules.RULES)
def test_rules_name_known_sentences(name, ids):
    assert name and set(ids) <= {n for n, _ in license_rules.SENTENCES}


def test_long_runs_take_linear_time(make_docs):
    """Signs, blanks and lines by the hundred thousand neither exhaust the stack nor take quadratic time."""
    grant, n = "Released under the MIT License.", 100_000
    runs = ["* " * n, " " * n, "#" * n, "*" * n, "-" * n, "/" * n, "x" * n, "word " * n, "* x " * n, "=\n" * n, "* \n" * n, "# a\n" * n, "\n" * n]
    runs += ["<!--" * n, "-- " * n, "rem " * n, "*/" * n, "\t \n" * n, "…\n" * n, "copyright " * n, "neither the name of a\n" * 5000]
    rows = [(i, f"{grant}\n\n{run}") for i, run in enumerate(runs)] + [(100 + i, f"{run}\n\n{grant}") for i, run in enumerate(runs)]
    rows += [(200 + i, f"{grant}\n{run}") for i, run in enumerate(runs)] + [(300 + i, run + "\nx") for i, run in enumerate(runs)]
    start = time.monotonic()
    got = _scan(make_docs(rows))
    assert time.monotonic() - start < 120
    assert all(got[i][0] == (["MIT"] if i < 300 else []) for i in got)
