"""License scans by sentence rules.

Comment signs at either end of the lines are taken off. Paragraphs (runs of lines that are not blank) that hold a
licence word are cut into sentences. A sentence is normalised (lower case, no punctuation but dots inside numbers,
single spaces, its line ends kept) and searched for licence sentences, by an ordered table of patterns. They
start where a sentence or a line starts and end where one ends, so that both wrapped sentences and lines without
a full stop are found; within a pattern, free words run over at most WRAPS line ends, and over none before
another licence sentence. Other sentences have no identifier. A document's
identifiers, in order, form a sequence; ordered licence rules, longest first, are matched against it.
A rule that matches names its licence and uses up its sentences, so that a full licence text is not
also reported as its parts. Identifiers that no rule used are listed as unmatched. The whole
operator is a projection of the scan: no shuffle, nothing broadcast; DataFrame functions only.

**Cases.** Null and empty texts have no sentences and no licences. Repeated rows, ids and null ids
give a row each. A licence named several times is listed once, in order of the rules. Other columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line without any of these holds no known sentence.
TRIGGER = r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|liab|public domain|spdx|gnu |rights reserved"
SENTENCE_END = r"[.!?;](?:\s+|$)"
#: TRIGGER with its blanks as line ends and comment signs.
WRAPPED_TRIGGER = TRIGGER.replace(" ", r"[\s/*#;%>!-]+")
#: Line ends that free words within a pattern run over.
WRAPS = 20
#: Signs and blanks at the start of a line, a sign at its end. Possessive loops run without a stack, and a run of one
#: sign or of blanks is tried from its start only, so that time follows the length of the text.
COMMENT = (
    r"(?im)^[^\S\n]*+(?:(?:<!--|/++\*++|//++|\*++/|[*#;%>!]++|--++|(?:rem|dnl)(?=\s))[^\S\n]*+)++"
    r"|(?<![^\S\n])[^\S\n]*+(?:(?<!\*)\*++/++|(?<!-)--++>|(?<![*#])[*#]++)[^\S\n]*+$"
)
BLANK_LINES = r"\n\s*\n"
#: The GPL's first sentence as one, its version clause as the next, and that clause with the words "of the License".
FREE_SOFTWARE = r"(?i)(free\s+software)\s*;(\s+you\s+can\s+redistribute)"
FOUNDATION = r"(?i)(free\s+software\s+foundation),(\s+(?:either\s+)?version\s)"
VERSION_ONLY = r"(?i)(either\s+version\s+[23])(,?\s+or\s)"

# Licence sentences (normalised, as patterns of the whole sentence) by identifier.
_SUBJECT = r"(?:(?:this|the) (?:work|program|software|file|project|code|document|package|library|source code)(?: is| may be used)?|it is)?"
_GRANT = rf"(?:{_SUBJECT} ?(?:is )?(?:licen[cs]ed|released|distributed|made available|available|published) (?:to you )?under(?: the terms of)?(?: the| an| a)?)"
_VERSION = r"(?:version |v ?)?"
_LATER = r"(?: or(?: at your option)? any later version| or later)?"
SENTENCES: tuple[tuple[str, str], ...] = (
    ("apache-2-grant", rf"{_GRANT} apache (?:software )?licen[cs]e {_VERSION}2(?:\.0)?(?: the licen[cs]e)?"),
    ("apache-2-use", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2-copy", r"you may obtain a copy of the licen[cs]e at(?: .*)?"),
    ("apache-2-disclaimer", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis.*"),
    ("apache-2-limits", r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("mit-grant", rf"{_GRANT} mit(?:/x11)? licen[cs]e"),
    ("mit-permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit-condition", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-disclaimer", r"the software is provided as is without warranty of any kind express or implied.*"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability.*"),
    ("isc-permission", r"permission to use copy modify and/?or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("isc-grant", rf"{_GRANT} isc licen[cs]e"),
    ("bsd-redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("bsd-source", r"(?:\d )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-endorse", r"(?:\d )?neither the name of .* may be used to endorse or promote products derived from this software.*"),
    ("bsd-3-grant", rf"{_GRANT} (?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)(?: licen[cs]e)?"),
    ("bsd-2-grant", rf"{_GRANT} (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-grant", rf"{_GRANT} bsd licen[cs]e"),
    ("agpl-3-grant", rf"{_GRANT} (?:gnu )?(?:affero general public licen[cs]e|agpl) ?{_VERSION}3(?:\.0)?{_LATER}"),
    ("lgpl-3-grant", rf"{_GRANT} (?:gnu )?(?:lesser general public licen[cs]e|lgpl) ?{_VERSION}3(?:\.0)?{_LATER}"),
    ("lgpl-2.1-grant", rf"{_GRANT} (?:gnu )?(?:lesser general public licen[cs]e|lgpl) ?{_VERSION}2\.1{_LATER}"),
    ("gpl-3-grant", rf"{_GRANT} (?:gnu )?(?:general public licen[cs]e|gpl) ?{_VERSION}3(?:\.0)?{_LATER}"),
    ("gpl-2-grant", rf"{_GRANT} (?:gnu )?(?:general public licen[cs]e|gpl) ?{_VERSION}2(?:\.0)?{_LATER}"),
    ("gpl-free", r"this program is free software you can redistribute it and/?or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation.*"),
    ("gpl-version-3", r"either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl-version-2", r"either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-disclaimer", r"this program is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl-copy", r"you should have received a copy of the gnu (?:lesser |affero )?general public licen[cs]e along with this (?:program|library|work).*"),
    ("mpl-2-form", r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2\.0"),
    ("mpl-2-copy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("mpl-2-grant", rf"{_GRANT} mozilla public licen[cs]e {_VERSION}2(?:\.0)?"),
    ("unlicense-public", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", rf"{_SUBJECT} ?(?:is )?(?:dedicated to|released into|placed in|in) the public domain"),
    ("cc0-grant", rf"{_GRANT} (?:creative commons )?cc ?0(?: 1\.0)?(?: universal)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd-grant", rf"{_GRANT} (?:cc by nc nd|creative commons attribution noncommercial noderiv(?:ative)?s)(?: \d\.\d)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa-grant", rf"{_GRANT} (?:cc by nc sa|creative commons attribution noncommercial sharealike)(?: \d\.\d)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-grant", rf"{_GRANT} (?:cc by nc|creative commons attribution noncommercial)(?: \d\.\d)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nd-grant", rf"{_GRANT} (?:cc by nd|creative commons attribution noderiv(?:ative)?s)(?: \d\.\d)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa-grant", rf"{_GRANT} (?:cc by sa|creative commons attribution sharealike)(?: \d\.\d)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-grant", rf"{_GRANT} (?:cc by|creative commons attribution)(?: \d\.\d)?(?: international)?(?: licen[cs]e)?"),
    ("all-rights", r"(?:copyright .*)?all rights reserved"),
    ("spdx-mit", r".*spdx licen[cs]e identifier mit"),
    ("spdx-apache-2", r".*spdx licen[cs]e identifier apache 2\.0"),
    ("spdx-gpl-3", r".*spdx licen[cs]e identifier gpl 3\.0(?: only| or later)?"),
    ("spdx-gpl-2", r".*spdx licen[cs]e identifier gpl 2\.0(?: only| or later)?"),
    ("spdx-bsd-3", r".*spdx licen[cs]e identifier bsd 3 clause"),
    ("other-grant", rf"{_GRANT} .*licen[cs]e.*"),
)

# Licences by the ordered sentences that grant them, tried from the top.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-2-grant", "apache-2-use", "apache-2-copy", "apache-2-disclaimer", "apache-2-limits")),
    ("MIT", ("mit-grant", "mit-permission", "mit-condition", "mit-disclaimer", "mit-liability")),
    ("MIT", ("mit-permission", "mit-condition", "mit-disclaimer", "mit-liability")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-version-3", "gpl-disclaimer", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-version-2", "gpl-disclaimer", "gpl-copy")),
    ("ISC", ("isc-permission", "mit-disclaimer")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-version-3")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-version-2")),
    ("MPL-2.0", ("mpl-2-form", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2-form",)),
    ("MPL-2.0", ("mpl-2-grant",)),
    ("Apache-2.0", ("apache-2-grant",)),
    ("Apache-2.0", ("spdx-apache-2",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("spdx-mit",)),
    ("ISC", ("isc-permission",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-3-grant",)),
    ("BSD-3-Clause", ("spdx-bsd-3",)),
    ("BSD-2-Clause", ("bsd-2-grant",)),
    ("BSD", ("bsd-grant",)),
    ("AGPL-3.0", ("agpl-3-grant",)),
    ("LGPL-3.0", ("lgpl-3-grant",)),
    ("LGPL-2.1", ("lgpl-2.1-grant",)),
    ("GPL-3.0", ("gpl-3-grant",)),
    ("GPL-3.0", ("spdx-gpl-3",)),
    ("GPL-2.0", ("gpl-2-grant",)),
    ("GPL-2.0", ("spdx-gpl-2",)),
    ("Unlicense", ("unlicense-public",)),
    ("Public-Domain", ("public-domain",)),
    ("CC0-1.0", ("cc0-grant",)),
    ("CC-BY-NC-ND", ("cc-by-nc-nd-grant",)),
    ("CC-BY-NC-SA", ("cc-by-nc-sa-grant",)),
    ("CC-BY-NC", ("cc-by-nc-grant",)),
    ("CC-BY-ND", ("cc-by-nd-grant",)),
    ("CC-BY-SA", ("cc-by-sa-grant",)),
    ("CC-BY", ("cc-by-grant",)),
    ("Proprietary", ("all-rights",)),
)


def normalise(sentence: Column) -> Column:
    """Lower case, punctuation as blanks but for dots between digits and slashes, single blanks and line ends."""
    kept = F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}./\n]|\.(?![0-9])|(?<![0-9])\.", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(kept, r"[^\S\n]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))


def _over_lines(pattern: str, free: str) -> str:
    """A pattern with line ends for blanks; free words at either end stay in their line, others are ``free``."""
    start, end = pattern.startswith(".*"), re.search(r"( ?)\.\*((?:\)\?)?)$", pattern)
    body = pattern[2 * start : end.start() if end else None].replace(".*", "\0").replace(" ", r"[ \n]").replace("\0", free)
    return (r"[^\n]*" if start else "") + body + (end[1] + r"[^\n]*" + end[2] if end else "")


def _any_sentence() -> str:
    """One pattern for every licence sentence, from a line's start to a line's end, in order of the table."""
    lines = "|".join(_over_lines(pattern, r"[^\n]*") for _, pattern in SENTENCES)
    free = rf"(?:[^\n]*\n(?!(?:{lines})(?:\n|$))){{0,{WRAPS}}}?[^\n]*"
    return r"(?:^|(?<=\n))(?:" + "|".join(_over_lines(pattern, free) for _, pattern in SENTENCES) + r")(?=\n|$)"


def sentences(text: Column) -> Column:
    """The normalised licence sentences of a text, in order."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), COMMENT, "")
    paragraphs = F.filter(F.split(bare, BLANK_LINES), lambda x: x.rlike(WRAPPED_TRIGGER))

    def cut(paragraph: Column) -> Column:
        for pattern, told in ((FREE_SOFTWARE, "$1:$2"), (FOUNDATION, "$1;$2"), (VERSION_ONLY, "$1 of the License$2")):
            paragraph = F.regexp_replace(paragraph, pattern, told)
        return F.split(paragraph, SENTENCE_END)

    parts = F.flatten(F.transform(paragraphs, cut))
    every = F.lit(_any_sentence())
    found = F.flatten(F.transform(parts, lambda x: F.regexp_extract_all(normalise(x), every, F.lit(0))))
    return F.filter(F.transform(found, lambda x: F.trim(F.translate(x, "\n", " "))), lambda x: x != "")


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, null if it is not a licence sentence."""
    found = F.when(sentence.rlike(f"^(?:{SENTENCES[0][1]})$"), SENTENCES[0][0])
    for name, pattern in SENTENCES[1:]:
        found = found.when(sentence.rlike(f"^ ?(?:{pattern})$"), name)
    return found


def _rule_pattern(names: tuple[str, ...]) -> str:
    return "," + ",".join(n.replace(".", r"\.") for n in names) + ","


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentence_ids (in order), licenses (in order of the rules, each
    once), unmatched (identifiers that no rule used)."""
    holds = F.coalesce(F.col("text").rlike(WRAPPED_TRIGGER), F.lit(False))
    found = F.when(holds, sentences(F.col("text"))).otherwise(F.array().cast("array<string>"))
    out = docs.select("doc_id", found.alias("sentences"))
    out = out.select("doc_id", F.transform("sentences", identifier).alias("ids"))
    out = out.select("doc_id", F.filter("ids", lambda x: x.isNotNull()).alias("sentence_ids"))
    # the sequence ",a,,b,,c,": one comma on either side of every identifier
    joined = F.concat_ws("", F.transform("sentence_ids", lambda x: F.concat(F.lit(","), x, F.lit(","))))
    out = out.withColumn("left", joined).withColumn("named", F.array().cast("array<string>"))
    out = out.select("doc_id", "sentence_ids", *_matched())
    listed = F.filter(F.split("left", ",+"), lambda x: x != "")
    return out.select("doc_id", "sentence_ids", F.array_distinct("licenses").alias("licenses"), listed.alias("unmatched"))


def _matched() -> list[Column]:
    """What the ordered rules name and leave of the sequence ``left``."""
    rules = F.array(
        *(F.struct(F.lit(name).alias("name"), F.lit(_rule_pattern(ids).replace(",", ",+")).alias("pattern")) for name, ids in RULES)
    )
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<string>").alias("named"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.call_function("rlike", state["left"], rule["pattern"])
        return F.when(
            hit,
            F.struct(
                F.regexp_replace(state["left"], rule["pattern"], F.lit(",,")).alias("left"),
                F.array_append(state["named"], rule["name"]).alias("named"),
            ),
        ).otherwise(state)

    done = F.when(F.col("left") == "", start).otherwise(F.aggregate(rules, start, step))
    return [done["left"].alias("left"), done["named"].alias("licenses")]
