"""Licence scans by sentence rules.

A text is cut into sentences at marks and blank lines. Known sentences are sought by patterns, in lower case and whatever
blanks, marks and comment marks stand between the words; each gets its identifier. Rules are ordered: each names a licence
and a sequence of identifiers. A rule fits where its identifiers follow each other, with GAP unknown sentences between two
of them at most; the sentences that it uses are taken, and later rules see what is left. So a whole licence wins over its
own parts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from re import _constants, _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import scanned, tidied

#: Unknown sentences allowed between two sentences of a rule.
GAP = 3

#: Known sentences, as (identifier, pattern of the normalised sentence). At most one .* in a pattern stands
#: for any text of the same paragraph.
SENTENCES = (
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit-warranty", r"the software is provided as is without warranty of any kind"),
    ("mit-name", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit licen[sc]e"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", r"neither the name of .* may be used to endorse or promote products"),
    ("bsd-advert", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-warranty", r"this software is provided by .* as is and any express or implied warranties"),
    ("bsd-name", r"(?:released|licensed|distributed) under (?:the )?(?:(?P<n>[234]) ?clause )?bsd licen[sc]e"),
    ("isc-grant", r"permission to use copy modify and ?(?:/ ?)?(?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-header", r"licensed under the apache licen[sc]e,? version 2(?:\.0)?"),
    ("apache-copy", r"you may obtain a copy of the licen[sc]e at"),
    ("apache-warranty", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("gpl-free", r"(?:this program|this file|it) is free software you can redistribute it and ?(?:/ ?)?or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl-free", r"is free software you can redistribute it and ?(?:/ ?)?or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl-free", r"is free software you can redistribute it and ?(?:/ ?)?or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gpl-warranty", r"is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-copy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[sc]e"),
    ("gpl-3-name", r"(?:licensed|released|distributed) under the gnu general public licen[sc]e,? version 3"),
    ("gpl-2-name", r"(?:licensed|released|distributed) under the gnu general public licen[sc]e,? version 2"),
    ("gpl-name", r"(?:licensed|released|distributed) under the gnu general public licen[sc]e"),
    ("lgpl-name", r"(?:licensed|released|distributed) under the gnu (?:lesser|library) general public licen[sc]e"),
    ("mpl-2", r"subject to the terms of the mozilla public licen[sc]e,? v(?:ersion)? ?\.? ?2"),
    ("cc-by-nc-sa", r"(?:licensed|released) under (?:a |the )?(?:creative commons|cc) (?:attribution noncommercial sharealike|by nc sa)"),
    ("cc-by-nc-nd", r"(?:licensed|released) under (?:a |the )?(?:creative commons|cc) (?:attribution noncommercial noderiv\w*|by nc nd)"),
    ("cc-by-nc", r"(?:licensed|released) under (?:a |the )?(?:creative commons|cc) (?:attribution noncommercial|by nc)"),
    ("cc-by-sa", r"(?:licensed|released) under (?:a |the )?(?:creative commons|cc) (?:attribution sharealike|by sa)"),
    ("cc-by", r"(?:licensed|released) under (?:a |the )?(?:creative commons|cc) (?:attribution|by)"),
    ("cc0-name", r"cc0"),
    ("cc0", r"to the extent possible under law .* has waived all copyright"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:is|are|released|placed) (?:hereby )?(?:in|into|in to) the public domain"),
    ("all-rights", r"all rights reserved"),
    ("zlib-warranty", r"this software is provided as is without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib-origin", r"the origin of this software must not be misrepresented"),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("boost-name", r"(?:licensed|released|distributed) under the boost software licen[sc]e"),
    ("epl-2", r"made available under the terms of the eclipse public licen[sc]e,? (?:version |v ?\.? ?)?2"),
    ("epl-1", r"made available under the terms of the eclipse public licen[sc]e,? (?:version |v ?\.? ?)?1"),
    ("ofl", r"licensed under the sil open font licen[sc]e"),
    ("cddl", r"subject to the terms of the common development and distribution licen[sc]e"),
    ("artistic", r"(?:licensed|released|distributed) under the (?:terms of the )?artistic licen[sc]e"),
    ("perl", r"under the same terms as perl itself"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e"),
    ("spdx-mit", r"spdx licen[sc]e identifier mit(?![\w-])"),
    ("spdx-apache-2", r"spdx licen[sc]e identifier apache 2\.0"),
    ("spdx-bsd-2", r"spdx licen[sc]e identifier bsd 2"),
    ("spdx-bsd-3", r"spdx licen[sc]e identifier bsd 3"),
    ("spdx-isc", r"spdx licen[sc]e identifier isc"),
    ("spdx-gpl-2", r"spdx licen[sc]e identifier gpl 2\.0"),
    ("spdx-gpl-3", r"spdx licen[sc]e identifier gpl 3\.0"),
    ("spdx-lgpl", r"spdx licen[sc]e identifier lgpl"),
    ("spdx-agpl-3", r"spdx licen[sc]e identifier agpl 3\.0"),
    ("spdx-mpl-2", r"spdx licen[sc]e identifier mpl 2\.0"),
    ("spdx-epl-2", r"spdx licen[sc]e identifier epl 2\.0"),
    ("spdx-zlib", r"spdx licen[sc]e identifier zlib"),
    ("spdx-boost", r"spdx licen[sc]e identifier bsl 1\.0"),
    ("spdx-unlicense", r"spdx licen[sc]e identifier unlicense"),
)
#: Ordered rules, as (licence, identifiers in sequence).
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("Apache-2.0", ("apache-header", "apache-copy", "apache-warranty")),
    ("AGPL-3.0", ("agpl-free", "gpl-warranty", "gpl-copy")),
    ("LGPL", ("lgpl-free", "gpl-warranty", "gpl-copy")),
    ("GPL", ("gpl-free", "gpl-warranty", "gpl-copy")),
    ("ISC", ("isc-grant", "mit-warranty")),
    ("Zlib", ("zlib-warranty", "zlib-grant", "zlib-origin")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name",)),
    ("BSD", ("bsd-name",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-header",)),
    ("GPL-3.0", ("gpl-3-name",)),
    ("GPL-2.0", ("gpl-2-name",)),
    ("LGPL", ("lgpl-name",)),
    ("GPL", ("gpl-name",)),
    ("GPL", ("gpl-free",)),
    ("MPL-2.0", ("mpl-2",)),
    ("CC-BY-NC-SA", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND", ("cc-by-nc-nd",)),
    ("CC-BY-NC", ("cc-by-nc",)),
    ("CC-BY-SA", ("cc-by-sa",)),
    ("CC-BY", ("cc-by",)),
    ("CC0", ("cc0",)),
    ("CC0", ("cc0-name",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public-domain",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-name",)),
    ("EPL-2.0", ("epl-2",)),
    ("EPL-1.0", ("epl-1",)),
    ("OFL-1.1", ("ofl",)),
    ("CDDL", ("cddl",)),
    ("Artistic", ("artistic",)),
    ("Perl", ("perl",)),
    ("WTFPL", ("wtfpl",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache-2",)),
    ("BSD-2-Clause", ("spdx-bsd-2",)),
    ("BSD-3-Clause", ("spdx-bsd-3",)),
    ("ISC", ("spdx-isc",)),
    ("GPL-2.0", ("spdx-gpl-2",)),
    ("GPL-3.0", ("spdx-gpl-3",)),
    ("LGPL", ("spdx-lgpl",)),
    ("AGPL-3.0", ("spdx-agpl-3",)),
    ("MPL-2.0", ("spdx-mpl-2",)),
    ("EPL-2.0", ("spdx-epl-2",)),
    ("Zlib", ("spdx-zlib",)),
    ("BSL-1.0", ("spdx-boost",)),
    ("Unlicense", ("spdx-unlicense",)),
    ("All-Rights-Reserved", ("all-rights",)),
)
#: A sentence ends at a mark that a blank follows (but for the v. of a version) and at a blank line.
_END = re.compile(r"(?<=[.!?])(?<!\bv\.)\s+|\n\s*\n")
_BLANK_LINE = re.compile(r"\n\s*\n")
#: Marks of comments and lists at the edges of a line.
_EDGE = re.compile(r"(?m)^[ \t]*(?:(?:<!--|\(\*|[/*#;%!|>:'.\"-])+|(?:dnl|rem)\b)|(?<![*#/|;-])(?:--+>|[*#/|;-]+\)?)[ \t\r]*$")
#: What a blank of a known sentence's pattern fits: any marks in a sentence.
_BLANK = r"(?:[^\w.\x00\x01]|\.(?!\d))++"


def _needed(parsed) -> list[set[str]]:
    """From a parsed pattern: sets of words, of each of which any text that it fits holds one."""
    out, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is _constants.ASSERT_NOT:
            continue
        if op is _constants.LITERAL and arg != ord(" "):
            run += chr(arg)
            continue
        if run:
            out.append({run})
            run = ""
        if op is _constants.SUBPATTERN:
            out += _needed(arg[-1])
        elif op is _constants.BRANCH:
            sides = [_needed(side) for side in arg[1]]
            if all(sides):
                out.append(set().union(*(max(side, key=lambda words: min(map(len, words))) for side in sides)))
    return sorted(out, key=lambda words: -min(map(len, words)))


@cache
def _known() -> list[tuple[str, list[set[str]], list[re.Pattern]]]:
    """(identifier, sets of words one of each of which is needed, patterns before and after .*) of the known sentences."""
    wide = lambda p: re.compile(p.strip().replace(",?", "").replace(" ?", f"(?:{_BLANK})?").replace(" ", _BLANK))
    return [(name, _needed(_parser.parse(pattern.replace(",?", ""))), [wide(p) for p in pattern.split(".*")]) for name, pattern in SENTENCES]


def sought(low: str) -> list[tuple[str, list[re.Pattern]]]:
    """The known sentences whose words a text in lower case has; no others can be in it."""
    return [(name, parts) for name, needed, parts in _known() if all(any(word in low for word in words) for words in needed)]


def spans_of(parts: list[re.Pattern], whole: str) -> Iterator[tuple[int, int]]:
    """Where a known sentence stands in a text, leftmost first and without overlaps.

    Of two parts the second may stand anywhere after the first in the same paragraph (\x01 ends one); the nearest counts.
    The parts' places are merged, so no length is too long and no text takes more than two searches.
    """
    if len(parts) == 1:
        yield from (m.span() for m in parts[0].finditer(whole))
        return
    tails, tail, at = parts[1].finditer(whole), None, 0
    for head in parts[0].finditer(whole):
        if head.start() < at:
            continue
        while tail is None or tail.start() < head.end():
            tail = next(tails, None)
            if tail is None:
                return
        if whole.find("\x01", head.end(), tail.start()) < 0:
            at = tail.end()
            yield head.start(), at


def plain(text: str) -> str:
    """In lower case, with the marks at the lines' edges made blanks; every code point keeps its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return _EDGE.sub(lambda m: " " * len(m[0]), low)


def ends(low: str) -> list[tuple[int, int]]:
    """(start, end) of the blanks after the sentences of a plain text."""
    return [m.span() for m in _END.finditer(low)]


def sentences(size: int, cuts: list[tuple[int, int]]) -> list[int]:
    """Where the sentences between the cuts begin."""
    at, out = 0, []
    for b, e in [*cuts, (size, size)]:
        if at < b:
            out.append(at)
        at = e
    return out


def identify(text: str) -> tuple[int, list[tuple[int, int, int, str]]]:
    """How many sentences there are, and (number, start, end, identifier) of the known ones, by place.

    Known sentences are sought in the whole text, so lines and marks of comments don't part them, and several may share a
    sentence; of those that overlap the first listed stays. A mark inside of one (an abbreviation's) ends none.
    """
    low = plain(text)
    cuts, spans, taken = ends(low), [], bytearray(len(low))
    if found := sought(low):
        whole = list(low.replace("\x00", " ").replace("\x01", " "))
        for b, e in cuts:
            whole[b] = "\x01" if _BLANK_LINE.search(low, b, e) else "\x00"
        whole = "".join(whole)
        for name, parts in found:
            for b, e in spans_of(parts, whole):
                if taken.find(1, b, e) < 0:
                    taken[b:e] = b"\x01" * (e - b)
                    spans.append((b, e, name))
        cuts = [c for c in cuts if not taken[c[0]]]
    begun = sentences(len(low), cuts)
    return len(begun), [(bisect_right(begun, b), b, e, name) for b, e, name in sorted(spans)]


def match(found: list[tuple[int, int, int, str]]) -> list[tuple[str, int, int]]:
    """(licence, start, end) of the rules that fit, by start."""
    left, out = list(found), []
    for licence, sequence in RULES:
        if not set(sequence) <= {f[3] for f in left}:
            continue
        i = 0
        while i < len(left):
            taken, k = [], i
            for name in sequence:
                while k < len(left) and left[k][3] != name and taken and left[k][0] - left[taken[-1]][0] <= GAP + 1:
                    k += 1
                if k >= len(left) or left[k][3] != name or taken and left[k][0] - left[taken[-1]][0] > GAP + 1:
                    break
                taken.append(k)
                k += 1
            if len(taken) == len(sequence):
                out.append((licence, left[i][1], left[taken[-1]][2]))
                for j in reversed(taken):
                    del left[j]
            else:
                i += 1
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_sentences, known (array of identifiers in order), licences (sorted set), spans.

    A span is licence:start:end in code points, end exclusive. A null or empty text has no sentence; null ids and
    repeated rows stay as they are. Whole texts are read, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                n, found = identify(t or "")
                hits = match(found)
                rows.append((n, [f[3] for f in found], sorted({h[0] for h in hits}), [f"{x}:{s}:{e}" for x, s, e in hits]))
            lists = pa.list_(pa.string())
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), lists, lists, lists))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "n_sentences", "known", "licences", "spans"])

    rows = scanned(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(tidied(run), f"{id_col} long, n_sentences long, known array<string>, licences array<string>, spans array<string>")
