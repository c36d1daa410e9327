"""Operator 6: fuzzy search for short license notices.

A notice may differ by up to ``errors`` characters (inserted, left out or changed). Cut into two pieces more
than that, at least two of its pieces are without any difference (the pigeonhole principle), and the starts
that they imply differ by no more than ``errors``. So one Aho-Corasick pass over the lower-cased text for
all pieces of all notices finds seeds of every occurrence, and a lone seed is none. Around agreeing seeds the
regex library's bounded-error matching verifies the notice and gives its span and its number of edits.

Of overlapping matches the one with the fewest edits stays, then the longer notice, then the earlier. But a
notice with which a longer one of its license begins gives way to the longer one wherever both match.
Defined results: null and empty texts hold none. Repeated rows are each reported, as is every occurrence.
Case doesn't count; a changed white space is an edit. Other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partylens.llm.base import find_texts, table

NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification"),
    ("BSD", "Licensed under the BSD 3-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
    ("proprietary", "All rights reserved."),
)
#: Production parameters: an edit is allowed for every so many characters of a notice.
CHARACTERS_AN_EDIT = 10


def split(notice: str, pieces: int) -> list[tuple[int, str]]:
    """(offset, piece): consecutive pieces of equal length, but for one."""
    edges = [len(notice) * i // pieces for i in range(pieces + 1)]
    return [(a, notice[a:b]) for a, b in zip(edges[:-1], edges[1:])]


class Notices:
    def __init__(self, notices=NOTICES, characters_an_edit: int = CHARACTERS_AN_EDIT):
        import ahocorasick
        import regex

        self.each, seeds = [], {}
        for i, (name, notice) in enumerate(notices):
            low = notice.lower()
            errors = len(low) // characters_an_edit
            self.each.append((name, low, errors, regex.compile(rf"(?b)(?:{regex.escape(low)}){{e<={errors}}}")))
            for offset, piece in split(low, errors + 2):
                seeds.setdefault(piece, []).append((i, offset))
        # of each notice, the longer ones of its license that begin with it
        self.longer = [{j for j, y in enumerate(self.each) if y[0] == x[0] and y[1] != x[1] and y[1].startswith(x[1])} for x in self.each]
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """(license, begin, end, edits) of one text, in order."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        places: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.seeds.iter(low):
            for i, offset in where:
                places.setdefault(i, []).append((last + 1 - size - offset, offset))
        found, regions = set(), []
        for i, starts in places.items():
            if len(starts) < 2:
                continue
            name, notice, errors, _ = self.each[i]
            starts.sort()
            # seeds of one occurrence put its start within the number of errors; each such run is one place to verify
            at = 0
            while at < len(starts):
                to = at
                while to + 1 < len(starts) and starts[to + 1][0] - starts[to][0] <= errors:
                    to += 1
                if len({offset for _, offset in starts[at : to + 1]}) > 1:
                    begin, end = max(0, starts[at][0] - errors), min(len(low), starts[to][0] + len(notice) + errors)
                    regions.append((i, begin, end))
                    exact = low.find(notice, begin, end)
                    while exact >= 0:
                        found.add((0, -len(notice), exact, exact + len(notice), name, i))
                        exact = low.find(notice, exact + len(notice), end)
                at = to + 1
        exacts = sorted((b, e, k) for _, _, b, e, _, k in found)
        for i, begin, end in regions:
            name, notice, errors, pattern = self.each[i]
            least = len(notice) - errors
            # an exact match wins over all that overlaps it but a longer form; no room beside it means nothing left to find
            for b, e, k in exacts:
                if i not in self.longer[k] and b < end and e > begin and b - begin < least and end - e < least:
                    break
            else:
                while begin < end:
                    m = pattern.search(low, begin, end)
                    if not m:
                        break
                    if m.end() > m.start():
                        found.add((sum(m.fuzzy_counts), -len(notice), m.start(), m.end(), name, i))
                    begin = max(m.end(), begin + 1)
        # a match that a longer form overlaps comes directly after it
        ranked = []
        for edits, size, begin, end, name, i in found:
            over = [x[0] for x in found if x[5] in self.longer[i] and x[2] < end and x[3] > begin] if self.longer[i] else []
            ranked.append((max([edits, *over]), size, begin, end, name, edits))
        kept: list[tuple] = []
        for _, _, begin, end, name, edits in sorted(ranked):
            if all(end <= b or begin >= e for _, b, e, _ in kept):
                kept.append((name, begin, end, edits))
        return sorted(kept, key=lambda x: x[1])


@functools.cache
def notices() -> Notices:
    return Notices()


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, begin, end, edits, value): one row for each notice found; places are in characters."""

    def make():
        own = notices()

        def each(texts):
            rows, out = [], {"license": [], "begin": [], "end": [], "edits": [], "value": []}
            for i, text in enumerate(texts):
                for name, begin, end, edits in own.find(text):
                    rows.append(i)
                    for key, value in zip(out, (name, begin, end, edits, text[begin:end])):
                        out[key].append(value)
            return rows, out

        return each

    fields = [T.StructField("license", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("value", T.StringType())]
    return find_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", make, fields)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))


QUERIES = {"op6_licenses": op6_licenses}
SQL: dict[str, str] = {}
