"""Licence scans by conditional compression.

Words around cue words (whatever the line) vote for places where a template may stand; every such place is
aligned word by word, and confirmed by how much the template as a raw Zstandard dictionary saves on the
text there and by the exact differences in wording. Of matches that overlap, the one that explains most
words stays; all others are reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import column_bytes, map_batches, stable_columns

#: Wordings of common public licence notices.
TEMPLATES = {
    "MIT-statement": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at"
    ),
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "AGPL-3.0-statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."
    ),
    "LGPL-3.0-statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at"
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Phrases that tell a licence from its relatives. A notice in which one of them is broken up or missing is a
#: variant, of a licence that may be another one.
NAMES = {
    "MIT-statement": ("mit license",),
    "Apache-2.0-statement": ("apache license version 2.0",),
    "Apache-2.0": ("apache license version 2.0",),
    "GPL-3.0-statement": ("gnu general public license", "version 3"),
    "GPL-3.0": ("gnu general public license", "version 3"),
    "GPL-2.0": ("gnu general public license", "version 2"),
    "AGPL-3.0": ("gnu affero general public license", "version 3"),
    "AGPL-3.0-statement": ("gnu affero general public license", "version 3"),
    "LGPL-3.0": ("gnu lesser general public license", "version 3"),
    "LGPL-2.1": ("gnu lesser general public license", "version 2.1"),
    "LGPL-3.0-statement": ("gnu lesser general public license", "version 3"),
    "CC-BY-NC-4.0-statement": ("cc by-nc 4.0",),
    "CC-BY-NC-4.0": ("attribution-noncommercial 4.0",),
    "CC-BY-ND-4.0": ("attribution-noderivatives 4.0",),
    "CC-BY-NC-SA-4.0": ("attribution-noncommercial-sharealike 4.0",),
    "CC-BY-NC-ND-4.0": ("attribution-noncommercial-noderivatives 4.0",),
    "CC-BY-4.0": ("attribution 4.0",),
    "CC-BY-SA-4.0": ("attribution-sharealike 4.0",),
    "ISC": ("or without fee",),
    "MIT": ("free of charge",),
    "MPL-2.0": ("mozilla public license v 2.0",),
    "BSD": ("source and binary forms",),
    "Unlicense": ("public domain",),
}
#: A licence named by its tag, alone or as an expression.
TAG = re.compile(rb"SPDX-License-Identifier:[ \t]*(\(?[0-9A-Za-z.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[0-9A-Za-z.+-]+\)?)*)")
#: Words of which a text must hold one before its lines are looked at.
CUE = re.compile(rb"licen[cs]|permi(?:ssion|tted)|redistribut|public domain|copyright|creative commons", re.I)
WORD = re.compile(rb"[0-9A-Za-z]+(?:[.-][0-9A-Za-z]+)*")
COLUMNS = (
    ("block", pa.int32(), "int"),
    ("first_line", pa.int32(), "int"),
    ("n_lines", pa.int32(), "int"),
    ("license", pa.string(), "string"),
    ("saving", pa.float64(), "double"),
    ("coverage", pa.float64(), "double"),
    ("n_missing", pa.int32(), "int"),
    ("n_added", pa.int32(), "int"),
    ("exact", pa.bool_(), "boolean"),
    ("differences", pa.list_(pa.string()), "array<string>"),
    ("variant", pa.bool_(), "boolean"),
)


def words_of(raw: bytes) -> list[bytes]:
    return WORD.findall(raw.lower())


class Scanner:
    def __init__(self, templates: dict[str, str], least_saving: float, least_coverage: float):
        self.least_saving, self.least_coverage = least_saving, least_coverage
        self.names = sorted(templates)
        raw = {n: templates[n].encode() for n in self.names}
        self.words = {n: words_of(raw[n]) for n in self.names}
        self.slack = {n: len(self.words[n]) // 4 + 2 for n in self.names}
        self.reach = max([len(self.words[n]) + 2 * self.slack[n] for n in self.names], default=0)
        self.places: dict[bytes, dict[str, list[int]]] = defaultdict(dict)  # word -> template -> positions
        for n in self.names:
            for j, w in enumerate(self.words[n]):
                self.places[w].setdefault(n, []).append(j)
        self.plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.given = {}
        for n in self.names:
            block = zstandard.ZstdCompressionDict(raw[n].lower(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[n] = zstandard.ZstdCompressor(level=3, dict_data=block, write_checksum=False, write_content_size=False, write_dict_id=False)

    def scan(self, raw: bytes) -> list[tuple]:
        """(first line, lines, licence, saving, coverage, missing, added, exact, differences, variant) of every notice."""
        if not CUE.search(raw):
            return []
        lower = raw.lower()
        spans = [m.span() for m in WORD.finditer(lower)]
        words = [lower[a:b] for a, b in spans]
        ends = [b for _, b in spans]
        regions: list[list[int]] = []
        for m in CUE.finditer(lower):
            at = bisect_right(ends, m.start())
            a, b = max(0, at - self.reach), min(len(words), at + self.reach + 1)
            if regions and a <= regions[-1][1]:
                regions[-1][1] = b
            else:
                regions.append([a, b])
        found = [x for a, b in regions for x in self._matches(lower, words, spans, a, b)]
        taken: list[tuple[int, int]] = []
        kept = []
        for m in TAG.finditer(raw):
            at, line = bisect_right(ends, m.start()), lower.count(b"\n", 0, m.start())
            kept.append((at, line, 1, m[1].decode(), None, 1.0, 0, 0, True, [], False))
        for _, _, name, c, d, *rest in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            k = bisect_left(taken, (c, d))
            if (k == 0 or taken[k - 1][1] <= c) and (k == len(taken) or d <= taken[k][0]):
                taken.insert(k, (c, d))
                start, end = spans[c][0], spans[d - 1][1]
                kept.append((c, lower.count(b"\n", 0, start), lower.count(b"\n", start, end) + 1, name, *rest))
        return [x[1:] for x in sorted(kept)]

    def _matches(self, lower: bytes, words: list[bytes], spans: list[tuple[int, int]], a: int, b: int) -> Iterator[tuple]:
        """(words explained, saving, template, first word, end, ...) wherever a template may stand in words a to b.

        A common word votes for each start that it allows; a place with fewer votes than words that must be
        found can't hold the template."""
        votes: dict[str, list[int]] = defaultdict(list)
        for i in range(a, b):
            for name, places in self.places.get(words[i], {}).items():
                votes[name] += [i - j for j in places]
        for name, starts in votes.items():
            size, slack = len(self.words[name]), self.slack[name]
            need = max(1, int(np.ceil(self.least_coverage * size - 1e-9)))
            if len(starts) < need:
                continue
            starts = np.sort(np.array(starts))
            n = np.searchsorted(starts, starts + 2 * slack, "right") - np.arange(len(starts))
            last = None
            for start in np.unique(starts[n >= need]).tolist():
                if last is not None and start <= last + slack:
                    continue  # the window there reaches as far
                last = start
                lo, hi = max(a, start - slack), min(b, start + size + 3 * slack)
                if match := self._compare(name, lower, words[lo:hi], spans[lo:hi]):
                    explained, saving, c, d, *rest = match
                    yield explained, saving, name, lo + c, lo + d, saving, *rest

    def _compare(self, name: str, lower: bytes, own: list[bytes], spans: list[tuple[int, int]]) -> tuple | None:
        """The template's best place among ``own`` words, confirmed by wording and by saved bytes."""
        want = self.words[name]
        codes = SequenceMatcher(None, want, own, autojunk=False).get_opcodes()
        equal = [k for k, x in enumerate(codes) if x[0] == "equal"]
        if not equal:
            return None
        (_, a0, _, c0, _), (_, _, b1, _, d1) = codes[equal[0]], codes[equal[-1]]
        if sum(codes[k][2] - codes[k][1] for k in equal) < self.least_coverage * len(want) - 1e-9:
            return None
        # Words in place of the template's first or last ones belong to the notice, others around it don't.
        first, end = max(0, c0 - a0), min(len(own), d1 + len(want) - b1)
        codes = [("replace", 0, a0, first, c0), *codes[equal[0] : equal[-1] + 1], ("replace", b1, len(want), d1, end)]
        missing, added, shown = 0, 0, []
        for kind, a, b, c, d in codes:
            if kind != "equal" and (b > a or d > c):
                missing, added = missing + b - a, added + d - c
                shown.append(f"{b' '.join(want[a:b]).decode()} -> {b' '.join(own[c:d]).decode()}")
        text = b" ".join(lower[spans[first][0] : spans[end - 1][1]].split())
        saving = 1 - len(self.given[name].compress(text)) / len(self.plain.compress(text))
        if saving < self.least_saving:
            return None
        coverage = 1 - missing / len(want)
        inside = b" " + b" ".join(own[first:end]) + b" "
        variant = any(b" %b " % n.encode() not in inside for n in NAMES.get(name, ()))
        return len(want) - 2 * missing - added, saving, first, end, coverage, missing, added, missing == added == 0, shown, variant


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, least_saving: float = 0.25, least_coverage: float = 0.7) -> DataFrame:
    """A row per licence notice, in lines of any length and next to others: where it stands, its licence, the share of bytes that the template saves,
    the share of the template's words found, and the wording differences. ``variant``: the nearest wording is ``license``, but
    the words that name it differ, so it is another or an unknown licence. A tag (``SPDX-License-Identifier``) is a
    notice too, with its expression as licence and a null saving.

    Texts of any length are read whole, only around cue words closely; an empty table gives no rows. Null and empty texts, and texts without a cue word, have none. Ties are broken by
    template name; repeated rows and null ids are reported each. Extra columns are ignored. Documents are
    read once and not shuffled; templates are a parameter of fixed size.
    """
    chosen = TEMPLATES if templates is None else templates

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(chosen, least_saving, least_coverage)
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(column_bytes(batch, "text")):
                for number, found in enumerate(own.scan(raw)):
                    at.append(i)
                    rows.append((number, *found))
            columns = list(zip(*rows)) if rows else [[]] * len(COLUMNS)
            arrays = [batch.column("doc_id").take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, (_, t, _) in zip(columns, COLUMNS)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(n for n, _, _ in COLUMNS)])

    schema = "doc_id long, " + ", ".join(f"{n} {t}" for n, _, t in COLUMNS)
    return map_batches(stable_columns(documents, "doc_id", "text"), step, schema)


def license_summary(found: DataFrame) -> DataFrame:
    """Documents and blocks per licence; variants apart."""
    return found.groupBy("license", "variant").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_blocks"), F.count_if("exact").alias("n_exact"))
