"""Licence scan by conditional compression.

A text is cut into blocks (paragraphs, and the single lines that look like a
notice). A block is a candidate if it has one of the cue words that every
template holds. A candidate is compressed on its own and again with each
template as a raw zstandard dictionary; what it shares with a template comes
for nothing then, so the share of bytes saved ranks templates. Each one of
which the block has enough words, in any order, is confirmed by its exact
wording: words are aligned, what a template has and the block lacks or changes
is listed, and a licence is reported if enough of the template's words are
there in order. A block may state several licences.

Edge cases: null and empty texts have no block; names, years and holders in a
notice don't count as differences; a line or paragraph that is longer than a
window is cut into overlapping windows, whatever its length and number of
lines, so long texts are scanned whole; ties between templates for the same
words go to fewer differences, fewer words in between and more bytes saved,
then to the first by name; repeated rows give repeated results; a null id is
reported as null; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import batchwise

#: Identifiers of well-known licences and the wording of their short notices and main clauses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
#: Further identifiers of the SPDX list and the names that short notices use.
NAMES: dict[str, str] = {
    "0BSD": "BSD Zero Clause License",
    "AFL-3.0": "Academic Free License v3.0",
    "AGPL-3.0": "GNU Affero General Public License v3.0",
    "Artistic-2.0": "Artistic License 2.0",
    "Apache-1.1": "Apache License, Version 1.1",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-4-Clause": "BSD 4-Clause License",
    "BSL-1.0": "Boost Software License 1.0",
    "CC-BY-3.0": "Creative Commons Attribution 3.0 Unported License",
    "CC-BY-SA-3.0": "Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-ND-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CDDL-1.0": "Common Development and Distribution License 1.0",
    "CECILL-2.1": "CeCILL Free Software License Agreement v2.1",
    "ECL-2.0": "Educational Community License v2.0",
    "EPL-1.0": "Eclipse Public License 1.0",
    "EPL-2.0": "Eclipse Public License 2.0",
    "EUPL-1.2": "European Union Public License 1.2",
    "GFDL-1.3": "GNU Free Documentation License, version 1.3",
    "GPL-2.0": "GNU General Public License v2.0",
    "GPL-3.0": "GNU General Public License v3.0",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License v3.0",
    "LPPL-1.3c": "LaTeX Project Public License v1.3c",
    "MIT-0": "MIT No Attribution License",
    "MPL-1.1": "Mozilla Public License 1.1",
    "MPL-2.0": "Mozilla Public License 2.0",
    "MS-PL": "Microsoft Public License",
    "MulanPSL-2.0": "Mulan Permissive Software License, Version 2",
    "NCSA": "University of Illinois/NCSA Open Source License",
    "ODbL-1.0": "Open Data Commons Open Database License v1.0",
    "OFL-1.1": "SIL Open Font License, Version 1.1",
    "OSL-3.0": "Open Software License 3.0",
    "PostgreSQL": "PostgreSQL License",
    "PSF-2.0": "Python Software Foundation License 2.0",
    "Unlicense": "The Unlicense",
    "UPL-1.0": "Universal Permissive License v1.0",
    "Vim": "Vim License",
    "WTFPL": "Do What The F*ck You Want To Public License",
    "Zlib": "zlib License",
}
#: Identifiers in tags that have no short notice of their own above.
TAGS = ("ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "MPL-2.0", "AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "GPL-2.0", "GPL-3.0")


def short_notices() -> dict[str, tuple[str, ...]]:
    """Tags and one-line notices, made from identifiers and names; GNU identifiers also come with a suffix."""
    out: dict[str, list[str]] = {}
    for ident in dict.fromkeys((*NAMES, *TAGS)):
        suffixes = ("", "-only", "-or-later") if "GPL" in ident or ident.startswith("GFDL") else ("",)
        out[ident] = [f"SPDX-License-Identifier: {ident}{s}" for s in suffixes]
        if ident in NAMES:
            out[ident] += [f"Licensed under the {NAMES[ident].removeprefix('The ')}.", f"Released under the {NAMES[ident].removeprefix('The ')}."]
    return {k: tuple(v) for k, v in out.items()}


#: Every template has one of these, in lower case.
CUES = ("licen", "permi", "redistribut", "public domain", "all rights reserved", "proprietary", "cc0", "mozilla public")
#: The words of a cue may be on two lines, with a comment mark between them.
_CUE_PATTERNS = {c: c.replace(" ", r"[\W_]+") for c in CUES}
_CUE = re.compile("|".join(_CUE_PATTERNS.values()), re.IGNORECASE)
_PARAGRAPH = re.compile(r"^[^\n]++(?:\n[^\n]++)++", re.MULTILINE)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Words of a window, and its step, in blocks longer than that.
WINDOW, STEP = 160, 80
#: Least share of a template's words that are in a block in order.
CONFIRM = 0.85
#: Words between the licences of a dual notice.
JOINING = {"or", "and", "either"}


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def windows(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of overlapping windows over a stretch of a text, or the stretch itself if it is short."""
    spans = [m.span() for m in re.compile(r"\S+").finditer(text, begin, end)]
    if len(spans) <= WINDOW:
        yield begin, end
        return
    for k in range(0, len(spans) - STEP, STEP):
        yield spans[k][0], spans[min(k + WINDOW, len(spans)) - 1][1]


class Scanner:
    """Templates with their dictionaries and words."""

    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None) -> None:
        short = short_notices() if templates is None else {}
        known = TEMPLATES if templates is None else templates
        self.rows = [(name, k, t, words(t)) for name in sorted({*known, *short}) for k, t in enumerate(dict.fromkeys((*known.get(name, ()), *short.get(name, ()))))]
        # a notice made of a name alone must have all of its words
        made = {t for texts in short.values() for t in texts}
        self.least = [1.0 if t in made else CONFIRM for _, _, t, _ in self.rows]
        if missing := [t for _, _, t, _ in self.rows if not _CUE.search(t)]:
            raise ValueError(f"no cue word in {missing[0]!r}")
        self.counts = [Counter(w) for _, _, _, w in self.rows]
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.with_template = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.lower().encode() + b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for _, _, t, _ in self.rows]

    def blocks(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, block): lines, and paragraphs of more lines as one, cut into windows if long."""
        at = 0
        for line in text.split("\n"):
            if _CUE.search(line):
                for a, b in windows(text, at, at + len(line)):
                    if _CUE.search(text, a, b):
                        yield a, text[a:b]
            at += len(line) + 1
        for m in _PARAGRAPH.finditer(text):  # notices wrapped over lines
            if _CUE.search(text, *m.span()):
                for a, b in windows(text, *m.span()):
                    # the windows of a line have what lies in that line alone
                    if "\n" in (block := text[a:b]) and _CUE.search(block):
                        yield a, " ".join(block.split())

    def possible(self, block: str) -> list[int]:
        """Templates that ``confirm`` may accept: words that the block lacks altogether are few."""
        have = set(words(block))
        lost = [sum(n for w, n in c.items() if w not in have) for c in self.counts]
        return [k for k, n in enumerate(lost) if (len(self.rows[k][3]) - n) / max(1, len(self.rows[k][3])) >= self.least[k]]

    def rank(self, block: str, among: list[int] | None = None) -> list[tuple[float, int]]:
        """(share of bytes saved, template), best first, of all templates or some."""
        if among == []:
            return []
        raw = block.lower().encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        saved = [(1 - len(self.with_template[k].compress(raw)) / alone, k) for k in (range(len(self.rows)) if among is None else among)]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def align(self, have: list[str], k: int) -> tuple[float, list[str], list[int]]:
        """Share of the template's words found in order, its words that are missing or changed, and the places of those found."""
        want = self.rows[k][3]
        match = SequenceMatcher(None, want, have, autojunk=False)
        missing, at = [], []
        for tag, a, b, c, d in match.get_opcodes():
            if tag == "equal":
                at += range(c, d)
            elif tag in ("delete", "replace"):
                missing += [f"{' '.join(want[a:b])}>{' '.join(have[c:d])[:80]}"]
        if at and at[-1] + 1 - at[0] > 1.3 * len(want) + 3:
            return 0.0, missing, at  # words that are strewn over the block
        return len(at) / max(1, len(want)), missing, at

    def confirm(self, block: str, k: int) -> tuple[float, list[str]]:
        """Share of the template's words found in order, and its words that are missing or changed."""
        return self.align(words(block), k)[:2]

    def stated(self, block: str) -> list[tuple[str, float, float, list[str]]]:
        """(licence, share saved, share of words, differences) of the confirmed licences of a block, best first.

        Where wordings overlap, the better one stays; another one also stays if
        the words in between only join the two, as in "MIT OR Apache-2.0".
        """
        have, good = words(block), []
        for saved, k in self.rank(block, self.possible(block)):
            share, missing, at = self.align(have, k)
            # a version number or a clause that names the licence may not differ
            if share >= self.least[k] and not any(re.search(r"\d|^(?:sa|nc|by|mit|bsd|lesser|affero|apache|isc)\b", d.split(">")[0]) for d in missing):
                good.append(((-share, len(missing), at[-1] + 1 - at[0] - len(at), -saved, self.rows[k][0]), k, saved, share, missing, at))
        out, taken = {}, set()
        for _, k, saved, share, missing, at in sorted(good):
            name, between = self.rows[k][0], set(range(at[0], at[-1])) - set(at)
            joined = {have[i] for i in between if i not in taken} - set(self.rows[k][3])
            apart = taken.isdisjoint(range(at[0], at[-1] + 1))
            dual = not taken.issuperset(at) and joined <= JOINING and any(have[i] in JOINING for i in between)
            if apart or dual:
                out.setdefault(name, (name, saved, share, missing))
                taken.update(at)
        return list(out.values())

    def scan(self, text: str | None) -> list[tuple[int, str, float, float, list[str]]]:
        """(start, licence, share saved, share of words, differences) for each confirmed licence of a text, once each."""
        found: dict[str, tuple[int, str, float, float, list[str]]] = {}
        if not text or not _CUE.search(text):
            return []
        for start, block in self.blocks(text):
            for name, saved, share, missing in self.stated(block):
                if name not in found or share > found[name][3]:
                    found[name] = (start, name, saved, share, missing)
        return sorted(found.values())


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, license, start, saved, share, differences): a row for each licence that a document states."""
    names = ["doc_id", "license", "start", "saved", "share", "differences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in scanner.scan(t)]
            if rows:
                ids, start, name, saved, share, missing = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(name, pa.string()), pa.array(start, pa.int64()), pa.array(saved, pa.float64()), pa.array(share, pa.float64()), pa.array(missing, pa.list_(pa.string()))], names)

    # the cues are tested once in the JVM, so that texts without one never reach Python
    low = F.lower(F.col(text))
    has = [F.contains(low, F.lit(c.split()[-1])) & (low.rlike(p) if " " in c else F.lit(True)) for c, p in _CUE_PATTERNS.items()]
    cued = docs.where(F.greatest(*has))
    return cued.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(batchwise, run, "doc_id long, license string, start long, saved double, share double, differences array<string>").withColumnRenamed("doc_id", doc_id)
