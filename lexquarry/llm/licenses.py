"""License scans by conditional compression.

Blocks of a text (its lines, and runs of lines for longer wordings) that hold a word of licensing
are compressed by zstandard twice: alone, and with each template as raw dictionary. How far the
template shrinks a block ranks the templates; all that shrink it enough are confirmed by their exact wording: the
differences between words of block and template, with places for names, years and versions left free.
"""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import bounded

# Short public wordings of licences; <...> stands for anything of a few words.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "EPL-2.0": ["Licensed under the Eclipse Public License, Version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["Licensed under the zlib License.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Proprietary": ["All rights reserved.", "Copyright (c) <years> <holder>. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission."],
}
# Whole texts of short licences, added to their wordings.
AS_IS = "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD_CLAUSES = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE'
MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEMPLATES["MIT"].append(f"{TEMPLATES['MIT'][-1]} {MIT_REST}")
TEMPLATES["ISC"].append(f"{TEMPLATES['ISC'][-1]} {ISC_REST}")
TEMPLATES["BSD-2-Clause"].append(f"{TEMPLATES['BSD'][0]} {BSD_CLAUSES} {BSD_WARRANTY} {AS_IS}")
TEMPLATES["BSD-3-Clause"].append(f"{TEMPLATES['BSD'][0]} {BSD_CLAUSES} {TEMPLATES['BSD-3-Clause'][1]} {BSD_WARRANTY} {AS_IS}")
# A block without any of these words is no candidate.
CANDIDATE = r"(?i)licen[cs]e|copyright|all rights reserved|public domain|redistribut|permission is hereby|creative commons|free software|\bcc0\b|\bcc by"
WORD = re.compile(r"<[a-z]+>|[0-9]+(?:\.[0-9]+)*|[^\W\d_]+(?:-[^\W\d_]+)*")
LEAST, AGREE = 0.35, 0.9
BARE = 3  # words of a wording that stands no others between them
WIDEST = 4096  # characters within which a license told of again is the same one
#: Characters of the longest wording of a scale: longer blocks are looked at in windows around each candidate word.
SCALES = (100, 250, 500, 1800)
WHOLE = SCALES[-1]  # of texts that span paragraphs: windows of the whole text
FAMILIES = {"BSD": ("BSD-2-Clause", "BSD-3-Clause")}  # wordings that several licenses share, and these
LONG = 40  # words from which on a wording has room for few words more
SHORT = 3 * SCALES[0]


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@lru_cache(1)
def _compressors():
    import zstandard

    alone = zstandard.ZstdCompressor(level=3)
    out = []
    for name, wordings in TEMPLATES.items():
        for wording in wordings:
            raw = zstandard.ZstdCompressionDict(" ".join(words(wording)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            scale = next(x for x in SCALES if len(wording) <= x)
            out.append((name, scale, words(wording), zstandard.ZstdCompressor(level=3, dict_data=raw)))
    return alone, out


def differences(block: list[str], template: list[str]) -> tuple[float, list[str]]:
    """The share of the template's words that stand in the block in order, and what differs: -missing, +added between them."""
    hits = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    same = free = 0
    diff: list[str] = []
    for k, (tag, a, b, c, d) in enumerate(hits):
        if tag == "equal":
            same += b - a
        else:
            places = sum(w.startswith("<") for w in template[a:b])
            free += places
            diff += [f"-{w}" for w in template[a:b] if not w.startswith("<")]
            if 0 < k < len(hits) - 1:  # what stands around the wording is no part of it
                diff += [f"+{w}" for w in (block[c:d] if not places else [])]
    return (same + free) / max(1, len(template)), diff


NUMBERS = re.compile(r"[+-][0-9.]+$")
KINDS = re.compile(r"[+-](?:nc|sa|nd|by|lesser|affero|general|noncommercial|sharealike|attribution-noncommercial|attribution-sharealike|by-nc|by-sa|mit|apache|bsd|mozilla|gnu|clause)$")


def scan_block(block: str, scale: int | None = None) -> list[tuple[str, float, float, str]]:
    """License, size reduction, agreement and differences of each license in the block (of wordings of one scale, if given)."""
    found = words(block)
    if not found:
        return []
    alone, templates = _compressors()
    text = " ".join(found).encode()
    size = len(alone.compress(text))
    best: dict[str, tuple] = {}
    for name, own, template, with_it in templates:
        if scale not in (None, own):
            continue
        gain = 1 - len(with_it.compress(text)) / size
        # what a wording can save at most is its own length: long blocks are measured against it
        reach = min(1.0, len(" ".join(template)) / max(1, len(text)))
        if gain < LEAST * reach:
            continue
        agree, diff = differences(found, template)
        if len(template) <= BARE and any(d[0] == "+" for d in diff):  # so few words are a wording only side by side
            continue
        if len(template) >= LONG and sum(d[0] == "+" for d in diff) > (1 - AGREE) * len(template):  # a clause more is another license
            continue
        # another number or another clause is another license
        if agree >= AGREE and not any(NUMBERS.match(d) or KINDS.match(d) for d in diff):
            told = (agree, gain, name, diff)
            if name not in best or told[:2] > best[name][:2]:
                best[name] = told
    return [(name, gain, agree, " ".join(diff)) for agree, gain, name, diff in sorted(best.values(), key=lambda t: (-t[0], -t[1], t[2]))]


def blocks(text: str) -> list[tuple[int, str, int | None]]:
    """Candidate blocks with their places and scales: lines, and paragraphs of several lines; of long ones windows around each candidate word."""
    wanted, out, at = re.compile(CANDIDATE), [], 0
    for paragraph in re.split(r"(\n[ \t]*\n)", text):
        lines = paragraph.split("\n")
        place, near = at, []
        for line in lines:
            if wanted.search(line):
                near.append((place, line))
            place += len(line) + 1
        if near:
            out += near
            if len(lines) > 1:
                out.append((at, paragraph))
        at += len(paragraph)
    cut: dict[tuple, None] = {}
    for place, block in out:
        if len(block) <= SHORT:
            cut[place, block, None] = None
            continue
        for m in wanted.finditer(block):
            for scale in SCALES[:-1]:
                low = max(0, m.start() - scale * 3 // 2)
                cut[place + low, block[low : m.end() + scale * 3 // 2], scale] = None
    last = -WHOLE
    for m in wanted.finditer(text):
        if m.start() - last >= WHOLE // 2:  # what is around a nearer one lies in the window before
            last, low = m.start(), max(0, m.start() - WHOLE * 3 // 2)
            cut[low, text[low : m.end() + WHOLE * 3 // 2], WHOLE] = None
    return list(cut)


SHAPE = "licenses array<struct<at: long, license: string, reduction: double, agreement: double, differences: string>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the licenses found in every text, by place; an empty array where there are none.

    Null and empty texts hold none. A license that several blocks at one place tell of (a line and its
    paragraph) is given once, by its best agreement; of equal ones the first. A family isn't given beside one of its licenses. Long texts are read whole, in windows around each
    word of licensing. Rows that repeat each give a row; other columns are left out, whatever their names. An empty
    table gives no rows. Texts without a word of licensing aren't sent to Python.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    docs = bounded(docs).select("doc_id", F.when(F.col("text").rlike(CANDIDATE), F.col("text")).alias("text"))

    def run(batches):
        memo: dict[tuple, list] = {}
        for b in batches:
            out = []
            for text in b["text"].to_pylist():
                told: list[dict] = []
                for at, block, scale in blocks(text) if text else []:
                    if (block, scale) not in memo:
                        if len(memo) > 50_000:
                            memo.clear()
                        memo[block, scale] = scan_block(block, scale)
                    for name, gain, agree, diff in memo[block, scale]:
                        row = {"at": at, "license": name, "reduction": gain, "agreement": agree, "differences": diff}
                        same = [t for t in told if t["license"] == name and t["at"] <= at + len(block) and at <= t["at"] + WIDEST]
                        if not same:
                            told.append(row)
                        elif agree > max(t["agreement"] for t in same):
                            told = [t for t in told if t not in same] + [row]
                near = lambda t, names: any(o["license"] in names and abs(o["at"] - t["at"]) <= WIDEST for o in told)  # noqa: E731, B023
                told = [t for t in told if not near(t, FAMILIES.get(t["license"], ()))]
                out.append(sorted(told, key=lambda t: (t["at"], t["license"])))
            kind = pa.list_(pa.struct([("at", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("agreement", pa.float64()), ("differences", pa.string())]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, kind)], names=["doc_id", "licenses"])

    return docs.mapInArrow(run, f"doc_id {doc_type}, {SHAPE}")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (names by comma, in order of place), differences (by bar); rows as in scan()."""
    names = F.array_join(F.transform("licenses", lambda x: x["license"]), ",")
    return scan(docs).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), names.alias("licenses"), F.array_join(F.transform("licenses", lambda x: x["differences"]), "|").alias("differences"))
