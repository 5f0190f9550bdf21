"""License scans by template-markup matching.

Method. A template is wording with marked regions: ``[[...]]`` may be missing, ``<<n>>`` stands for up
to n words of any kind. Each template is compiled into an automaton over word tokens; a text matches
at a place if the automaton, started there, accepts: mandatory wording must be met word by word.
Plain phrases are templates without regions. All places are found, in whole texts. Short notices name a
license; whole license texts are templates of their own, so a text with altered conditions is refused.

Defined results: null text and text without words match nothing and score 0; places that overlap
all count; repeated rows are scanned each time; very long texts are scanned whole, in steps bounded by the
template's length from each first word; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleethealth.llm.common import batched, rows_of

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that name a license, with labels of their own.
NOTICES = {
    "released under the [[terms of the]] mit license": "mit",
    "licensed under the [[terms of the]] mit license": "mit",
    "licensed under the apache license [[version 2 0]]": "apache-2.0",
    "licensed under cc by nc [[nd]] [[sa]] <<1>> 0": "cc-by-nc",
    "licensed under [[a]] [[the]] creative commons attribution [[noncommercial]] [[sharealike]] <<2>> [[international]] license": "cc",
    "this work is licensed under [[the]] [[terms of the]] [[gnu]] general public license [[version <<1>>]]": "gpl-notice",
    "under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation": "gpl-notice",
    "spdx license identifier <<1>> [[0]] [[only]] [[or later]] [[clause]]": "spdx",
    "copyright [[c]] <<8>> all rights reserved": "copyright-notice",
}
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose [[title]] and noninfringement in no event shall <<8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "[[3]] neither the name of <<12>> nor the names of [[its]] contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this software is provided by <<10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of [[the]] use of this software even if advised of the possibility of such damage",
)
#: Whole license texts and headers. A text gets the label only if all mandatory wording is there, in order, word by word.
LICENSES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _WARRANTY: "mit-text",
    f"{_BSD[0]} {_BSD[2]}": "bsd-2-clause-text",
    f"{_BSD[0]} {_BSD[1]} {_BSD[2]}": "bsd-3-clause-text",
    "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-text",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution": "zlib-text",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _WARRANTY: "unlicense-text",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] [[www]] apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2.0-header",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] [[www]] mozilla org mpl 2 0": "mpl-2.0-header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation either version <<2>> of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [[lesser]] [[affero]] general public license for more details": "gpl-header",
}
#: Templates with optional and replaceable regions: notices, and whole texts.
TEMPLATES = NOTICES | LICENSES
#: Bytes that are no part of a word become spaces; A to Z become a to z.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Automaton:
    """States in order; state k reads token ``reads[k]`` (None: any word) and goes to k + 1."""

    label: str
    reads: list[bytes | None]
    skips: list[set[int]]  # states that a state may be left for without reading
    first: set[bytes] = field(default_factory=set)

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    def match(self, tokens: list[bytes], at: int) -> int:
        """End of the longest match that starts at a place, or -1."""
        states, final, best = self.closure({0}), len(self.reads), -1
        for k in range(at, len(tokens)):
            states = self.closure({s + 1 for s in states if s < final and (self.reads[s] is None or self.reads[s] == tokens[k])})
            if not states:
                break
            if final in states:
                best = k + 1
        return best


def compile_template(template: str, label: str) -> Automaton:
    reads: list[bytes | None] = []
    jumps: list[tuple[int, int]] = []
    opened: list[int] = []
    for part in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", template):
        if part == "[[":
            opened.append(len(reads))
        elif part == "]]":
            jumps.append((opened.pop(), len(reads)))
        elif part.startswith("<<"):
            most, start = int(part[2:-2]), len(reads)
            reads += [None] * most
            jumps += [(start + k, start + most) for k in range(most)]
        else:
            reads += words(part)
    if opened:
        raise ValueError(f"a region of {template!r} isn't closed")
    out = Automaton(label, reads, [set() for _ in range(len(reads) + 1)])
    for a, b in jumps:
        out.skips[a].add(b)
    starts = out.closure({0})
    if len(reads) in starts or any(reads[s] is None for s in starts):
        raise ValueError(f"{template!r} has to start with a word")
    out.first = {reads[s] for s in starts}
    return out


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.by_first: dict[bytes, list[tuple[bool, Automaton]]] = {}
        for is_base, group in ((True, base), (False, templates)):
            for template, label in group.items():
                automaton = compile_template(template, label)
                for w in automaton.first:
                    self.by_first.setdefault(w, []).append((is_base, automaton))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, bool]]]:
        """Number of words, and (start, end, label, is base) of every match."""
        tokens, first = words(text), self.by_first
        found = []
        for i in [i for i, w in enumerate(tokens) if w in first]:
            for is_base, automaton in first[tokens[i]]:
                if (end := automaton.match(tokens, i)) > 0:
                    found.append((i, end, automaton.label, is_base))
        return len(tokens), found


def _covered(found: list[tuple[int, int, str, bool]]) -> int:
    total, reached = 0, 0
    for a, b, _, _ in sorted(found):
        total += max(0, b - max(a, reached))
        reached = max(reached, b)
    return total


_SCAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
_PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def license_places(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, start, end, label: every match, in words from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        yield from batched(((doc_id, a, b, label) for doc_id, text in rows_of(batches) for a, b, label, _ in scanner.scan(text)[1]), _PLACES, 5000)

    return _texts(docs).mapInArrow(run, "doc_id long, start long, end long, label string")


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row per document: counts, places and labels; the score is the share of words inside matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)

        def each():
            for doc_id, text in rows_of(batches):
                n, found = scanner.scan(text)
                starts = [a for a, _, _, is_base in found if is_base]
                names = lambda kind: ",".join(sorted({label for _, _, label, b in found if b or not kind}))
                yield doc_id, n, len(starts), min(starts, default=None), max(starts, default=None), names(True), names(False), _covered(found) / n if n else 0.0

        yield from batched(each(), _SCAN, 5000)

    return _texts(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
