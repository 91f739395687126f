"""License scan by template markup: notices as token automata.

A template is wording with two kinds of markup: ``<<beginOptional>>...<<endOptional>>``
may be left out, and ``<<var;max=n>>`` stands for up to n words of any kind.  Each template is
compiled into an automaton over words, run wherever its first two words stand; it accepts
where all mandatory wording matches exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import map_arrow

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}



def optional(words: str) -> str:
    return f"<<beginOptional>>{words}<<endOptional>>"


#: What may follow the name of a Creative Commons licence.
CC_END = " ".join([*(optional(v) for v in ("4 0", "3 0", "2 5", "2 0", "1 0")), *map(optional, ("international", "unported", "generic", "public"))])
CC_NAMES = {
    "cc-by": ("", "by"),
    "cc-by-sa": ("share alike", "by sa"),
    "cc-by-nd": ("no derivatives", "by nd"),
    "cc-by-nc": ("non commercial", "by nc"),
    "cc-by-nc-sa": ("non commercial share alike", "by nc sa"),
    "cc-by-nc-nd": ("non commercial no derivatives", "by nc nd"),
}


def creative_commons() -> list[tuple[str, str]]:
    """The six licences by their names, words written together or apart, and by their short forms with a version or a verb."""
    found = []
    for label, (name, short) in CC_NAMES.items():
        together = name.replace("share alike", "sharealike").replace("non commercial", "noncommercial").replace("no derivatives", "noderivatives")
        for words in sorted({name, together}):
            found.append((label, f"creative commons attribution {words} {CC_END} license"))
        found.append((label, f"cc {short} {CC_END} license"))
        found += [(label, f"cc {short} {version}") for version in ("4 0", "3 0")]
        # A short form that others begin with says too little without a version.
        if not any(other.startswith(f"{short} ") for _, other in CC_NAMES.values()):
            found.append((label, f"licensed under {optional('a')} {optional('the')} cc {short}"))
    return found


DISCLAIMER = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall <<var;max=12>> be liable for any claim damages or other liability whether in an "
    "action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<var;max=1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<var;max=1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution "
)
BSD_NAME = (
    "<<var;max=1>> neither the name of <<var;max=12>> nor the names of <<var;max=3>> contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission "
)
BSD_END = (
    "this software is provided by <<var;max=12>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;max=12>> be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any "
    "way out of the use of this software even if advised of the possibility of such damage"
)


def gnu(label: str, name: str, version: str) -> list[tuple[str, str]]:
    """A GNU licence by its name and version, and by the notice in a file's head."""
    published = optional("as published by the free software foundation")
    return [
        (label, f"gnu {name} {published} {optional('either')} version {version}"),
        (
            label,
            f"free software you can redistribute it and or modify it under the terms of the gnu {name} {published} {optional('either')} version {version} "
            f"of the license {optional('or at your option any later version')} <<var;max=5>> is distributed in the hope that it will be useful but without any "
            f"warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details",
        ),
    ]


#: Label and template of each notice that the method knows: licences in full, notices in file heads, names.
TEMPLATES = [
    ("mit", f"the mit license {optional('mit')}"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        f"{optional('the software')} to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        f"distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so {optional('subject to the following conditions')} "
        f"the above copyright notice and this permission notice {optional('including the next paragraph')} shall be included in all copies or substantial portions of the software {DISCLAIMER}",
    ),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("apache-2", "apache 2 0 license"),
    ("apache-2", "spdx license identifier apache 2 0"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the "
        "license at <<var;max=10>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    *creative_commons(),
    *gnu("gpl-2", "general public license", "2"),
    *gnu("gpl-3", "general public license", "3"),
    ("gpl-3", "gnu gpl <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 3"),
    *gnu("lgpl-3", "lesser general public license", "3"),
    *gnu("agpl-3", "affero general public license", "3"),
    ("mpl-2", "mozilla public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 2 0"),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain "
        "one at <<var;max=6>>",
    ),
    ("bsd-2", BSD_START + BSD_END),
    ("bsd-3", BSD_START + BSD_NAME + BSD_END),
    ("bsd-3", "bsd 3 clause <<beginOptional>><<var;max=3>><<endOptional>> license"),
    (
        "isc",
        f"permission to use copy modify and {optional('or')} distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and <<var;max=12>> disclaims all warranties with regard to "
        "this software including all implied warranties of merchantability and fitness in no event shall <<var;max=12>> be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
        "action arising out of or in connection with the use or performance of this software",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
MARK = re.compile(r"<<(.*?)>>|([^<]+)")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """States with word arrows, arrows for any word and empty arrows; the last state accepts."""

    label: str
    arrows: list[dict[bytes, int]] = field(default_factory=list)
    any: list[int | None] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    head: list[bytes] = field(default_factory=list)
    mandatory: int = 0

    def state(self) -> int:
        self.arrows.append({})
        self.any.append(None)
        self.empty.append([])
        return len(self.arrows) - 1

    def reach(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def end_of_match(self, words: list[bytes], at: int) -> int | None:
        """End of the longest match that starts at word ``at``."""
        states, best, accept = self.reach({0}), None, len(self.arrows) - 1
        for i in range(at, len(words) + 1):
            if accept in states:
                best = i
            if not states or i == len(words):
                break
            w = words[i]
            states = self.reach({t for s in states for t in (self.arrows[s].get(w), self.any[s]) if t is not None})
        return best


def compile_template(label: str, template: str) -> Automaton:
    a = Automaton(label)
    at, opened, straight = a.state(), [], True
    for mark, plain in MARK.findall(template):
        if mark == "beginOptional":
            opened.append(at)
            straight = False
        elif mark == "endOptional":
            a.empty[opened.pop()].append(at)
            new = a.state()
            a.empty[at].append(new)
            at = new
        elif mark.startswith("var"):
            straight = False
            start, ends = at, []
            for _ in range(int(mark.partition("max=")[2])):
                new = a.state()
                a.any[at] = new
                ends.append(new)
                at = new
            a.empty[start].append(at)
            for s in ends[:-1]:
                a.empty[s].append(at)
            new = a.state()
            a.empty[at].append(new)
            at = new
        elif plain:
            for w in words_of(plain):
                new = a.state()
                a.arrows[at][w] = new
                at = new
                a.mandatory += not opened
                if straight and len(a.head) < 2:
                    a.head.append(w)
    if len(a.head) < 2:
        raise ValueError(f"a template begins with two mandatory words: {template!r}")
    new = a.state()
    a.empty[at].append(new)
    return a


def scan_words(words: list[bytes], automata: dict[bytes, list[Automaton]], heads: re.Pattern) -> list[tuple[int, int, str, int]]:
    """(start, end, label, mandatory words) of every accepted place."""
    flat, found, seen, upto = b" " + b" ".join(words) + b" ", [], 0, 0
    for m in heads.finditer(flat):
        seen += flat.count(b" ", upto, m.start())
        upto = m.start()
        for a in automata[m[1]]:
            end = a.end_of_match(words, seen)
            if end is not None:
                found.append((seen, end, a.label, a.mandatory))
    return found


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Words are runs of ASCII letters (A-Z lower-cased), digits and all characters from
    U+0080 on.  n_base counts every place of a base phrase; first_word and last_word are null
    without one.  score is 0 without a label, else 1 - 2 ** (-m / 2) for the most mandatory
    words m of an accepted place.  matches: array of (start, end, label), in words; where
    several ends of a place fit, the last one counts.  Null and empty texts have no words, an
    empty table gives no rows, texts of any length are read whole; repeated rows each get their
    row; other columns aren't used.
    """
    schema = (
        f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, matches array<struct<start:long,end:long,label:string>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_head: dict[bytes, list[Automaton]] = {}
        own = [compile_template(label, phrase) for phrase, label in base.items()]
        for a in [*own, *(compile_template(x, t) for x, t in templates)]:
            by_head.setdefault(b" ".join(a.head), []).append(a)
        heads = re.compile(b" (?=(" + b"|".join(map(re.escape, by_head)) + b") )")
        mine = {id(a) for a in own}
        only = {h: [a for a in found if id(a) in mine] for h, found in by_head.items()}
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]
        for batch in batches:
            rows = []
            for value in batch.column(1):
                words = words_of(value.as_py())
                every = scan_words(words, by_head, heads)
                firm = scan_words(words, only, heads) if every else []
                labels = lambda xs: ",".join(sorted({x[2] for x in xs}))
                score = 1 - 2.0 ** (-max((x[3] for x in every), default=0) / 2)
                rows.append((len(words), len(firm), min((x[0] for x in firm), default=None), max((x[0] for x in firm), default=None), labels(firm), labels(every), score, [{"start": s, "end": e, "label": x} for s, e, x, _ in every]))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)
