"""Operator 6: licence notices by template markup.

A template is its mandatory wording with two kinds of markup: ``[[ .. ]]`` may be missing, ``<<n>>`` stands for up
to n words of any kind (names, years, addresses). It is compiled into an automaton over words; a text holds the
licence where all mandatory words follow each other exactly, optional regions apart. Fixed phrases, such as "cc by
nc", are templates without markup; each place counts.

Whole licence texts are templates as well; ``whole`` names those that are there from their first mandatory word to their
last. The score is the best template's share of mandatory words that are matched from some place on before the automaton
dies: 1 where a template is accepted, 0 where no text of a licence begins.

Defined results: null, empty and wordless texts have 0 counts, null places, empty labels and score 0. Repeated rows
each get their row. Other columns are ignored. Words are of letters, digits and all beyond ASCII, A-Z lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import texts_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The contract's fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Wordings of public licences and their usual notices, with markup.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<4>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"),
    ("mit", "[[this <<3>> is]] released under the [[terms of the]] mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "[[3]] neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "licensed under the apache license version 2 0 [[the license]]"),
    ("gpl-3", "[[this <<3>> is]] licensed under the gnu general public license version 3 [[or later]]"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or [[at your option]] any later version"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or [[at your option]] any later version"),
    ("gpl-2", "[[this <<3>> is]] licensed under the gnu general public license version 2 [[or later]]"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0-1", "to the extent possible under law <<12>> has waived all copyright and related or neighboring rights to"),
    ("cc-by-nc", "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[4 0]] [[license]]"),
    ("cc-by-nc", "creative commons attribution noncommercial <<2>> license"),
    ("cc-by-sa", "licensed under [[a]] [[the]] cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike <<2>> license"),
    ("cc-by", "creative commons attribution <<2>> license"),
]

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors [[or copyright holders]] be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "this software is provided by <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version {1} of the license or [[at your option]] any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0}general public license for more details you should have received a copy of the gnu {0}general public license along with this program [[if not write to the free software foundation inc <<12>>]] [[if not see <<6>>]]"
_NOTICE = {label: words for label, words in TEMPLATES[:5] if label in ("isc", "bsd-2-clause", "bsd-3-clause") or words.startswith("permission")}

#: Whole licence texts, and whole notices of those that are too long to stand in a file's head.
WHOLE = [
    ("mit", f"{_NOTICE['mit']} {_AS_IS}"),
    ("isc", f"{_NOTICE['isc']} the software is provided as is and <<8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", f"{_NOTICE['bsd-2-clause']} {_BSD}"),
    ("bsd-3-clause", f"{_NOTICE['bsd-2-clause']} {_NOTICE['bsd-3-clause']} {_BSD}"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
    ("unlicense", f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_AS_IS} [[for more information please refer to <<4>>]]"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-2", _GPL.format("", "2")),
    ("gpl-3", _GPL.format("", "3")),
    ("agpl-3", _GPL.format("affero ", "3")),
    ("lgpl", _GPL.format("lesser ", "<<3>>")),
]


@dataclass
class Automaton:
    """States are places between words. Each has the words that lead on, places reached without a word, and how
    many words of any kind may still pass."""

    label: str
    steps: list[dict[bytes, int]]
    jumps: list[list[int]]
    spare: list[tuple[int, int]]  # (words that may pass, place after)
    done: list[int]  # mandatory words before each place
    total: int
    whole: bool = False  # of a whole licence text

    @classmethod
    def of(cls, label: str, markup: str, whole: bool = False) -> Automaton:
        out = cls(label, [{}], [[]], [(0, 0)], [0], 0, whole)
        open_: list[int] = []
        for part in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup):
            at = len(out.steps) - 1
            if part == "[[":
                open_.append(at)
            elif part == "]]":
                out.jumps[open_.pop()].append(at)
            else:
                out.steps.append({})
                out.jumps.append([])
                out.spare.append((0, 0))
                out.done.append(out.done[-1])
                if part.startswith("<<"):
                    out.spare[at] = int(part[2:-2]), at + 1
                    out.jumps[at].append(at + 1)
                else:
                    out.steps[at][part.encode()] = at + 1
                    if not open_:
                        out.done[-1] += 1
        if open_:
            raise ValueError(f"an optional region of {label} isn't closed")
        out.total = out.done[-1]
        return out

    def spread(self, states: dict[int, int]) -> dict[int, int]:
        """With all places that need no word; a state is (place: spare words used)."""
        todo = list(states)
        while todo:
            for to in self.jumps[todo.pop()]:
                if states.get(to, 1) > 0:
                    states[to] = 0
                    todo.append(to)
        return states

    def starts(self) -> set[bytes]:
        return {w for s in self.spread({0: 0}) for w in self.steps[s]}

    def run(self, words: list[bytes], at: int) -> tuple[int | None, int]:
        """The end of the longest match that starts at word ``at``, and how many mandatory words were matched."""
        states, most, end, last = self.spread({0: 0}), 0, None, len(self.steps) - 1
        while states and at < len(words):
            new: dict[int, int] = {}
            for s, used in states.items():
                to = self.steps[s].get(words[at])
                if to is not None:
                    new[to] = 0
                spare, after = self.spare[s]
                if used < spare:
                    new[s] = min(new.get(s, used + 1), used + 1)
                    new.setdefault(after, 0)
            at += 1
            states = self.spread(new)
            most = max([most, *(self.done[s] for s in new if self.steps[s] or s == last)])
            if last in states:
                end = at
        return end, most


class Scanner:
    """All templates and phrases over one text."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, whole=WHOLE):
        self.phrases = [(label, [w.encode() for w in words.split()]) for words, label in phrases.items()]
        self.automata = [*(Automaton.of(*t) for t in templates), *(Automaton.of(*t, whole=True) for t in whole)]
        self.at: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for word in a.starts():
                self.at.setdefault(word, []).append(a)
        self.first: dict[bytes, list[tuple[str, list[bytes]]]] = {}
        for p in self.phrases:
            self.first.setdefault(p[1][0], []).append(p)
        self.starts = self.first.keys() | self.at.keys()

    def scan(self, low: bytes) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, bool]], float, int]:
        """(label, start) of each phrase, (label, start, end, whole) of each accepted template, the score, and how many words
        there are."""
        words = WORD.findall(low)
        base, found, score, starts = [], [], 0.0, self.starts
        for k in [k for k, w in enumerate(words) if w in starts]:
            for label, phrase in self.first.get(words[k], ()):
                if words[k : k + len(phrase)] == phrase:
                    base.append((label, k))
                    score = 1.0
            for a in self.at.get(words[k], ()):
                end, most = a.run(words, k)
                score = max(score, most / a.total)
                if end is not None:
                    found.append((a.label, k, end, a.whole))
        return base, found, score, len(words)


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, whole string, places array<struct<label:string,first:long,end:long,whole:boolean>>"


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, whole=WHOLE) -> DataFrame:
    """A row a text: fixed phrases (n_base, first_word, last_word, base_labels), all labels, the score, the labels whose
    whole text is there, and the places, in words, of accepted templates."""
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, whole)
        for batch in batches:
            rows = [scanner.scan(t.encode().lower()) for t in texts_of(batch)]
            join = lambda labels: ",".join(sorted(set(labels)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for *_, n in rows], pa.int64()),
                    pa.array([len(b) for b, *_ in rows], pa.int64()),
                    pa.array([min((k for _, k in b), default=None) for b, *_ in rows], pa.int64()),
                    pa.array([max((k for _, k in b), default=None) for b, *_ in rows], pa.int64()),
                    pa.array([join(x for x, _ in b) for b, *_ in rows], pa.string()),
                    pa.array([join([x for x, _ in b] + [x for x, *_ in f]) for b, f, *_ in rows], pa.string()),
                    pa.array([s for *_, s, _ in rows], pa.float64()),
                    pa.array([join(x for x, _, _, w in f if w) for _, f, *_ in rows], pa.string()),
                    pa.array([[{"label": x, "first": k, "end": e, "whole": w} for x, k, e, w in f] for _, f, *_ in rows], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("whole", pa.bool_())]))),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "whole", "places"],
            )

    return frame.mapInArrow(run, RESULT)
