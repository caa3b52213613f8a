"""Operator 3: license scans by template markup compiled to token automata."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean_batches
from .kernels import pieces, words

#: Places of these phrases are counted, and their labels are always given.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Fixed wording of public licenses and notices. ``<<optional>>...<<end>>`` may be absent;
#: ``<<any N>>`` stands for up to N words. A label may have several templates.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2", "licensed under the apache license version 2 0 <<optional>> the license <<end>>"),
    ("mit", "<<optional>> released <<end>> <<optional>> licensed <<end>> <<optional>> distributed <<end>> under the <<optional>> terms of the <<end>> mit license"),
    ("gpl-3", "licensed under the gnu general public license <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version 3"),
    ("cc-by-nc", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by nc <<optional>> sa <<end>> <<any 2>>"),
    ("cc-by-nc", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> creative commons attribution noncommercial <<any 4>> license"),
    ("cc-by", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> creative commons attribution <<optional>> 4 0 <<end>> <<optional>> international <<end>> license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to"
        " the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall"
        " be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express"
        " or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no"
        " event shall <<any 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising"
        " from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the"
        " above copyright notice and this permission notice appear in all copies the software is provided as is and <<any 12>> disclaims all"
        " warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions"
        " are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer <<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of"
        " conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "bsd-3",
        "neither the name of <<any 12>> nor the names of its contributors may be used to endorse or promote products derived from this software"
        " without specific prior written permission",
    ),
    (
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not"
        " limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 8>> be"
        " liable for any direct indirect incidental special exemplary or consequential damages",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain"
        " a copy of the license at <<any 8>> unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific"
        " language governing permissions and limitations under the license",
    ),
    *[
        (
            label,
            f"is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software"
            f" foundation either version {version} of the license or <<optional>> at your option <<end>> any later version",
        )
        for label, name, version in (
            ("gpl-2", "general public license", "2"),
            ("gpl-3", "general public license", "3"),
            ("lgpl-2.1", "lesser general public license", "2 1"),
            ("lgpl-3", "lesser general public license", "3"),
            ("agpl-3", "affero general public license", "3"),
        )
    ],
    (
        "gpl",
        "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness"
        " for a particular purpose see the gnu <<optional>> lesser <<end>> <<optional>> affero <<end>> general public license for more details",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this"
        " file you can obtain one at <<any 1>> mozilla org mpl 2 0",
    ),
    (
        "epl-2",
        "this program and the accompanying materials are made available under the terms of the eclipse public license <<optional>> version <<end>>"
        " <<optional>> v <<end>> 2 0 which <<optional>> accompanies this distribution and <<end>> is available at",
    ),
    (
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"
        " covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative"
        " works of the software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will <<any 8>> be held liable for any damages arising"
        " from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and"
        " to alter it and redistribute it freely",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or"
        " distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    ("cc0", "to the extent possible under law <<any 4>> waived all copyright and related or neighboring rights"),
    *[(label, f"spdx license identifier {name}") for label, name in (("mit", "mit"), ("apache-2", "apache 2 0"), ("isc", "isc"), ("mpl-2", "mpl 2 0"), ("bsd-3", "bsd 3 clause"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"))],
]
_MARK = re.compile(r"<<(optional|end|any (\d+))>>|(\S+)")


class TokenAutomaton:
    """A template as a nondeterministic automaton over words.

    State i stands before the template's i-th step. A literal step moves on at
    its word alone; an optional region has a free move from its start past its
    end; a replaceable region of N words is N steps at any word, each of which
    may be passed over.
    """

    def __init__(self, template: str):
        self.literal: list[bytes | None] = []  # None: any word
        self.free: dict[int, list[int]] = {}
        open_regions: list[int] = []
        mandatory: list[int] = []
        for kind, number, word in _MARK.findall(template):
            at = len(self.literal)
            if kind == "optional":
                open_regions.append(at)
            elif kind == "end":
                self.free.setdefault(open_regions.pop(), []).append(at)
            elif number:
                for k in range(int(number)):
                    self.free.setdefault(at + k, []).append(at + k + 1)
                    self.literal.append(None)
            else:
                self.literal.append(word.encode())
                if not open_regions:
                    mandatory.append(at)
        if open_regions:
            raise ValueError("an optional region has no end")
        #: The longest run of mandatory words: a text without it can't match.
        runs: list[list[int]] = []
        for at in mandatory:
            if runs and runs[-1][-1] == at - 1 and at not in self.free:
                runs[-1].append(at)
            else:
                runs.append([at])
        best = max(runs, key=len, default=[])
        self.anchor = b" " + b" ".join(self.literal[i] for i in best) + b" "
        self.before = best[0] if best else 0
        self.start = self._closed({0})

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.free.get(todo.pop(), ()):
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def match(self, text: list[bytes], at: int) -> int | None:
        """The end of the longest match that begins at word ``at``; None if there is none."""
        states, end = set(self.start), None
        goal = len(self.literal)
        for i in range(at, len(text) + 1):
            if goal in states:
                end = i
            if i == len(text):
                break
            word = text[i]
            states = self._closed({s + 1 for s in states if s < goal and self.literal[s] in (None, word)})
            if not states:
                break
        return end

    def places(self, text: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """Word intervals of the matches, from left to right without overlap; joined: the words, a space around each."""
        out: list[tuple[int, int]] = []
        at = joined.find(self.anchor)
        while at >= 0:
            word = joined.count(b" ", 0, at)
            for begin in range(max(out[-1][1] if out else 0, word - self.before), word + 1):
                end = self.match(text, begin)
                if end is not None and end > word:
                    out.append((begin, end))
                    break
            at = joined.find(self.anchor, at + 1)
        return out


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase's words stand, overlapping ones too."""
    needle, out, at, word, last = b" " + phrase + b" ", [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += joined.count(b" ", last, at)
        last = at
        out.append(word)
        at = joined.find(needle, at + 1)
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of every row of docs.

    ``matches`` lists label, start and end (in words) of the template matches.
    A template accepts where its mandatory words follow each other exactly.
    score is 1 where a match covers 20 words or more, 0.9 for a shorter one,
    0.5 for a phrase alone, 0 for nothing. Null and empty texts have no words;
    repeated rows are scanned row by row; texts may be of any length; other
    columns of docs aren't read.
    """
    lean_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " matches array<struct<label:string,start:long,end:long>>"
    )

    def scan(batches):
        automata = [(label, TokenAutomaton(t)) for label, t in templates]
        wanted = [(p.encode(), label) for p, label in phrases.items()]
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches, 1):
            rows: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
            for text in batch.column(1):
                seq = words((text.as_py() or "").encode())
                joined = b" " + b" ".join(seq) + b" "
                places, base = [], set()
                for phrase, label in wanted:
                    if found := phrase_places(joined, phrase):
                        places += found
                        base.add(label)
                found = [{"label": label, "start": a, "end": b} for label, x in automata if x.anchor in joined for a, b in x.places(seq, joined)]
                longest = max((m["end"] - m["start"] for m in found), default=0)
                rows["n_words"].append(len(seq))
                rows["n_base"].append(len(places))
                rows["first_word"].append(min(places, default=None))
                rows["last_word"].append(max(places, default=None))
                rows["base_labels"].append(",".join(sorted(base)))
                rows["labels"].append(",".join(sorted(base | {m["label"] for m in found})))
                rows["score"].append(1.0 if longest >= 20 else 0.9 if longest else 0.5 if base else 0.0)
                rows["matches"].append(sorted(found, key=lambda m: (m["start"], m["label"], m["end"])))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), types, strict=True))], names=["doc_id", *rows])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def license_digest(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).drop("matches")
