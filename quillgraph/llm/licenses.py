"""License scans: notices and license texts by templates with optional and replaceable regions, and fixed phrases.

A template's markup: ``[[`` and ``]]`` enclose wording that may be left out, ``{{n}}`` stands for up to n words of any
kind; all other wording is mandatory and has to match word for word. A template is compiled to an automaton over
words, whose transitions are words' hashes; texts are scanned for each template's first mandatory words and the
automaton runs from the places found. Words are runs of letters, digits and everything outside ASCII, A-Z lower-cased.

Defined cases: a null text counts as empty; a text without words has no places and score 0; repeated rows are
scanned each; a null id is kept; other columns are ignored; an empty table gives no rows. Optional and replaceable
regions at a template's start may be missing, so the search starts at the first mandatory wording; a template without
any is refused. Texts are taken whole, whatever their length; a task holds the words of one text, or of about 1 MB of
shorter ones, at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import bytewords as W
from quillgraph.llm.common import pieces, utf8

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: template, from the wording of the licenses and of the notices that they ask for
TEMPLATES = {
    "mit-notice": "licensed under the [[terms of the]] mit license",
    "mit-release": "released under the mit license",
    "mit-text": "[[the mit license]] [[mit]] [[copyright {{12}}]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software",
    "isc-text": "[[isc license]] [[copyright {{12}}]] permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-text": "[[copyright {{12}}]] permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software",
    "bsd-text": "[[copyright {{12}}]] [[all rights reserved]] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3-clause": "[[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-2-notice": "licensed under the apache license version 2 0 [[the license]]",
    "apache-2-header": "[[copyright {{12}}]] licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] [[www]] apache org licenses license 2 0",
    "apache-2-text": "apache license version 2 0 january 2004 [[http www apache org licenses]] terms and conditions for use reproduction and distribution",
    "gpl-notice": "licensed under the [[terms of the]] gnu [[lesser]] general public license [[as published by the free software foundation]] [[either]] [[version {{2}}]]",
    "gpl-header": "[[this file is part of {{4}}]] [[this program]] [[{{4}}]] is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version {{1}} of the license [[or at your option any later version]]",
    "lgpl-header": "[[this library]] [[{{4}}]] is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation [[either]] version {{2}} of the license [[or at your option any later version]]",
    "lgpl-2-header": "[[this library]] [[{{4}}]] is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation [[either]] version {{2}} of the license [[or at your option any later version]]",
    "agpl-text": "gnu affero general public license version {{1}}",
    "mpl-2-header": "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {{6}}]]",
    "epl-header": "this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] {{3}} which [[accompanies this distribution and]] is available at",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-text": "[[to the extent possible under law]] {{8}} has waived all copyright and related or neighboring rights to",
    "cc-notice": "licensed under [[a creative commons]] cc by {{2}} 4 0",
    "cc-by-text": "licensed under a creative commons attribution [[noncommercial]] [[non commercial]] [[sharealike]] [[share alike]] [[noderivatives]] {{3}} international license",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
}
Node = tuple[str, object]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def parse(template: str) -> list[Node]:
    """Nodes ("word", w), ("any", n) or ("maybe", nodes)."""
    stack: list[list[Node]] = [[]]
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\[\]{}]+", template):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            inner = stack.pop()
            stack[-1].append(("maybe", inner))
        elif part.startswith("{{"):
            stack[-1].append(("any", int(part[2:-2])))
        else:
            stack[-1].extend(("word", w) for w in words_of(part))
    if len(stack) != 1:
        raise ValueError("regions don't close: " + template)
    nodes = stack[0]
    while nodes and nodes[0][0] != "word":
        nodes = nodes[1:]
    if not nodes:
        raise ValueError("a template needs mandatory wording: " + template)
    return nodes


def weight_of(template: str) -> float:
    """How much a match says, from 0.5 to 1: more with more mandatory words."""
    return round(1 - 0.5 / sum(kind == "word" for kind, _ in parse(template)), 4)


def hash_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = W.find_words(raw, np.array([0, len(raw)]))
    return W.hash_words(raw, s, e)


class Automaton:
    """States are numbered; step holds (state, word hash) to states, free states go on with any word."""

    def __init__(self, template: str):
        nodes = parse(template)
        self.step: dict[tuple[int, int], set[int]] = {}
        self.free: dict[int, set[int]] = {}
        self.skip: dict[int, set[int]] = {}
        self.n = 1
        self.end = self._build(nodes, 0)
        self.lead = []
        for kind, x in nodes:
            if kind != "word" or len(self.lead) == 4:
                break
            self.lead.append(x)
        self.lead_hash = hash_of(self.lead)

    def _new(self) -> int:
        self.n += 1
        return self.n - 1

    def _build(self, nodes: list[Node], at: int) -> int:
        for kind, x in nodes:
            to = self._new()
            if kind == "word":
                self.step.setdefault((at, int(hash_of([x])[0])), set()).add(to)
            elif kind == "any":
                for _ in range(x):
                    self.skip.setdefault(at, set()).add(to)
                    nxt = self._new()
                    self.free.setdefault(at, set()).add(nxt)
                    at = nxt
                self.skip.setdefault(at, set()).add(to)
            else:
                self.skip.setdefault(at, set()).add(to)
                end = self._build(x, at)
                self.skip.setdefault(end, set()).add(to)
            at = to
        return at

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts(self, h: list[int]) -> bool:
        """Whether some beginning of the words h is accepted."""
        states = self.closure({0})
        for w in h:
            if self.end in states:
                return True
            states = self.closure({t for s in states for t in (*self.step.get((s, w), ()), *self.free.get(s, ()))})
            if not states:
                return False
        return self.end in states


def regex_of(template: str) -> str:
    """The same language as a regular expression over words that a space follows each (for SQL)."""

    def out(nodes: list[Node]) -> str:
        return "".join(f"{x} " if k == "word" else f"([^ ]+ ){{0,{x}}}" if k == "any" else f"({out(x)})?" for k, x in nodes)

    return out(parse(template))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels and labels (arrays, distinct and sorted), score:
    the largest weight of a template that matches, 0.5 with phrases only, 0 without either."""
    source = docs.select(F.col(text_col), F.col(id_col).alias("doc_id"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = [(label, hash_of(words_of(p))) for p, label in phrases.items()]
        machines = [(label, Automaton(t)) for label, t in templates.items()]
        weight = {label: weight_of(t) for label, t in templates.items()}
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in pieces(off):
                starts, ends, woff = W.find_words(raw[off[a] : off[b]], off[a : b + 1] - off[a], W.SYMBOL)
                h = W.hash_words(raw[off[a] : off[b]], starts, ends)
                n = b - a
                rooms = np.repeat(woff[1:], np.diff(woff)) - np.arange(len(h))  # words from here to the row's end

                def places(p: np.ndarray) -> np.ndarray:
                    at = np.flatnonzero(h == p[0])
                    at = at[rooms[at] >= len(p)]
                    for j in range(1, len(p)):
                        at = at[h[at + j] == p[j]]
                    return at

                count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                more: list[set[str]] = [set() for _ in range(n)]
                for label, p in fixed:
                    at = places(p)
                    row = np.searchsorted(woff, at, side="right") - 1
                    np.add.at(count, row, 1)
                    np.minimum.at(first, row, at - woff[row])
                    np.maximum.at(last, row, at - woff[row])
                    for r in np.unique(row):
                        base[r].add(label)
                for label, m in machines:
                    at = places(m.lead_hash)
                    for i, r in zip(at.tolist(), (np.searchsorted(woff, at, side="right") - 1).tolist()):
                        if label not in more[r] and m.accepts(h[i : min(i + m.n, woff[r + 1])].tolist()):
                            more[r].add(label)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(a, n), pa.array(np.diff(woff)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
                        pa.array([sorted(x) for x in base], pa.list_(pa.string())), pa.array([sorted(x | y) for x, y in zip(base, more)], pa.list_(pa.string())),
                        pa.array([max(weight[t] for t in y) if y else 0.5 if x else 0.0 for x, y in zip(base, more)], pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double")
