"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, and a shunting-yard parser
evaluates the tags' and/or/with expressions: which licences they offer, and which hold whatever is chosen.

Phrases are found in the sequence of words ``[0-9a-z\\x80-]+`` after lower-casing A-Z, so they may span any punctuation
and lines; a phrase never begins or ends inside a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Base phrases: each place counts.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices: they add labels only.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0-1.0",
    "this is free and unencumbered software": "unlicense",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: How a tag stands in the text: words joined by hyphens, then a colon and the expression, to the line's end.
_TAG, _REST = "-".join(TAG.split()) + ":", re.compile(r"[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[0-9a-z][0-9a-z.+-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list | None:
    """The longest prefix of ``expression`` that is a licence expression, in reverse Polish order; None if there is none.

    Operators by rank: with, and, or. Identifiers are compared in lower case.
    """
    out: list[str] = []
    stack: list[str] = []
    best: list | None = None
    operand = False  # whether the last token was a whole operand
    for m in _TOKEN.finditer(expression.translate(_LOWER)):
        t = m.group()
        if t == "(":
            if operand:
                break
            stack.append(t)
        elif t == ")":
            if not operand or "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
        elif t in _RANK:
            if not operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        else:
            if operand:
                break
            out.append(t)
            operand = True
        if operand and "(" not in stack:
            best = [*out, *reversed(stack)]
    return best


@dataclass(frozen=True)
class Terms:
    """What an expression says: the licences it offers, and those of them that hold under every choice."""

    offered: frozenset[str]
    required: frozenset[str]


def evaluate(rpn: list[str]) -> Terms:
    """``and`` requires what either side requires, ``or`` only what both do; ``a with b`` is a licence of its own.

    Sets are merged into the larger side, so that a long expression takes little more than linear time.
    """
    stack: list[tuple[set[str], set[str]]] = []
    for t in rpn:
        if t not in _RANK:
            stack.append(({t}, {t}))
            continue
        (more, must), (offered, required) = stack.pop(), stack.pop()
        if t == "with":
            names = {f"{x} with {y}" for x in offered for y in more} if len(offered) == len(more) == 1 else offered | more
            stack.append((names, set(names) if required and must else set()))
            continue
        if len(offered) < len(more):
            offered, more = more, offered
        offered |= more
        if t == "or":
            required &= must
        else:
            if len(required) < len(must):
                required, must = must, required
            required |= must
        stack.append((offered, required))
    return Terms(frozenset(stack[0][0]), frozenset(stack[0][1]))


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in [*BASE, *NOTICES, TAG]:
            words = f" {phrase} "
            self.automaton.add_word(words, (phrase, len(words)))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, str, str, float]:
        low = (text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower()
        words = WORD.findall(low)
        line = f" {' '.join(words)} "
        places, base, labels, seen, at = [], set(), set(), 0, 0
        tags = []
        for end, (phrase, size) in self.automaton.iter(line):
            if phrase not in BASE and phrase != TAG:
                labels.add(NOTICES[phrase])
                continue
            start = end - size + 1
            if start >= seen:  # ends come in order, starts of shorter phrases may not: counted on from the last place
                at += line.count(" ", seen, start)
            else:
                at -= line.count(" ", start, seen)
            seen = start
            if phrase == TAG:
                tags.append(at)
            else:
                places.append(at)
                base.add(BASE[phrase])
        expressions, required = [], set()
        if tags:
            wanted = set(tags)
            for start in (m.start() for k, m in enumerate(WORD.finditer(low)) if k in wanted):
                if low.startswith(_TAG, start):
                    rest = _REST.match(low, start + len(_TAG)).group(1)
                    if rpn := parse(rest):
                        terms = evaluate(rpn)
                        labels.update(terms.offered)
                        required.update(terms.required)
                        expressions.append(rest.strip())
        labels |= base
        # Each notice leaves half of the doubt; a tag that parses leaves a tenth.
        doubt = 0.5 ** min(len(places) + len(labels - base), 50) * (0.1 if expressions else 1.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), ",".join(sorted(required)), "\n".join(expressions), 1.0 - doubt if labels else 0.0


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, required string, expressions string, score double"
_TYPES = [pa.int64()] * 4 + [pa.string()] * 4 + [pa.float64()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its doc_id, the base places (first_word and last_word are null without any), base_labels,
    labels (of phrases, and the licences that tags' expressions offer), required (those of the latter that hold under every
    choice of an expression), the expressions by line, and a score from 0 (nothing found) to 1.

    A null text counts as empty; rows are independent, so ties, repeated rows and further columns change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*found)) if found else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES))], ["doc_id", *_NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
