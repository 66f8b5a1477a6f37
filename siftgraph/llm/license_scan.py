"""License scans by template markup.

A template is wording with marked regions: [[...]] may be missing (regions
nest), {{name:k}} stands for 0 to k words of any kind, {{name:k:pattern}} for 1 to
k words that each match the pattern. Each template is compiled into an automaton
over words; a text matches where the automaton accepts a stretch of its words,
that is where all mandatory words stand exactly as the template has them.

Words are maximal runs of bytes other than 00-2F, 3A-60 and 7B-7F after A-Z is
lower-cased, so templates are written in such words.

Base phrases are looked for beside the templates and keep their labels; a
template adds its own. The score is 1 with an accepted template, 0.5 with base
phrases only, else 0. Null and empty texts have no words; repeated rows each get
their result; other columns are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, each_text, session

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Templates by label. Wording is that of the licenses' own notices.
TEMPLATES = {
    "MIT": ["[[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software [[and to permit persons to whom the software is furnished to do so subject to the following conditions]]"],
    "Apache-2.0": ["licensed under the apache license version 2 0 [[the license]] [[you may not use this file except in compliance with the license]]"],
    "GPL-2.0": ["[[this {{work:8}} is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]]"],
    "GPL-3.0": ["[[this {{work:8}} is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]]"],
    "CC-BY": ["[[this {{work:8}} is]] licensed under [[a]] cc by {{version:1:[1-4]}} {{minor:1:[05]}}"],
    "CC-BY-NC": ["[[this {{work:8}} is]] licensed under [[a]] cc by nc {{version:1:[1-4]}} {{minor:1:[05]}}"],
    "CC-BY-SA": ["[[this {{work:8}} is]] licensed under [[a]] cc by sa {{version:1:[1-4]}} {{minor:1:[05]}}"],
    "BSD": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "copyright-notice": ["copyright [[c]] {{year:2:(19|20)[0-9][0-9]}} {{holder:16}} all rights reserved"],
}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """A template's automaton: for each state its moves (word or None for a pattern, pattern, next) and its free moves."""

    def __init__(self, template: str):
        self.moves: list[list[tuple[bytes | None, re.Pattern | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        at, optional = 0, []
        for token in re.findall(r"\[\[|\]\]|\{\{.*?\}\}|[^\s\[\]{}]+", template):
            if token == "[[":
                optional.append(at)
            elif token == "]]":
                self.free[optional.pop()].append(at)
            elif token.startswith("{{"):
                _, most, *pattern = token[2:-2].split(":", 2)
                pattern = re.compile(pattern[0].encode()) if pattern else None
                places = [at]
                for _ in range(int(most)):
                    at = self._step(None, pattern, at)
                    places.append(at)
                for x in places[pattern is not None : -1]:
                    self.free[x].append(at)
            else:
                at = self._step(token.encode(), None, at)
        self.final = at
        self.first = {w for s in self._closed({0}) for w, _, _ in self.moves[s] if w is not None}

    def _step(self, word, pattern, at: int) -> int:
        self.moves.append([])
        self.free.append([])
        self.moves[at].append((word, pattern, len(self.moves) - 1))
        return len(self.moves) - 1

    def _closed(self, states: set[int]) -> set[int]:
        stack, out = list(states), set(states)
        while stack:
            for x in self.free[stack.pop()]:
                if x not in out:
                    out.add(x)
                    stack.append(x)
        return out

    def end(self, words: list[bytes], start: int) -> int:
        """Behind the longest accepted stretch from start, or -1."""
        states, end = self._closed({0}), -1
        for i in range(start, len(words) + 1):
            if self.final in states:
                end = i
            if i == len(words):
                break
            w = words[i]
            states = self._closed({x for s in states for word, pattern, x in self.moves[s] if (word == w if word is not None else pattern is None or pattern.fullmatch(w))})
            if not states:
                break
        return end


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None):
        self.templates, self.base = templates or TEMPLATES, base or BASE
        self._compile()

    def _compile(self) -> None:
        self.automata = [(label, Automaton(t)) for label, ts in self.templates.items() for t in ts]
        self.phrases = [(p.encode().split(), label) for p, label in self.base.items()]
        self.starts: dict[bytes, list] = {}
        for label, a in self.automata:
            for w in a.first:
                self.starts.setdefault(w, []).append((label, a))
        self.heads: dict[bytes, list] = {}
        for p, label in self.phrases:
            self.heads.setdefault(p[0], []).append((p, label))
        self.wanted = frozenset(self.starts) | frozenset(self.heads)

    def __getstate__(self):
        return self.templates, self.base

    def __setstate__(self, state):
        self.templates, self.base = state
        self._compile()

    def scan(self, text: bytes) -> dict:
        found = words(text)
        out = {"n_words": len(found), "base": [], "spans": []}
        if self.wanted.isdisjoint(found):
            return out
        for i, w in enumerate(found):
            if w not in self.wanted:
                continue
            for p, label in self.heads.get(w, ()):
                if found[i : i + len(p)] == p:
                    out["base"].append((i, label))
            for label, a in self.starts.get(w, ()):
                if (end := a.end(found, i)) >= 0:
                    out["spans"].append((label, i, end))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first word, end) of each row."""
    session(docs)
    scanner = Scanner(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scanner.scan(x) for x in each_text(batch.column("text"))]
            base = [sorted({b for _, b in x["base"]}) for x in out]
            more = [sorted({*b, *(s[0] for s in x["spans"])}) for b, x in zip(base, out)]
            span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
            yield batch_of(
                doc_id=batch.column("doc_id"),
                n_words=pa.array([x["n_words"] for x in out], pa.int64()),
                n_base=pa.array([len(x["base"]) for x in out], pa.int64()),
                first_word=pa.array([min((i for i, _ in x["base"]), default=None) for x in out], pa.int64()),
                last_word=pa.array([max((i for i, _ in x["base"]), default=None) for x in out], pa.int64()),
                base_labels=pa.array([",".join(b) for b in base]),
                labels=pa.array([",".join(m) for m in more]),
                score=pa.array([1.0 if x["spans"] else 0.5 if x["base"] else 0.0 for x in out]),
                spans=pa.array([[dict(zip(("label", "first", "end"), s)) for s in x["spans"]] for x in out], span),
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(F.col("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long>>")
