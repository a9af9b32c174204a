"""License scans by template-markup matching.

A template is text with markup: ``<<beginOptional>>…<<endOptional>>`` may be absent and
``<<var;name=…;match=PATTERN;max=N>>`` stands for up to N words (0 too, unless ``min=1``) that each
match the pattern. Templates compile into one token automaton (states joined by words, empty moves
for optional parts, patterns for replaceable ones). The scan runs it from every place where a
template can begin and accepts where the mandatory wording stands, word for word. Phrases without
markup are templates too.

Null texts count as empty. Rows keep their multiplicity, extra columns are not returned, texts are
scanned whole; memory is bounded by one text's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frame import by_rows

#: Fixed value: ASCII letters and digits and everything beyond ASCII, after A-Z became a-z.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_NUMBER = "<<var;name=version;match=v?[0-9]+;max=2;min=1>>"
#: Templates of this library's own, with their labels.
TEMPLATES = {
    "mit-notice": "<<beginOptional>>is<<endOptional>> <<var;name=verb;match=released|licensed|distributed|available;max=1;min=1>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "Licensed under the Apache License <<beginOptional>>,<<endOptional>> <<beginOptional>>Version<<endOptional>> 2.0",
    "gpl-versioned": "<<beginOptional>>GNU<<endOptional>> General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version " + _NUMBER,
    "lgpl": "GNU <<var;name=kind;match=lesser|library;max=1;min=1>> General Public License",
    "agpl": "GNU Affero General Public License",
    "cc-by": "Creative Commons Attribution <<beginOptional>>" + _NUMBER + "<<endOptional>> <<beginOptional>>International<<endOptional>> License",
    "cc-by-nc": "licensed under <<beginOptional>>a<<endOptional>> CC BY NC <<beginOptional>>" + _NUMBER + "<<endOptional>>",
    "cc-by-sa": "licensed under <<beginOptional>>a<<endOptional>> CC BY SA <<beginOptional>>" + _NUMBER + "<<endOptional>>",
    "bsd-clause": "Redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "Mozilla Public License <<beginOptional>>v<<endOptional>> <<beginOptional>>Version<<endOptional>> 2.0",
    "proprietary": "All rights reserved",
}

_MARK = re.compile(r"<<\s*(beginOptional|endOptional|var)\s*(?:;([^<>]*))?>>", re.IGNORECASE)


def words_of(text: str | bytes) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return WORD.findall(raw.lower())  # bytes.lower() changes A-Z only


@dataclass
class Automaton:
    """Token automaton of several templates; state 0 is nowhere."""

    by_word: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    by_pattern: list[list[tuple[re.Pattern, int]]] = field(default_factory=lambda: [[]])
    empty: list[list[int]] = field(default_factory=lambda: [[]])
    accepts: dict[int, str] = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)
    first: dict[bytes, list[int]] = field(default_factory=dict)
    _closed: dict[int, frozenset[int]] = field(default_factory=dict)

    def _state(self) -> int:
        self.by_word.append({})
        self.by_pattern.append([])
        self.empty.append([])
        return len(self.empty) - 1

    def add(self, label: str, template: str) -> None:
        at = start = self._state()
        opened: list[int] = []
        pos = 0
        marks = [*_MARK.finditer(template), None]
        mandatory = 0
        for mark in marks:
            for word in words_of(template[pos : mark.start() if mark else len(template)]):
                new = self._state()
                self.by_word[at][word] = new
                at = new
                mandatory += not opened
            if mark is None:
                break
            pos = mark.end()
            kind = mark[1].lower()
            if kind == "beginoptional":
                opened.append(at)
            elif kind == "endoptional":
                if not opened:
                    raise ValueError(f"{label}: an optional part ends that did not begin")
                new = self._state()
                self.empty[at].append(new)
                self.empty[opened.pop()].append(new)
                at = new
            else:
                given = dict(x.split("=", 1) for x in mark[2].split(";"))
                pattern, most, least = re.compile(given["match"].encode()), int(given.get("max", 1)), int(given.get("min", 0))
                end = self._state()
                for k in range(most):
                    if k >= least:
                        self.empty[at].append(end)
                    new = self._state()
                    self.by_pattern[at].append((pattern, new))
                    at = new
                self.empty[at].append(end)
                at = end
        if opened or not mandatory:
            raise ValueError(f"{label}: an optional part is not ended, or there is no mandatory word")
        self.accepts[at] = label
        self.starts.append(start)
        for state in self.closure(start):
            if self.by_pattern[state]:
                self.first.setdefault(b"", []).append(start)  # may begin with a replaceable word
            for word in self.by_word[state]:
                self.first.setdefault(word, []).append(start)

    def closure(self, state: int) -> frozenset[int]:
        if state not in self._closed:
            seen, todo = {state}, [state]
            while todo:
                for x in self.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            self._closed[state] = frozenset(seen)
        return self._closed[state]

    def longest(self, words: list[bytes], at: int, start: int) -> tuple[str, int] | None:
        """The label and the end of the longest match of a template from a place, if it is accepted."""
        states, found = self.closure(start), None
        while True:
            found = next(((self.accepts[s], at) for s in states if s in self.accepts), found)
            if not states or at >= len(words):
                return found
            word, following = words[at], set()
            for s in states:
                if (new := self.by_word[s].get(word)) is not None:
                    following |= self.closure(new)
                for pattern, new in self.by_pattern[s]:
                    if pattern.fullmatch(word):
                        following |= self.closure(new)
            states = frozenset(following)
            at += 1

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """All accepted places: label, first word, word after the last."""
        first, wild = self.first, sorted(set(self.first.get(b"", ())))
        found = []
        for at, word in enumerate(words):
            if wild or word in first:
                for start in {*wild, *first.get(word, ())}:
                    if hit := self.longest(words, at, start):
                        found.append((hit[0], at, hit[1]))
        return found


def compile_templates(templates: dict[str, str]) -> Automaton:
    out = Automaton()
    for label, template in templates.items():
        out.add(label, template)
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``id_col, n_words, matches array<struct<label, first_word, last_word>>``: every accepted place, in order.

    ``templates`` maps labels to template markup; a label may not repeat.
    """
    given = {v: k for k, v in BASE.items()} | TEMPLATES if templates is None else dict(templates)
    match = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_templates(given)
        for b in by_rows(batches):
            n, found = [], []
            for raw in b.column(1).to_pylist():
                words = words_of(raw)
                n.append(len(words))
                hits = automaton.scan(words)
                found.append([{"label": label, "first_word": a, "last_word": z - 1} for label, a, z in sorted(hits, key=lambda h: (h[1], h[0]))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(match))], ["id", "n_words", "matches"])

    rows = df.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, matches array<struct<label string, first_word long, last_word long>>").withColumnRenamed("id", id_col)


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: counts and places of the base phrases, labels, and a score.

    The score is 0 without any match, 0.5 with base phrases alone, 1 where a whole notice is accepted.
    """
    labels = sorted(BASE.values())
    base = F.filter("matches", lambda m: m["label"].isin(labels))
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda m: m["label"]))), ",")
    return scanned.select(
        F.col(id_col),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first_word"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        F.when(F.size("matches") == 0, 0.0).when(F.size("matches") == F.size(base), 0.5).otherwise(1.0).alias("score"),
    )
