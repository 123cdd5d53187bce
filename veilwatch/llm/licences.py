"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Every place of a text where the word pairs of a template stand close together is a paragraph: around each
such pair the ``LONGEST`` pairs from it on are searched, in a line and over line breaks alike (comment
leaders left out; a line without a word ends a stretch), and the part from the first to the last word pair
of the template is judged by itself, so that other words of its line, however many, do not matter.  Of finds
that overlap the most similar stays, then the one of more pairs.  A line without such a place is a paragraph
as a whole.  The place reported is the first line; a family is reported once for its first line.

A paragraph's features are which words and word pairs it holds; a multinomial logistic regression over
them names a licence family or ``unknown``.  The unknown class is on lines of the corpus and on licence words in random order, and calibrated: a temperature that fits a
held-out half, and a least probability for naming a family.  A named family is confirmed when at
least ``CONFIRM`` of the word pairs of one of its templates stand in the paragraph; unconfirmed ones are
reported as ``unknown`` with their probability.

Training uses the templates with words dropped and surroundings added, and at most ``SAMPLE_LINES``
lines of at most ``SAMPLE_CHARS`` characters drawn by hash from the whole corpus: a bounded sample, so
the model is small at any corpus size and is broadcast.  Every paragraph of every whole text is scanned.

Defined results: null and empty texts have no paragraph; a very long text or line is scanned whole, its words
as one array; repeated rows each report; ties go to the family first in the list; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import digest, field, pack_row, ship_code

# Families and how their notices read.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under AGPL v3",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "distributed under the Apache License 2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Released under the BSD License",
        "licensed under the BSD 3-Clause License",
    ],
    "cc-by": [
        "licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under GPL v3",
    ],
    "lgpl": [
        "under the terms of the GNU Lesser General Public License",
        "licensed under the GNU Lesser General Public License, version 2.1",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "licensed under the MIT License",
    ],
    "mpl": [
        "subject to the terms of the Mozilla Public License, v. 2.0",
        "licensed under the Mozilla Public License 2.0",
    ],
    "proprietary": [
        "All rights reserved",
        "Unauthorized copying of this file is strictly prohibited",
        "Proprietary and confidential",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain",
        "This work is dedicated to the public domain",
        "Licensed under CC0 1.0 Universal",
    ],
}

UNKNOWN = "unknown"
SAMPLE_LINES = 2500
SAMPLE_CHARS = 1000
PER_TEMPLATE = 50
LEAST_PROBABILITY = 0.5
CONFIRM = 0.8
ROUNDS = 200
#: Training lines that must hold a feature for it to have a weight.
LEAST_COUNT = 5
#: Words of the longest template.
LONGEST = max(len(t.split()) for some in TEMPLATES.values() for t in some)
#: Comment leaders that are words; those of symbols are no words.
LEADERS = np.array([xxhash.xxh64_intdigest(w) for w in (b"dnl", b"rem")], np.uint64)
_TRIM = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "doc_id long, paragraph long, family string, probability double, similarity double"


@dataclass
class Lines:
    """The words of some lines: hashes of all words that have a letter or digit, and their line."""

    words: np.ndarray
    line: np.ndarray

    @classmethod
    def of(cls, lines: list[bytes]) -> Lines:
        split = [x.lower().split() for x in lines]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        flat = pa.array(chain.from_iterable(split), pa.large_binary(), size=int(lens.sum()))
        coded = flat.dictionary_encode()
        bare = [_TRIM.sub(b"", w) for w in coded.dictionary.to_pylist()]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, bare), np.uint64, len(bare))
        some = np.fromiter(map(bool, bare), bool, len(bare))
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kept = some[ids] if len(ids) else np.empty(0, bool)
        return cls(hashes[ids][kept] if len(ids) else np.empty(0, np.uint64),
                   np.repeat(np.arange(len(split)), lens)[kept])

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(feature, line) of words and of pairs of neighbours in a line."""
        near = self.line[1:] == self.line[:-1]
        pairs = _pair(self.words[:-1][near], self.words[1:][near])
        return np.concatenate([self.words, pairs]), np.concatenate([self.line, self.line[1:][near]])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _MIX) ^ (b + (a >> np.uint64(29)))
    return (x ^ (x >> np.uint64(31))) * _MIX


def pairs_of(line: bytes) -> np.ndarray:
    """The distinct word pairs of one line."""
    words = Lines.of([line]).words
    return np.unique(_pair(words[:-1], words[1:]))


@dataclass
class Model:
    families: list[str]        # the last is unknown
    features: np.ndarray       # sorted
    weights: np.ndarray        # features by families
    bias: np.ndarray
    temperature: float
    templates: list[list[np.ndarray]]

    def logits(self, lines: list[bytes]) -> np.ndarray:
        """Per line and family; features outside the model weigh nothing."""
        return self._logits(Lines.of(lines), len(lines))

    def _logits(self, words: Lines, size: int) -> np.ndarray:
        feature, line = words.features()
        out = np.tile(self.bias, (size, 1))
        if not len(feature):
            return out
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        known = self.features[at] == feature
        seen = np.unique(line[known] * len(self.features) + at[known])  # each feature once per line
        at, line = seen % len(self.features), seen // len(self.features)
        for k in range(len(self.families)):
            out[:, k] += np.bincount(line, self.weights[at, k], size)
        return out

    def scan(self, lines: list[bytes], words: Lines | None = None) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, similarity) of the lines that are named a licence."""
        p = _softmax(self._logits(words or Lines.of(lines), len(lines)) / self.temperature)
        best = p[:, :-1].argmax(axis=1)
        top = p[np.arange(len(lines)), best]
        out = []
        for k in np.flatnonzero((top >= LEAST_PROBABILITY) & (top >= p[:, -1])):
            own = pairs_of(lines[k])
            near = max((np.isin(t, own).mean() for t in self.templates[best[k]]), default=0.0)
            name = self.families[best[k]] if near >= CONFIRM else UNKNOWN
            out.append((int(k), name, float(top[k]), float(near)))
        return out

    def notices(self, words: Lines, doc: np.ndarray) -> list[tuple[int, int, str, float, float]]:
        """(first line, last line, family, probability, similarity) of confirmed notices, wherever they begin.

        ``doc`` is the document of each line.
        """
        first = np.append(True, words.line[1:] != words.line[:-1])[:len(words.line)]
        some = ~(first & np.isin(words.words, LEADERS))
        word, line = words.words[some], words.line[some]
        if len(word) < 2:
            return []
        near = (line[1:] - line[:-1] <= 1) & (doc[line[1:]] == doc[line[:-1]])
        run = np.append(0, np.cumsum(~near))
        pairs = _pair(word[:-1], word[1:])
        every = np.unique(np.concatenate([t for own in self.templates for t in own]))
        hits = np.flatnonzero(near & np.isin(pairs, every))
        judged: dict[bytes, np.ndarray] = {}
        found = []
        for family, own in enumerate(self.templates):
            for t in own:
                at = hits[np.isin(pairs[hits], t)]
                end = np.searchsorted(at, at + LONGEST)
                done = 0  # a notice found whole is not searched again
                for k in np.flatnonzero(end - np.arange(len(at)) >= CONFIRM * len(t)):
                    if at[k] < done:
                        continue
                    span = at[k:end[k]]
                    span = span[run[span] == run[at[k]]]
                    similarity = len(np.unique(pairs[span])) / len(t)
                    if similarity < CONFIRM or pairs[span[0]] in pairs[span[1:]]:
                        continue
                    while pairs[span[-1]] in pairs[span[:-1]]:
                        span = span[:-1]
                    a, b = int(span[0]), int(span[-1]) + 2
                    key = word[a:b].tobytes()
                    if key not in judged:
                        judged[key] = _softmax(self._logits(
                            Lines(word[a:b], np.zeros(b - a, np.int64)), 1) / self.temperature)[0]
                    p = judged[key]
                    if similarity == 1:
                        done = b - 1
                    if p.argmax() == family and p[family] >= LEAST_PROBABILITY:
                        found.append((-similarity, -len(t), a, b, family, float(p[family])))
        taken = np.zeros(len(word), bool)
        best = []
        for similarity, _, a, b, family, p in sorted(found):
            if not taken[a:b].any():
                taken[a:b] = True
                best.append((int(line[a]), int(line[b - 1]), self.families[family], p, -similarity))
        return best

    def paragraphs(self, lines: list[bytes], doc: np.ndarray) -> list[tuple[int, str, float, float]]:
        """``notices``, and ``scan`` of the lines that hold none, by first line."""
        words = Lines.of(lines)
        best: dict[tuple[int, str], tuple[float, float]] = {}
        inside = set()
        for first, last, family, p, similarity in self.notices(words, doc):
            best.setdefault((first, family), (p, similarity))
            inside.update(range(first, last + 1))
        rows = [(k, family, p, similarity) for (k, family), (p, similarity) in best.items()]
        return sorted(rows + [x for x in self.scan(lines, words) if x[0] not in inside])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(sample: list[bytes], seed: int) -> tuple[list[bytes], np.ndarray]:
    """Training lines and their family numbers."""
    rng = np.random.default_rng(seed)
    templates = [[t.encode() for t in some] for some in TEMPLATES.values()]
    every = [w for some in templates for t in some for w in t.split()]
    filler = [w for x in sample[:200] for w in x.split()] or [b"text"]
    known = [set(pairs_of(t).tolist()) for some in templates for t in some]
    lines, labels = [], []
    for family, some in enumerate(templates):
        for t in some:
            for k in range(PER_TEMPLATE):
                words = t.split()
                if k and len(words) > 4:
                    words = [w for w in words if rng.random() > 0.08]
                before, after = rng.integers(0, 12, 2) if k % 2 else (0, 0)
                lines.append(b" ".join([*rng.choice(filler, before), *words, *rng.choice(filler, after)]))
                labels.append(family)
    def names_one(own: set[int]) -> bool:
        return any(len(own & t) >= CONFIRM * len(t) for t in known)

    plain = [x for x in sample if not names_one(set(pairs_of(x).tolist()))]
    plain *= -(-SAMPLE_LINES // len(plain)) if plain else 1  # a small corpus weighs as much as a large one
    lines += plain
    labels += [len(templates)] * len(plain)
    for _ in range(PER_TEMPLATE * 8):
        lines.append(b" ".join(rng.choice(every, rng.integers(3, 14))))
        labels.append(len(templates))
    order = rng.permutation(len(lines))
    return [lines[k] for k in order], np.array(labels)[order]


def train(sample: list[bytes], seed: int = 7) -> Model:
    """Fit on half of the examples with a ridge penalty, set the temperature on the other half."""
    lines, labels = _examples(sample, seed)
    families = [*TEMPLATES, UNKNOWN]
    feature, line = Lines.of(lines).features()
    half = len(lines) // 2
    first = line < half
    names, counts = np.unique(feature[first], return_counts=True)
    names = names[counts >= LEAST_COUNT]
    at = np.minimum(np.searchsorted(names, feature[first]), len(names) - 1)
    told = names[at] == feature[first]
    x = np.zeros((half, len(names)), np.float32)
    x[line[first][told], at[told]] = 1
    y = np.eye(len(families), dtype=np.float32)[labels[:half]]
    w = np.zeros((len(names), len(families)), np.float32)
    b = np.zeros(len(families), np.float32)
    mw, vw = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        err = (_softmax(x @ w + b) - y) / half
        g = x.T @ err + 1e-4 * w
        mw, vw = 0.9 * mw + 0.1 * g, 0.999 * vw + 0.001 * g * g
        w -= 0.05 * (mw / (1 - 0.9 ** step)) / (np.sqrt(vw / (1 - 0.999 ** step)) + 1e-8)
        b -= 0.5 * err.sum(axis=0)
    model = Model(families, names, w.astype(np.float64), b.astype(np.float64), 1.0,
                  [[pairs_of(t.encode()) for t in some] for some in TEMPLATES.values()])
    logits, want = model.logits(lines[half:]), labels[half:]

    def loss(t: float) -> float:
        p = _softmax(logits / t)[np.arange(len(want)), want]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    model.temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    return model


def sample_lines(docs: DataFrame) -> list[bytes]:
    """At most ``SAMPLE_LINES`` lines by hash, from about ten times as many documents' lines."""
    df = pack_row(docs)
    text = field(df, "text", "string")
    n = df.where(text.isNotNull()).count()
    share = min(1.0, SAMPLE_LINES / max(n, 1))
    drawn = (F.pmod(digest(field(df, "doc_id", "long"), text), F.lit(1 << 30))
             < F.lit(int(share * (1 << 30)))) if share < 1 else F.lit(True)
    lines = df.where(drawn).select(F.explode(F.split(text, "\n")).alias("x")).where(
        (F.length(F.btrim("x")) > 0) & (F.length("x") <= SAMPLE_CHARS))
    rows = lines.distinct().orderBy(F.xxhash64("x"), "x").limit(SAMPLE_LINES).collect()
    return [r[0].encode() for r in rows]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per licence paragraph: ``doc_id``, ``paragraph`` (first line), family and evidence."""
    ship_code(docs.sparkSession)
    model = model or train(sample_lines(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    df = pack_row(docs)
    source = df.select(field(df, "doc_id", "long").alias("doc_id"),
                       field(df, "text", "string").alias("text"))
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = [(t or "").encode().split(b"\n") for t in part.column(1).to_pylist()]
                lens = np.fromiter(map(len, texts), np.int64, len(texts))
                starts = np.cumsum(lens) - lens
                found = own.paragraphs(list(chain.from_iterable(texts)), np.repeat(np.arange(len(lens)), lens))
                k = np.array([f[0] for f in found], np.int64)
                doc = np.searchsorted(starts, k, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc, pa.int64())),
                     pa.array(k - starts[doc] if len(k) else k, pa.int64()),
                     pa.array([f[1] for f in found], pa.string()),
                     pa.array([f[2] for f in found], pa.float64()),
                     pa.array([f[3] for f in found], pa.float64())], names=names)

    return source.mapInArrow(run, _SCHEMA)
