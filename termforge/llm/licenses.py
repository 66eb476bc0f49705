"""License scans: an exact set-similarity join of text blocks with license templates, by containment.

A template is a short notice with the label it stands for. A block matches where the share of the template's
distinct words that it holds, the containment, is THRESHOLD or more. Blocks are BLOCK consecutive words of a
paragraph (lines between blank lines), starting every BLOCK / 2 words, so that any BLOCK / 2 + 1 words stand whole
in some block; templates have no more than that.

Join. All distinct words are put in one global order, rarest first by the number of blocks that hold them. With
need = ceil(THRESHOLD * |template|), a match shares need words, so the first |template| - need + 1 words of the
template and the first |block| - need + 1 of the block share one (prefix filter), blocks of fewer than need words
can't match (length filter), and a shared word at places i and j leaves at most min(|template| - i, |block| - j)
shared words from there on (positional filter). Pairs that pass are counted in full. Since words of no
template never count, blocks are held as their template words only, which changes no containment.

An exact check follows: the template's key words are all there, and the words meet the threshold within some
SPREAD * |template words| consecutive words, so that words scattered over a long paragraph are no notice.

Scale: one pass over the texts writes, per document, the places of template words (a few bytes a place); word
frequencies are summed before they are shuffled; the join reads the written table. The templates and their index are broadcast: at
most MAX_TEMPLATE_WORDS words together, which is checked. No text is shuffled, no block is dropped, none capped.

Defined results. A null or empty text has no words, no labels and a score of 0. Rows that repeat give repeated
results; a null doc_id is kept. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from termforge.llm.common import materialize, resident

THRESHOLD, BLOCK, SPREAD = 0.85, 128, 2
MAX_TEMPLATE_WORDS = 50_000

#: Phrases that name a license wherever they stand.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


#: Usual wordings of public license notices, and the words without which they are none.
TEMPLATES = (
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu", "general", "public")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu", "general", "redistribute")),
    Template("lgpl", "licensed under the gnu lesser general public license version 3", ("gnu", "lesser", "general")),
    Template("agpl", "licensed under the gnu affero general public license version 3", ("gnu", "affero", "general")),
    Template("apache", "licensed under the apache license version 2 0", ("apache",)),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses", ("apache", "compliance", "obtain")),
    Template("mit", "released under the mit license", ("mit", "license")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission", "granted", "restriction")),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative", "commons", "attribution")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "by", "nc")),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative", "commons", "noncommercial")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc", "by", "sa")),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative", "commons", "sharealike")),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived", "copyright", "neighboring")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution", "binary", "permitted")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission", "fee", "granted")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla", "public")),
    Template("epl", "made available under the terms of the eclipse public license 2 0", ("eclipse", "public")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered", "domain")),
)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BLANK = re.compile(r"\n[ \t\r]*\n")


def words(text: str) -> list[bytes]:
    """Runs of digits, letters a to z (A to Z lower-cased) and characters beyond ASCII."""
    return text.encode().translate(_LOWER).split()


class Vocabulary:
    """Numbers for the words of templates and phrases."""

    def __init__(self, templates: Iterable[Template], phrases: dict[str, str]):
        self.templates = list(templates)
        split = [words(t.text) for t in self.templates] + [words(p) for p in phrases]
        if sum(map(len, split)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words together")
        self.number = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}))}
        self.sets = [frozenset(self.number[w] for w in ws) for ws in split[: len(self.templates)]]
        self.widths = [SPREAD * len(ws) for ws in split[: len(self.templates)]]
        if any(len(ws) > BLOCK // 2 + 1 for ws in split[: len(self.templates)]):
            raise ValueError(f"a template of more than {BLOCK // 2 + 1} words; cut it in several")
        self.keys = [frozenset(self.number[k.encode()] for k in t.keys) for t in self.templates]
        self.phrases: dict[int, list] = {}
        for phrase, label in phrases.items():
            first, *rest = (self.number[w] for w in words(phrase))
            self.phrases.setdefault(first, []).append((rest, label))

    def places(self, text: str | None) -> tuple[int, list[int], list[int], list[int]]:
        """(number of words, places of known words, their numbers, the first word's place of each paragraph)."""
        n, at, known, starts = 0, [], [], []
        get = self.number.get
        for paragraph in _BLANK.split(text or ""):
            starts.append(n)
            for w in words(paragraph):
                k = get(w)
                if k is not None:
                    at.append(n)
                    known.append(k)
                n += 1
        return n, at, known, starts

    def base(self, at: list[int], known: list[int]) -> tuple[int, int | None, int | None, list[str]]:
        """(places of phrases, smallest and largest start, labels)."""
        starts, labels = [], set()
        for i, k in enumerate(known):
            for rest, label in self.phrases.get(k, ()):
                end = i + 1 + len(rest)
                if known[i + 1 : end] == rest and at[end - 1 : end] == [at[i] + len(rest)]:
                    starts.append(at[i])
                    labels.add(label)
        return len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


def blocks(n: int, at: list[int], known: list[int], starts: list[int]) -> Iterator[tuple[int, list[int], list[int]]]:
    """(first word, places, numbers) of every block that holds a known word."""
    low = 0
    for start, end in zip(starts, [*starts[1:], n]):
        for first in range(start, max(end - BLOCK // 2, start + 1), BLOCK // 2):
            while low < len(at) and at[low] < first:
                low += 1
            high = low
            while high < len(at) and at[high] < min(first + BLOCK, end):
                high += 1
            if high > low:
                yield first, at[low:high], known[low:high]


class Index:
    """The templates by the rarest words of each, under a global order of words."""

    def __init__(self, vocabulary: Vocabulary, blocks_with: dict[int, int], threshold: float):
        self.vocabulary = vocabulary
        order = sorted(vocabulary.number.values(), key=lambda k: (blocks_with.get(k, 0), k))
        self.rank = {k: i for i, k in enumerate(order)}
        self.sizes = [len(s) for s in vocabulary.sets]
        self.need = [math.ceil(threshold * size - 1e-9) for size in self.sizes]
        self.least = min(self.need, default=1)
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, own in enumerate(vocabulary.sets):
            for i, rank in enumerate(sorted(self.rank[k] for k in own)[: self.sizes[t] - self.need[t] + 1]):
                self.postings.setdefault(rank, []).append((t, i))

    def candidates(self, held: set[int]) -> set[int]:
        """Templates that pass the length, prefix and positional filters for a block of these words."""
        ranks = sorted(map(self.rank.__getitem__, held))
        found = set()
        for j, rank in enumerate(ranks[: len(ranks) - self.least + 1]):
            for t, i in self.postings.get(rank, ()):
                need = self.need[t]
                if len(ranks) >= need and j <= len(ranks) - need and min(self.sizes[t] - i, len(ranks) - j) + min(i, j) >= need:
                    found.add(t)
        return found

    def matches(self, n: int, at: list[int], known: list[int], starts: list[int]) -> list[tuple[int, int, int, int, float]]:
        """(template, block's first word, first word, words, containment) of every block and template that match.

        The words are the narrowest stretch of the greatest containment.
        """
        out = []
        for first, places, numbers in blocks(n, at, known, starts):
            held = set(numbers)
            for t in sorted(self.candidates(held)) if len(held) >= self.least else ():
                own = self.vocabulary.sets[t]
                if len(own & held) >= self.need[t] and self.vocabulary.keys[t] <= held:
                    best = self._stretch(t, [(p, k) for p, k in zip(places, numbers) if k in own])
                    if best:
                        out.append((t, first, *best))
        return out

    def _stretch(self, t: int, hits: list[tuple[int, int]]) -> tuple[int, int, float] | None:
        width, keys, low, inside, best = self.vocabulary.widths[t], self.vocabulary.keys[t], 0, {}, None
        for place, k in hits:
            inside[k] = inside.get(k, 0) + 1
            while hits[low][0] <= place - width or inside[hits[low][1]] > 1:
                inside[hits[low][1]] -= 1
                if not inside[hits[low][1]]:
                    del inside[hits[low][1]]
                low += 1
            if len(inside) >= self.need[t] and keys <= inside.keys():
                found = (-len(inside), place - hits[low][0], hits[low][0])
                best = min(best, found) if best else found
        return best and (best[2], best[1] + 1, -best[0] / self.sizes[t])


def scan(docs: DataFrame, templates: Iterable[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels of phrases), found (label, the block's first word, the notice's first word and number of words, containment) of every document."""
    import pyarrow as pa

    templates = tuple(templates)
    ints = pa.list_(pa.int32())
    sparse = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("at", ints), ("known", ints), ("starts", ints)])

    def read(batches: Iterable) -> Iterator:
        vocabulary = resident(("licenses", templates), lambda: Vocabulary(templates, phrases))
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                piece = batch.slice(part, 512)
                rows = [vocabulary.places(t) for t in piece.column("text").to_pylist()]
                columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), list(sparse)[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], schema=sparse)

    places = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        read, "doc_id long, n_words long, at array<int>, known array<int>, starts array<int>"
    )
    places = materialize(places, "license-words")

    def count(batches: Iterable) -> Iterator:
        for batch in batches:
            total: dict[int, int] = {}
            for row in batch.select(["n_words", "at", "known", "starts"]).to_pylist():
                for _, _, numbers in blocks(*row.values()):
                    for k in set(numbers):
                        total[k] = total.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    # One row a template word: at most MAX_TEMPLATE_WORDS.
    order = {r["word"]: r["n"] for r in places.mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    hit = pa.struct([("label", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string())), ("found", pa.list_(hit))])

    def join(batches: Iterable) -> Iterator:
        index = resident(("license-index", templates, threshold, frozenset(order.items())), lambda: Index(Vocabulary(templates, phrases), order, threshold))
        vocabulary = index.vocabulary
        for batch in batches:
            base, found = [], []
            for row in batch.select(["n_words", "at", "known", "starts"]).to_pylist():
                base.append(vocabulary.base(row["at"], row["known"]))
                hits = [(templates[t].label, *hit) for t, *hit in index.matches(*row.values())]
                found.append([dict(zip(("label", "block", "first", "words", "containment"), h)) for h in hits])
            counts = [pa.array([b[i] for b in base], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), *counts, pa.array([b[3] for b in base], pa.list_(pa.string())), pa.array(found, pa.list_(hit))], schema=schema
            )

    return places.mapInArrow(
        join,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, found array<struct<label:string,block:long,first:long,words:long,containment:double>>",
    )


def label_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: 1 with a base phrase, else the greatest containment found, else 0."""
    found = scan(docs)
    labels = F.array_sort(F.array_union("base", F.array_distinct(F.col("found.label"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("found.containment")), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        F.size("found").cast("long").alias("n_matches"),
    )
