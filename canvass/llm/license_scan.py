"""Operator 6: license scans by an exact set-similarity join of text blocks with templates.

A block is a run of BLOCK words, taken every BLOCK / 2 words, so any run of
BLOCK / 2 words lies in one block. A template is found in a block that has at
least the share CONTAINED of the template's distinct words. The join is exact:

 * length filter: only blocks with enough words of any template are kept;
 * prefix filter: with words in one global order, rarest first (counted over all
   blocks kept), a block that meets a template's threshold must have one of the
   template's first n - ceil(t * n) + 1 words;
 * positional filter: a first shared word at place p of the template leaves at
   most n - p words to share.

Templates are a fixed list; the words of a block that no template has are
dropped at once. Beside that, base phrases are found where their words stand
consecutively.

Defined cases: null or empty text has no words, no labels and score 0; rows that
repeat an id are scanned one by one; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import map_arrow, prepare, read_table, staged
from canvass.llm.words import LOWER, NOT_ALNUM, text_bytes, word_bounds, word_hashes

#: Share of a template's distinct words that a block must have.
CONTAINED = 0.8

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices of well-known licenses, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
           "files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
           "as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
           "conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}

#: Words of a block: twice the longest template.
BLOCK = 2 * max(len(t.split()) for t in TEMPLATES.values())


def _words(column: pa.Array):
    data, bounds = text_bytes(column)
    data = LOWER[data]
    begin, end, at = word_bounds(data, bounds, NOT_ALNUM)
    return word_hashes(data, begin, end), at


def _hash(words: str) -> np.ndarray:
    return _words(pa.array([words]))[0]


def _vocabulary(templates: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Sorted hashes of all template words, and each template's words as places in it."""
    sets = {label: np.unique(_hash(text)) for label, text in templates.items()}
    words = np.unique(np.concatenate(list(sets.values())))
    return words, {label: np.searchsorted(words, s) for label, s in sets.items()}


def needed(n: int, share: float = CONTAINED) -> int:
    """Words of a template of n distinct words that a block must have."""
    return max(1, math.ceil(share * n - 1e-9))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, phrases=None, share: float = CONTAINED) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base, blocks): blocks are sets of template words."""
    prepare(docs.sparkSession)
    words, sets = _vocabulary(templates or TEMPLATES)
    wanted = {p: _hash(p) for p in (phrases or PHRASES)}
    labels = phrases or PHRASES
    least = min(needed(len(s), share) for s in sets.values())
    block = 2 * max(len(t.split()) for t in (templates or TEMPLATES).values())

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, at = _words(batch.column("text"))
        n = len(at) - 1
        owner = np.repeat(np.arange(n), np.diff(at))
        count, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        base = [set() for _ in range(n)]
        for phrase, own in wanted.items():
            # consecutive words of one text
            here = np.flatnonzero(hashes[:max(0, len(hashes) - len(own) + 1)] == own[0])
            for j in range(1, len(own)):
                here = here[hashes[here + j] == own[j]]
            here = here[owner[here] == owner[here + len(own) - 1]] if len(here) else here
            for i in here:
                doc, place = int(owner[i]), int(i - at[owner[i]])
                count[doc] += 1
                first[doc] = place if first[doc] < 0 else min(first[doc], place)
                last[doc] = max(last[doc], place)
                base[doc].add(labels[phrase])
        place = np.minimum(np.searchsorted(words, hashes), len(words) - 1) if len(hashes) else np.zeros(0, np.int64)
        known = words[place] == hashes if len(hashes) else np.zeros(0, bool)
        total = np.concatenate(([0], np.cumsum(known)))
        blocks = []
        for a, b in itertools.pairwise(at):
            starts = np.arange(a, max(a + 1, b - block // 2), block // 2) if b > a else np.zeros(0, np.int64)
            ends = np.minimum(starts + block, b)
            own = []
            for s, e in zip(starts[total[ends] - total[starts] >= least], ends[total[ends] - total[starts] >= least], strict=True):
                got = np.unique(place[s:e][known[s:e]])
                if len(got) >= least:
                    own.append(got.tolist())
            blocks.append(own)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(count),
             pa.array(first, mask=first < 0), pa.array(last, mask=last < 0), pa.array([sorted(x) for x in base], pa.list_(pa.string())),
             pa.array(blocks, pa.list_(pa.list_(pa.int32())))],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kernel,
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<array<int>>",
                     "text")


def prefix_index(sets: dict[str, np.ndarray], frequency: np.ndarray, share: float = CONTAINED):
    """For each prefix word: (template, its place in the template's global order)."""
    index: dict[int, list[tuple[str, int]]] = {}
    for label, own in sets.items():
        order = sorted(own.tolist(), key=lambda w: (frequency[w], w))
        for place, word in enumerate(order[:len(order) - needed(len(order), share) + 1]):
            index.setdefault(word, []).append((label, place))
    return index


def best_matches(block: list[int], sets, index, frequency, share: float = CONTAINED) -> dict[str, float]:
    """Containment of each template that the block meets."""
    own, seen, found = set(block), set(), {}
    for word in sorted(block, key=lambda w: (frequency[w], w)):
        for label, place in index.get(word, ()):
            if label in seen:
                continue
            n = len(sets[label])
            if n - place < needed(n, share) or len(own) < needed(n, share):
                continue
            seen.add(label)
            common = sum(w in own for w in sets[label].tolist())
            if common >= needed(n, share):
                found[label] = common / n
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, phrases=None, share: float = CONTAINED) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base, found, score) of every row."""
    table = staged(scanned(docs, id_col, text_col, templates, phrases, share), "blocks")
    words, sets = _vocabulary(templates or TEMPLATES)
    frequency = np.zeros(len(words), dtype=np.int64)
    for r in (table.where(F.size("blocks") > 0).select(F.explode(F.flatten("blocks")).alias("w")).groupBy("w")
              .agg(F.count("*").alias("n")).collect()):  # one row a template word
        frequency[r["w"]] = r["n"]
    index = prefix_index(sets, frequency, share)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, score = [], []
        for blocks in batch.column("blocks").to_pylist():
            best: dict[str, float] = {}
            for block in blocks:
                for label, value in best_matches(block, sets, index, frequency, share).items():
                    best[label] = max(best.get(label, 0.0), value)
            found.append(sorted(best))
            score.append(max(best.values(), default=0.0))
        kept = batch.select([c for c in batch.schema.names if c != "blocks"])
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.list_(pa.string())), pa.array(score, pa.float64())],
                                          names=[*kept.schema.names, "found", "score"])

    return map_arrow(table, kernel, "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
                                    "found array<string>, score double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"), "score")
