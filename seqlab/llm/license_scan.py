"""License scans: a positional index of rare licence words, intersected by relative position.

Inverse document frequency of every licence word is counted over all documents. In each file the `rare` licence words
of highest IDF that occur in it look up their postings, (template, position); so do, however many others a file has, the
rarest words of each template, one more than `least` allows to miss, so that every match has a vote. Each occurrence votes
for the alignment "place in the file less position in the template". An alignment with votes is a match if all mandatory
key phrases of the template stand at their relative positions and at least `least` of the template's words do. A base phrase is a template that is one key phrase, so it matches where its words
stand consecutively.

Defined results: null or empty text has no words, no labels, score 0 and null first and last word. Overlapping places
all count. Labels are distinct. Repeated rows each give a row; an empty table gives none. Further columns of any name
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import ALNUM, Words, documents, hash_words, only, pieces

RARE, LEAST = 32, 0.8
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Label, words of a public notice, its mandatory key phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", ("permission is hereby granted free of charge", "this software and associated documentation files")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
     "with the license", ("apache license version 2 0", "except in compliance with the license")),
    ("apache-2", "licensed under the apache license version 2 0", ("licensed under the apache license version 2 0",)),
    ("mit", "released under the mit license", ("released under the mit license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license", ("this program is free software", "gnu general public license")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("subject to the terms of the mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software released into the public domain",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike 4 0",)),
)


class Index:
    """Postings of all templates; the first len(BASE) are the base phrases."""

    def __init__(self, templates=TEMPLATES):
        rows = [(label, phrase, (phrase,)) for label, phrase in BASE] + list(templates)
        self.labels = [r[0] for r in rows]
        words = [r[1].split() for r in rows]
        self.vocabulary = sorted({w for ws in words for w in ws})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.words = [np.array([number[w] for w in ws]) for ws in words]
        hashes = hash_words(self.vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.must = []
        for (_, _, phrases), ws in zip(rows, words, strict=True):
            at = []
            for phrase in phrases:
                p = phrase.split()
                i = next(i for i in range(len(ws)) if ws[i:i + len(p)] == p)
                at += range(i, i + len(p))
            self.must.append(np.array(sorted(set(at))))

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Number in the vocabulary of each word, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)

    def postings(self, df: np.ndarray, least: float):
        """Per word: (template, position) pairs; and each template's rarest words, of which every match holds one."""
        at: list[list[tuple[int, int]]] = [[] for _ in self.vocabulary]
        anchors = np.zeros(len(df), bool)
        for t, ws in enumerate(self.words):
            miss = sum((len(ws) - m) / len(ws) >= least for m in range(1, len(ws)))
            anchors[ws[np.argsort(df[ws], kind="stable")[:miss + 1]]] = True
            for i, w in enumerate(ws):
                at[w].append((t, i))
        size = np.array([len(x) for x in at])
        flat = np.array([p for x in at for p in x]).reshape(-1, 2)
        return size, np.concatenate([[0], np.cumsum(size)]), flat, anchors


def frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """Documents that each licence word occurs in; one row a word and task goes to the driver."""
    def task(batches):
        df = np.zeros(len(index.vocabulary), np.int64)
        for _, texts in pieces(batches):
            w = Words(texts, ALNUM)
            ids, owner = index.ids(w.hashes()), w.owner()
            hit = ids >= 0
            seen = np.unique(owner[hit] * len(df) + ids[hit])
            df += np.bincount(seen % len(df), minlength=len(df))
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(len(df)), pa.int32()), "n": pa.array(df)})

    out = np.zeros(len(index.vocabulary), np.int64)
    for r in only(docs, "text").mapInArrow(task, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n  # len(vocabulary) rows
    return out


def expand(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: which item each of the sum(size) places belongs to, and its number there."""
    item = np.repeat(np.arange(len(size)), size)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)


def matches(index: Index, post, df: np.ndarray, ids: np.ndarray, bounds: np.ndarray, rare: int, least: float):
    """(text, template, first word, share) of every match; `ids` are all words of some texts."""
    size, first, flat, anchors = post
    hit = np.flatnonzero(ids >= 0)
    owner = np.searchsorted(bounds, hit, side="right") - 1
    # the `rare` rarest licence words of each file, and the anchors
    pair = np.unique(owner * len(df) + ids[hit])
    o, w = pair // len(df), pair % len(df)
    by = np.lexsort((df[w], o))
    rank = np.empty(len(pair), np.int64)
    rank[by] = np.arange(len(pair)) - np.searchsorted(o[by], o[by])
    chosen = pair[(rank < rare) | anchors[w]]
    hit = hit[np.isin(owner * len(df) + ids[hit], chosen)]
    item, k = expand(size[ids[hit]])
    entry = flat[first[ids[hit[item]]] + k]
    start, template = hit[item] - entry[:, 1], entry[:, 0]
    found = []
    for t, words in enumerate(index.words):
        at = np.unique(start[template == t])
        own = np.searchsorted(bounds, at, side="right") - 1
        # an alignment may begin before or end after the file, but its mandatory phrases must lie inside
        must = at[:, None] + index.must[t]
        ok = (own >= 0) if len(at) else np.zeros(0, bool)
        low, high = must.min(1, initial=1 << 60), must.max(1, initial=-1)
        own = np.searchsorted(bounds, np.maximum(low, 0), side="right") - 1
        ok = (low >= 0) & (high < len(ids))
        own = np.minimum(own, len(bounds) - 2)
        ok &= (low >= bounds[own]) & (high < bounds[own + 1])
        at, own, must = at[ok], own[ok], must[ok]
        ok = (ids[must] == words[index.must[t]]).all(1)
        at, own = at[ok], own[ok]
        place = at[:, None] + np.arange(len(words))
        inside = (place >= bounds[own][:, None]) & (place < bounds[own + 1][:, None])
        share = ((ids[np.clip(place, 0, len(ids) - 1)] == words) & inside).mean(1) if len(at) else np.zeros(0)
        ok = share >= least
        found.append((own[ok], np.full(ok.sum(), t), at[ok], share[ok]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def scan(docs: DataFrame, templates=TEMPLATES, rare: int = RARE, least: float = LEAST) -> DataFrame:
    """Every document with its base places, labels and score."""
    index = Index(templates)
    df = frequencies(docs, index)
    post = index.postings(df, least)
    names = np.array(index.labels)

    def task(batches):
        for batch, texts in pieces(batches):
            w = Words(texts, ALNUM)
            own, template, at, share = matches(index, post, df, index.ids(w.hashes()), w.bounds, rare, least)
            at = at - w.bounds[own]
            n = len(texts)
            base = template < len(BASE)
            lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            np.minimum.at(lo, own[base], at[base])
            np.maximum.at(hi, own[base], at[base])
            score = np.zeros(n)
            np.maximum.at(score, own, share)
            tags: list[set] = [set() for _ in range(n)]
            base_tags: list[set] = [set() for _ in range(n)]
            for o, t, b in zip(own.tolist(), template.tolist(), base.tolist(), strict=True):
                tags[o].add(names[t])
                if b:
                    base_tags[o].add(names[t])
            none = hi < 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(w.counts.astype(np.int64)),
                "n_base": pa.array(np.bincount(own[base], minlength=n).astype(np.int64)),
                "first_word": pa.array(lo, mask=none), "last_word": pa.array(hi, mask=none),
                "base_labels": pa.array([",".join(sorted(x)) for x in base_tags], pa.string()),
                "labels": pa.array([",".join(sorted(x)) for x in tags], pa.string()), "score": pa.array(score)})

    return only(docs, "doc_id", "text").mapInArrow(
        task, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
