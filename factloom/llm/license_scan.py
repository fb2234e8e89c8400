"""Licence scans with a positional rare-token index.

The index maps each word of the licence templates to its postings (template, position).  The inverse document frequency
of every template word is counted over the whole corpus.  Each template has its own ``RAREST`` words of highest IDF, of
all its words and not of those that a file happens to hold, so it is looked up alike whatever else the file holds.  Their
places in the file and their postings are intersected by relative position (file place minus template place);
an alignment with enough words in step is verified: the template's mandatory key phrase must stand in the file at that
alignment.  The words of the key phrase are looked up too, so every alignment that would be verified is found.  The share
of the template's words that stand at the aligned places is the match's score.

Base places are those where a phrase's words stand consecutively.  ``labels`` are the base labels and those of verified
templates; ``score`` is 1 if there is a base place, else the best verified share, else 0.  Null and empty texts have no
words, no labels and score 0.  Repeated rows are scanned alike; repeated words of a phrase count at each place; a null
doc_id is kept as it is.  Texts of any length are scanned whole.  An empty table gives no rows; other columns, whatever
their names, take no part.  Words are compared by 64-bit hashes, that is with a chance of 2**-64 for each two words;
base places are compared with the words of the text besides, templates and their key phrases are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, ship, table
from .textwords import ALNUM_WORDS, Words, chunks, hash_words, window_hashes

#: phrase -> label of the base contract (fixed values)
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: (label, template text, mandatory key phrase); short openings of well-known licences and notices (fixed values)
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "person obtaining a copy"),
    ("mit", "released under the mit license", "mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "and or distribute"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain cc0", "public domain"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("proprietary", "this file is proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited", "proprietary and confidential"),
]
RAREST, MIN_STEP, MIN_SHARE = 8, 2, 0.5
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class TemplateIndex:
    """word hash -> postings (template, place); key phrases and base phrases as window hashes."""

    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> None:
        self.labels = [x for x, _, _ in templates]
        rows = [hash_words(t.split()) for _, t, _ in templates]
        self.rows = rows
        word = np.concatenate(rows)
        order = np.argsort(word, kind="stable")
        self.post_word = word[order]
        self.post_template = np.repeat(np.arange(len(rows)), [len(x) for x in rows])[order]
        self.post_place = np.concatenate([np.arange(len(x)) for x in rows])[order]
        self.vocabulary = np.unique(word)
        self.key = []  # (place in the template, words)
        for (_, text, phrase), row in zip(templates, rows, strict=True):
            words, own = phrase.split(), text.split()
            at = next(i for i in range(len(own)) if own[i : i + len(words)] == words)
            self.key.append((at, row[at : at + len(words)]))
        self.need = np.array([min(MIN_STEP, len(words)) for _, words in self.key])
        self.look_up(np.zeros(len(self.vocabulary)))
        self.base = [(p.encode().split(), window_hashes(hash_words(p.split()), len(p.split()))[0], label) for p, label in base.items()]
        self.known = np.zeros(1 << 16, dtype=bool)
        self.known[self.vocabulary >> np.uint64(48)] = True

    def look_up(self, idf: np.ndarray) -> None:
        """Chooses the postings in use: of each template, its words of highest ``idf`` and those of its key phrase."""
        use = np.zeros(len(self.post_word), dtype=bool)
        for t, (row, (_, key)) in enumerate(zip(self.rows, self.key, strict=True)):
            own = np.searchsorted(self.vocabulary, np.unique(row))
            rare = self.vocabulary[own[np.lexsort((own, -idf[own]))][:RAREST]]
            use |= (self.post_template == t) & np.isin(self.post_word, np.concatenate((rare, key)))
        self.use_word, self.use_template, self.use_place = self.post_word[use], self.post_template[use], self.post_place[use]
        self.used = np.isin(self.vocabulary, self.use_word)

    def template_words(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word place, vocabulary number) of the chunk's words that are in some template."""
        at = np.flatnonzero(self.known[w.hash >> np.uint64(48)])
        v = np.minimum(np.searchsorted(self.vocabulary, w.hash[at]), len(self.vocabulary) - 1)
        ok = self.vocabulary[v] == w.hash[at]
        return at[ok], v[ok]

    def verified(self, words: np.ndarray, place: np.ndarray, vocab: np.ndarray) -> dict[str, float]:
        """Labels of the templates found in one file, with their scores. place, vocab: its template words that are looked up."""
        hashes = self.vocabulary[vocab]
        lo, hi = np.searchsorted(self.use_word, hashes, "left"), np.searchsorted(self.use_word, hashes, "right")
        n = hi - lo
        flat = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shift = np.repeat(place, n) - self.use_place[flat]
        pairs, votes = np.unique((self.use_template[flat] << 40) + shift + (1 << 39), return_counts=True)
        template, shift = pairs >> 40, (pairs & ((1 << 40) - 1)) - (1 << 39)
        enough = votes >= self.need[template]
        found: dict[str, float] = {}
        for t, at in zip(template[enough].tolist(), shift[enough].tolist(), strict=True):
            offset, key = self.key[t]
            a = at + offset
            if a < 0 or not np.array_equal(words[a : a + len(key)], key):
                continue
            row = self.rows[t]
            lo_, hi_ = max(0, -at), min(len(row), len(words) - at)
            share = float((row[lo_:hi_] == words[at + lo_ : at + hi_]).sum()) / len(row)
            if share >= MIN_SHARE:
                found[self.labels[t]] = max(found.get(self.labels[t], 0.0), share)
        return found


def template_idf(docs: DataFrame, index: TemplateIndex, **columns: str) -> np.ndarray:
    """Inverse document frequency of each template word, over all documents."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_seen = np.zeros(len(shared.value.vocabulary), np.int64), 0
        for part, texts in chunks(batches):
            w = Words(texts, ALNUM_WORDS, True)
            at, v = shared.value.template_words(w)
            doc = np.searchsorted(w.first, at, side="right") - 1
            total += np.bincount(np.unique(doc * len(total) + v) % len(total), minlength=len(total))
            docs_seen += part.num_rows
        n = np.append(total, docs_seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["word", "n"])

    n = {r.word: r.n for r in id_and_text(docs, **columns).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    size = len(index.vocabulary)
    return np.log((1 + n.get(size, 0)) / (1 + np.array([n.get(i, 0) for i in range(size)])))


def scan_licenses(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per document: base places and labels, the labels of verified templates, a score."""
    spark = docs.sparkSession
    ship(spark)
    index = TemplateIndex()
    index.look_up(template_idf(docs, index, **columns))
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part, texts in chunks(batches):
            w = Words(texts, ALNUM_WORDS, True)
            size = part.num_rows
            n, low, high = np.zeros(size, np.int64), np.full(size, 2**62), np.full(size, -1)
            base: list[set] = [set() for _ in range(size)]
            for words, phrase, label in index.base:
                k = len(words)
                at, h = w.windows(k)
                at = at[h == phrase]
                at = at[[w.text(a, a + k) == words for a in at.tolist()]] if len(at) else at
                doc = np.searchsorted(w.first, at, side="right") - 1
                np.add.at(n, doc, 1)
                np.minimum.at(low, doc, at - w.first[doc])
                np.maximum.at(high, doc, at - w.first[doc])
                for d in np.unique(doc).tolist():
                    base[d].add(label)
            labels, score = [set(x) for x in base], [1.0 if x else 0.0 for x in base]
            at, v = index.template_words(w)
            at, v = at[index.used[v]], v[index.used[v]]
            doc = np.searchsorted(w.first, at, side="right") - 1
            for d in np.unique(doc).tolist():
                own = doc == d if size < 2 else slice(*np.searchsorted(doc, [d, d + 1]))
                found = index.verified(w.hash[w.first[d] : w.first[d + 1]], at[own] - w.first[d], v[own])
                labels[d] |= found.keys()
                score[d] = max([score[d], *found.values()])
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(w.counts()), pa.array(n), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score, pa.float64())],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return id_and_text(docs, **columns).mapInArrow(run, RESULT)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
