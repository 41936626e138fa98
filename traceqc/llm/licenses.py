"""License scans by a positional index of rare licence words.

Templates are paragraphs of licences and the short lines that name one. A first pass over the corpus counts the documents
that hold each template word (as many counts as the templates have words), which gives the words' inverse document
frequencies. The index posts each template's rarest words with their places. In a second pass a document is looked up by
its own highest-IDF words: of the words that it shares with a template, the ``rare_words`` rarest. Each of their places
votes for a placement of the template (place in the document minus place in the template); words that agree in
their relative position vote for the same placement. A placement with enough of the template's IDF weight gives the
template's label if one of its mandatory phrases stands there word for word.

Texts are read whole, in vectorised slices; counts and index have the size of the templates (checked), whatever the
corpus.

Defined results: a null or empty text has no words, no places and score 0; repeated rows are scanned one by one, and counted
each; words of equal frequency rank by their first place in the template; very long texts are scanned whole; an empty
table gives an empty result; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceqc.llm import grams
from traceqc.llm.common import table

#: Base phrases and their labels, as the contract fixes them.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, mandatory phrases (``;`` between them) and the words of a paragraph (fixed values: texts of public licences).
TEMPLATE_TEXT = """
mit | mit license | released under the mit license
mit | mit license | this project is licensed under the terms of the mit license
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | included in all copies or substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | with or without fee is hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
bsd | bsd license | licensed under the bsd license
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | must retain the above copyright notice | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | must reproduce the above copyright notice | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-3-clause | endorse or promote products derived | neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
apache-2.0 | apache license | licensed under the apache license version 2 0
apache-2.0 | apache license | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0 | as is basis without warranties or conditions | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
gpl-3.0 | gnu general public license version 3 | this work is licensed under the gnu general public license version 3
gpl | gnu general public license as published | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl | see the gnu general public license | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
lgpl | lesser general public license | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation
agpl | affero general public license | it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
epl | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license
bsl-1.0 | boost software license | distributed under the boost software license version 1 0
zlib | freely subject to the following restrictions | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
cc0 | cc0 | dedicated to the public domain under cc0 1 0 universal
cc-by | creative commons attribution | this work is licensed under a creative commons attribution 4 0 international license
cc-by-sa | creative commons attribution sharealike;creative commons attribution share alike | this work is licensed under a creative commons attribution sharealike 4 0 international license
cc-by-nc | creative commons attribution noncommercial;creative commons attribution non commercial | this work is licensed under a creative commons attribution noncommercial 4 0 international license
cc-by-nc | cc by nc | licensed under cc by nc 4 0
cc-by-sa | cc by sa | licensed under cc by sa 4 0
wtfpl | do what the fuck you want | do what the fuck you want to public license
"""

TEMPLATES = [(label, text, must.split(";")) for label, must, text in (row.split(" | ") for row in TEMPLATE_TEXT.strip().split("\n"))]


@dataclass(frozen=True)
class Scan:
    """Words of a template that are posted, words of a document that look up a template, and the share of the weight of
    the template's ``rare_words`` rarest words that a placement must collect."""

    posted_words: int = 16
    rare_words: int = 6
    min_share: float = 0.5
    slack: int = 2  # words by which places may differ from the template
    max_template_words: int = 100_000


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return grams.words(data, np.array([0, len(data)]), grams.alnum_table()).hash


def idf_of(held: Mapping[int, int], total: int, word: int) -> float:
    """Inverse document frequency, above 0 also for a word that all of ``total`` documents hold."""
    return math.log(1 + total / (1 + held.get(word, 0)))


class Index:
    """The templates' rare words as arrays sorted by word hash: template, place and weight."""

    def __init__(self, base: dict, templates: list, scan: Scan, held: Mapping[int, int] | None = None, total: int = 0):
        self.scan = scan
        self.labels = [label for label, _, _ in templates]
        texts = [word_hashes(t) for _, t, _ in templates]
        if sum(map(len, texts)) > scan.max_template_words:
            raise ValueError("the templates are too long for one index")
        self.vocabulary = np.unique(np.concatenate([*texts, np.zeros(0, np.uint64)]))
        idf = {h: idf_of(held or {}, total, h) for h in self.vocabulary.tolist()}
        posts = []
        self.weight = np.zeros(len(texts))
        for k, t in enumerate(texts):
            words = t.tolist()
            rare = sorted(set(words), key=lambda h: (-idf[h], words.index(h)))
            rank = {h: r for r, h in enumerate(rare[: scan.posted_words])}
            posts += [(h, k, place, idf[h], rank[h]) for place, h in enumerate(words) if h in rank]
            self.weight[k] = sum(idf[h] for h in rare[: scan.rare_words])
        posts.sort()
        self.word = np.array([p[0] for p in posts], np.uint64)
        self.template = np.array([p[1] for p in posts])
        self.place = np.array([p[2] for p in posts])
        self.idf = np.array([p[3] for p in posts])
        self.rank = np.array([p[4] for p in posts])
        self.length = np.array([len(t) for t in texts])
        self.phrases = [[word_hashes(p) for p in must] for _, _, must in templates]
        self.base = [(label, word_hashes(p)) for p, label in base.items()]
        first = {int(p[0]) for p in self.phrases_all()} | {int(p[0]) for _, p in self.base}
        known = np.array(sorted(first | {int(h) for h in self.word}), np.uint64)
        self.known = known
        # a table over 16 bits of the hash tells almost all other words apart at once
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(known >> np.uint64(48)).astype(np.int64)] = True

    def phrases_all(self):
        return [p for must in self.phrases for p in must]

    def places(self, w: np.ndarray, at: np.ndarray, phrase: np.ndarray, doc_end: np.ndarray) -> np.ndarray:
        """Of the places ``at``, those where the whole phrase stands before the end of its document."""
        at = at[(w[at] == phrase[0]) & (at + len(phrase) <= doc_end[at])] if len(at) else at
        for k in range(1, len(phrase)):
            at = at[w[at + k] == phrase[k]]
        return at

    def scan_words(self, w: grams.Words) -> list[list]:
        """Columns of the result for the documents of ``w``."""
        n = len(w.first) - 1
        at = np.flatnonzero(self.maybe[(w.hash >> np.uint64(48)).astype(np.int64)])
        at = at[np.isin(w.hash[at], self.known)]
        doc_of = np.searchsorted(w.first, at, "right") - 1
        limit = np.zeros(len(w.hash), np.int64)
        limit[at] = w.first[doc_of + 1]
        doc_at = np.zeros(len(w.hash), np.int64)
        doc_at[at] = doc_of
        n_base, firsts, lasts = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: dict[int, set] = defaultdict(set)
        for label, phrase in self.base:
            hits = self.places(w.hash, at, phrase, limit)
            d, local = doc_at[hits], hits - w.first[doc_at[hits]]
            np.add.at(n_base, d, 1)
            np.minimum.at(firsts, d, local)
            np.maximum.at(lasts, d, local)
            for x in set(d.tolist()):
                base[x].add(label)
        own, score = self.method(w, at, limit, doc_at)
        labels = [",".join(sorted(base[d] | own[d])) for d in range(n)]
        empty = n_base == 0
        return [
            np.diff(w.first),
            n_base,
            [None if e else int(x) for e, x in zip(empty, firsts)],
            [None if e else int(x) for e, x in zip(empty, lasts)],
            [",".join(sorted(base[d])) for d in range(n)],
            labels,
            [max(score[d], 1.0 if base[d] else 0.0) for d in range(n)],
        ]

    def method(self, w: grams.Words, at: np.ndarray, limit: np.ndarray, doc_at: np.ndarray):
        """Labels and the best share by placement votes, for each document that has any."""
        own: dict[int, set] = defaultdict(set)
        score: dict[int, float] = defaultdict(float)
        lo, hi = np.searchsorted(self.word, w.hash[at]), np.searchsorted(self.word, w.hash[at], "right")
        times = hi - lo
        posts = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        if not len(posts):
            return own, score
        place = np.repeat(at, times)
        # of the words that a document shares with a template, the rarest ones look it up
        kind = doc_at[place] * len(self.labels) + self.template[posts]
        pair = np.unique(kind * self.scan.posted_words + self.rank[posts])
        own_kind = pair // self.scan.posted_words
        head = np.searchsorted(own_kind, own_kind)
        chosen = pair[np.arange(len(pair)) - head < self.scan.rare_words]
        looked = np.isin(kind * self.scan.posted_words + self.rank[posts], chosen)
        posts, place = posts[looked], place[looked]
        doc, template, shift = doc_at[place], self.template[posts], place - self.place[posts]
        # votes of a template in a document, by shift; those less than the slack apart are one placement
        order = np.lexsort((shift, template, doc))
        doc, template, shift, word, idf = doc[order], template[order], shift[order], w.hash[place][order], self.idf[posts][order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (template[1:] != template[:-1]) | (shift[1:] - shift[:-1] > self.scan.slack)
        group = np.cumsum(new) - 1
        # a word counts once for a placement
        pair = np.lexsort((word, group))
        once = np.ones(len(pair), bool)
        once[1:] = (group[pair][1:] != group[pair][:-1]) | (word[pair][1:] != word[pair][:-1])
        gained = np.bincount(group[pair][once], idf[pair][once], group[-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(doc)) - 1
        share = gained / self.weight[template[heads]]
        group_doc, group_template = doc[heads], template[heads]
        begin = np.maximum(shift[heads] - self.scan.slack, w.first[group_doc])
        stop = np.minimum(shift[tails] + self.length[group_template] + self.scan.slack, w.first[group_doc + 1])
        for k, must in enumerate(self.phrases):
            found = np.sort(np.concatenate([self.places(w.hash, at, p, limit) for p in must]))
            mine = np.flatnonzero(group_template == k)
            if not len(found) or not len(mine):
                continue
            next_one = np.append(found, np.iinfo(np.int64).max)[np.searchsorted(found, begin[mine])]
            for g in mine[next_one < stop[mine]]:
                d = int(group_doc[g])
                score[d] = max(score[d], min(1.0, float(share[g])))
                if share[g] >= self.scan.min_share:
                    own[d].add(self.labels[k])
        return own, score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[dict[int, int], int]:
    """How many documents hold each word of ``vocabulary`` (of bounded size), and how many there are."""
    table_ = grams.alnum_table()
    # no word has the hash of the count of all rows
    all_rows = -1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, data, offsets in grams.sliced(batch):
                w = grams.words(data, offsets, table_)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) else np.zeros(0, np.int64)
                doc = np.searchsorted(w.first, hit, "right") - 1
                held += np.bincount(np.unique(doc * len(vocabulary) + at[hit]) % max(1, len(vocabulary)), minlength=len(vocabulary))
                rows += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(vocabulary)), all_rows)), pa.array(np.append(held, rows))], ["word", "n"])

    got = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in got}
    total = counts.pop(all_rows, 0)
    return {int(vocabulary[k]): n for k, n in counts.items()}, total


def scanned(docs: DataFrame, base: dict | None = None, templates: list | None = None, scan: Scan = Scan(), id_col: str = "doc_id") -> DataFrame:
    """Counts, labels and score of every document."""
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    held, total = document_counts(docs, Index(base, templates, scan).vocabulary)
    index = Index(base, templates, scan, held, total)
    table_ = grams.alnum_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in grams.sliced(batch):
                columns = index.scan_words(grams.words(data, offsets, table_))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], SCHEMA_NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
