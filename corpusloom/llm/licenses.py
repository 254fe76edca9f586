"""Licence scan by a positional index of rare tokens.

Templates are short, telling passages of licences. The index holds, for each template, the postings
(word, position) of its words with the highest inverse document frequency over all documents. A
file's words that are in the index vote for (template, position of the template in the file); where
enough different words agree, the template's words are compared there and its mandatory key phrases
are looked up. Base phrases are counted at every place where their words stand consecutively.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, quoted

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Templates (label, passage, key phrases of which all must stand in the matched place).
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl-2", "the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
)
RARE_WORDS, AGREE, LEAST = 5, 2, 0.7


def places(words: list[bytes], phrase: str) -> list[int]:
    """All word positions where the phrase's words stand consecutively."""
    joined, what, out = b" " + b" ".join(words) + b" ", b" " + phrase.encode() + b" ", []
    at, seen, n = joined.find(what), 0, 0
    while at >= 0:
        n += joined.count(b" ", seen, at)
        seen = at
        out.append(n)
        at = joined.find(what, at + 1)
    return out


class RareTokenIndex:
    """Postings of each template's rarest words. ``frequencies``: documents that have a word."""

    def __init__(self, frequencies: dict[bytes, int], templates=TEMPLATES, rare: int = RARE_WORDS, agree: int = AGREE, least: float = LEAST):
        self.templates = [(label, passage.encode().split(), keys) for label, passage, keys in templates]
        self.agree, self.least = agree, least
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            rarest = sorted(set(words), key=lambda w: (frequencies.get(w, 0), w))[:rare]
            for w in rarest:
                for i, x in enumerate(words):
                    if x == w:
                        self.postings[w].append((t, i))

    def matches(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, first word of the place, share of the template's words that stand there) of all verified places."""
        present = self.postings.keys() & set(words)
        if not present:
            return []
        votes: dict[tuple[int, int], set] = defaultdict(set)
        for i, w in enumerate(words):
            if w in present:
                for t, at in self.postings[w]:
                    votes[t, i - at].add(w)
        out = []
        for (t, start), agreeing in votes.items():
            label, passage, keys = self.templates[t]
            if len(agreeing) < min(self.agree, len(set(passage))):
                continue
            place = words[max(0, start) : start + len(passage)]
            there = words[start : start + len(passage)] if start >= 0 else [b""] * -start + place
            share = sum(a == b for a, b in zip(passage, there)) / len(passage)
            if share >= self.least and all(places(place, k) for k in keys):
                out.append((label, max(0, start), share))
        return sorted(out)


def vocabulary(templates=TEMPLATES) -> set[bytes]:
    return {w for _, passage, _ in templates for w in passage.encode().split()}


def word_frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """In how many documents, of all, each of the licence words stands. The driver gets a row a licence word."""
    listed = sorted(words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, total = set(listed), Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(wanted.intersection(alnum_words(text)))
        yield pd.DataFrame({"word": [w.decode() for w in total], "n": list(total.values())}, columns=["word", "n"]).astype({"word": object, "n": "int64"})

    rows = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in rows}


def _scan(broadcast, base):
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,word:bigint,share:double>>"

    @F.pandas_udf(schema)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = broadcast.value
        for texts in batches:
            rows = []
            for text in texts:
                words = alnum_words(text)
                found = {p: places(words, p) for p, _ in base}
                starts = [i for v in found.values() for i in v]
                labels = {label for p, label in base if found[p]}
                method = index.matches(words)
                every = labels | {m[0] for m in method}
                rows.append((
                    len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)),
                    max([1.0] * bool(starts) + [m[2] for m in method], default=0.0),
                    [{"label": a, "word": b, "share": c} for a, b, c in method],
                ))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches), one row a document.

    A null or empty text has no words, no places, empty label lists and score 0. Equal texts get equal
    results. The score is 1 where a base phrase stands, else the best share of a matched template.
    """
    index = RareTokenIndex(word_frequencies(docs, vocabulary(templates)), templates)
    scan = _scan(docs.sparkSession.sparkContext.broadcast(index), base)
    return docs.select("doc_id", scan(docs[quoted("text")]).alias("r")).select("doc_id", "r.*")
