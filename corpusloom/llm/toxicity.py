"""Toxicity by ordinal regression with a cumulative link.

Grades of severity are 0 (not toxic), 1 (toxic) and 2 (severe). P(grade >= k) = sigmoid(w.x - t_k):
one weight vector for all thresholds t_1 <= t_2. Features are words of the whole text: log(1 + count)
of those that the labelled sample ties to toxicity. The expected severity is the sum of both
probabilities; a document is rejected if P(grade >= 1) is at least 1/2.

Labels only say toxic or not, so grade 2 is a stand-in: a toxic document of the sample counts as severe if the sum of
its features is above the median of the toxic ones. Give ``fit_ordinal`` grades of one's own where there are some.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import alnum_words, free_name, held_out, quoted

#: Bounds of the labelled sample: documents of either kind, features, bytes of a text, and bytes of all texts of a kind.
MAX_TRAIN_DOCS, MAX_FEATURES, MAX_TEXT_BYTES, MAX_SAMPLE_BYTES = 4000, 512, 1 << 20, 32 << 20


@dataclass
class OrdinalModel:
    features: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([20.0, 20.0]))

    def vector(self, words: list[bytes] | dict[bytes, int]) -> dict[int, float]:
        """log(1 + count) of each feature that stands in the document, of its words or their counts."""
        if isinstance(words, dict):
            return {i: float(np.log1p(words[w])) for w, i in self.features.items() if w in words}
        present = self.features.keys() & set(words)
        if not present:
            return {}
        counts = Counter(w for w in words if w in present)
        return {self.features[w]: float(np.log1p(c)) for w, c in counts.items()}

    def grades(self, text: str | None) -> tuple[float, float]:
        """P(grade >= 1) and P(grade >= 2)."""
        z = sum(self.weights[i] * v for i, v in self.vector(alnum_words(text)).items())
        p = 1 / (1 + np.exp(-np.clip(z - self.thresholds, -40, 40)))
        return float(p[0]), float(p[1])


def choose_features(toxic: list[Iterable[bytes]], clean: list[Iterable[bytes]], most: int, least: float = 4.5) -> list[bytes]:
    """Words that stand in toxic documents more often, by the signed root of the likelihood ratio; those from ``least`` on."""
    a, b = Counter(w for ws in toxic for w in ws), Counter(w for ws in clean for w in ws)
    na, nb = len(toxic), len(clean)

    def part(x: float, n: float, p: float) -> float:
        return (x * np.log(x / (n * p)) if x else 0.0) + ((n - x) * np.log((n - x) / (n * (1 - p))) if n > x else 0.0)

    def root(w: bytes) -> float:
        x, y = a[w], b[w]
        p = (x + y) / (na + nb)
        if not 0 < p < 1 or x * nb <= y * na:
            return 0.0
        return float(np.sqrt(max(0.0, 2 * (part(x, na, p) + part(y, nb, p)))))

    scored = sorted(((root(w), w) for w in a if a[w] >= 2), key=lambda s: (-s[0], s[1]))
    return [w for s, w in scored if s >= least][:most]


def one_of_copies(rows: Iterable[tuple[int, Iterable[bytes]]]) -> list[tuple[int, dict[bytes, int]]]:
    """One document of each label and set of words, as counts of its words, so that copies do not count as evidence.

    Equal words of all documents are one object, so the sample takes little more memory than its vocabulary."""
    seen, words_, out = set(), {}, []
    for label, words in rows:
        counts = Counter(words)
        key = (label, hashlib.sha1(b" ".join(sorted(counts))).digest())
        if key not in seen:
            seen.add(key)
            out.append((label, {words_.setdefault(w, w): n for w, n in counts.items()}))
    return out


def fit_ordinal(x: np.ndarray, grades: np.ndarray, weight: np.ndarray, steps: int = 1500, rate: float = 0.1, ridge: float = 1e-5):
    """Adam on the negative log likelihood of the cumulative model; thresholds are a start and a positive step."""
    w, start, step = np.zeros(x.shape[1]), 0.0, 0.0
    params = np.concatenate((w, [start, step]))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for i in range(1, steps + 1):
        w, t1 = params[:-2], params[-2]
        gap = np.exp(np.clip(params[-1], -20, 5))
        z = x @ w
        g = np.zeros_like(params)
        low, high = np.logaddexp(0, z - t1), np.logaddexp(0, z - t1 - gap)
        p1, p2, apart = np.exp(z - t1 - low), np.exp(z - t1 - gap - high), -np.expm1(-gap)
        # grade 0: log(1 - p1); grade 1: log(p1 - p2), where p1 - p2 = p1 * (1 - p2) * apart; grade 2: log(p2)
        dz = weight * np.select([grades < 1, grades < 2], [p1, p1 + p2 - 1], p2 - 1)
        dt = [
            (weight * np.select([grades < 1, grades < 2], [-p1, np.exp(high - low) / apart], 0)).sum(),
            (weight * np.select([grades < 1, grades < 2], [0, -np.exp(low - high - gap) / apart], 1 - p2)).sum()]
        g[:-2] = x.T @ dz / weight.sum() + ridge * w
        g[-2] = (dt[0] + dt[1]) / weight.sum()
        g[-1] = dt[1] * gap / weight.sum()
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return params[:-2], np.array([params[-2], params[-2] + np.exp(np.clip(params[-1], -20, 5))])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_features: int = MAX_FEATURES, max_text_bytes: int = MAX_TEXT_BYTES, keep_out: bool = True, max_bytes: int = MAX_SAMPLE_BYTES) -> OrdinalModel:
    """Fits on a bounded sample: at most ``max_docs`` labelled toxic and as many other documents, drawn by a hash of the
    id, as long as their texts have at most ``max_bytes`` together for either kind, which is all that comes to the
    driver. Texts over ``max_text_bytes`` are not learned from, and texts of one label with equal sets of words count
    once. Documents whose id's crc32 is divisible by 5 are left out for measuring, unless ``keep_out`` is false.

    Of several labels of an id the highest counts; of several texts of an id the shortest, then that of the smallest
    hash; null ids, labels and texts are not learned from. With no toxic label nothing is toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= max_text_bytes)
    if keep_out:
        rows = rows.where(~held_out(F.col("doc_id")))
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 12).cast("double") / float(1 << 52)
    rate = F.lit(0.0)
    for toxic, n in counts.items():
        rate = F.when(F.col("toxic") == toxic, min(1.0, 0.9 * max_docs / n)).otherwise(rate)
    drawn = known.where(u < rate).limit(2 * max_docs)  # bounded, so it is broadcast and no text is shuffled
    sizes = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("k"))).alias("t"))
    upto = F.sum("t.n").over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))  # of at most 2 * max_docs rows
    chosen = sizes.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("doc_id", "toxic", "t.k")
    got = rows.join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("k")).groupBy("doc_id", "toxic").agg(F.first("text").alias("text")).toLocalIterator()
    texts = sorted((r.toxic, r.text) for r in got)
    sets = one_of_copies((t, alnum_words(x)) for t, x in texts)
    del texts
    toxic, clean = [w.keys() for t, w in sets if t], [w.keys() for t, w in sets if not t]
    features = choose_features(toxic, clean, max_features)
    if not features:
        return OrdinalModel()
    model = OrdinalModel({w: i for i, w in enumerate(features)})
    x = np.zeros((len(sets), len(features)))
    for i, (_, words) in enumerate(sets):
        for j, value in model.vector(words).items():
            x[i, j] = value
    y = np.array([t for t, _ in sets])
    mass = x.sum(1)
    grades = np.where(y > 0, 1 + (mass > np.median(mass[y > 0])), 0)
    # each kind weighs as much as it does among all labels, not as in the sample
    n = [(y == 0).sum(), (y > 0).sum()]
    weight = np.where(y > 0, counts.get(1, 0) / max(1, n[1]), counts.get(0, 0) / max(1, n[0]))
    model.weights, model.thresholds = fit_ordinal(x, grades, weight)
    return model


def _severity(broadcast):
    @F.pandas_udf("severity double, p_toxic double, p_severe double, grade int, toxic boolean")
    def severity(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = broadcast.value
        for texts in batches:
            p = np.array([model.grades(t) for t in texts]).reshape(-1, 2)
            yield pd.DataFrame({"severity": p.sum(1), "p_toxic": p[:, 0], "p_severe": p[:, 1], "grade": (p >= 0.5).sum(1).astype("int32"), "toxic": p[:, 0] >= 0.5})

    return severity


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with a last column (severity from 0 to 2, p_toxic, p_severe, grade, toxic), named ``__toxicity`` with
    as many underscores after it as it takes to clash with no other.

    Null and empty texts have no features, so they have the score of a text without a toxic word; equal texts have
    equal scores, repeated rows stay; an empty table gives no rows.
    """
    return docs.withColumn(free_name(docs, "toxicity"), _severity(docs.sparkSession.sparkContext.broadcast(model))(docs[quoted("text")]))


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` without those with P(grade >= 1) of 1/2 or more."""
    scored = score(docs, model)
    return scored.where(~F.col(scored.columns[-1])["toxic"]).select(*[F.col(quoted(c)) for c in docs.columns])
