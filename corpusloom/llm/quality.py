"""Quality filter by importance resampling.

Two generative models over hashed n-grams of tokens: one of all documents (raw) and one of the
documents that are labelled good (target). A document's weight is the log ratio of its n-grams'
probabilities. Gumbel top-k over the weights draws k documents without replacement; k is the
expected number of documents of the target, sum(min(1, share * ratio)) over all of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, row_key, uniform, without, written

BUCKETS, PRIOR = 1 << 14, 50.0
#: The target's model is fitted on at most so many documents labelled good, drawn by a hash of the id.
MAX_TARGET_DOCS = 1 << 15
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the single tokens and of the pairs of neighbours of a whole text; tokens are runs of word or of other characters."""
    if not text:
        return np.zeros(0, np.int64)
    tokens = _TOKEN.findall(text.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens)) * np.uint64(0x9E3779B97F4A7C15)
    pairs = (h[:-1] ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD) + h[1:] * np.uint64(0xC4CEB9FE1A85EC53)
    both = np.concatenate((h, pairs))
    return ((both ^ (both >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % buckets


def count_ngrams(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Counts of all n-grams: (bucket, raw, target), from (text, target boolean). One partial count vector a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"], batch["target"]):
                got = ngram_buckets(text, buckets)
                np.add.at(total[0], got, 1)
                if target:
                    np.add.at(total[1], got, 1)
        used = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": used, "raw": total[0][used], "target": total[1][used]})

    return texts.mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))


class Model:
    """Log ratios by bucket, and the share of good documents among labelled ones."""

    def __init__(self, ratios: np.ndarray, share: float):
        self.ratios, self.share = ratios, share

    def weight(self, text: str | None) -> float:
        got = ngram_buckets(text, len(self.ratios))
        return float(self.ratios[got].sum())


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, max_target_docs: int = MAX_TARGET_DOCS) -> Model:
    """Raw counts cover all documents, the share all labels. The target's counts cover the documents labelled
    good, of which a hash draws at most ``max_target_docs``: their ids are broadcast, so that no text is
    shuffled. The target's model has a prior of ``prior`` counts a bucket that is centred on the raw model, so
    that a bucket nobody has seen weighs 0. The driver gets one row a bucket. Without documents or labelled
    good ones all ratios are 0."""
    # labels: one row a document; if several, it is good if any says so
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = good.agg(F.count("quality").alias("n"), F.sum("quality").alias("good")).first()
    rate = min(1.0, 0.9 * max_target_docs / max(known.good or 0, 1))
    drawn = good.where((F.col("quality") == 1) & (uniform(F.col("doc_id"), F.lit(5)) < rate)).select("doc_id").limit(max_target_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id", "left_semi").select("text", F.lit(True).alias("target"))
    rows = count_ngrams(docs.select("text", F.lit(False).alias("target")), buckets).select("bucket", "raw", F.lit(0).cast("long").alias("target")).unionByName(
        count_ngrams(texts, buckets).select("bucket", F.lit(0).cast("long").alias("raw"), "target")).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = rows.toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[got["bucket"]], target[got["bucket"]] = got["raw"], got["target"]
    if not raw.sum() or not target.sum():
        return Model(np.zeros(buckets), 1.0)
    expected = raw / raw.sum() * target.sum()
    return Model(np.log((target + prior) / (expected + prior)), (known.good or 0) / max(known.n, 1))


def _weights(broadcast):
    @F.pandas_udf("double")
    def weights(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = broadcast.value
        for texts in batches:
            yield pd.Series([model.weight(t) for t in texts], dtype=float)

    return weights


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, row_key, weight, key): key is the weight plus Gumbel noise, which depends on id and text only.

    Null and empty texts have weight 0; repeated rows have equal keys; other columns play no part.
    """
    weights = _weights(docs.sparkSession.sparkContext.broadcast(model))
    text, doc_id = docs[quoted("text")], docs[quoted("doc_id")]
    rows = docs.select(doc_id.alias("doc_id"), row_key(docs).alias("row_key"), weights(text).alias("weight"), uniform(doc_id, F.xxhash64(text), F.lit(4)).alias("u"))
    return rows.select("doc_id", "row_key", "weight", (F.col("weight") - F.log(-F.log("u"))).alias("key"))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest value of a double column, exactly: histograms of ever smaller ranges, of which the driver gets the counts only."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while True:
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        if not width or low + width == low:
            return high
        counts = {r.b: r for r in inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("b")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b].n:
                break
            k -= counts[b].n
        low, high, n = counts[b].low, counts[b].high, counts[b].n
        if low == high:
            return low
        if n <= few:
            values = sorted((r[0] for r in rows.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()), reverse=True)
            return values[k - 1]


def resample(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, weight, key, kept) of all documents, and ``docs`` restricted to the drawn ones.

    Null and empty texts have weight 0. Rows with equal id and text have equal keys and share their
    fate: at the last place all of them are drawn. Without documents nothing is drawn, without
    labelled good ones everything is. Texts are scored once; the rows to keep are then told by their keys, without a
    shuffle. Further columns may have any names.
    """
    model = fit(docs, labels, buckets, prior)
    scores = written(scored(docs, model), "quality")
    k = scores.agg(F.sum(F.least(F.lit(1.0), F.lit(model.share) * F.exp(F.least("weight", F.lit(50.0)))))).first()[0] or 0.0
    cut = kth_largest(scores, "key", int(round(k)))
    drawn = F.col("key") >= F.lit(cut)
    surely, looked_up = without(
        docs, row_key(docs), scores.where(~drawn).select(F.col("row_key").alias("key")), scores.where(drawn).select(F.col("row_key").alias("key")))
    return scores.select("doc_id", "weight", "key", drawn.alias("kept")), surely.union(looked_up)
