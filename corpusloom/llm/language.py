"""Language identification by a convolutional network over bytes, trained with numpy.

The lower-cased text is cut into windows of 256 bytes, with runs of anything but letters turned into
one blank. Filters of widths 2, 3 and 4 run over embedded bytes; the largest response of each filter
in a window feeds a softmax. A document's prediction is the mean over all its windows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, quoted, written

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 12, 8
#: Bounds of the training sample, in documents and in windows of a language.
MAX_TRAIN_DOCS, MAX_TRAIN_WINDOWS, MAX_TRAIN_BYTES = 1500, 3000, 64 << 20
MAX_LANGUAGES = 1000


_OTHER = re.compile(r"[\W\d_]+")


@functools.cache
def _numbers() -> frozenset[str]:
    """Word characters that are numbers and no digits, like ``½``, ``²`` or ``Ⅷ``."""
    return frozenset(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("Nl", "No"))


def letters_of(text: str | None) -> bytes:
    """The letters (general category L) of a whole text, lower-cased, with one blank for anything between; empty if it has none."""
    if not text:
        return b""
    out = _OTHER.sub(" ", text.lower())
    if not out.isascii() and (found := _numbers().intersection(out)):
        out = _OTHER.sub(" ", out.translate(dict.fromkeys(map(ord, found), " ")))
    return out.strip().encode("utf-8", "replace")


def windows_of(data: bytes, window: int = WINDOW) -> np.ndarray:
    """Windows over all the bytes; the last one ends with the text. Short texts are filled with blanks."""
    if len(data) < window:
        return np.frombuffer(data.ljust(window), np.uint8)[None, :]
    n = -(-len(data) // window)
    starts = [min(i * window, len(data) - window) for i in range(n)]
    a = np.frombuffer(data, np.uint8)
    return np.stack([a[s : s + window] for s in starts])


class ByteCnn:
    """Embedding (256 x DIM), one bank of FILTERS for each width, and a softmax over their largest responses.

    All filters look at the widest span; ``mask`` keeps a narrow filter's weights beyond its width at 0,
    so that one matrix product gives all responses.
    """

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.span, n = languages, max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.concatenate([np.tile(np.arange(self.span * DIM)[:, None] < w * DIM, FILTERS) for w in WIDTHS], 1)
        width = np.repeat(WIDTHS, FILTERS)
        self.p = {
            "E": rng.normal(0, 0.5, (256, DIM)), "W": rng.normal(0, 1, (self.span * DIM, n)) * (2 / (width * DIM)) ** 0.5 * self.mask,
            "b": np.zeros(n), "V": rng.normal(0, 0.1, (n, len(languages))), "c": np.zeros(len(languages)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """Embeddings of every span: (windows, places, span * DIM)."""
        e = np.take(self.p["E"], x, axis=0).reshape(len(x), -1)
        step = e.itemsize
        shape = (len(x), x.shape[1] - self.span + 1, self.span * DIM)
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, shape, (e.strides[0], DIM * step, step)))

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.p["V"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on the cross entropy; only the place of a filter's largest response passes a gradient on."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                i = order[s : s + batch]
                cols = self._columns(x[i])
                r = (cols.reshape(-1, cols.shape[2]) @ self.p["W"]).reshape(*cols.shape[:2], -1)
                at = r.argmax(1)
                best = np.take_along_axis(r, at[:, None], 1)[:, 0] + self.p["b"]
                h = np.maximum(best, 0)
                d = self._softmax(h)
                d[np.arange(len(i)), y[i]] -= 1
                d /= len(i)
                dr = d @ self.p["V"].T * (best > 0)
                seen = np.take_along_axis(cols, at[:, :, None], 1)
                g = {"V": h.T @ d + 1e-4 * self.p["V"], "c": d.sum(0), "b": dr.sum(0), "E": np.zeros_like(self.p["E"]),
                     "W": np.einsum("bf,bfk->kf", dr, seen) * self.mask}
                de = dr[:, :, None] * self.p["W"].T[None]
                for j in range(self.span):
                    np.add.at(g["E"], np.take_along_axis(x[i], at + j, 1), de[:, :, j * DIM : (j + 1) * DIM])
                step += 1
                lr = rate * (1 - epoch / epochs) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v2[k] += 0.001 * (g[k] ** 2 - v2[k])
                    self.p[k] -= (lr * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)

    def probabilities(self, x: np.ndarray, batch: int = 32) -> np.ndarray:
        out = []
        for s in range(0, len(x), batch):
            cols = self._columns(x[s : s + batch])
            r = (cols.reshape(-1, cols.shape[2]) @ self.p["W"]).reshape(*cols.shape[:2], -1)
            out.append(self._softmax(np.maximum(r.max(1) + self.p["b"], 0)))
        return np.concatenate(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        data = letters_of(text)
        if not data or not self.languages:
            return "und", 0.0
        x = windows_of(data)
        mean = sum(self.probabilities(x[s : s + 4096]).sum(0) for s in range(0, len(x), 4096)) / len(x)
        best = int(mean.argmax())
        return self.languages[best], float(min(1.0, mean[best]))


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_windows: int = MAX_TRAIN_WINDOWS, max_bytes: int = MAX_TRAIN_BYTES, max_languages: int = MAX_LANGUAGES) -> ByteCnn:
    """Fits on text and lang of documents with a language that are not held out.

    The sample is bounded: about ``max_docs`` documents of each language, drawn by a hash of the text, four windows of
    each (spread over the whole text; equal ones count once), ``max_windows`` windows a language and about ``max_bytes``
    in all, drawn by a hash of the window. Only the ``max_languages`` most frequent languages are learned; of equally
    frequent ones those that sort first. Reruns fit the same model.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, min(1.0, max_docs / n)).otherwise(rate)
    u = F.shiftrightunsigned(F.xxhash64("text"), 12).cast("double") / float(1 << 52)

    @F.pandas_udf("array<binary>")
    def some(texts: pd.Series) -> pd.Series:
        def pick(text):
            x = windows_of(letters_of(text))
            return [x[i].tobytes() for i in sorted({0, len(x) // 3, 2 * len(x) // 3, len(x) - 1})] if letters_of(text) else []

        return texts.map(pick)

    sample = rows.where(u < rate).select("lang", F.explode(some("text")).alias("w")).distinct()
    sample = written(sample, "windows")
    n, limit = sample.count(), max(1, max_bytes // WINDOW)
    part = F.shiftrightunsigned(F.xxhash64("w", "lang"), 12).cast("double") / float(1 << 52) < (min(1.0, 0.9 * limit / n) if n else 1.0)
    got = sorted((r.lang, bytes(r.w)) for r in sample.where(part).collect())
    languages = sorted({lang for lang, _ in got})
    model = ByteCnn(languages)
    x, y, rng = [], [], np.random.default_rng(5)
    for k, lang in enumerate(languages):
        own = [w for g, w in got if g == lang]
        take = rng.permutation(len(own))[:max_windows]
        x += [np.frombuffer(own[i], np.uint8) for i in take]
        y += [k] * len(take)
    if x:
        model.fit(np.stack(x), np.array(y))
    return model


def _predict(broadcast):
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = broadcast.value
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row a document, repeated rows included.

    Null texts and texts without a letter (general category L) are ``und`` with score 0; so is everything if there was
    nothing to learn from. Equal texts have equal predictions; of equal probabilities the language that sorts first
    wins. Other columns play no part, so none can clash.
    """
    predict = _predict(docs.sparkSession.sparkContext.broadcast(model))
    return docs.select("doc_id", held_out(docs[quoted("doc_id")]).alias("held_out"), predict(docs[quoted("text")]).alias("p")).select("doc_id", "held_out", "p.*")
