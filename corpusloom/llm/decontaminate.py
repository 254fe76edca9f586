"""Benchmark decontamination by word windows.

The windows of the benchmark are broadcast while its text is below ``max_broadcast_bytes``; every
worker builds a hash bitmap of them, rolls a hash over each document's words and verifies every hit
of the bitmap on the words themselves. A larger benchmark is matched by a shuffle join on window
hashes, verified on the words too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, free_name, maybe_wanted, quoted, vectorized, written

WINDOW = 10
MAX_BROADCAST_BYTES = 4 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MULTIPLIERS = np.random.default_rng(20240).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows_of(words: list[bytes], n: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Every ``n`` consecutive words; fewer words, but not none, are one window."""
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [tuple(words)] if words else []


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive word hashes."""
    count = len(values) - n + 1
    h = np.zeros(max(count, 0), np.uint64)
    for k in range(n):
        h += values[k : k + count] * _MULTIPLIERS[k % 64]
    h ^= h >> np.uint64(29)
    h *= _MULTIPLIERS[0]
    return h ^ (h >> np.uint64(32))


class WindowIndex:
    """Windows by length: a bitmap of their hashes, and their words with the items that have them.

    Word hashes are Python's own, so an index serves the process that builds it only.
    """

    def __init__(self, items: list[tuple[object, str | None]], n: int = WINDOW):
        self.windows: dict[bytes, list] = defaultdict(list)
        lengths: dict[int, list] = defaultdict(list)
        for item_id, text in items:
            for w in set(windows_of(alnum_words(text), n)):
                key = b" ".join(w)
                if key not in self.windows:
                    lengths[len(w)].append(w)
                self.windows[key].append(item_id)
        self.bitmaps = {}
        for length, ws in lengths.items():
            bits = max(20, int(16 * len(ws) - 1).bit_length())
            bitmap = np.zeros(1 << bits, bool)
            for w in ws:
                bitmap[self.slot(rolling(self.hashes(list(w)), length), bits)] = True
            self.bitmaps[length] = (bits, bitmap)

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    @staticmethod
    def slot(h: np.ndarray, bits: int) -> np.ndarray:
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are inside an occurrence of a window, and the items that have one."""
        hit, found = np.zeros(len(words), bool), set()
        values = self.hashes(words)
        for length, (bits, bitmap) in self.bitmaps.items():
            if len(words) < length:
                continue
            for i in np.flatnonzero(bitmap[self.slot(rolling(values, length), bits)]):
                ids = self.windows.get(b" ".join(words[i : i + length]))
                if ids:
                    hit[i : i + length] = True
                    found.update(ids)
        return hit, found


def spans_of(hit: np.ndarray) -> list[list[int]]:
    """Runs of hit words as [first, after the last]."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of the spans and what stands between them; what is left is joined by one blank."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data)]
    parts, at = [], 0
    for first, after in spans:
        parts.append(data[at : places[first][0]])
        at = places[after - 1][1]
    parts = [p.decode("utf-8", "surrogatepass") for p in [*parts, data[at:]]]
    return " ".join(x for x in (p.strip() for p in parts) if x)


_RESULT = "n_words long, n_hit long, items array<string>, spans array<array<int>>"
_indexes: dict = {}


def _scan(broadcast, n):
    @F.pandas_udf(_RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = (id(broadcast), n)
        if key not in _indexes:
            _indexes.clear()
            _indexes[key] = (broadcast, WindowIndex(broadcast.value, n))
        index = _indexes[key][1]
        for texts in batches:
            rows = []
            for text in texts:
                words = alnum_words(text)
                hit, items = index.hits(words)
                rows.append((len(words), int(hit.sum()), sorted(str(i) for i in items if i is not None), spans_of(hit)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return scan


@vectorized("array<struct<at:int,n:int,h:bigint,w:binary>>")
def _windows_of_document(texts: pd.Series, lengths: pd.Series) -> pd.Series:
    def rows(text, lengths):
        import xxhash

        words = alnum_words(text)
        out = []
        for n in lengths:
            for i in range(len(words) - n + 1):
                w = b" ".join(words[i : i + n])
                out.append({"at": i, "n": n, "h": xxhash.xxh64_intdigest(w) - (1 << 63), "w": w})
        return out

    return pd.Series([rows(t, ns) for t, ns in zip(texts, lengths)])


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, n: int) -> DataFrame:
    """The way for a benchmark of any size: windows of both sides meet by a shuffle on their hash."""
    @F.pandas_udf("array<struct<n:int,h:bigint,w:binary>>")
    def item_windows(texts: pd.Series) -> pd.Series:
        import xxhash

        return pd.Series([
            [{"n": len(w), "h": xxhash.xxh64_intdigest(b" ".join(w)) - (1 << 63), "w": b" ".join(w)} for w in set(windows_of(alnum_words(t), n))]
            for t in texts])

    @F.pandas_udf("n_words long, n_hit long, spans array<array<int>>")
    def marks(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = []
        for t, ps in zip(texts, places):
            hit = np.zeros(len(alnum_words(t)), bool)
            for at, length in ps if ps is not None else ():
                hit[at : at + length] = True
            rows.append((len(hit), int(hit.sum()), spans_of(hit)))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "spans"])

    each = benchmark.select(F.col("item_id").cast("string").alias("item"), F.explode(item_windows("text")).alias("x"))
    wins = written(each.groupBy("x.n", "x.h", "x.w").agg(F.collect_set("item").alias("items")), "windows")
    lengths = [r.n for r in wins.select("n").distinct().collect()]  # n different values at most
    keyed = written(docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("doc"), docs[quoted(text)].alias("text")).withColumn("row", F.monotonically_increasing_id()), "docs")
    places = keyed.select("row", F.explode(_windows_of_document("text", F.array(*[F.lit(x) for x in lengths]) if lengths else F.expr("cast(array() as array<int>)"))).alias("x")).select("row", "x.*")
    # a bitmap leaves out nearly all windows before anything is shuffled; windows of many documents meet theirs by a broadcast
    hits = written(maybe_wanted(places, F.col("h"), written(wins.select(F.col("h").alias("key")), "keys"), "maybe").where("maybe").drop("maybe"), "hits")
    counts = hits.groupBy("n", "h", "w").agg(F.count("*").alias("k"))
    hot = written(wins.join(counts.where(F.col("k") > max(10_000, hits.count() // 100_000)), ["n", "h", "w"]).drop("k"), "hot")  # at most 100,000 rows
    matched = hits.join(F.broadcast(hot), ["n", "h", "w"]).union(hits.join(F.broadcast(hot), ["n", "h", "w"], "left_anti").join(wins, ["n", "h", "w"]))
    found = matched.groupBy("row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.collect_set(F.array("at", "n")).alias("places"))
    out = keyed.join(found, "row", "left").select(
        "doc", F.struct(marks("text", "places").alias("m"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")).alias("y"))
    return out.select("doc.*", F.struct("y.m.n_words", "y.m.n_hit", "y.items", "y.m.spans").alias(free_name(docs, "hits")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """All columns of ``docs`` and a last one (n_words, n_hit, items as sorted strings, spans of hit words), named
    ``__hits`` with as many underscores after it as it takes to clash with no other.

    A null or empty text has no words and no hits; so does any text where the benchmark is empty.
    Items without words have no windows; windows of an item with a null id mark words but name no
    item. Equal rows get equal results.
    """
    bench = benchmark.select("item_id", "text")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(16)), F.lit(0))).first()[0]
    if size > max_broadcast_bytes:
        return _joined(docs, bench, text, n)
    items = [(r.item_id, r.text) for r in bench.collect()]
    scan = _scan(docs.sparkSession.sparkContext.broadcast(items), n)
    return docs.withColumn(free_name(docs, "hits"), scan(docs[quoted(text)]))


@vectorized("string")
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_spans(t, s) if t is not None and len(s) else t for t, s in zip(texts, spans)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", n: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contamination: ``documents`` drops every document with a hit, ``spans`` cuts the hit words out of its text."""
    found = find_contamination(docs, benchmark, text, n, max_broadcast_bytes)
    hits, columns = F.col(found.columns[-1]), [F.col(quoted(c)) for c in docs.columns]
    if mode == "documents":
        return found.where(hits["n_hit"] == 0).select(*columns)
    if mode != "spans":
        raise ValueError(f"mode must be documents or spans, not {mode!r}")
    return found.withColumn(text, _cut(F.col(quoted(text)), hits["spans"])).select(*columns)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find_contamination(docs.select("doc_id", "text"), benchmark, **options).select(
        "doc_id", "__hits.n_words", "__hits.n_hit", F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("__hits.n_hit") > 0).alias("contaminated"),
    )
