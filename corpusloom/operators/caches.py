"""Result caches: append-only tables of (id, fp, in, prediction, seq), the last write wins."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(settings: Any, digits: int = 16) -> str:
    """Names what a cached result depends on: the SHA-1 of the settings as JSON with sorted keys."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:digits]


def model_identity(path: str, suffixes: tuple[str, ...] = (".json", ".bin", ".safetensors", ".onnx", ".model")) -> str:
    """What a model is called in a fingerprint: the digest of its files' names and contents, wherever the folder lies;
    a name that is no folder, or a folder without such files, stands for itself."""
    folder = Path(path)
    files = sorted(f for f in folder.iterdir() if f.is_file() and f.suffix in suffixes) if folder.is_dir() else []
    if not files:
        return path
    whole = hashlib.sha256()
    for f in files:
        with f.open("rb") as handle:
            whole.update(f"{f.name}\0{hashlib.file_digest(handle, 'sha256').hexdigest()}\n".encode())
    return f"sha256:{whole.hexdigest()[:16]}"


def lru_hits(calls: DataFrame, capacity: int, by: str = "worker", order: str = "seq") -> DataFrame:
    """(worker, calls, hits): what a cache of ``capacity`` keys for each worker finds, the one used longest ago going
    first; a capacity of 0 turns it off. Calls (worker, seq, key) are replayed in order; a worker's cache is held, not
    its calls. Null keys are never cached."""

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker, held, n, hits = None, OrderedDict(), 0, 0
        for batch in batches:
            for w, key in zip(batch["w"], batch["key"]):
                if w != worker:
                    if n:
                        yield pd.DataFrame({by: [worker], "calls": [n], "hits": [hits]})
                    worker, held, n, hits = w, OrderedDict(), 0, 0
                n += 1
                if key is None or not capacity:
                    continue
                hits += key in held
                held[key] = held.move_to_end(key) if key in held else None
                if len(held) > capacity:
                    held.popitem(last=False)
        if n:
            yield pd.DataFrame({by: [worker], "calls": [n], "hits": [hits]})

    rows = calls.select(F.col(by).cast("string").alias("w"), F.col(order).alias("o"), F.col("key").cast("string").alias("key")).where("w is not null")
    return rows.repartition("w").sortWithinPartitions("w", "o").select("w", "key").mapInPandas(replay, f"`{by}` string, calls long, hits long")


def batch_count(n: Column, size: int) -> Column:
    """Calls that ``n`` texts take in batches of ``size``."""
    return F.ceil(n / F.lit(size)).cast("bigint")


def latest(cache: DataFrame, fingerprints: list[str] | None = None, key: list[str] | None = None) -> DataFrame:
    """The last row of each key, of accepted fingerprints only; a partial maximum, not a window."""
    key = key or ["id"]
    rows = cache.where(F.col("fp").isin(fingerprints)) if fingerprints else cache
    rest = [c for c in cache.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct("seq", *[c for c in rest if c != "seq"])).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def missing(inputs: DataFrame, cache: DataFrame, fingerprints: list[str], accept_legacy: bool = False) -> DataFrame:
    """Inputs (id, in) that no usable row of the cache answers; rows without a hash answer only if that is allowed."""
    rows = latest(cache, fingerprints).select(F.col("id").alias("__id"), F.col("in").alias("__in"))
    same = F.col("in").isNull() | F.col("in").eqNullSafe(F.col("__in"))
    if accept_legacy:
        same = same | F.col("__in").isNull()
    return inputs.join(rows, (F.col("id") == F.col("__id")) & same, "left_anti")


def run_with_cache(inputs: DataFrame, cache: DataFrame, fingerprint: str, generate, accept_legacy: bool = False) -> DataFrame:
    """New rows for the cache: ``generate`` sees each different missing input once."""
    todo = missing(inputs, cache, [fingerprint], accept_legacy)
    once = generate(todo.select("in", "text").dropDuplicates(["in"])).select("in", "prediction")
    return todo.select("id", "in").join(once, "in").select("id", F.lit(fingerprint).alias("fp"), "in", "prediction")


def chunk_hits(calls: DataFrame) -> DataFrame:
    """(calls, distinct keys, hits) of repeated chunk keys, as a memo of unlimited size would have."""
    per_key = calls.groupBy("key").agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("calls"), F.count("*").alias("distinct_keys"), F.sum(F.col("n") - 1).alias("hits"))
