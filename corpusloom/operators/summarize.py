"""Summaries by strategy, with a pluggable generator. A generator is a function from (key, text) to (key, summary)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, text
from .prepare import desired_strategy

#: What a generator is told for each length.
PRESETS = {"short": {"max_new_tokens": 48, "length_penalty": 0.6}, "medium": {"max_new_tokens": 128}, "long": {"max_new_tokens": 256, "min_new_tokens": 64, "length_penalty": 2.0}}


def lead_generator(n: int = 1) -> Callable[[DataFrame], DataFrame]:
    """The stand-in for a model: the first sentences."""
    return lambda rows: rows.select("key", text.lead(F.col("text"), n).alias("summary"))


def batch_generator(model: Callable[[list[str]], list[str]], batch_size: int = 4) -> Callable[[DataFrame], DataFrame]:
    """Runs a model on batches of similar length, once for each different text of a partition."""

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            order = rows.assign(n=rows["text"].str.len()).sort_values("n", ascending=False)
            texts = order["text"].drop_duplicates().tolist()
            done = {}
            for s in range(0, len(texts), batch_size):
                part = texts[s : s + batch_size]
                done |= dict(zip(part, model(part)))
            yield rows[["key"]].assign(summary=rows["text"].map(done))

    return lambda rows: rows.mapInPandas(generate, "key string, summary string")


def summarize(docs: DataFrame, generate=None, budget: int = 1023, strategy: str = "auto", chunk_tokens: int = 1024, overlap: int = 64, hierarchical_above: int = 1024, threshold: float = 0.6, factcheck: str = "off") -> DataFrame:
    """(id, strategy, summary) of (id, document). Short texts go to the generator whole, longer ones after
    extraction or chunk by chunk; chunk summaries are joined without repeats. Equal inputs are generated once."""
    generate = generate or lead_generator()
    rows = docs.select("id", text.text_of(F.col("document")).alias("document"))
    rows = rows.withColumn("strategy", desired_strategy(text.token_count(F.col("document")), budget, strategy, hierarchical_above))
    whole = rows.where("strategy = 'direct'").select("id", "strategy", F.lit(0).alias("part"), F.col("document").alias("text"))
    cut = rows.where("strategy = 'extractive'").select("id", "strategy", F.lit(0).alias("part"), arrow.extract(F.col("document"), max_tokens=budget, reserved=0)["input_text"].alias("text"))
    pieces = rows.where("strategy = 'hierarchical'").select("id", "strategy", F.posexplode(arrow.chunks(F.col("document"), max_tokens=chunk_tokens, overlap=overlap)).alias("part", "c")).select("id", "strategy", "part", F.col("c.text").alias("text"))
    units = whole.unionByName(cut).unionByName(pieces).withColumn("key", text.content_hash(F.col("text"), 40))
    made = generate(units.select("key", "text").dropDuplicates(["key"]))
    parts = units.join(made, "key").groupBy("id", "strategy").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "summary"))), lambda x: x["summary"]).alias("parts"))
    source = F.col("document") if factcheck != "off" else F.lit(None).cast("string")
    joined = parts.where("strategy = 'hierarchical'").join(rows.select("id", "document"), "id").select("id", "strategy", arrow.reduce_parts(F.col("parts"), source, budget, threshold, factcheck)["summary"].alias("summary"))
    return parts.where("strategy <> 'hierarchical'").select("id", "strategy", F.col("parts")[0].alias("summary")).unionByName(joined)
