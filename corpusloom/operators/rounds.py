"""Generate-reduce in rounds, and checked requests for summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, text
from .prepare import desired_strategy
from .summarize import PRESETS, lead_generator, summarize

Generator = Callable[[DataFrame], DataFrame]


def _settled(df: DataFrame) -> DataFrame:
    """Cuts a round off from the next one, so that nothing is generated twice: a checkpoint where there is a folder for it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir() and (folder := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()


def reduce_in_rounds(docs: DataFrame, generate: Generator | None = None, budget: int = 1023, chunk_tokens: int = 512, overlap: int = 64, max_rounds: int = 2) -> DataFrame:
    """(id, text, rounds, extracted) of (id, document): texts that fit the budget, ready for the last generation.

    In a round every text above the budget is cut into chunks, the different chunks of all of them are generated
    together, and the summaries that are not empty are joined in order. What is still too long after ``max_rounds``
    is extracted to the budget. Null documents are empty texts; an id should stand for one row.
    """
    generate = generate or lead_generator()
    rows = docs.select("id", text.text_of(F.col("document")).alias("text"), F.lit(0).alias("rounds"))
    too_long = text.token_count(F.col("text")) > budget
    for _ in range(max_rounds):
        rows = _settled(rows)
        if not rows.where(too_long).limit(1).count():
            break
        units = rows.where(too_long).select("id", F.posexplode(arrow.chunks(F.col("text"), max_tokens=chunk_tokens, overlap=overlap)).alias("part", "c")).select(
            "id", "part", F.col("c.text").alias("text"), text.content_hash(F.col("c.text"), 40).alias("key"))
        made = generate(units.select("key", "text").dropDuplicates(["key"])).where("summary <> ''")
        joined = units.join(made, "key").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "summary"))), lambda x: x["summary"]), " ").alias("joined"))
        again = rows.where(too_long).join(joined, "id", "left").select("id", text.text_of(F.col("joined")).alias("text"), (F.col("rounds") + 1).alias("rounds"))
        rows = rows.where(~too_long).union(again)
    rows = _settled(rows).withColumn("extracted", too_long)
    whole = rows.where(~F.col("extracted"))
    cut = rows.where("extracted").select("id", arrow.extract(F.col("text"), max_tokens=budget, reserved=0)["input_text"].alias("text"), "rounds", "extracted")
    return whole.union(cut)


def request_errors(requests: DataFrame, max_chars: int = 20_000) -> DataFrame:
    """(id, text, error) of (id, text): the text without white space around it, and why it is refused, null if it is not.

    ``empty`` is a null, empty or blank text, ``too_long`` one of more than ``max_chars`` characters, ``nothing_left`` one
    of which normalisation leaves nothing.
    """
    stripped = text.trimmed(text.text_of(F.col("text")))
    rows = requests.select("id", stripped.alias("text"))
    left = arrow.normalize(F.col("text"))
    return rows.withColumn("error", F.when(F.col("text") == "", "empty").when(F.char_length("text") > max_chars, "too_long").when(left == "", "nothing_left"))


def answer_requests(requests: DataFrame, length: str = "medium", generators: Callable[[dict], Generator] | None = None, max_chars: int = 20_000, budget: int = 1023, **options) -> DataFrame:
    """(id, length, strategy, input_tokens, summary, error) for every request (id, text); refused ones have an error only.

    ``generators`` makes a generator of a length's settings. An unknown length or further columns are an error, as a
    field that nobody reads would be one in a request.
    """
    if length not in PRESETS:
        raise ValueError(f"length must be one of {', '.join(PRESETS)}, not {length!r}")
    if further := [c for c in requests.columns if c not in ("id", "text")]:
        raise ValueError(f"unknown fields: {', '.join(further)}")
    checked = _settled(request_errors(requests, max_chars))
    good = checked.where("error is null").select("id", arrow.normalize(F.col("text")).alias("document"))
    made = summarize(good, generators(PRESETS[length]) if generators else lead_generator(), budget, **options).select("id", "summary")
    tokens = text.token_count(F.col("document"))
    told = good.select("id", tokens.alias("input_tokens"), desired_strategy(tokens, budget, options.get("strategy", "auto"), options.get("hierarchical_above", 1024)).alias("strategy"))
    return checked.select("id", "error").join(told, "id", "left").join(made, "id", "left").select("id", F.lit(length).alias("length"), "strategy", "input_tokens", "summary", "error")
