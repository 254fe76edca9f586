"""Whole runs: user flows, judge runs behind a cost gate, checks of stored results, summary tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import judge, text
from . import evaluate
from .latency import cost_estimate

LENGTHS = ("short", "medium", "long")


class OverBudget(RuntimeError):
    pass


def corpus_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row of means with two decimals; zeros without samples."""
    return rows.agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 2).alias(m) for m in metrics])


def reference_metrics(rows: DataFrame, repeat: int = 3, novel: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Means of the metrics that need no prediction, for the reference summaries of (document, summary)."""
    s, d = F.col("summary"), F.col("document")
    each = {"length_syllables": F.size(text.syllables(s)), f"repetition_{repeat}gram": text.repetition_rate(s, repeat), **{f"novel_{n}gram": text.novelty_rate(s, d, n) for n in novel}}
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(k) for k, c in each.items()])


def human_means(rows: DataFrame, scores: list[str], first: str, **options) -> tuple[DataFrame, DataFrame]:
    """Means of human scores by system, nulls left out, and paired tests of the first system against each other one.

    ``rows``: system, id, stratum, cluster and the scores; ``options`` go to the bootstrap.
    """
    means = evaluate.unpivoted(rows, scores, ["system", "id"]).groupBy("system", "metric").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"))
    return means, evaluate.paired_bootstrap(rows, scores, first, **options)


def value_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows for each value (rounds of a reduction, reasons, strategies); nulls count as a value."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def recovered_by_system(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """(system, n, parsed, recovered, lost): replies that parse, whose score only the pattern recovers, and the rest."""
    error = judge.parsed(F.col(raw))["error"]
    marked = replies.select("system", error.isNull().alias("ok"), judge.recovered_score(F.col(raw)).isNotNull().alias("found"))
    return marked.groupBy("system").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok") & F.col("found")).alias("recovered"), F.count_if(~F.col("ok") & ~F.col("found")).alias("lost"))


def consistency(stored: DataFrame, recomputed: DataFrame, on: list[str], metrics: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(metric, n, max_diff, ok) over rows that both tables have; a value that only one of them has is not ok."""
    both = stored.select(*on, *[F.col(m).cast("double").alias(f"a_{m}") for m in metrics]).join(
        recomputed.select(*on, *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics]), on)
    pairs = both.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("a"), F.col(f"b_{m}").alias("b")) for m in metrics])))
    diff = F.abs(F.col("a") - F.col("b"))
    return pairs.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.max(diff), 9).alias("max_diff"), F.bool_and(
        F.coalesce(diff < tolerance, F.col("a").isNull() & F.col("b").isNull())).alias("ok"))


def stratified_sample(rows: DataFrame, n: int, flag: str = "is_long", key: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows, half of each value of a flag (the odd one has it not), in an order that depends on seed and ids only."""
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key)]
    on = evaluate.bounded_first(rows.where(F.col(flag)), [flag], n // 2, order)
    return on.unionByName(evaluate.bounded_first(rows.where(~F.col(flag)), [flag], n - n // 2, order))


def shuffled(rows: DataFrame, key: str = "id", cap: int | None = None, seed: int = 42) -> DataFrame:
    """All rows in the order of a hash of seed and id, or the first ``cap`` of them."""
    out = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)
    return out if cap is None else out.limit(cap)


def user_flow(documents: DataFrame, lengths: tuple[str, ...] = LENGTHS) -> DataFrame:
    """One call a document and length, in order; every later call of a hierarchical document finds its chunks in the cache.

    ``documents``: id, strategy, n_chunks and more. The lengths stand in the row, so nothing is joined.
    """
    calls = documents.select("*", F.posexplode(F.array(*[F.lit(x) for x in lengths])).alias("order", "length"))
    hierarchical = F.coalesce(F.col("strategy") == "hierarchical", F.lit(False))
    return calls.withColumns({"chunk_cache_hit": hierarchical & (F.col("order") > 0), "generate_calls": F.when(~hierarchical, 1).when(F.col("order") == 0, F.col("n_chunks")).otherwise(0)})


def attainment(rows: DataFrame, by: list[str], target_ms: float = 500.0) -> DataFrame:
    """Whether median and 95th percentile meet the target."""
    p50, p95 = F.percentile("latency_ms", F.lit(0.5)), F.percentile("latency_ms", F.lit(0.95))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (p50 < target_ms).alias("p50_ok"), (p95 < target_ms).alias("p95_ok"))


def check_cost(prompts: DataFrame, limit_usd: float, **prices) -> float:
    """The estimated cost of the prompts; ``OverBudget`` before anything is sent if it is above the limit."""
    usd = cost_estimate(prompts, **prices).first()["usd"] or 0.0
    if usd > limit_usd:
        raise OverBudget(f"the run would cost {usd:.2f} USD; the limit is {limit_usd:.2f}")
    return usd


def judge_requests(rows: DataFrame, template: str, model: str, version: str, max_chars: int = 30000) -> DataFrame:
    """Adds key, prompt and document_truncated to (system, id, document, prediction).

    The key hashes everything that the reply depends on, so a changed prompt, model or prediction asks again.
    """
    document = text.text_of(F.col("document"))
    values = {"{document}": F.substring(document, 1, max_chars), "{summary}": text.text_of(F.col("prediction"))}
    filled = F.concat(*[values.get(piece, F.lit(piece)) for piece in re.split(r"(\{document\}|\{summary\})", template)])
    key = F.sha1(F.concat_ws("\x1f", F.lit(model), F.lit(version), F.col("system"), F.col("id").cast("string"), filled).cast("binary"))
    return rows.withColumns({"prompt": filled, "key": key, "document_truncated": F.char_length(document) > max_chars})


def judge_missing(requests: DataFrame, cache: DataFrame, retry_errors: bool = True) -> DataFrame:
    """Requests whose key no cached reply (key, error) answers; replies with an error are asked again if wanted."""
    done = cache.where("error is null") if retry_errors else cache
    return requests.join(done.select("key"), "key", "left_anti")


def run_judge(requests: DataFrame, cache: DataFrame, ask: Callable[[DataFrame], DataFrame], limit_usd: float, retry_errors: bool = True, **prices) -> DataFrame:
    """New rows for the judge's cache. ``ask`` adds ``raw`` to (key, prompt); the cost is checked before it runs.

    A broken reply keeps its error unless the pattern recovers its score.
    """
    todo = judge_missing(requests, cache, retry_errors)
    check_cost(todo, limit_usd, **prices)
    replies = ask(todo.select("key", "prompt").dropDuplicates(["key"])).select("key", "raw").withColumn("p", judge.parsed(F.col("raw")))
    broken = F.col("p.error").isNotNull()
    score = F.coalesce("p.score", judge.recovered_score(F.col("raw")))
    return todo.drop("prompt").join(replies, "key").select(
        "key", "system", "id", "document_truncated", "raw", score.alias("score"), F.col("p.unsupported_claims").alias("unsupported_claims"),
        F.when(broken, judge.recovered_rationale(F.col("raw"))).otherwise(F.col("p.rationale")).alias("rationale"), F.when(score.isNull(), F.col("p.error")).alias("error"))


def win_rate(a: Column, b: Column) -> Column:
    """Share of rows where ``a`` is above ``b``, ties a half; rows with a null are left out."""
    return F.avg(F.when(a > b, 1.0).when(a == b, 0.5).when(a < b, 0.0))
