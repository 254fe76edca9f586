"""Latency tables and the choice of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bucket_label


def percentile(c: Column, q: float, accuracy: int | None = None) -> Column:
    """The interpolated percentile, exactly: a group's different values are held in one buffer. For groups with very
    many of them ``accuracy`` takes a sketch of bounded size instead: a value whose rank is off by a share of at most
    1 / accuracy, without interpolation."""
    return F.percentile(c, F.lit(q)) if accuracy is None else F.percentile_approx(c.cast("double"), F.lit(q), F.lit(accuracy))


def _p(c: str, q: float, accuracy: int | None = None) -> Column:
    return F.round(percentile(F.col(c), q, accuracy), 6)


def latency_summary(rows: DataFrame, by: list[str], accuracy: int | None = None) -> DataFrame:
    """``rows``: latency_ms, generate_ms, new_tokens. Rates are ratios of sums; ``accuracy`` as in ``percentile``."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), _p("latency_ms", 0.5, accuracy).alias("p50"), _p("latency_ms", 0.95, accuracy).alias("p95"), F.round(F.avg("latency_ms"), 6).alias("mean"),
        F.round(F.max("latency_ms"), 6).alias("max"), F.round(F.count("*") / F.nullif(F.sum("latency_ms") / 1000.0, F.lit(0.0)), 6).alias("docs_per_s"),
        F.round(F.sum("new_tokens") / F.nullif(F.sum("generate_ms") / 1000.0, F.lit(0.0)), 6).alias("tokens_per_s"))


def latency_by_bucket(rows: DataFrame, edges: tuple[int, ...] = (256, 512), target_ms: float = 500.0) -> DataFrame:
    """Percentiles by input size, and whether they meet the target; buckets without rows stay, with nulls."""
    labels = [f"≤{edges[0]}", *[f"{a + 1}–{b}" for a, b in zip(edges, edges[1:])], f">{edges[-1]}"]
    buckets = rows.sparkSession.createDataFrame(list(enumerate(labels)), "position int, bucket string")
    found = rows.groupBy(bucket_label(F.col("input_tokens"), edges).alias("bucket")).agg(
        F.count("*").alias("n"), _p("latency_ms", 0.5).alias("p50"), _p("latency_ms", 0.95).alias("p95"))
    return buckets.join(found, "bucket", "left").select(
        "bucket", "position", F.coalesce("n", F.lit(0)).alias("n"), "p50", "p95", (F.col("p50") < target_ms).alias("p50_ok"), (F.col("p95") < target_ms).alias("p95_ok"))


def flow_rollup(rows: DataFrame) -> DataFrame:
    """UI flow: calls by strategy, documents (sum over their calls) by strategy, hierarchical calls by number of chunks."""
    stats = [F.count("*").alias("n"), _p("latency_ms", 0.5).alias("p50"), _p("latency_ms", 0.95).alias("p95")]
    calls = rows.groupBy(F.col("strategy").alias("part")).agg(*stats).withColumn("level", F.lit("call"))
    docs = rows.groupBy("id", "strategy").agg(F.sum("latency_ms").alias("latency_ms")).groupBy(F.col("strategy").alias("part")).agg(*stats).withColumn("level", F.lit("document"))
    chunks = rows.where("strategy = 'hierarchical' and n_chunks is not null").groupBy(F.col("n_chunks").cast("string").alias("part")).agg(*stats).withColumn("level", F.lit("chunks"))
    return calls.unionByName(docs).unionByName(chunks)


def identical_share(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on, F.col("summary").alias("x")).join(b.select(*on, F.col("summary").alias("y")), on).agg(
        F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same"), F.round(100.0 * F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("pct"))


def versus_baseline(runs: DataFrame, baseline: str, warn_drop: float = 1.0) -> DataFrame:
    """``runs``: (run, device, rouge, predictions by id). Change in ROUGE against the device's baseline run, equal outputs, warning."""
    score = runs.groupBy("device", "run").agg(F.avg("rouge").alias("rouge"))
    base = score.where(F.col("run") == baseline).select("device", F.col("rouge").alias("base"))
    own = runs.where(F.col("run") == baseline).select("device", "id", F.col("prediction").alias("bp"))
    same = runs.join(own, ["device", "id"]).groupBy("device", "run").agg(F.count_if(F.col("prediction") == F.col("bp")).alias("identical"))
    delta = F.col("rouge") - F.col("base")
    return score.join(base, "device", "left").join(same, ["device", "run"], "left").select(
        "device", "run", F.round("rouge", 6).alias("rouge"), F.round(delta, 6).alias("delta"), F.coalesce("identical", F.lit(0)).alias("identical"), (delta < -warn_drop).alias("warning"))


def parameter_grid(spark, penalties: list[float], minimums: list[int]) -> DataFrame:
    """All combinations; the baseline (1.0, 0) is first, the others by (min_new, penalty)."""
    grid = spark.createDataFrame([(float(p),) for p in penalties], "length_penalty double").crossJoin(spark.createDataFrame([(int(m),) for m in minimums], "min_new_tokens int"))
    base = spark.createDataFrame([(1.0, 0)], grid.schema)
    is_base = (F.col("length_penalty") == 1.0) & (F.col("min_new_tokens") == 0)
    return base.union(grid.where(~is_base)).select(
        F.concat(F.lit("lp"), F.regexp_replace(F.col("length_penalty").cast("string"), r"\.0$", ""), F.lit("_min"), F.col("min_new_tokens").cast("string")).alias("candidate"),
        "length_penalty", "min_new_tokens").orderBy(~is_base, "min_new_tokens", "length_penalty")


def candidate_scores(rows: DataFrame, metrics: list[str], datasets: list[str], by: str = "rougeL") -> DataFrame:
    """Means a candidate, and of one metric a dataset in columns of its own."""
    means = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    return rows.groupBy("candidate").agg(F.count("*").alias("n"), *means, *[F.round(F.avg(F.when(F.col("dataset") == d, F.col(by))), 6).alias(f"{by}_{d}") for d in datasets])


def best_candidate(scores: DataFrame, baseline: str, tolerance: float = 1.0, metric: str = "rougeL", repetition: str = "repetition_3gram") -> DataFrame:
    """The best metric among candidates that repeat at most ``tolerance`` more than the baseline; of equal ones the first by name."""
    limit = scores.where(F.col("candidate") == baseline).select((F.col(repetition) + tolerance).alias("__limit"))
    return scores.join(limit, F.col(repetition) <= F.col("__limit")).drop("__limit").orderBy(F.desc(metric), "candidate").limit(1)


def cost_estimate(prompts: DataFrame, chars_per_token: float, input_price: float, output_price: float, output_tokens: int) -> DataFrame:
    tokens = F.sum(F.char_length("prompt")) / chars_per_token
    out = F.count("*") * output_tokens
    return prompts.agg(
        F.count("*").alias("requests"), F.sum(F.char_length("prompt")).cast("bigint").alias("chars"), F.round(tokens, 6).alias("input_tokens"), out.cast("bigint").alias("output_tokens"),
        F.round(tokens / 1e6 * input_price + out / 1e6 * output_price, 6).alias("usd"))
