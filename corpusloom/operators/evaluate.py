"""Evaluation: metrics a sample, metrics a system and subset, bootstrap, agreement, sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrow, text

METRICS = ("rouge1", "rouge2", "rougeL", "bertscore_f", "faithfulness")


def unsupported_items(prediction: Column, document: Column) -> Column:
    """Numbers and names of a prediction that its document does not have, sentence by sentence; a blank one has none."""
    return F.flatten(F.transform(arrow.check_summary(prediction, document), lambda x: x["unsupported"]))


def sample_metrics(rows: DataFrame, novel: tuple[int, ...] = (1, 2), repeat: int = 3, factcheck: bool = False) -> DataFrame:
    """Adds metrics to (system, id, document, summary, prediction). Nulls count as empty texts.

    With ``factcheck`` also ``unsupported_pct``: 100 where the prediction has an unsupported number or name, else 0.
    """
    if factcheck:
        rows = rows.withColumn("unsupported_pct", F.when(F.size(unsupported_items(F.col("prediction"), F.col("document"))) > 0, 100.0).otherwise(0.0))
    p, s, d = F.col("prediction"), F.col("summary"), F.col("document")
    return rows.withColumns({
        "rouge1": text.rouge_n(p, s, 1), "rouge2": text.rouge_n(p, s, 2), "length_syllables": F.size(text.syllables(p)),
        f"repetition_{repeat}gram": text.repetition_rate(p, repeat), **{f"novel_{n}gram": text.novelty_rate(p, d, n) for n in novel}})


def subset_labels() -> Column:
    return F.explode(F.array(F.lit("all"), F.concat(F.lit("dataset="), "dataset"), F.when(F.col("is_long"), "long").otherwise("short")))


def subset_metrics(rows: DataFrame, metrics: list[str], score: str | None = "faithfulness") -> DataFrame:
    """Means of metrics, and a score's distribution, for each system over all samples, each dataset, long and short ones."""
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in metrics]]
    if score:
        c = F.col(score).cast("double")
        aggs += [F.count(c).alias(f"{score}_n"), F.round(F.avg(c), 6).alias(f"{score}_mean"), F.round(100.0 * F.avg((c == 5).cast("double")), 6).alias(f"{score}_pct_5"),
                 F.round(100.0 * F.avg((c <= 2).cast("double")), 6).alias(f"{score}_pct_le2")]
    return rows.withColumn("subset", subset_labels()).groupBy("system", "subset").agg(*aggs)


def unpivoted(rows: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """One row a metric, without its nulls."""
    return rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "x").where("x is not null")


#: P(X <= k) of the Poisson distribution with mean 1; what lies above the last one has a probability of 2e-12.
_POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(13))


def bootstrap_means(values: DataFrame, by: list[str], n_boot: int, seed: int = 42) -> DataFrame:
    """(by, boot, mean): means of ``n_boot`` draws of clusters, with replacement inside each stratum.

    ``values`` has stratum, cluster and x besides ``by``; null strata and clusters are strata and clusters too. Rows
    shrink to sums of a cluster first. How often a boot draws a cluster is a Poisson number of mean 1, from the hash of
    seed, stratum, cluster and boot; sums of a stratum are then scaled to its number of clusters, so that every stratum
    keeps its weight, as it does where exactly as many clusters are drawn as it has. So there is no join and no window:
    boots come from a sequence in the row and are added up before the one shuffle.
    """
    sums = values.groupBy(*by, "stratum", "cluster").agg(F.sum("x").alias("s"), F.count("x").alias("c"))
    none = F.lit("")
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("stratum").cast("string"), none), F.coalesce(F.col("cluster").cast("string"), none), "boot")
    u = F.col("u")
    times = sum(((u >= t).cast("int") for t in _POISSON), F.lit(0))
    drawn = sums.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("u", text.hash_draw(key)).withColumn("m", times)
    strata = drawn.groupBy(*by, "stratum", "boot").agg(
        F.count("*").alias("k"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("s")).alias("s"), F.sum(F.col("m") * F.col("c")).alias("c")).where("m > 0")
    scale = F.col("k") / F.col("m")
    return strata.groupBy(*by, "boot").agg((F.sum(scale * F.col("s")) / F.sum(scale * F.col("c"))).alias("mean"))


def bootstrap_ci(values: DataFrame, by: list[str], n_boot: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean and percentile interval; without rows no row."""
    tail = (1 - confidence) / 2
    point = values.groupBy(*by).agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"))
    ends = bootstrap_means(values, by, n_boot, seed).groupBy(*by).agg(
        F.round(F.percentile("mean", F.lit(tail)), 6).alias("ci_low"), F.round(F.percentile("mean", F.lit(1 - tail)), 6).alias("ci_high"))
    return point.join(ends, by)


def paired_bootstrap(rows: DataFrame, metrics: list[str], reference: str, n_boot: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Differences of a reference system to each other one on ids where both have a value: diff, interval, two-sided p."""
    flat = unpivoted(rows, metrics, ["system", "id", "stratum", "cluster"])
    a = flat.where(F.col("system") == reference).select("metric", "id", F.col("x").alias("a"))
    diffs = flat.where(F.col("system") != reference).join(a, ["metric", "id"]).select("metric", "system", "stratum", "cluster", (F.col("a") - F.col("x")).alias("x"))
    by, tail = ["metric", "system"], (1 - confidence) / 2
    means = bootstrap_means(diffs, by, n_boot, seed).groupBy(*by).agg(
        F.round(F.percentile("mean", F.lit(tail)), 6).alias("ci_low"), F.round(F.percentile("mean", F.lit(1 - tail)), 6).alias("ci_high"),
        F.round(F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("mean") <= 0).cast("double")), F.avg((F.col("mean") >= 0).cast("double")))), 6).alias("p_value"))
    return diffs.groupBy(*by).agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("diff")).join(means, by)


def significance(rows: DataFrame, metrics: list[str], reference: str, **options) -> DataFrame:
    """Intervals of every system and metric and paired tests, as one table with a kind and nulls where a column does not apply."""
    ci = bootstrap_ci(unpivoted(rows, metrics, ["system", "id", "stratum", "cluster"]), ["system", "metric"], **options).withColumn("kind", F.lit("ci"))
    paired = paired_bootstrap(rows, metrics, reference, **options).withColumns({"kind": F.lit("paired"), "reference": F.lit(reference)})
    return ci.unionByName(paired, allowMissingColumns=True)


def confusion(rows: DataFrame, a: str, b: str, low: int = 1, high: int = 5) -> DataFrame:
    """(a, b, n) for all pairs of scores, zeros included."""
    grid = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(a)).withColumn(b, F.explode(F.sequence(F.lit(low), F.lit(high))))
    counts = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("int").alias(a), F.col(b).cast("int").alias(b)).agg(F.count("*").alias("n"))
    return grid.join(counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def weighted_kappa(rows: DataFrame, a: str, b: str, low: int = 1, high: int = 5) -> DataFrame:
    """Quadratic weighted kappa; null without pairs, or if chance alone leaves no disagreement."""
    cells = confusion(rows, a, b, low, high)
    total = F.sum("n").over(W.partitionBy())
    rowsum, colsum = F.sum("n").over(W.partitionBy(a)), F.sum("n").over(W.partitionBy(b))
    weighted = cells.withColumns({"w": F.pow(F.col(a) - F.col(b), F.lit(2)) / float((high - low) ** 2), "e": rowsum * colsum / F.nullif(total, F.lit(0)), "t": total})
    expected = F.sum(F.col("w") * F.col("e"))
    return weighted.agg(F.max("t").alias("n"), F.round(F.when(expected > 0, 1 - F.sum(F.col("w") * F.col("n")) / expected), 6).alias("qwk"))


def with_average_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks with ties at their mean, of a numeric column; nulls have none.

    Counts of each different value are added up in two levels: inside up to 256 ranges of about as many values each,
    whose edges are approximate quantiles, and over the ranges. So no window holds all values.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    edges = sorted(set(counts.select(F.col(column).cast("double").alias("x")).approxQuantile("x", [i / 256 for i in range(1, 256)], 0.001)))
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(column))) if edges else F.lit(0)
    counts = counts.withColumn("__part", part)
    totals = counts.groupBy("__part").agg(F.sum("__n").alias("__t")).withColumn(
        "__before", F.coalesce(F.sum("__t").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    inside = F.coalesce(F.sum("__n").over(W.partitionBy("__part").orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("__inside", inside).join(F.broadcast(totals), "__part").select(column, (F.col("__before") + F.col("__inside") + (F.col("__n") + 1) / 2.0).alias(name))
    return rows.join(ranks, column, "left")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation; null for fewer than two pairs or a constant side."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = with_average_rank(with_average_rank(both, a, "__ra"), b, "__rb")
    return ranked.agg(F.count("*").alias("n"), F.round(pearson("__ra", "__rb"), 6).alias("spearman"))


def pearson(a: str | Column, b: str | Column) -> Column:
    """Correlation; null if a side is constant, where ``corr`` would fail."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def kappa_interval(rows: DataFrame, human: str, judge: str, n_boot: int = 1000, confidence: float = 0.95, seed: int = 42, key: str = "item_id") -> DataFrame:
    """(ci_low, ci_high) of the quadratic weighted kappa over bootstrap draws of items; nulls without pairs.

    Draws are Poisson numbers from hashes of seed, item and boot, as in ``bootstrap_means``. Sums of the disagreement and
    of the scores' first two moments give the kappa of a boot, so a boot needs one row.
    """
    both = rows.where(F.col(human).isNotNull() & F.col(judge).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(human).cast("double").alias("a"), F.col(judge).cast("double").alias("b"))
    drawn = both.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("u", text.hash_draw(F.concat_ws(":", F.lit(seed), F.coalesce("k", F.lit("")), "boot")))
    m = sum(((F.col("u") >= t).cast("int") for t in _POISSON), F.lit(0))
    sums = drawn.withColumn("m", m).groupBy("boot").agg(F.sum("m").alias("n"), *[F.sum(F.col("m") * c).alias(x) for x, c in {
        "d": F.pow(F.col("a") - F.col("b"), F.lit(2)), "sa": F.col("a"), "sb": F.col("b"), "qa": F.col("a") * F.col("a"), "qb": F.col("b") * F.col("b")}.items()])
    # the mean of (a - b)^2 over all pairs of a human and a judge score
    chance = (F.col("qa") + F.col("qb")) / F.col("n") - 2 * F.col("sa") * F.col("sb") / (F.col("n") * F.col("n"))
    kappa = F.when((F.col("n") > 0) & (chance > 1e-12), 1 - F.col("d") / F.col("n") / chance)
    tail = (1 - confidence) / 2
    return sums.select(kappa.alias("q")).agg(F.round(F.percentile("q", F.lit(tail)), 6).alias("ci_low"), F.round(F.percentile("q", F.lit(1 - tail)), 6).alias("ci_high"))


def sheet_agreement(key: DataFrame, sheet: DataFrame, human: str = "human_score", judge: str = "faithfulness", **options) -> DataFrame:
    """Agreement of a filled annotation sheet with the key that knows what each item is, with the interval of kappa.

    Items of the key that the sheet lacks or leaves empty do not count. Items that the sheet has twice, or that the key
    does not know, are an error: the sheet belongs to another key then.
    """
    twice = [r.item_id for r in sheet.groupBy("item_id").count().where("count > 1").orderBy("item_id").limit(5).collect()]
    unknown = [r.item_id for r in sheet.join(key, "item_id", "left_anti").select("item_id").orderBy("item_id").limit(5).collect()]
    if twice or unknown:
        raise ValueError(f"items more than once in the sheet: {twice}; items that the key does not know: {unknown}")
    rows = key.join(sheet.select("item_id", human), "item_id", "left")
    return agreement(rows, human, judge).join(kappa_interval(rows, human, judge, **options))


def agreement(rows: DataFrame, human: str, judge: str) -> DataFrame:
    both = rows.where(F.col(human).isNotNull() & F.col(judge).isNotNull())
    d = (F.col(human) - F.col(judge)).cast("double")
    basic = both.agg(
        F.count("*").alias("n"), F.round(100.0 * F.avg((d == 0).cast("double")), 6).alias("exact_pct"), F.round(100.0 * F.avg((F.abs(d) <= 1).cast("double")), 6).alias("within1_pct"),
        F.round(F.avg(human), 6).alias("human_mean"), F.round(F.avg(judge), 6).alias("judge_mean"), F.round(F.avg(d), 6).alias("mean_diff"))
    return basic.join(weighted_kappa(both, human, judge).drop("n")).join(spearman(both, human, judge).drop("n"))


def score_distribution(rows: DataFrame, score: str, error: Column) -> DataFrame:
    c = F.col(score)
    return rows.groupBy("system").agg(*[F.count_if(c == k).alias(f"n_{k}") for k in range(1, 6)], F.count_if(error).alias("parse_errors"), F.round(F.avg(c), 6).alias("mean"))


def flag_quality(rows: DataFrame, flagged: Column, low: Column) -> DataFrame:
    """Share flagged; recall = share flagged of low scores; precision = share of low scores among the flagged."""
    f, bad = flagged.cast("double"), low.cast("double")
    return rows.agg(
        F.count("*").alias("n"), F.round(100.0 * F.avg(f), 6).alias("flag_pct"), F.round(100.0 * F.avg(F.when(low, f)), 6).alias("recall_pct"),
        F.round(100.0 * F.avg(F.when(flagged, bad)), 6).alias("precision_pct"))


def hash_rank(by: list[str], key: Column, seed: int = 42) -> Column:
    """A rank in an order that depends on ids and the seed only: samples of it are fixed, order-free and nested."""
    return F.row_number().over(W.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), key))


def bounded_first(rows: DataFrame, by: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group. Spark keeps ``n`` rows a group and task before the shuffle (window group limit)."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def nested_sample(rows: DataFrame, n: int, key: str = "id", by: list[str] | None = None, seed: int = 42) -> DataFrame:
    md5 = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return bounded_first(rows, by, n, [md5, F.col(key)]) if by else rows.orderBy(md5, key).limit(n)


def balanced_sample(rows: DataFrame, systems: list[str], n: int, key: str = "id", seed: int = 42, paired: bool = False, require: str | None = None, strict: bool = False) -> DataFrame:
    """``n`` items over the systems, as even as can be, the first systems one more; with ``paired`` the same ids for all.

    With ``require`` only rows count where that column (a judge's score) is not null. With ``strict`` a system that has
    fewer rows than it should give is an error.
    """
    if require:
        rows = rows.where(F.col(require).isNotNull())
    quota = {s: n // len(systems) + (i < n % len(systems)) for i, s in enumerate(systems)}
    rows = rows.where(F.col("system").isin(systems))
    if paired:
        quota = dict.fromkeys(systems, n // len(systems))
        rows = rows.join(in_all_systems(rows, key, len(systems)), key, "left_semi")
    limit = F.lit(0)
    for s, q in quota.items():
        limit = F.when(F.col("system") == s, q).otherwise(limit)
    if strict:
        have = {r.system: r.n for r in rows.groupBy("system").agg(F.count("*").alias("n")).collect()}
        if short := {s: have.get(s, 0) for s, q in quota.items() if have.get(s, 0) < q}:
            raise ValueError(f"too few rows: {short}, wanted {quota}")
    who = F.col(key).cast("string") if paired else F.concat_ws(":", "system", F.col(key).cast("string"))
    return rows.withColumn("__rn", hash_rank(["system"], who, seed)).where(F.col("__rn") <= limit).drop("__rn")


def in_all_systems(rows: DataFrame, key: str, n_systems: int) -> DataFrame:
    """Relational division: ids that every system has."""
    return rows.groupBy(key).agg(F.count_distinct("system").alias("__s")).where(F.col("__s") == n_systems).select(key)


def blind_items(rows: DataFrame, seed: int = 42, key: str = "id") -> DataFrame:
    """Numbers H001, H002, ... in a fixed shuffled order; for annotation sheets, which are small."""
    order = F.md5(F.concat_ws(":", F.lit(seed), "system", F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("item_id", F.concat(F.lit("H"), F.lpad(F.row_number().over(W.orderBy(order, key)).cast("string"), 3, "0")))


def greedy_match(tokens: DataFrame, pair: str = "pair") -> DataFrame:
    """Precision, recall and F of greedy cosine matching. ``tokens``: (pair, side 0 hypothesis or 1 reference, emb, mask).

    Tokens are grouped by pair as arrays, so each pair's products are made inside a row. An empty side gives 0.
    """
    norm = F.sqrt(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = tokens.where("mask = 1").withColumn("n", norm).withColumn("u", F.transform("emb", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(0.0)))
    sides = unit.groupBy(pair).agg(F.collect_list(F.when(F.col("side") == 0, F.col("u"))).alias("h"), F.collect_list(F.when(F.col("side") == 1, F.col("u"))).alias("r"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def mean_best(a: Column, b: Column) -> Column:
        best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y))))
        return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)

    scored = sides.select(pair, mean_best(F.col("h"), F.col("r")).alias("p"), mean_best(F.col("r"), F.col("h")).alias("r"))
    return scored.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
