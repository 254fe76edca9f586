"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule, a piecewise linear function of training time t in [0, 1]. Its
integral is the source's weight; the part of the integral before t, times the source's target, is
the demand for its words until t. Documents are put in a fixed random order within their source, and
the words before a document, inverted through the demand, give its training position. A source that is
read more than once goes on in the same order, so every pass of a document has a position of its own.

The running sum of a source is taken in two levels, over slices of the random order and inside each
slice, so that no source meets in one task. Everything is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import draw, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Schedules that sources take in turn, by code point: knots (t, weight). Their integrals are 5, 2 and 1.
SCHEDULES = (
    ((0.0, 7.5), (1.0, 2.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)),
)
SHARE, MOST, SLICES = 1.5, 2.0, 4096


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def inverse(knots: Sequence[tuple[float, float]], q: Column) -> Column:
    """The time until which the share ``q`` of a schedule's integral has gone."""
    total, done, out = integral(knots), 0.0, None
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        if area <= 0:
            continue
        rest = F.greatest(F.lit(0.0), F.least(F.lit(area), q * total - done))
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = rest, in the form that keeps digits for a small slope
        x = 2 * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * rest)))
        pieces.append((done + area, F.coalesce(F.lit(t0) + F.when(rest > 0, x).otherwise(0.0), F.lit(t0))))
        done += area
    for upper, t in reversed(pieces):
        out = t if out is None else F.when(q * total <= upper, t).otherwise(out)
    return out


def ranked(rows: DataFrame, *order: Column, name: str) -> DataFrame:
    """Adds the row's number (from 0) in the order: numbers inside range partitions plus the partitions' offsets."""
    dealt = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    before = dealt.groupBy("__part").count().withColumn(
        "__before", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("count")
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__inside", inside).join(before, "__part").withColumn(
        name, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


def plan_sources(sized: DataFrame, schedules=SCHEDULES, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source: source, source_size, schedule number, weight, target.

    The driver keeps three numbers a round: the words that are left to share, the weights that share
    them, and how many targets stopped. Rounds end when no target is above ``most`` times its source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(totals, F.col("source").isNull(), F.col("source"), name="number")
    cycle = F.array(*[F.lit(integral(s)) for s in schedules])
    sources = written(
        sources.withColumn("schedule", (F.col("number") % len(schedules)).cast("int"))
        .withColumn("weight", F.element_at(cycle, F.col("schedule") + 1))
        .withColumn("most", most * F.col("source_size")).drop("number"),
        "sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        left = sources.agg(
            F.sum(F.when(full, F.col("most"))).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("weights"), F.count_if(full).alias("stopped")
        ).first()
        if left.stopped == stopped or not left.weights:
            if not left.weights:
                level = float("inf") if left.stopped else 0.0
            break
        stopped, level = left.stopped, (share * total - (left.given or 0.0)) / left.weights
    target = F.least(F.col("most"), F.col("weight") * F.lit(level)) if level != float("inf") else F.col("most")
    return sources.select("source", "source_size", "schedule", "weight", target.alias("target"))


def mix(docs: DataFrame, schedules=SCHEDULES, share: float = SHARE, most: float = MOST, slices: int = SLICES) -> DataFrame:
    """One row a document with the whole mix: doc_id, source, size, source_size, target, taken, passes, extra, position, positions.

    A source whose target is above its size is read in whole passes, and the last, partial pass takes
    documents in the source's order until the target is reached; the document at the end of it is
    taken up to that word. ``passes`` counts the whole passes, ``extra`` the words of the partial one,
    ``positions`` are the training positions in [0, 1] of the document's first word in each pass that takes of it, in
    order, and ``position`` is the first of them (null if nothing is taken). Null texts have size 0 and are never taken; null sources form a source of their own, the
    last one. The order inside a source is the hash of id and text; where both are equal, either row may
    come first, which no column shows but which of two equal rows is taken. Other columns play no part, so none can
    clash. An empty table gives no rows.
    """
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        draw(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))).alias("order"),
    ).withColumn("slice", F.floor(F.col("order") * slices).cast("int"))
    sized = written(sized, "sized")
    plan = plan_sources(sized, schedules, share, most)
    before = sized.groupBy("source", "slice").agg(F.sum("size").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    offsets = before.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.source", "slice", "before", "source_size", "schedule", "target")
    inside = W.partitionBy("source", "slice").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d").join(
        offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.slice") == F.col("o.slice"))
    ).select("doc_id", "d.source", "size", "source_size", "schedule", "target", (F.col("inside") + F.col("before")).alias("start"))
    words = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    extra = F.greatest(F.lit(0), F.least("size", words - F.col("passes") * F.col("source_size") - F.col("start"))).cast("long")
    rows = rows.withColumn("passes", passes).withColumn("extra", extra).withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
    turns = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)).otherwise(0)
    starts = F.transform(F.slice(F.sequence(F.lit(0).cast("long"), F.greatest(turns, F.lit(1)) - 1), F.lit(1), turns.cast("int")), lambda p: F.col("start") + p * F.col("source_size"))
    return rows.withColumn("positions", F.transform(starts, lambda s: position(s, schedules))).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "passes", "extra", F.get("positions", F.lit(0)).alias("position"), "positions")


def position(start: Column, schedules=SCHEDULES) -> Column:
    """The training position at which ``start`` words of the source have gone by."""
    q = start / F.greatest(F.col("target"), F.lit(1.0))
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        out = F.when(F.col("schedule") == i, inverse(knots, q)).otherwise(out)
    return out


def by_position(mixed: DataFrame) -> DataFrame:
    """The mix, one row a document, range-sorted by its first training position; documents that are not taken come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """(position, doc_id, source, pass, words): what is read when, range-sorted; one row for each pass of a document.

    Words are the document's size in whole passes and ``extra`` in the last, partial one. Of equal positions the
    smaller id comes first.
    """
    return mixed.select("doc_id", "source", "size", "passes", "extra", F.posexplode("positions").alias("pass", "at")).select(
        F.col("at").alias("position"), "doc_id", "source", "pass", F.when(F.col("pass") < F.col("passes"), F.col("size")).otherwise(F.col("extra")).alias("words")
    ).orderBy("position", "doc_id", "pass")
