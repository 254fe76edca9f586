"""Writers: partitioned Parquet, CSV, statistics, blind sheets, provenance, Markdown tables."""

from __future__ import annotations

import json
import platform
from pathlib import PurePosixPath

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.evaluate import blind_items


def write_processed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one folder a dataset and split."""
    df.write.mode(mode).partitionBy("dataset", "split").parquet(path)


def smoke_path(path: str, limited: bool) -> str:
    """Limited runs go to a sibling folder, so that they never overwrite a full one."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.name}_smoke")) if limited and not p.name.endswith("_smoke") else str(p)


def write_csv(df: DataFrame, path: str, *dropped: str) -> None:
    flat = df.drop(*dropped)
    arrays = {c: F.to_json(c) for c, t in flat.dtypes if t.startswith(("array", "map", "struct"))}
    flat.withColumns(arrays).write.mode("overwrite").option("header", True).csv(path)


def stats_json(stats: DataFrame, keys: list[str]) -> str:
    """Nested JSON of a small table of statistics: one level a key."""
    out: dict = {}
    for r in stats.orderBy(*keys).collect():
        row, at = r.asDict(recursive=True), out
        for k in keys[:-1]:
            at = at.setdefault(str(row[k]), {})
        at[str(row[keys[-1]])] = {k: v for k, v in row.items() if k not in keys}
    return json.dumps(out, ensure_ascii=False, indent=2, default=str)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_blind_sheet(rows: DataFrame, path: str, force: bool = False, seed: int = 42) -> None:
    """Items, an empty sheet and the key; refuses to overwrite unless forced."""
    items, mode = blind_items(rows, seed), "overwrite" if force else "errorifexists"
    items.select("item_id", "document", "prediction").orderBy("item_id").write.mode(mode).json(f"{path}/items")
    empty = [F.lit(None).cast("string").alias(c) for c in ("human_score", "human_coverage", "human_notes")]
    items.select("item_id", *empty).orderBy("item_id").write.mode(mode).option("header", True).csv(f"{path}/sheet")
    items.drop("document", "prediction").orderBy("item_id").write.mode(mode).json(f"{path}/key")


def provenance(df: DataFrame, config: dict) -> dict:
    """What a run was made with; never fails it."""
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
        digest = df.sparkSession.range(1).select(content_hash(F.lit(plan), 16)).first()[0]
    except Exception as e:  # noqa: BLE001
        digest = f"unavailable: {type(e).__name__}"
    return {"spark": pyspark.__version__, "python": platform.python_version(), "plan": digest, "config": config}


def shown(value, digits: int = 2) -> str:
    if value is None:
        return "–"
    if isinstance(value, bool):
        return "yes" if value else "no"
    return f"{value:,.{digits}f}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) else str(value)


def markdown_table(df: DataFrame, order: list[str], digits: int = 2, most: int = 1000) -> str:
    """A small result table as Markdown."""
    rows = df.orderBy(*order).limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(v, digits) for v in r) + " |" for r in rows])


def evaluation_report(metrics: DataFrame, significance: DataFrame, title: str = "Evaluation") -> str:
    """Main table, subsets, intervals and paired tests."""
    main = metrics.where("subset = 'all'").drop("subset")
    parts = [f"# {title}", markdown_table(main, ["system"]), "## Subsets", markdown_table(metrics.where("subset <> 'all'"), ["subset", "system"]),
             "## Intervals", markdown_table(significance.where("kind = 'ci'").select("system", "metric", "n", "mean", "ci_low", "ci_high"), ["metric", "system"]),
             "## Paired tests", markdown_table(significance.where("kind = 'paired'").select("reference", "system", "metric", "n", "diff", "ci_low", "ci_high", "p_value"), ["metric", "system"], 3)]
    return "\n\n".join(parts) + "\n"


def model_card_table(metrics: DataFrame, own: str, metric_names: tuple[str, ...] = ("rouge1", "rouge2", "rougeL"), score: str = "faithfulness_mean") -> str:
    """A card's two tables: all systems on the whole set, and the card's own system by subset with its mean length."""
    shown_columns = [c for c in (*metric_names, score) if c in metrics.columns]
    every = metrics.where("subset = 'all'").select("system", "n", *shown_columns)
    subsets = metrics.where((F.col("system") == own) & (F.col("subset") != "all")).select("subset", "n", *[c for c in (*metric_names, "length_syllables") if c in metrics.columns])
    return "\n\n".join([markdown_table(every, ["system"]), f"By subset, {own}:", markdown_table(subsets, ["subset"])]) + "\n"


def distribution_report(distribution: DataFrame, title: str = "Scores") -> str:
    """The distribution of a score by system, as ``operators.evaluate.score_distribution`` gives it."""
    return f"## {title}\n\n{markdown_table(distribution, ['system'])}\n"


def qualitative_report(rows: DataFrame, k: int = 5, max_chars: int = 700) -> str:
    """The best and worst k samples by faithfulness and ROUGE-L."""
    short = rows.withColumn("document", F.substring("document", 1, max_chars)).select("id", "system", "faithfulness", "rougeL", "prediction", "document")
    best = short.orderBy(F.desc_nulls_last("faithfulness"), F.desc("rougeL"), "id").limit(k)
    worst = short.orderBy(F.asc_nulls_last("faithfulness"), "rougeL", "id").limit(k)
    return "\n\n".join(["## Best", markdown_table(best, ["id"]), "## Worst", markdown_table(worst, ["id"])]) + "\n"


def latency_report(summary: DataFrame, buckets: DataFrame, title: str = "Latency") -> str:
    """``operators.latency.latency_summary`` by its first column, and ``latency_by_bucket``."""
    return "\n\n".join([f"# {title}", markdown_table(summary, [summary.columns[0]]), "## By input size", markdown_table(buckets.orderBy("position"), ["position"])]) + "\n"


def tuning_report(scores: DataFrame, best: DataFrame, metric: str = "rougeL", title: str = "Tuning") -> str:
    """Candidates from the best down, and the one that is picked."""
    picked = best.select("candidate").first()
    table = markdown_table(scores.withColumn("picked", F.col("candidate") == (picked[0] if picked else None)).withColumn("rank", F.row_number().over(W.orderBy(F.desc(metric), "candidate"))), ["rank"])
    return "\n\n".join([f"# {title}", f"Picked: {picked[0] if picked else 'none'}", table]) + "\n"


def flow_report(rollup: DataFrame, identical: DataFrame | None = None, title: str = "User flow") -> str:
    """Calls, documents and numbers of chunks of ``operators.latency.flow_rollup``, and the share of equal outputs."""
    parts = [f"# {title}"]
    for level in ("call", "document", "chunks"):
        parts += [f"## By {level}", markdown_table(rollup.where(F.col("level") == level).drop("level"), ["part"])]
    if identical is not None:
        parts += ["## Equal outputs", markdown_table(identical, ["n"])]
    return "\n\n".join(parts) + "\n"
