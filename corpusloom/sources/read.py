"""Readers. All give fixed schemas; filters and column choices reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hash_split, text_of

RECORD = ("id", "document", "summary")


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    if lost := [c for c in columns if c not in df.columns]:
        raise MissingColumns(f"missing columns: {', '.join(lost)}")
    return df


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Reads the columns asked for only; an absent one is an error."""
    df = spark.read.parquet(path)
    return require_columns(df, *columns).select(*columns) if columns else df


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def news_records(raw: DataFrame, dataset: str, split: str, key: str = "guid", document: str = "article", summary: str = "abstract") -> DataFrame:
    return raw.select(
        F.concat_ws("-", F.lit(dataset), F.lit(split), F.col(key).cast("string")).alias("id"), text_of(F.col(document)).alias("document"),
        text_of(F.col(summary)).alias("summary"), F.lit(split).alias("split"), F.lit(dataset).alias("dataset"))


def sections_of(raw: DataFrame, article: str = "article") -> Column:
    """Sections as an array of structs, from either layout."""
    kind = raw.schema[article].dataType.typeName()
    if kind == "array":
        return F.transform(F.col(article), lambda s: F.struct(s["document"].alias("document"), s["summary"].alias("summary")))
    return F.arrays_zip(F.col(f"{article}.document").alias("document"), F.col(f"{article}.summary").alias("summary"))


def howto_records(raw: DataFrame, dataset: str, key: str = "url", seed: int = 42, ratios=(("train", 0.9), ("validation", 0.05), ("test", 0.05)), max_scan: int | None = None, limit_per_split: int | None = None, ordinal: str | None = None) -> DataFrame:
    """One record a section. All sections of an article share the split that the hash of its key gives."""
    if max_scan is not None:
        raw = first_rows(raw, max_scan, ordinal or key)
    stem = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 12)
    order = [F.col(ordinal)] if ordinal else []
    rows = raw.select(
        stem.alias("stem"), F.col(key).alias("cluster"), *[c.alias("scan") for c in order], hash_split(F.col(key), seed, ratios).alias("split"), F.posexplode(sections_of(raw)).alias("section", "s"))
    out = rows.select(
        F.concat_ws("-", F.lit(dataset), "stem", F.col("section").cast("string")).alias("id"), text_of(F.col("s.document")).alias("document"), text_of(F.col("s.summary")).alias("summary"),
        "split", F.lit(dataset).alias("dataset"), "cluster", "section", *(["scan"] if order else []))
    if limit_per_split is not None:
        place = F.row_number().over(W.partitionBy("split").orderBy("scan" if order else "cluster", "section"))
        out = out.withColumn("__rn", place).where(F.col("__rn") <= limit_per_split).drop("__rn")
    return out


LOADERS = {"news": news_records, "howto": howto_records}


def load(name: str, *args, **options) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"unknown dataset {name!r}; known are {', '.join(sorted(LOADERS))}")
    return LOADERS[name](*args, **options)


def read_sheet(spark: SparkSession, path: str, *scores: str) -> DataFrame:
    """An annotation sheet: comma or semicolon, byte order mark or not, blanks around headers; scores must be 1 to 5."""
    head = spark.read.text(path).limit(1).first()
    first = (head[0] if head else "").lstrip("﻿")
    df = spark.read.csv(path, sep=";" if first.count(";") > first.count(",") else ",", header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    require_columns(df, "item_id", *scores)
    df = df.withColumn("item_id", F.trim("item_id")).withColumns({s: F.trim(s).try_cast("double").cast("int") for s in scores})
    for s in scores:
        if bad := df.where(F.col(s).isNotNull() & ~F.col(s).between(1, 5)).select("item_id", s).head(3):
            raise ValueError(f"{s} out of 1 to 5: {[tuple(r) for r in bad]}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, by Spark's own file systems."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines cache; ``seq`` orders its lines by the time their file was written, then by file and place. Spark gives
    files of later appends random names, so names alone do not tell which came last. Blank lines are skipped; a folder
    that does not exist yet is an empty cache."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id string, prediction string, fp string, `in` string, seq struct<time:timestamp,file:string,block:bigint,at:bigint>")
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    r = F.from_json("value", "id string, prediction string, fp string, `in` string")
    return rows.where(F.trim("value") != "").select(r.alias("r"), F.struct("time", "file", "block", "at").alias("seq")).select("r.*", "seq")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """A run's JSON of parallel arrays as one row a document."""
    raw = spark.read.json(path, multiLine=True)
    arrays = [c for c in ("ids", "latency_ms", "generate_ms", "new_tokens", "input_tokens", "predictions") if c in raw.columns]
    rest = [c for c in raw.columns if c not in arrays]
    return raw.select(*rest, F.inline(F.arrays_zip(*arrays)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("id"), F.col("value").alias("document"))
