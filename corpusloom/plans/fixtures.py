"""The tables that the registered queries derive from the driver's, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.classes import ABBREVIATIONS, NOT_SPACE, SPACE, WORD


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan with fewer partitions than cores (one small file) over all of them; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(system, id, dataset, is_long, document, summary, prediction, faithfulness, human, cluster, stratum).

    The reference summary is sentences 2 and 3; systems are simple picks of sentences. Documents with fewer
    than three sentences are left out.
    """
    def picked(s):
        longest = F.element_at(F.array_sort(F.transform(s, lambda x, i: F.struct((-F.char_length(x)).alias("n"), i.alias("i"), x.alias("x")))), 1)["x"]
        systems = {"lead1": F.element_at(s, 1), "lead3": F.array_join(F.slice(s, 1, 3), " "), "tail2": F.array_join(F.slice(s, -2, 2), " "), "long1": longest}
        picks = F.array(*[F.struct(F.lit(k).alias("system"), v.alias("prediction")) for k, v in systems.items()])
        return F.when(F.size(s) >= 3, F.struct(F.array_join(F.slice(s, 2, 2), " ").alias("summary"), (text.token_count(F.col("text")) > 1024).alias("is_long"), picks.alias("picks")))

    d = documents(spark, sf).withColumn("x", text.let(text.sentences(F.col("text")), picked))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("l_id"), (1 + 2 * F.col("quality") + 2 * (1 - F.col("toxic"))).alias("faithfulness"))
    draw = text.hash_draw(F.concat(F.lit("human:"), F.col("doc_id").cast("string")))
    return d.join(labels, F.col("doc_id") == F.col("l_id"), "left").select(
        "doc_id", F.col("lang").alias("dataset"), "x.is_long", F.col("text").alias("document"),
        F.col("x.summary").alias("summary"), "faithfulness", F.when(F.col("faithfulness").isNotNull(), 1 + F.floor(draw * 5).cast("int")).alias("human"),
        F.col("source").alias("cluster"), F.col("lang").alias("stratum"), F.inline_outer("x.picks")).where("system is not null").withColumnRenamed("doc_id", "id")  # a filter below would split sentences twice


def split_records(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), text.hash_split(F.col("source")).alias("split0"), text.hash_split(F.col("doc_id"), 7, (("train", 0.6), ("validation", 0.2), ("test", 0.2))).alias("split"),
                    F.col("text").alias("document"), text.lead(F.col("text"), 1).alias("summary")).drop("split0")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """UI calls made of events: latency, strategy, document, chunks."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("id"), F.col("value").alias("latency_ms"), (F.col("value") * 0.8).alias("generate_ms"), (F.col("event_id") % 97 + 3).alias("new_tokens"),
        (F.col("event_id") % 1500).alias("input_tokens"), F.when(F.col("event_id") % 3 == 0, "direct").when(F.col("event_id") % 3 == 1, "extractive").otherwise("hierarchical").alias("strategy"),
        F.when(F.col("event_id") % 3 == 2, F.col("event_id") % 4 + 2).alias("n_chunks"), "event_type", "event_id")


# the same in DuckDB's SQL

ABBREVIATION = (
    r"(^|[\s\"'“‘(\[.])((?" + "{flags}" + ":" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")|\p{Lu})\.((?:[!?…][.!?…]*)?[\"'”’)\]]*)("
    + SPACE + ")"
)


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_sentences(x: str) -> str:
    quote = "''"
    pattern = ABBREVIATION.replace("{flags}", "i").replace("'", quote)
    boundary = text.BOUNDARY.replace("'", quote)
    out = f"coalesce({x}, '')"
    for _ in range(2):
        out = f"regexp_replace({out}, '{pattern}', '\\1\\2.\\3' || chr(1) || '\\4', 'g')"
    out = f"regexp_replace({out}, '{boundary}', '\\1' || chr(2) || '\\2', 'g')"
    pieces = f"list_transform(regexp_split_to_array({out}, '[\\x02\\n]'), lambda p: {sql_trim('replace(p, chr(1), chr(1)[1:0])')})"
    return f"list_filter({pieces}, lambda p: length(p) >= 2)"


def sql_syllables(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{WORD}+')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{NOT_SPACE}+')"


def sql_ngrams(words: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({words}) - {n - 2}, 1)), lambda i: array_to_string({words}[i : i + {n - 1}], ' '))"


def sql_draw(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def sql_rouge(p: str, r: str) -> str:
    """F1 of two lists of grams."""
    hits = f"coalesce(list_sum(list_transform(list_intersect(list_distinct({p}), list_distinct({r})), lambda g: least(len(list_filter({p}, lambda x: x = g)), len(list_filter({r}, lambda x: x = g))))), 0)"
    return f"(CASE WHEN len({p}) + len({r}) > 0 THEN 200.0::DOUBLE * {hits} / (len({p}) + len({r})) ELSE 0.0::DOUBLE END)"


SAMPLES = f"""
sents AS (SELECT doc_id, lang, source, text, {sql_sentences('text')} AS s FROM documents),
base AS (SELECT d.doc_id AS id, lang AS dataset, len({sql_tokens('text')}) > 1024 AS is_long, text AS document, array_to_string(s[2:3], ' ') AS summary,
    1 + 2 * l.quality + 2 * (1 - l.toxic) AS faithfulness, CASE WHEN l.doc_id IS NOT NULL THEN 1 + floor({sql_draw("'human:' || d.doc_id::VARCHAR")} * 5)::INT END AS human,
    source AS cluster, lang AS stratum, s FROM sents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE len(s) >= 3),
samples AS (
    SELECT *, 'lead1' AS system, s[1] AS prediction FROM base UNION ALL
    SELECT *, 'lead3', array_to_string(s[1:3], ' ') FROM base UNION ALL
    SELECT *, 'tail2', array_to_string(s[len(s) - 1 : len(s)], ' ') FROM base UNION ALL
    SELECT *, 'long1', list_sort(list_transform(range(1, len(s) + 1), lambda i: {{'n': -length(s[i]), 'i': i, 'x': s[i]}}))[1].x FROM base)"""

CALLS = """calls AS (SELECT user_id AS id, value AS latency_ms, value * 0.8::DOUBLE AS generate_ms, event_id % 97 + 3 AS new_tokens, event_id % 1500 AS input_tokens,
    CASE event_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'extractive' ELSE 'hierarchical' END AS strategy, CASE WHEN event_id % 3 = 2 THEN event_id % 4 + 2 END AS n_chunks, event_type, event_id FROM events)"""
