"""The registered query of each operator, over its whole table, and the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, media, mixing, neardup, quality, toxicity, urls, warc
from .common import new_path, table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path = new_path(spark, "media")
    media.write_media(docs, F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), path)
    rows = media.media_features(media.read_media(spark, path))
    return rows.select(
        F.regexp_extract("member", r"^\d+-(.*)\.png$", 1).try_cast("bigint").alias("doc_id"),
        F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "archive", "offset", "error"))).otherwise(F.col("n_bytes")).alias("n_bytes"),
        "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    positions = F.transform("positions", lambda p: F.round(p, 6)).alias("positions")
    return mixing.by_position(mixed).select("doc_id", "size", "source_size", "target", "taken", "source", "passes", "extra", F.round("position", 6).alias("position"), positions)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = quality.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return scores


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    rows = warc.read_warc(spark, path)
    gap = F.raise_error(F.concat_ws(" ", F.lit("gap"), "file", "offset", "length", "reason"))
    return rows.select(
        F.when(F.col("kind") == "gap", gap).otherwise(warc.page_of(F.col("record_id"))).alias("page_id"),
        "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.identify(docs, language.train(docs))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", "__toxicity.*")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")).drop("matches")


QUERIES = {f.__name__: f for f in (
    op1_media, op2_decontaminate, op3_mix, op4_quality, op5_warc, op6_language, op7_neardup, op8_toxicity, op9_urls, op10_licenses)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(greatest(len(w) - 9, 1))) AS i, w FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM bw),
lens AS (SELECT DISTINCT n FROM wins),
dw AS (SELECT doc_id, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i, w FROM d, lens),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM dw) JOIN wins USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', hex[i])]), 'string_agg', '') AS b FROM p),
coded AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT), 1)), 'string_agg', '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first_id FROM bits)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM coded""",
    "op9_urls": r"""
WITH u AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
listed AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
    CASE PATTERNS END AS any_pattern FROM u)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
         WHEN any_pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
    CASE WHEN rule IS NULL THEN any_pattern END AS pattern
FROM listed""",
}
# every pattern is run on every page here, the smaller name first; the operator runs only those that its index fetches
ORACLES["op9_urls"] = ORACLES["op9_urls"].replace("PATTERNS", " ".join(
    f"WHEN regexp_matches(host || path, '{r.regex}') THEN '{r.name}'" for r in sorted(urls.RULES, key=lambda r: r.name) if not r.listed))

_BLANK_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: An exact join on shingles, without bands or sketches.
ORACLES["op7_neardup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n) AS nx, any_value(b.n) AS ny FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p WHERE 100 * shared >= 75 * (nx + ny - shared)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, low) AS component_id, doc_id <= coalesce(low, doc_id) AS kept FROM s LEFT JOIN c ON x = doc_id"""

_TEMPLATES = ", ".join(f"({t}, '{label}', '{passage}', '{keys[0]}')" for t, (label, passage, keys) in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.BASE)
#: Every place of every template is compared word by word here; rarest words are counted over all documents, as the index does.
ORACLES["op10_licenses"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
t AS (SELECT *, string_split(passage, ' ') AS p FROM (VALUES {_TEMPLATES}) x(t, label, passage, key)),
tw AS (SELECT t, unnest(p) AS word, unnest(range(len(p))) AS pos FROM t),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM e WHERE word IN (SELECT word FROM tw) GROUP BY word),
rare AS (SELECT t, word FROM (SELECT DISTINCT t, word FROM tw) LEFT JOIN df USING (word) QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), word) <= {licenses.RARE_WORDS}),
v AS (SELECT doc_id, tw.t, i - pos AS start, count(*) AS same, count(DISTINCT rare.word) AS agree FROM e JOIN tw USING (word) LEFT JOIN rare ON rare.t = tw.t AND rare.word = tw.word GROUP BY ALL),
m AS (SELECT doc_id, label, same / len(p)::DOUBLE AS share FROM v JOIN t USING (t) JOIN d USING (doc_id)
    WHERE same / len(p)::DOUBLE >= {licenses.LEAST} AND agree >= least({licenses.AGREE}, len(list_distinct(p)))
    AND contains(' ' || array_to_string(w[greatest(start, 0) + 1 : start + len(p)], ' ') || ' ', ' ' || key || ' ')),
b AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: array_to_string(w[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase)) AS pos FROM d, (VALUES {_PHRASES}) x(phrase, label)),
bs AS (SELECT doc_id, count(*) AS n, min(pos) AS low, max(pos) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
ls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
ms AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low AS first_word, high AS last_word, coalesce(bs.labels, '') AS base_labels, coalesce(ls.labels, '') AS labels,
    CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN ms USING (doc_id)"""


def _sql_inverse(knots) -> str:
    """``mixing.inverse`` of ``q`` in SQL."""
    total, done, pieces = mixing.integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        rest = f"greatest(0::DOUBLE, least({area}::DOUBLE, q * {total}::DOUBLE - {done}::DOUBLE))"
        x = f"2 * {rest} / ({w0}::DOUBLE + sqrt(greatest(0::DOUBLE, {w0 * w0}::DOUBLE + 2 * ({slope}::DOUBLE) * {rest})))"
        done += area
        pieces.append(f"WHEN q * {total}::DOUBLE <= {done}::DOUBLE THEN {t0}::DOUBLE + CASE WHEN {rest} > 0 THEN {x} ELSE 0 END")
    pieces[-1] = "WHEN true THEN " + pieces[-1].split(" THEN ", 1)[1]
    return f"CASE {' '.join(pieces)} END"


_POSITION = " ".join(f"WHEN {i} THEN {_sql_inverse(k)}" for i, k in enumerate(mixing.SCHEDULES))
ORACLES["op3_mix"] = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS schedule FROM d GROUP BY source),
w AS (SELECT *, [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][schedule + 1] AS weight, 2::DOUBLE * source_size AS most FROM s),
c AS (SELECT *, most / weight AS stops, row_number() OVER (ORDER BY most / weight, source) AS k,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, k) AS level FROM c WHERE level < stops),
t AS (SELECT c.source, source_size, schedule, coalesce(least(most, weight * l.level), most) AS target FROM c, l),
r AS (SELECT doc_id, d.source, size, source_size, schedule, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes FROM r),
e AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - passes * source_size - start)) AS extra FROM p),
f AS (SELECT *, list_transform(range(CASE WHEN size > 0 THEN passes + CASE WHEN extra > 0 THEN 1 ELSE 0 END ELSE 0 END), lambda k: (start + k * source_size) / greatest(target, 1)) AS qs FROM e),
g AS (SELECT *, list_transform(qs, lambda q: round(CASE schedule {_POSITION} END, 6)) AS positions FROM f)
SELECT doc_id, size, source_size, target, (passes * size + extra)::BIGINT AS taken, source, passes::BIGINT AS passes, extra::BIGINT AS extra, positions[1] AS position, positions
FROM g"""
