"""The registered queries: each operator over whole tables, and the same in DuckDB's SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrow, judge, numbers, text
from ..operators import caches, prepare
from ..operators import evaluate as ev
from ..operators import latency as lat
from ..operators import rounds, runs
from . import fixtures as fx
from ..functions.classes import SPACE, WORD
from .fixtures import CALLS, SAMPLES, documents, sql_draw, sql_ngrams, sql_rouge, sql_sentences, sql_syllables, sql_tokens, sql_trim, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def r6(x: str) -> str:
    return f"round({x}, 6)"


# metrics

_P1, _R1 = sql_syllables("prediction"), sql_syllables("summary")


@query(f"""
WITH {SAMPLES},
words AS (SELECT *, {_P1} AS p, {_R1} AS r FROM samples),
scored AS (SELECT system, dataset, is_long, {sql_rouge('p', 'r')} AS rouge1 FROM words),
labelled AS (SELECT system, rouge1, unnest(['all', 'dataset=' || dataset, CASE WHEN is_long THEN 'long' ELSE 'short' END]) AS subset FROM scored)
SELECT system, subset, count(*) AS n, {r6('avg(rouge1)')} AS rouge1 FROM labelled GROUP BY ALL""")
def flagship_rouge1_by_subset(spark, sf):
    rows = fx.samples(spark, sf).withColumn("rouge1", text.rouge_n(F.col("prediction"), F.col("summary"), 1))
    return ev.subset_metrics(rows, ["rouge1"], None)


@query(f"""
WITH {SAMPLES},
words AS (SELECT *, {_P1} AS pw, {_R1} AS rw FROM samples),
grams AS (SELECT system, CASE WHEN len(pw) >= 2 THEN {sql_ngrams('pw', 2)} ELSE [] END AS p, CASE WHEN len(rw) >= 2 THEN {sql_ngrams('rw', 2)} ELSE [] END AS r FROM words)
SELECT system, count(*) AS n, {r6('avg(' + sql_rouge('p', 'r') + ')')} AS rouge2 FROM grams GROUP BY system""")
def rouge2_by_system(spark, sf):
    return fx.samples(spark, sf).groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg(text.rouge_n(F.col("prediction"), F.col("summary"), 2)), 6).alias("rouge2"))


@query(f"""
WITH {SAMPLES},
words AS (SELECT id, ({_P1})[1:40] AS p, ({_R1})[1:40] AS r FROM samples WHERE system = 'lead1'),
lcs AS (SELECT id, p, r, CASE WHEN len(p) > 0 AND len(r) > 0 THEN list_last(list_reduce(p, lambda row, x:
    list_reduce(range(1, len(r) + 1), lambda done, j: list_append(done, CASE WHEN r[j] = x THEN row[j] + 1 ELSE greatest(row[j + 1], list_last(done)) END), [0::BIGINT]),
    list_transform(range(len(r) + 1), lambda z: 0::BIGINT))) ELSE 0 END AS n FROM words)
SELECT id, {r6('CASE WHEN len(p) + len(r) > 0 THEN 200.0::DOUBLE * n / (len(p) + len(r)) ELSE 0.0::DOUBLE END')} AS rouge_l FROM lcs""")
def rouge_l_short(spark, sf):
    return fx.samples(spark, sf).where("system = 'lead1'").select("id", F.round(text.rouge_l(F.col("prediction"), F.col("summary"), 40), 6).alias("rouge_l"))


@query()
def rouge_l_summary(spark, sf):
    return fx.samples(spark, sf).select("system", "id", F.round(arrow.rouge_l(F.col("prediction"), F.col("summary")), 6).alias("rouge_l"))


@query()
def rouge_l_whole(spark, sf):
    return fx.samples(spark, sf).select("system", "id", F.round(arrow.rouge_l(F.col("prediction"), F.col("document")), 6).alias("rouge_l"))


@query(f"""
WITH w AS (SELECT doc_id, {sql_syllables('text')} AS s FROM documents), g AS (SELECT doc_id, CASE WHEN len(s) >= 3 THEN {sql_ngrams('s', 3)} ELSE [] END AS g FROM w)
SELECT doc_id, {r6('CASE WHEN len(g) > 0 THEN 100.0::DOUBLE * (len(g) - len(list_distinct(g))) / len(g) ELSE 0.0::DOUBLE END')} AS repetition FROM g""")
def repetition_rate(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(text.repetition_rate(F.col("text")), 6).alias("repetition"))


@query(f"""
WITH {SAMPLES}, w AS (SELECT system, id, {_P1} AS p, {sql_syllables('document')} AS d FROM samples),
g AS (SELECT system, id, list_distinct(p) AS p1, d AS d1, CASE WHEN len(p) >= 2 THEN list_distinct({sql_ngrams('p', 2)}) ELSE [] END AS p2, CASE WHEN len(d) >= 2 THEN {sql_ngrams('d', 2)} ELSE [] END AS d2 FROM w)
SELECT system, id, {r6('CASE WHEN len(p1) > 0 THEN 100.0::DOUBLE * (len(p1) - len(list_intersect(p1, list_distinct(d1)))) / len(p1) ELSE 0.0::DOUBLE END')} AS novel_1gram,
    {r6('CASE WHEN len(p2) > 0 THEN 100.0::DOUBLE * (len(p2) - len(list_intersect(p2, list_distinct(d2)))) / len(p2) ELSE 0.0::DOUBLE END')} AS novel_2gram FROM g""")
def novel_ngrams(spark, sf):
    p, d = F.col("prediction"), F.col("document")
    return fx.samples(spark, sf).select("system", "id", F.round(text.novelty_rate(p, d, 1), 6).alias("novel_1gram"), F.round(text.novelty_rate(p, d, 2), 6).alias("novel_2gram"))


# text functions

_STRIP = "coalesce(html, '')"
for _pattern, _to in ((r"(?s)<!--.*?-->", "' '"), (r"(?is)<script\b[^>]*>.*?</script\s*>", "' '"), (r"(?is)<style\b[^>]*>.*?</style\s*>", "' '"),
                      (r"(?i)</?(?:p|div|br|li|ul|ol|tr|h[1-6]|section|article)\b[^<>]*>", "chr(10)"), (r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?/?>", "' '")):
    _STRIP = f"regexp_replace({_STRIP}, '{_pattern}', {_to}, 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_entity}', '{_char}')"


def _sql_squeeze(x: str) -> str:
    from ..functions.classes import INLINE_SPACE, SPACE

    return sql_trim(f"regexp_replace(regexp_replace({x}, '{INLINE_SPACE}+', ' ', 'g'), '{SPACE}*\\n{SPACE}*', chr(10), 'g')")


@query(f"SELECT page_id, md5(x) AS digest, length(x)::INT AS n_chars FROM (SELECT page_id, {_sql_squeeze(_STRIP)} AS x FROM pages)")
def strip_html_pages(spark, sf):
    x = text.squeeze(text.strip_markup(F.col("html")))
    return table(spark, sf, "pages").select("page_id", F.md5(x.cast("binary")).alias("digest"), F.char_length(x).alias("n_chars"))


@query(f"""
SELECT doc_id, md5(x) AS digest FROM (SELECT doc_id, {_sql_squeeze("regexp_replace(translate(nfc_normalize(coalesce(text, '')), chr(9) || chr(11) || chr(12) || chr(13) || chr(8232) || chr(8233) || chr(133), '   ' || chr(10) || chr(10) || chr(10) || chr(10)), '[' || chr(1) || '-' || chr(9) || '\\x0b-\\x1f\\x7f-\\x{9f}]|\\p{Cf}', '', 'g')")} AS x FROM documents)""")
def normalize_text(spark, sf):
    x = arrow.normalize(F.col("text"), markup=False, style=None)
    return documents(spark, sf).select("doc_id", F.md5(x.cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)")
def sentence_split(spark, sf):
    return documents(spark, sf).select("doc_id", text.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, array_to_string(({sql_sentences('text')})[1:3], ' ') AS lead FROM documents")
def lead_n(spark, sf):
    return documents(spark, sf).select("doc_id", text.lead(F.col("text"), 3).alias("lead"))


@query(f"""
SELECT lang, count(*) AS n, {r6('avg(k)')} AS mean, {r6('quantile_cont(k, 0.95)')} AS p95, max(k) AS max, {r6('100.0::DOUBLE * avg((k > 1024)::INT)')} AS pct_over
FROM (SELECT lang, len({sql_tokens('text')})::INT AS k FROM documents) GROUP BY lang""")
def token_stats_by_lang(spark, sf):
    return prepare.length_stats(documents(spark, sf).select("lang", text.token_count(F.col("text")).alias("k")), "k", ["lang"])


_REC = f"recs AS (SELECT doc_id AS id, doc_id AS ordinal, text AS document, array_to_string(({sql_sentences('text')})[1:1], ' ') AS summary FROM documents)"


@query(f"""
WITH {_REC}, c AS (SELECT *, len({sql_tokens('document')}) AS d, len({sql_tokens('summary')}) AS s FROM recs),
r AS (SELECT CASE WHEN {sql_trim("coalesce(document, '')")} = '' THEN 'empty_document' WHEN {sql_trim("coalesce(summary, '')")} = '' THEN 'empty_summary'
    WHEN d < 20 THEN 'short_document' WHEN s < 3 THEN 'short_summary' WHEN s > d THEN 'summary_longer_than_document' END AS reason FROM c)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def filter_reasons(spark, sf):
    rows = prepare.with_reason(fx.split_records(spark, sf))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_SPLIT = f"""recs AS (SELECT doc_id AS id, doc_id AS ordinal, {sql_draw("'7:' || doc_id::VARCHAR")} AS u, text FROM documents),
keyed AS (SELECT *, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS split,
    sha1(lower({sql_trim("regexp_replace(coalesce(text, ''), '[' || chr(9) || '-' || chr(13) || ' ]+', ' ', 'g')")})) AS k FROM recs),
ranked AS (SELECT *, CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS p FROM keyed),
marked AS (SELECT id, split, CASE WHEN p > min(p) OVER (PARTITION BY k) THEN 'duplicate_cross_split_' || split
    WHEN ordinal > min(ordinal) OVER (PARTITION BY k, split) THEN 'duplicate_within_' || split END AS drop_reason FROM ranked)"""


@query(f"WITH {_SPLIT} SELECT id, split, drop_reason FROM marked")
def dedup_cross_split(spark, sf):
    return prepare.dedup_reasons(fx.split_records(spark, sf)).select("id", "split", "drop_reason")


@query(f"WITH {_SPLIT} SELECT split, drop_reason, count(*) AS n FROM marked GROUP BY ALL")
def dedup_counts(spark, sf):
    return prepare.dedup_reasons(fx.split_records(spark, sf)).groupBy("split", "drop_reason").agg(F.count("*").alias("n"))


@query(f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'validation' ELSE 'test' END AS split FROM (SELECT {sql_draw(chr(39) + '42:' + chr(39) + ' || page_id::VARCHAR')} AS u FROM pages)) GROUP BY split")
def hash_split_ratio(spark, sf):
    return table(spark, sf, "pages").groupBy(text.hash_split(F.col("page_id")).alias("split")).agg(F.count("*").alias("n"))


_BM25 = f"""s AS (SELECT doc_id, {sql_sentences('text')} AS s FROM documents),
p AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sent, len(s) AS n FROM s),
t AS (SELECT doc_id, pos, unnest({sql_syllables('sent')}) AS term FROM p),
tf AS (SELECT doc_id, pos, term, count(*) AS f FROM t GROUP BY ALL),
l AS (SELECT doc_id, pos, n, coalesce(k, 0) AS k, avg(coalesce(k, 0)) OVER (PARTITION BY doc_id) AS mean FROM p LEFT JOIN (SELECT doc_id, pos, count(*) AS k FROM t GROUP BY ALL) USING (doc_id, pos)),
w AS (SELECT doc_id, pos, f, count(*) OVER (PARTITION BY doc_id, term) AS c, sum(f) OVER (PARTITION BY doc_id, term) AS total FROM tf),
b AS (SELECT doc_id, pos, sum(ln((n - c + 0.5::DOUBLE) / (c + 0.5::DOUBLE) + 1) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * k / mean)) * (total - f)) / (any_value(n) - 1) AS score FROM w JOIN l USING (doc_id, pos) WHERE n > 1 GROUP BY ALL),
score AS (SELECT doc_id, pos, sent, n, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score FROM p LEFT JOIN b USING (doc_id, pos))"""


@query(f"WITH {_BM25} SELECT doc_id, pos::INT AS pos, round(score, 4) AS score FROM score")
def bm25_centrality(spark, sf):
    s = documents(spark, sf).select("doc_id", arrow.bm25_centrality(text.sentences(F.col("text"))).alias("x"))
    return s.select("doc_id", F.posexplode_outer("x").alias("pos", "x")).where("pos is not null").select("doc_id", "pos", F.round("x", 4).alias("score"))


@query()
def lexrank_centrality(spark, sf):
    s = documents(spark, sf).select("doc_id", arrow.lexrank(text.sentences(F.col("text"))).alias("x"))
    return s.select("doc_id", F.posexplode_outer("x").alias("pos", "x")).where("pos is not null").select("doc_id", "pos", F.round("x", 6).alias("score"))


def _sql_extract(scores: str, tokens: int) -> str:
    """Greedy fill by rank, with skips; texts within the limit stay whole."""
    def n(x: str) -> str:
        return f"len(regexp_extract_all({x}, '{fx.NOT_SPACE}+'))"

    return f"""
WITH {scores}, sized AS (SELECT doc_id, pos, sent, {n('sent')} AS k, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS rank FROM score),
listed AS (SELECT doc_id, list({{'pos': pos::INT, 'sent': sent, 'k': k}} ORDER BY rank) AS l, count(*)::INT AS num FROM sized GROUP BY doc_id),
filled AS (SELECT doc_id, l, num, list_reduce(list_prepend({{'used': 0::BIGINT, 'ids': []::INT[]}}, list_transform(l, lambda x: {{'used': x.k, 'ids': [x.pos]}})),
    lambda a, x: CASE WHEN a.used + x.used <= {tokens} THEN {{'used': a.used + x.used, 'ids': list_concat(a.ids, x.ids)}} ELSE a END) AS f FROM listed),
d AS (SELECT doc_id, text, coalesce({n('text')}, 0) AS tokens FROM documents),
o AS (SELECT doc_id, text, tokens, coalesce(num, 0) AS num, CASE WHEN num > 0 THEN list_sort(f.ids) END AS ids, CASE WHEN num > 0 THEN l END AS l, f.used FROM d LEFT JOIN filled USING (doc_id)),
q AS (SELECT *, CASE WHEN num > 0 AND tokens > {tokens} AND len(ids) = 0 THEN regexp_extract(l[1].sent, '^[\\s]*(?:{fx.NOT_SPACE}+{SPACE}+){{0,{tokens - 1}}}{fx.NOT_SPACE}+') END AS cut FROM o)
SELECT doc_id, num AS num_sentences, num > 0 AND tokens > {tokens} AS was_filtered, cut IS NOT NULL AS was_truncated,
    CASE WHEN num = 0 THEN []::INT[] WHEN tokens <= {tokens} THEN range(num)::INT[] WHEN cut IS NOT NULL THEN [l[1].pos] ELSE ids END AS selected_sentence_ids,
    CASE WHEN num = 0 THEN 0 WHEN tokens <= {tokens} THEN tokens WHEN cut IS NOT NULL THEN {tokens} ELSE used END::INT AS input_tokens,
    CASE WHEN num = 0 THEN '' WHEN tokens <= {tokens} THEN text WHEN cut IS NOT NULL THEN cut
         ELSE array_to_string(list_transform(list_sort(list_filter(l, lambda x: list_contains(ids, x.pos))), lambda x: x.sent), ' ') END AS input_text
FROM q"""


@query(_sql_extract(_BM25, 255))
def extractive_budget(spark, sf):
    return documents(spark, sf).select("doc_id", arrow.extract(F.col("text"), max_tokens=256).alias("x")).select("doc_id", "x.*")


@query()
def extractive_ratio(spark, sf):
    return documents(spark, sf).select("doc_id", arrow.extract(F.col("text"), max_tokens=256, selection="ratio", ranker="lexrank").alias("x")).select("doc_id", "x.*")


@query()
def chunk_documents(spark, sf):
    c = documents(spark, sf).select("doc_id", F.posexplode(arrow.chunks(F.col("text"), max_tokens=128, overlap=32)).alias("chunk", "c"))
    return c.select("doc_id", "chunk", "c.num_tokens", "c.overlap_units", F.md5(F.col("c.text").cast("binary")).alias("digest"))


@query(f"""
WITH {SAMPLES}, a AS (SELECT id, {_P1} AS p FROM samples WHERE system = 'lead3'), b AS (SELECT id, {_P1} AS q FROM samples WHERE system = 'long1'),
g AS (SELECT id, list_distinct(CASE WHEN len(p) >= 2 THEN {sql_ngrams('p', 2)} WHEN len(p) = 1 THEN p ELSE [] END) AS x, list_distinct(CASE WHEN len(q) >= 2 THEN {sql_ngrams('q', 2)} WHEN len(q) = 1 THEN q ELSE [] END) AS y FROM a JOIN b USING (id))
SELECT id, {r6('CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)) ELSE 0.0::DOUBLE END')} AS overlap FROM g""")
def overlap_containment_pairs(spark, sf):
    s = fx.samples(spark, sf)
    a, b = s.where("system = 'lead3'").select("id", F.col("prediction").alias("a")), s.where("system = 'long1'").select("id", F.col("prediction").alias("b"))
    return a.join(b, "id").select("id", F.round(text.containment(F.col("a"), F.col("b")), 6).alias("overlap"))


@query()
def near_dup_sentences(spark, sf):
    s = documents(spark, sf).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("before"), F.size(arrow.merge_repeats(F.col("s"))).alias("after"))


@query()
def reduce_concat(spark, sf):
    d = documents(spark, sf).select("doc_id", F.col("text").alias("source"), text.sentences(F.col("text")).alias("parts"))
    return d.select("doc_id", arrow.reduce_parts(F.col("parts"), F.col("source"), 60, 0.6, "drop").alias("r")).select("doc_id", "r.*")


def _sql_canonical(x: str) -> str:
    return (f"CASE WHEN regexp_full_match({x}, '[0-9]{{1,2}}-[0-9]{{1,2}}(-[0-9]{{4}})?') THEN replace({x}, '-', '/') WHEN regexp_full_match({x}, '[0-9]{{1,3}}([.,][0-9]{{3}})+') THEN regexp_replace({x}, '[.,]', '', 'g') "
            f"WHEN regexp_full_match({x}, '[0-9]+[.,][0-9]+') THEN replace({x}, ',', '.') ELSE {x} END")


@query(rf"""
WITH c AS (SELECT conv_id, turn, text AS reply, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations),
n AS (SELECT conv_id, turn, list_transform(regexp_extract_all(coalesce(reply, ''), '[0-9]+(?:[.,/:\-][0-9]+)*'), lambda v: v) AS a, regexp_extract_all(coalesce(source, ''), '[0-9]+(?:[.,/:\-][0-9]+)*') AS b FROM c),
k AS (SELECT conv_id, turn, a, list_concat(list_transform(b, lambda v: {_sql_canonical('v')}), flatten(list_transform(b, lambda v: list_concat(list_transform(string_split(v, '-'), lambda q: {_sql_canonical('q')}),
    flatten(list_transform(list_concat(string_split(v, '-'), [{_sql_canonical('v')}]), lambda q: list_filter([regexp_extract(q, '^([0-9]{{1,2}}/[0-9]{{1,2}})/([0-9]{{4}})$', 1), regexp_extract(q, '^([0-9]{{1,2}}/[0-9]{{1,2}})/([0-9]{{4}})$', 2), regexp_extract(q, '^[0-9]{{1,2}}/([0-9]{{4}})$', 1)], lambda z: z <> ''))))))) AS known FROM n)
SELECT conv_id, turn, len(list_distinct(a))::INT AS n_numbers, len(list_filter(list_distinct(a), lambda v: NOT list_contains(known, {_sql_canonical('v')})))::INT AS n_unsupported FROM k""")
def number_factcheck(spark, sf):
    c = table(spark, sf, "conversations").withColumn("source", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    reply = F.col("text")
    return c.select("conv_id", "turn", F.size(F.array_distinct(numbers.numbers_in(reply))).alias("n_numbers"), F.size(numbers.unsupported_numbers(reply, F.col("source"))).alias("n_unsupported"))


@query()
def factcheck_names(spark, sf):
    c = fx.samples(spark, sf).select("system", "id", arrow.check_summary(F.col("prediction"), F.col("summary")).alias("c"))
    return c.select("system", "id", F.size("c").alias("sentences"), F.size(F.filter("c", lambda x: F.size(x["unsupported"]) > 0)).alias("flagged"))


def _sql_clean(x: str) -> str:
    t = f"regexp_replace({sql_trim(f'coalesce({x}, chr(0)[1:0])')}, '(?i){text.LABEL}', '')"
    lines = f"list_transform(regexp_split_to_array({t}, '[\\n\\r]+'), lambda v: {sql_trim(f'regexp_replace(v, {chr(39)}^\\s*(?:[-*•]|[0-9]+[.)])\\s+{chr(39)}, {chr(39)}{chr(39)})')})"
    return f"array_to_string(list_filter({lines}, lambda v: v <> ''), ' ')"


_QUOTES_SQL = "['\"', '''', '“', '”', '‘', '’', '«', '»']"
_CLEANED = f"""a AS (SELECT conv_id, turn, {_sql_clean('text')} AS t FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, turn, CASE WHEN length(t) >= 2 AND list_contains({_QUOTES_SQL}, t[1]) AND list_contains({_QUOTES_SQL}, t[-1]) THEN {sql_trim('substr(t, 2, length(t) - 2)')} ELSE t END AS t FROM a),
cleaned AS (SELECT conv_id, turn, regexp_replace(t, '{fx.SPACE}+', ' ', 'g') AS t FROM b)"""


@query(f"WITH {_CLEANED} SELECT conv_id, turn, md5(t) AS digest FROM cleaned")
def clean_summary(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.md5(text.clean_reply(F.col("text")).cast("binary")).alias("digest"))


_REFUSAL_SQL = text.REFUSAL.replace("'", "''")


@query(f"""
WITH {_CLEANED} SELECT coalesce(CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '(?i){_REFUSAL_SQL}') THEN 'refusal' WHEN k < 15 THEN 'too_short' WHEN k > 128 THEN 'too_long' END, 'kept') AS reason, count(*) AS n
FROM (SELECT t, len({sql_tokens('t')}) AS k FROM cleaned) GROUP BY 1""")
def distill_filter_reasons(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'").select(text.clean_reply(F.col("text")).alias("t"))
    return c.groupBy(F.coalesce(text.reply_reason(F.col("t")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# judge

_RAW = """raw AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"score": ' || (doc_id % 7) || ', "unsupported_claims": [], "rationale": "A. B! C."}'
    WHEN 1 THEN '```json' || chr(10) || '{"score": ' || (1 + doc_id % 5) || '.0, "unsupported_claims": ["x", "y"], "rationale": "fine"}' || chr(10) || '```'
    WHEN 2 THEN '{"score": "' || (1 + doc_id % 5) || '", "unsupported_claims": []}' WHEN 3 THEN '{"score": ' || (1 + doc_id % 5) || ', "unsupported_claims": ["a" b], "rationale": "Broken. Still"}' ELSE 'no score ' || doc_id END AS raw FROM documents)"""


#: The score of a reply that begins with it, white space left out.
_FIRST_SCORE = r"""regexp_extract(regexp_replace(regexp_replace(raw, '\s+', '', 'g'), '^```(?:json)?', ''), '^\{"score":([1-5])[,}]', 1)"""


def _raw(spark, sf):
    n = F.col("doc_id")
    k = (1 + n % 5).cast("string")
    return documents(spark, sf).select("doc_id", F.when(n % 5 == 0, F.concat(F.lit('{"score": '), (n % 7).cast("string"), F.lit(', "unsupported_claims": [], "rationale": "A. B! C."}')))
        .when(n % 5 == 1, F.concat(F.lit('```json\n{"score": '), k, F.lit('.0, "unsupported_claims": ["x", "y"], "rationale": "fine"}\n```')))
        .when(n % 5 == 2, F.concat(F.lit('{"score": "'), k, F.lit('", "unsupported_claims": []}')))
        .when(n % 5 == 3, F.concat(F.lit('{"score": '), k, F.lit(', "unsupported_claims": ["a" b], "rationale": "Broken. Still"}'))).otherwise(F.concat(F.lit("no score "), n.cast("string"))).alias("raw"))


@query(f"""
WITH {_RAW}, body AS (SELECT doc_id, regexp_extract(regexp_replace(trim(raw), '^```(?:json)?\\s*|\\s*```$', '', 'g'), '(?s)\\{{.*\\}}') AS b FROM raw),
j AS (SELECT doc_id, b, try_cast(b AS JSON) AS v FROM body),
s AS (SELECT doc_id, b, v, json_type(v, '$.score') AS t, try_cast(json_extract_string(v, '$.score') AS DOUBLE) AS x FROM j)
SELECT doc_id, CASE WHEN error IS NULL THEN x::INT END AS score, error, CASE WHEN error IS NULL THEN json_array_length(v, '$.unsupported_claims')::INT END AS n_claims FROM (
    SELECT *, CASE WHEN b = '' THEN 'no_json' WHEN v IS NULL THEN 'bad_json' WHEN t NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR x <> floor(x) OR x NOT BETWEEN 1 AND 5 THEN 'bad_score' END AS error FROM s)""")
def judge_parse(spark, sf):
    p = _raw(spark, sf).select("doc_id", judge.parsed(F.col("raw")).alias("p"))
    return p.select("doc_id", "p.score", "p.error", F.when(F.col("p.error").isNull(), F.size("p.unsupported_claims")).alias("n_claims"))


@query(f"""
WITH {_RAW} SELECT doc_id, try_cast({_FIRST_SCORE} AS INT) AS score, {sql_trim("regexp_extract(raw, '(?s)" + chr(34) + "unsupported_claims" + chr(34) + "\\s*:\\s*\\[(.*?)\\]\\s*,\\s*" + chr(34) + "rationale" + chr(34) + "', 1)")} AS claims FROM raw WHERE doc_id % 5 = 3""")
def judge_recover(spark, sf):
    return _raw(spark, sf).where("doc_id % 5 = 3").select("doc_id", judge.recovered_score(F.col("raw")).alias("score"), judge.recovered_claims(F.col("raw")).alias("claims"))


@query()
def judge_recover_all(spark, sf):
    return _raw(spark, sf).select("doc_id", judge.recovered_score(F.col("raw")).alias("score"), judge.recovered_claims(F.col("raw")).alias("claims"))


@query("SELECT doc_id, md5('Summarise: ' || substr(text, 1, 500)) AS digest, length(text) > 500 AS truncated FROM documents")
def prompt_truncation(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(text.fill_prompt("Summarise: {document}", F.col("text"), 500).cast("binary")).alias("digest"), (F.char_length("text") > 500).alias("truncated"))


@query(f"""
WITH p AS (SELECT length('Summarise: ' || substr(text, 1, 500)) AS k FROM documents)
SELECT count(*) AS requests, sum(k)::BIGINT AS chars, {r6('sum(k) / 3.5::DOUBLE')} AS input_tokens, (count(*) * 128)::BIGINT AS output_tokens,
    {r6('sum(k) / 3.5::DOUBLE / 1e6 * 0.15::DOUBLE + count(*) * 128 / 1e6 * 0.6::DOUBLE')} AS usd FROM p""")
def cost_estimate(spark, sf):
    p = documents(spark, sf).select(text.fill_prompt("Summarise: {document}", F.col("text"), 500).alias("prompt"))
    return lat.cost_estimate(p, 3.5, 0.15, 0.6, 128)


_CACHE = """cache AS (SELECT CAST(event_id % 500 AS VARCHAR) AS id, 'fp' || (event_id % 3) AS fp, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'h' || (event_id % 500 % 7) END AS in_, event_type AS prediction, event_id AS seq FROM events)"""


def _cache(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        (e % 500).cast("string").alias("id"), F.concat(F.lit("fp"), (e % 3).cast("string")).alias("fp"), F.when(e % 4 == 0, None).otherwise(F.concat(F.lit("h"), (e % 500 % 7).cast("string"))).alias("in"), F.col("event_type").alias("prediction"), e.alias("seq"))


@query(f"WITH {_CACHE} SELECT id, fp, in_ AS hash, prediction, seq FROM cache WHERE fp IN ('fp0', 'fp1') QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def cache_latest(spark, sf):
    return caches.latest(_cache(spark, sf), ["fp0", "fp1"]).withColumnRenamed("in", "hash")


@query(f"""
WITH {_CACHE}, l AS (SELECT id, in_ FROM cache WHERE fp IN ('fp0', 'fp1') QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
i AS (SELECT doc_id::VARCHAR AS id, 'h' || (doc_id % 7) AS h FROM documents)
SELECT id, h AS hash FROM i WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = i.id AND l.in_ = i.h)""")
def cache_missing(spark, sf):
    inputs = documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("h"), (F.col("doc_id") % 7).cast("string")).alias("in"))
    return caches.missing(inputs, _cache(spark, sf), ["fp0", "fp1"]).withColumnRenamed("in", "hash")


# aggregates

_SCORED = f"""{SAMPLES}, scored AS (SELECT id, system, dataset, is_long, cluster, stratum, faithfulness, human, len({_P1})::INT AS length_syllables, {sql_rouge(_P1, _R1)} AS rouge1 FROM samples)"""


def _scored(spark, sf):
    p = F.col("prediction")
    return fx.samples(spark, sf).withColumns({"length_syllables": F.size(text.syllables(p)), "rouge1": text.rouge_n(p, F.col("summary"), 1)})


@query(f"""
WITH {_SCORED}, labelled AS (SELECT *, unnest(['all', 'dataset=' || dataset, CASE WHEN is_long THEN 'long' ELSE 'short' END]) AS subset FROM scored)
SELECT system, subset, count(*) AS n, {r6('avg(rouge1)')} AS rouge1, {r6('avg(length_syllables)')} AS length_syllables, count(faithfulness) AS faithfulness_n, {r6('avg(faithfulness)')} AS faithfulness_mean,
    {r6('100.0::DOUBLE * avg((faithfulness = 5)::INT)')} AS faithfulness_pct_5, {r6('100.0::DOUBLE * avg((faithfulness <= 2)::INT)')} AS faithfulness_pct_le2 FROM labelled GROUP BY ALL""")
def subset_metrics(spark, sf):
    return ev.subset_metrics(_scored(spark, sf), ["rouge1", "length_syllables"])


@query(f"""
WITH {_SCORED} SELECT count(*) AS n, {r6('100.0::DOUBLE * avg((rouge1 < 20)::INT)')} AS flag_pct, {r6('100.0::DOUBLE * avg(CASE WHEN faithfulness <= 2 THEN (rouge1 < 20)::INT END)')} AS recall_pct,
    {r6('100.0::DOUBLE * avg(CASE WHEN rouge1 < 20 THEN (faithfulness <= 2)::INT END)')} AS precision_pct FROM scored WHERE faithfulness IS NOT NULL""")
def flag_precision_recall(spark, sf):
    return ev.flag_quality(_scored(spark, sf).where("faithfulness is not null"), F.col("rouge1") < 20, F.col("faithfulness") <= 2)


@query(f"""
WITH {_SCORED} SELECT system, {', '.join(f'count_if(faithfulness = {k}) AS n_{k}' for k in range(1, 6))}, count_if(faithfulness IS NULL) AS parse_errors, {r6('avg(faithfulness)')} AS mean FROM scored GROUP BY system""")
def score_distribution(spark, sf):
    return ev.score_distribution(_scored(spark, sf), "faithfulness", F.col("faithfulness").isNull())


def _sql_boot(values: str, by: str, n: int) -> str:
    times = " + ".join(f"(u >= {t!r}::DOUBLE)::INT" for t in ev._POISSON)
    return f"""sums AS (SELECT {by}, stratum, cluster, sum(x) AS s, count(x) AS c FROM {values} GROUP BY ALL),
draws AS (SELECT *, {sql_draw("'42:' || coalesce(stratum, '') || ':' || coalesce(cluster, '') || ':' || boot")} AS u FROM sums, range(1, {n} + 1) b(boot)),
strata AS (SELECT {by}, stratum, boot, count(*) AS k, sum(m) AS m, sum(m * s) AS s, sum(m * c) AS c FROM (SELECT *, {times} AS m FROM draws) GROUP BY ALL),
means AS (SELECT {by}, boot, sum(k / m::DOUBLE * s) / sum(k / m::DOUBLE * c) AS mean FROM strata WHERE m > 0 GROUP BY {by}, boot)"""


_N_BOOT = 200


@query(f"""
WITH {_SCORED}, vals AS (SELECT system, stratum, cluster, rouge1 AS x FROM scored), {_sql_boot('vals', 'system', _N_BOOT)},
ends AS (SELECT system, {r6('quantile_cont(mean, 0.025)')} AS ci_low, {r6('quantile_cont(mean, 0.975)')} AS ci_high FROM means GROUP BY system)
SELECT system, n, mean, ci_low, ci_high FROM (SELECT system, count(x) AS n, {r6('avg(x)')} AS mean FROM vals GROUP BY system) JOIN ends USING (system)""")
def bootstrap_ci_cluster(spark, sf):
    return ev.bootstrap_ci(_scored(spark, sf).select("system", "stratum", "cluster", F.col("rouge1").alias("x")), ["system"], _N_BOOT)


_PAIRED = f"""flat AS (SELECT system, id, stratum, cluster, 'rouge1' AS metric, rouge1 AS x FROM scored UNION ALL SELECT system, id, stratum, cluster, 'faithfulness', faithfulness::DOUBLE FROM scored WHERE faithfulness IS NOT NULL),
diffs AS (SELECT f.metric, f.system, f.stratum, f.cluster, a.x - f.x AS x FROM flat f JOIN flat a ON a.metric = f.metric AND a.id = f.id AND a.system = 'lead3' WHERE f.system <> 'lead3')"""
_PAIRED_OUT = f"""SELECT metric, system, n, diff, ci_low, ci_high, p_value FROM (SELECT metric, system, count(x) AS n, {r6('avg(x)')} AS diff FROM diffs GROUP BY ALL) JOIN (
    SELECT metric, system, {r6('quantile_cont(mean, 0.025)')} AS ci_low, {r6('quantile_cont(mean, 0.975)')} AS ci_high, {r6('least(1.0::DOUBLE, 2 * least(avg((mean <= 0)::INT), avg((mean >= 0)::INT)))')} AS p_value FROM means GROUP BY ALL) USING (metric, system)"""


@query(f"WITH {_SCORED}, {_PAIRED}, {_sql_boot('diffs', 'metric, system', _N_BOOT)} {_PAIRED_OUT}")
def paired_bootstrap(spark, sf):
    return ev.paired_bootstrap(_scored(spark, sf), ["rouge1", "faithfulness"], "lead3", _N_BOOT)


_FLAT = "flat AS (SELECT system, id, stratum, cluster, 'rouge1' AS metric, rouge1 AS x FROM scored UNION ALL SELECT system, id, stratum, cluster, 'faithfulness', faithfulness::DOUBLE FROM scored WHERE faithfulness IS NOT NULL)"


@query(f"""
WITH ci AS (WITH {_SCORED}, {_FLAT}, {_sql_boot('flat', 'system, metric', _N_BOOT)},
    ends AS (SELECT system, metric, {r6('quantile_cont(mean, 0.025)')} AS ci_low, {r6('quantile_cont(mean, 0.975)')} AS ci_high FROM means GROUP BY ALL)
    SELECT system, metric, n, mean, ci_low, ci_high FROM (SELECT system, metric, count(x) AS n, {r6('avg(x)')} AS mean FROM flat GROUP BY ALL) JOIN ends USING (system, metric)),
paired AS (WITH {_SCORED}, {_PAIRED}, {_sql_boot('diffs', 'metric, system', _N_BOOT)} {_PAIRED_OUT})
SELECT 'ci' AS kind, system, metric, n, mean, ci_low, ci_high, NULL AS diff, NULL AS p_value, NULL AS reference FROM ci
UNION ALL SELECT 'paired', system, metric, n, NULL, ci_low, ci_high, diff, p_value, 'lead3' FROM paired""")
def significance_all(spark, sf):
    return ev.significance(_scored(spark, sf), ["rouge1", "faithfulness"], "lead3", n_boot=_N_BOOT)


_PAIRS = f"{SAMPLES}, pairs AS (SELECT faithfulness AS judge, human FROM samples WHERE system = 'lead1')"


def _pairs(spark, sf):
    return fx.samples(spark, sf).where("system = 'lead1'").select(F.col("faithfulness").alias("judge"), "human")


@query(f"""
WITH {_PAIRS} SELECT h.k::INT AS human, j.k::INT AS judge, count(p.human) AS n FROM range(1, 6) h(k), range(1, 6) j(k) LEFT JOIN pairs p ON p.human = h.k AND p.judge = j.k GROUP BY ALL""")
def confusion_5x5(spark, sf):
    return ev.confusion(_pairs(spark, sf), "human", "judge")


_QWK = """cells AS (SELECT human AS a, judge AS b, count(*) AS n FROM pairs WHERE human IS NOT NULL AND judge IS NOT NULL GROUP BY ALL),
ra AS (SELECT a, sum(n) AS na FROM cells GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM cells GROUP BY b), tot AS (SELECT sum(n) AS t FROM cells),
kappa AS (SELECT (SELECT t FROM tot)::BIGINT AS n, 1 - (SELECT sum(pow(a - b, 2) * n) FROM cells) / (SELECT sum(pow(a - b, 2) * na * nb / t) FROM ra, rb, tot) AS q)"""


@query(f"WITH {_PAIRS}, {_QWK} SELECT n, {r6('q')} AS qwk FROM kappa")
def qwk(spark, sf):
    return ev.weighted_kappa(_pairs(spark, sf), "human", "judge")


_SPEARMAN = """ok AS (SELECT human, judge FROM pairs WHERE human IS NOT NULL AND judge IS NOT NULL),
rk AS (SELECT rank() OVER (ORDER BY human) + (count(*) OVER (PARTITION BY human) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY judge) + (count(*) OVER (PARTITION BY judge) - 1) / 2.0::DOUBLE AS y FROM ok),
rho AS (SELECT count(*) AS n, corr(x, y) AS r FROM rk)"""


@query(f"WITH {_PAIRS}, {_SPEARMAN} SELECT n, {r6('r')} AS spearman FROM rho")
def spearman(spark, sf):
    return ev.spearman(_pairs(spark, sf), "human", "judge")


@query(f"""
WITH {_PAIRS}, {_QWK}, {_SPEARMAN} SELECT count(*) AS n, {r6('100.0::DOUBLE * avg((human = judge)::INT)')} AS exact_pct, {r6('100.0::DOUBLE * avg((abs(human - judge) <= 1)::INT)')} AS within1_pct,
    {r6('avg(human)')} AS human_mean, {r6('avg(judge)')} AS judge_mean, {r6('avg(human - judge)')} AS mean_diff, (SELECT {r6('q')} FROM kappa) AS qwk, (SELECT {r6('r')} FROM rho) AS spearman FROM ok""")
def agreement(spark, sf):
    return ev.agreement(_pairs(spark, sf), "human", "judge")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) <= 20")
def nested_sample(spark, sf):
    return ev.nested_sample(documents(spark, sf).select("doc_id", "lang"), 20, "doc_id", ["lang"])


@query(f"""
WITH {SAMPLES} SELECT system, id FROM samples WHERE system IN ('lead1', 'lead3', 'tail2')
QUALIFY row_number() OVER (PARTITION BY system ORDER BY md5('42:' || system || ':' || id::VARCHAR), system || ':' || id::VARCHAR) <= CASE system WHEN 'tail2' THEN 16 ELSE 17 END""")
def balanced_sample(spark, sf):
    return ev.balanced_sample(fx.samples(spark, sf).select("system", "id"), ["lead1", "lead3", "tail2"], 50)


@query("SELECT p_brand AS id FROM part GROUP BY p_brand HAVING count(DISTINCT p_size % 5) = 5")
def paired_pool(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("id"), (F.col("p_size") % 5).alias("system"))
    return ev.in_all_systems(rows, "id", 5)


# latency

_LAT = f"count(*) AS n, {r6('quantile_cont(latency_ms, 0.5)')} AS p50, {r6('quantile_cont(latency_ms, 0.95)')} AS p95"


@query(f"""
WITH {CALLS} SELECT event_type, {_LAT}, {r6('avg(latency_ms)')} AS mean, {r6('max(latency_ms)')} AS max, {r6('count(*) / nullif(sum(latency_ms) / 1000.0::DOUBLE, 0)')} AS docs_per_s,
    {r6('sum(new_tokens) / nullif(sum(generate_ms) / 1000.0::DOUBLE, 0)')} AS tokens_per_s FROM calls GROUP BY event_type""")
def latency_summary(spark, sf):
    return lat.latency_summary(fx.calls(spark, sf), ["event_type"])


@query(f"""
WITH {CALLS}, b AS (SELECT *, CASE WHEN input_tokens <= 256 THEN '≤256' WHEN input_tokens <= 512 THEN '257–512' WHEN input_tokens <= 2048 THEN '513–2048' ELSE '>2048' END AS bucket FROM calls),
g AS (SELECT bucket, {_LAT} FROM b GROUP BY bucket)
SELECT d.bucket, d.position, coalesce(n, 0) AS n, p50, p95, p50 < 60 AS p50_ok, p95 < 60 AS p95_ok FROM (VALUES ('≤256', 0), ('257–512', 1), ('513–2048', 2), ('>2048', 3)) d(bucket, position) LEFT JOIN g USING (bucket)""")
def latency_buckets(spark, sf):
    return lat.latency_by_bucket(fx.calls(spark, sf), (256, 512, 2048), 60.0)


@query(f"""
WITH {CALLS}, docs AS (SELECT id, strategy, sum(latency_ms) AS latency_ms FROM calls GROUP BY ALL)
SELECT 'call' AS level, strategy AS part, {_LAT} FROM calls GROUP BY strategy UNION ALL SELECT 'document', strategy, {_LAT} FROM docs GROUP BY strategy
UNION ALL SELECT 'chunks', n_chunks::VARCHAR, {_LAT} FROM calls WHERE n_chunks IS NOT NULL GROUP BY n_chunks""")
def ui_flow_rollup(spark, sf):
    return lat.flow_rollup(fx.calls(spark, sf))


@query(f"WITH {SAMPLES} SELECT count(*) AS n, count_if(a.prediction = b.prediction) AS same, {r6('100.0::DOUBLE * avg((a.prediction = b.prediction)::INT)')} AS pct FROM samples a JOIN samples b ON a.id = b.id AND a.system = 'lead1' AND b.system = 'long1'")
def identical_outputs(spark, sf):
    s = fx.samples(spark, sf).select("system", "id", F.col("prediction").alias("summary"))
    return lat.identical_share(s.where("system = 'lead1'"), s.where("system = 'long1'"), ["id"])


@query(f"""
WITH {_SCORED}, runs AS (SELECT s.dataset AS device, s.system AS run, s.id, sc.rouge1 AS rouge, s.prediction FROM samples s JOIN scored sc USING (id, system)),
score AS (SELECT device, run, avg(rouge) AS rouge FROM runs GROUP BY ALL), same AS (SELECT r.device, r.run, count_if(r.prediction = b.prediction) AS identical FROM runs r JOIN runs b ON r.device = b.device AND r.id = b.id AND b.run = 'lead1' GROUP BY ALL)
SELECT s.device, s.run, {r6('s.rouge')} AS rouge, {r6('s.rouge - b.rouge')} AS delta, coalesce(identical, 0) AS identical, s.rouge - b.rouge < -1.0 AS warning FROM score s LEFT JOIN score b ON b.device = s.device AND b.run = 'lead1' LEFT JOIN same m ON m.device = s.device AND m.run = s.run""")
def run_delta_vs_baseline(spark, sf):
    runs = _scored(spark, sf).select(F.col("dataset").alias("device"), F.col("system").alias("run"), "id", F.col("rouge1").alias("rouge"), "prediction")
    return lat.versus_baseline(runs, "lead1")


@query(f"""
WITH {_SCORED}, t AS (SELECT system AS candidate, count(*) AS n, {r6('avg(rouge1)')} AS rouge1, {r6('avg(length_syllables)')} AS length_syllables, {r6("avg(CASE WHEN dataset = 'en' THEN rouge1 END)")} AS rouge1_en, {r6("avg(CASE WHEN dataset = 'fr' THEN rouge1 END)")} AS rouge1_fr FROM scored GROUP BY system)
SELECT * FROM t WHERE length_syllables <= (SELECT length_syllables + 10 FROM t WHERE candidate = 'lead1') ORDER BY rouge1 DESC, candidate LIMIT 1""")
def tune_pick_best(spark, sf):
    scores = lat.candidate_scores(_scored(spark, sf).withColumnRenamed("system", "candidate"), ["rouge1", "length_syllables"], ["en", "fr"], by="rouge1")
    return lat.best_candidate(scores, "lead1", 10.0, "rouge1", "length_syllables")


@query("""
SELECT 'lp' || regexp_replace(p::DOUBLE::VARCHAR, '\\.0$', '') || '_min' || m AS candidate, p::DOUBLE AS length_penalty, m::INT AS min_new_tokens FROM (VALUES (0.6), (1.0), (2.0)) a(p), (VALUES (0), (32), (64)) b(m)""")
def cross_grid(spark, sf):
    return lat.parameter_grid(spark, [0.6, 1.0, 2.0], [0, 32, 64])


_CUT_WORDS = f"""list_reduce(list_prepend({{'k': 0::BIGINT, 'n': 0::BIGINT, 'stop': false}}, list_transform(t, lambda x: {{'k': len(regexp_extract_all(lower(x), '{WORD}+')), 'n': 1::BIGINT, 'stop': false}})),
    lambda a, x: CASE WHEN a.stop OR (a.n > 0 AND a.k + x.k > target) THEN {{'k': a.k, 'n': a.n, 'stop': true}} ELSE {{'k': a.k + x.k, 'n': a.n + 1, 'stop': false}} END)"""
_CUT_SENTENCES = f"""list_reduce(list_prepend({{'k': 0::BIGINT, 'n': 0::BIGINT, 'stop': false}}, list_transform(s, lambda x: {{'k': len(regexp_extract_all(lower(x), '{WORD}+')), 'n': 1::BIGINT, 'stop': false}})),
    lambda a, x: CASE WHEN a.stop OR (a.n > 0 AND abs(a.k + x.k - target) > abs(a.k - target)) THEN {{'k': a.k, 'n': a.n, 'stop': true}} ELSE {{'k': a.k + x.k, 'n': a.n + 1, 'stop': false}} END)"""


@query(f"""
WITH {SAMPLES}, goal AS (SELECT id, len({_P1}) AS target FROM samples WHERE system = 'lead1'),
r AS (SELECT id, target, prediction, len({_P1}) AS k, {sql_tokens('prediction')} AS t, {sql_sentences('prediction')} AS s FROM samples JOIN goal USING (id) WHERE system = 'lead3')
SELECT id, CASE WHEN k > target THEN array_to_string(t[1 : {_CUT_WORDS}.n], ' ') ELSE prediction END AS by_syllables,
    CASE WHEN k > target THEN array_to_string(s[1 : {_CUT_SENTENCES}.n], ' ') ELSE prediction END AS by_sentences FROM r""")
def length_matched(spark, sf):
    s = fx.samples(spark, sf)
    target = s.where("system = 'lead1'").select("id", F.size(text.syllables(F.col("prediction"))).alias("target"))
    return s.where("system = 'lead3'").join(target, "id").select(
        "id", text.length_matched(F.col("prediction"), F.col("target")).alias("by_syllables"), text.length_matched(F.col("prediction"), F.col("target"), "sentences").alias("by_sentences"))


def _first_bigrams(s: DataFrame, *keys: str) -> DataFrame:
    words = text.syllables(F.col("document"))
    grams = F.array_distinct(text.ngrams(text.syllables(F.col("prediction")), 2))
    at = text.let(text.ngrams(words, 2), lambda d: F.filter(F.transform(grams, lambda g: F.array_position(d, g)), lambda i: i > 0))
    rows = s.select(*keys, F.greatest(F.size(words) - 2, F.lit(1)).alias("n"), at.alias("at")).where(F.size("at") > 0)
    mean = F.aggregate("at", F.lit(0.0), lambda t, i: t + (i - 1) / F.col("n")) / F.size("at")
    return rows.select(*keys, F.size("at").cast("bigint").alias("n_grams"), F.round(mean, 6).alias("mean_position"))


@query(f"""
WITH {SAMPLES}, w AS (SELECT id, {_P1} AS p, {sql_syllables('document')} AS d FROM samples WHERE system = 'tail2'),
g AS (SELECT id, len(d) AS n, list_distinct(CASE WHEN len(p) >= 2 THEN {sql_ngrams('p', 2)} ELSE [] END) AS p2, CASE WHEN len(d) >= 2 THEN {sql_ngrams('d', 2)} ELSE [] END AS d2 FROM w),
e AS (SELECT id, n, unnest(p2) AS gram, d2 FROM g)
SELECT id, count(*) AS n_grams, {r6('avg((list_position(d2, gram) - 1) / greatest(n - 2, 1)::DOUBLE)')} AS mean_position FROM e WHERE list_contains(d2, gram) GROUP BY id""")
def first_bigram_position(spark, sf):
    return _first_bigrams(fx.samples(spark, sf).where("system = 'tail2'"), "id")


@query()
def first_bigram_position_all(spark, sf):
    return _first_bigrams(fx.samples(spark, sf), "system", "id")


@query("""
WITH t AS (SELECT vec_id // 10 AS pair, vec_id % 2 AS side, vec_id, embedding FROM embeddings),
x AS (SELECT a.pair, a.vec_id AS h, b.vec_id AS r, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM t a JOIN t b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
p AS (SELECT pair, avg(m) AS p FROM (SELECT pair, h, max(c) AS m FROM x GROUP BY ALL) GROUP BY pair), r AS (SELECT pair, avg(m) AS r FROM (SELECT pair, r, max(c) AS m FROM x GROUP BY ALL) GROUP BY pair)
SELECT pair, round(coalesce(p, 0.0), 4) AS p, round(coalesce(r, 0.0), 4) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f FROM (SELECT DISTINCT pair FROM t) LEFT JOIN p USING (pair) LEFT JOIN r USING (pair)""")
def greedy_embedding_match(spark, sf):
    t = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("pair"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").alias("emb"), F.lit(1).alias("mask"))
    return ev.greedy_match(t).select("pair", *[F.round(c, 4).alias(c) for c in ("p", "r", "f")])


@query(f"SELECT doc_id, CASE WHEN k <= 255 THEN 'direct' WHEN k <= 1024 THEN 'extractive' ELSE 'hierarchical' END AS strategy FROM (SELECT doc_id, len({sql_tokens('text')}) AS k FROM documents)")
def strategy_choice(spark, sf):
    return documents(spark, sf).select("doc_id", prepare.desired_strategy(text.token_count(F.col("text")), 255).alias("strategy"))


@query()
def summarize_documents(spark, sf):
    from ..operators.summarize import summarize

    return summarize(documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("document")), budget=255, chunk_tokens=128, overlap=16)


@query(f"WITH c AS (SELECT sha1(line) AS key FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)), g AS (SELECT key, count(*) AS n FROM c GROUP BY key) SELECT sum(n)::BIGINT AS calls, count(*) AS distinct_keys, sum(n - 1)::BIGINT AS hits FROM g")
def chunk_cache_hits(spark, sf):
    return caches.chunk_hits(documents(spark, sf).select(F.explode(F.split("text", "\n")).alias("line")).select(F.sha1(F.col("line").cast("binary")).alias("key")))


# relational idioms

@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def pivot_counts_cube(spark, sf):
    return documents(spark, sf).cube("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count_if(l_linestatus = 'F') AS F, count_if(l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def pivot_status(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""
WITH e AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM documents)
SELECT CASE WHEN n_chars <= q[1] THEN 1 WHEN n_chars <= q[2] THEN 2 WHEN n_chars <= q[3] THEN 3 ELSE 4 END AS bin, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM documents, e GROUP BY 1""")
def quantile_bins(spark, sf):
    d = documents(spark, sf).select("n_chars")
    q = d.agg(F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    c = F.col("n_chars")
    bins = F.when(c <= F.col("q")[0], 1).when(c <= F.col("q")[1], 2).when(c <= F.col("q")[2], 3).otherwise(4)
    return d.crossJoin(F.broadcast(q)).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query(f"WITH {_SCORED} SELECT {r6('corr(a.length_syllables - b.length_syllables, a.rouge1 - b.rouge1)')} AS r, {r6('avg((a.rouge1 > b.rouge1)::INT)')} AS win_rate FROM scored a JOIN scored b ON a.id = b.id AND a.system = 'lead3' AND b.system = 'lead1'")
def corr_length_score(spark, sf):
    s = _scored(spark, sf).select("id", "system", "length_syllables", "rouge1")
    a, b = s.where("system = 'lead3'").alias("a"), s.where("system = 'lead1'").alias("b")
    gain = F.col("a.rouge1") - F.col("b.rouge1")
    return a.join(b, F.col("a.id") == F.col("b.id")).agg(F.round(ev.pearson((F.col("a.length_syllables") - F.col("b.length_syllables")).cast("double"), gain), 6).alias("r"), F.round(F.avg((gain > 0).cast("double")), 6).alias("win_rate"))


@query("WITH w AS (SELECT o_custkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50) SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM w)")
def semi_worst_k(spark, sf):
    worst = table(spark, sf, "orders").orderBy("o_totalprice", "o_orderkey").limit(50)
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return c.join(worst, c.c_custkey == worst.o_custkey, "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_distilled(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("SELECT origin, count(*) AS n FROM (SELECT doc_id, 'distilled' AS origin FROM labels UNION ALL SELECT doc_id, 'original' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY origin")
def union_tagged(spark, sf):
    from .jobs import training_mix

    mixed = training_mix(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), documents(spark, sf).select(F.col("doc_id").alias("id")))
    return mixed.groupBy("origin").agg(F.count("*").alias("n"))


@query(f"WITH {SAMPLES} SELECT a.system AS a, b.system AS b, count(*) AS n, count_if(a.prediction = b.prediction) AS same FROM samples a JOIN samples b ON a.id = b.id AND a.system < b.system GROUP BY ALL")
def pair_combos(spark, sf):
    s = fx.samples(spark, sf).select("id", "system", "prediction")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.system") < F.col("b.system"))).groupBy(F.col("a.system").alias("a"), F.col("b.system").alias("b")).agg(
        F.count("*").alias("n"), F.count_if(F.col("a.prediction") == F.col("b.prediction")).alias("same"))


@query(f"""
WITH {_SCORED} (SELECT 'best' AS kind, system, id FROM scored WHERE faithfulness IS NOT NULL ORDER BY faithfulness DESC, rouge1 DESC, id, system LIMIT 5) UNION ALL
(SELECT 'worst', system, id FROM scored WHERE faithfulness IS NOT NULL ORDER BY faithfulness, rouge1, id, system LIMIT 5)""")
def topk_best_worst(spark, sf):
    s = _scored(spark, sf).where("faithfulness is not null")
    best = s.orderBy(F.desc("faithfulness"), F.desc(F.round("rouge1", 9)), "id", "system").limit(5).select(F.lit("best").alias("kind"), "system", "id")
    return best.union(s.orderBy("faithfulness", F.round("rouge1", 9), "id", "system").limit(5).select(F.lit("worst"), "system", "id"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def head_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ev.bounded_first(o, ["o_custkey"], 2, [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""
WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS section FROM conversations)
SELECT 'howto-' || substr(md5(conv_id::VARCHAR), 1, 12) || '-' || section AS id, length(coalesce(text, '')) AS document_chars, length(coalesce(answer, '')) AS summary_chars FROM c""")
def explode_sections(spark, sf):
    from ..sources.read import howto_records

    c = table(spark, sf, "conversations").withColumn("answer", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    raw = c.groupBy(F.col("conv_id").alias("url")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("document"), F.col("answer").alias("summary")))).alias("article"))
    rows = howto_records(raw, "howto")
    return rows.select("id", F.char_length("document").cast("bigint").alias("document_chars"), F.char_length("summary").cast("bigint").alias("summary_chars"))


@query()
def processed_corpus(spark, sf):
    from .jobs import prepare_corpus

    rows = fx.split_records(spark, sf).withColumn("dataset", F.lit("docs"))
    return prepare_corpus(rows, normalize={"style": None}).select("id", "split", "document_tokens", "summary_tokens", "input_tokens", "num_sentences", "was_filtered", "was_truncated")


# whole runs

_REF_GRAMS = f"""w AS (SELECT {sql_syllables('summary')} AS p, {sql_syllables('document')} AS d FROM samples WHERE system = 'lead1'),
g AS (SELECT len(p) AS n, list_distinct(p) AS p1, d AS d1, CASE WHEN len(p) >= 3 THEN {sql_ngrams('p', 3)} ELSE [] END AS p3,
    CASE WHEN len(p) >= 2 THEN list_distinct({sql_ngrams('p', 2)}) ELSE [] END AS p2, CASE WHEN len(d) >= 2 THEN {sql_ngrams('d', 2)} ELSE [] END AS d2 FROM w)"""


@query(f"""
WITH {SAMPLES}, {_REF_GRAMS}
SELECT count(*) AS n, {r6('avg(n)')} AS length_syllables, {r6('avg(CASE WHEN len(p3) > 0 THEN 100.0::DOUBLE * (len(p3) - len(list_distinct(p3))) / len(p3) ELSE 0.0::DOUBLE END)')} AS repetition_3gram,
    {r6('avg(CASE WHEN len(p1) > 0 THEN 100.0::DOUBLE * (len(p1) - len(list_intersect(p1, list_distinct(d1)))) / len(p1) ELSE 0.0::DOUBLE END)')} AS novel_1gram,
    {r6('avg(CASE WHEN len(p2) > 0 THEN 100.0::DOUBLE * (len(p2) - len(list_intersect(p2, list_distinct(d2)))) / len(p2) ELSE 0.0::DOUBLE END)')} AS novel_2gram FROM g""")
def reference_metrics(spark, sf):
    return runs.reference_metrics(fx.samples(spark, sf).where("system = 'lead1'"))


@query(f"WITH {_SCORED} SELECT count(*) AS n, round(coalesce(avg(rouge1), 0), 2) AS rouge1, round(coalesce(avg(length_syllables), 0), 2) AS length_syllables FROM scored")
def corpus_rouge(spark, sf):
    return runs.corpus_means(_scored(spark, sf), ["rouge1", "length_syllables"])


@query(f"""
WITH {SAMPLES}, flat AS (SELECT system, 'human' AS metric, human::DOUBLE AS x FROM samples UNION ALL SELECT system, 'faithfulness', faithfulness::DOUBLE FROM samples)
SELECT system, metric, count(x) AS n, {r6('avg(x)')} AS mean FROM flat WHERE x IS NOT NULL GROUP BY ALL""")
def human_means(spark, sf):
    return runs.human_means(fx.samples(spark, sf), ["human", "faithfulness"], "lead1")[0]


@query(f"""
WITH {_RAW}, p AS ({ORACLES['judge_parse']}), m AS (SELECT 's' || doc_id % 3 AS system, error IS NULL AS ok, {_FIRST_SCORE} <> '' AS found FROM raw JOIN p USING (doc_id))
SELECT system, count(*) AS n, count_if(ok) AS parsed, count_if(NOT ok AND found) AS recovered, count_if(NOT ok AND NOT found) AS lost FROM m GROUP BY system""")
def recovered_by_system(spark, sf):
    return runs.recovered_by_system(_raw(spark, sf).withColumn("system", F.concat(F.lit("s"), F.col("doc_id") % 3)))


@query(f"""
WITH {_SCORED}, d AS (SELECT 'rouge1' AS metric, abs(round(rouge1, 3) - rouge1) AS diff FROM scored UNION ALL SELECT 'length_syllables', 0.0::DOUBLE FROM scored)
SELECT metric, count(*) AS n, round(max(diff), 9) AS max_diff, bool_and(diff < 0.000001) AS ok FROM d GROUP BY metric""")
def stored_consistency(spark, sf):
    scored = _scored(spark, sf).select("system", "id", "rouge1", "length_syllables")
    return runs.consistency(scored.withColumn("rouge1", F.round("rouge1", 3)), scored, ["system", "id"], ["rouge1", "length_syllables"])


@query(f"""
WITH d AS (SELECT doc_id, len({sql_tokens('text')}) > 256 AS is_long FROM documents)
SELECT doc_id, is_long FROM d QUALIFY row_number() OVER (PARTITION BY is_long ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) <= CASE WHEN is_long THEN 20 ELSE 21 END""")
def stratified_sample(spark, sf):
    rows = documents(spark, sf).select("doc_id", (text.token_count(F.col("text")) > 256).alias("is_long"))
    return runs.stratified_sample(rows, 41, key="doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 100")
def shuffled_cap(spark, sf):
    return runs.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


_EDGE = r"[.,;:!?\"''()-]"


@query(f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {sql_tokens('text')} AS w FROM documents),
c AS (SELECT doc_id, t, w, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, len(regexp_extract_all(lower(t), '[{text.VIETNAMESE}]')) AS marked,
    len(list_filter(w, lambda x: length(regexp_replace(x, '^{_EDGE}+|{_EDGE}+$', '', 'g')) <= 1)) AS bare, CASE WHEN len(w) >= 3 THEN {sql_ngrams('w', 3)} ELSE [] END AS g FROM w)
SELECT doc_id, concat_ws(',', CASE WHEN len(w) < 5 THEN 'too_short' END, CASE WHEN letters > 0 AND marked < 0.05 * letters THEN 'no_diacritics' END,
    CASE WHEN contains(t, '�') OR contains(t, '<unk>') OR contains(t, '<pad>') THEN 'bad_token' END, CASE WHEN bare > 0.4 * len(w) THEN 'single_characters' END,
    CASE WHEN len(w) >= 6 AND len(list_distinct(g)) < 0.5 * len(g) THEN 'repetitive' END) AS problems FROM c""")
def output_problems(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(text.output_problems(F.col("text")), ",").alias("problems"))


@query(f"WITH {CALLS} SELECT strategy, count(*) AS n, quantile_cont(latency_ms, 0.5) < 60 AS p50_ok, quantile_cont(latency_ms, 0.95) < 60 AS p95_ok FROM calls GROUP BY strategy")
def target_attainment(spark, sf):
    return runs.attainment(fx.calls(spark, sf), ["strategy"], 60.0)


@query(f"""
WITH d AS (SELECT doc_id, len({sql_tokens('text')}) AS n FROM documents), s AS (SELECT *, CASE WHEN n <= 300 THEN 'direct' WHEN n <= 600 THEN 'extractive' ELSE 'hierarchical' END AS strategy, ceil(n / 512.0)::BIGINT AS k FROM d),
c AS (SELECT *, unnest([0, 1, 2]) AS pos, unnest(['short', 'medium', 'long']) AS length FROM s)
SELECT strategy, length, pos, count(*) AS n, sum(CASE WHEN strategy <> 'hierarchical' THEN 1 WHEN pos = 0 THEN k ELSE 0 END)::BIGINT AS generate_calls, count_if(strategy = 'hierarchical' AND pos > 0) AS hits FROM c GROUP BY ALL""")
def user_flow(spark, sf):
    docs = documents(spark, sf).select("doc_id", text.token_count(F.col("text")).alias("n"))
    rows = docs.select("doc_id", prepare.desired_strategy(F.col("n"), 300, "auto", 600).alias("strategy"), F.ceil(F.col("n") / 512).alias("n_chunks"))
    return runs.user_flow(rows).groupBy("strategy", "length", F.col("order").alias("pos")).agg(
        F.count("*").alias("n"), F.sum("generate_calls").cast("bigint").alias("generate_calls"), F.count_if("chunk_cache_hit").alias("hits"))


_PROMPT = "Document: {document} Summary: {summary}"


@query("""
WITH r AS (SELECT doc_id AS id, sha1(concat_ws(chr(31), 'model', 'v1', 'copy', doc_id::VARCHAR, 'Document: ' || substr(coalesce(text, ''), 1, 30000) || ' Summary: ' || coalesce(source, ''))) AS key,
    length(coalesce(text, '')) > 30000 AS document_truncated FROM documents)
SELECT * FROM r WHERE NOT (id % 3 = 0 AND id % 2 <> 0)""")
def judge_missing(spark, sf):
    rows = documents(spark, sf).select(F.lit("copy").alias("system"), F.col("doc_id").alias("id"), F.col("text").alias("document"), F.col("source").alias("prediction"))
    asked = runs.judge_requests(rows, _PROMPT, "model", "v1").select("id", "key", "document_truncated")
    cache = asked.where("id % 3 = 0").select("key", F.when(F.col("id") % 2 == 0, "bad_json").alias("error"))
    return runs.judge_missing(asked, cache).select("id", "key", "document_truncated")


@query(f"SELECT lang, count(*) AS n, {r6('avg(r)')} AS mean, {r6('max(r)')} AS max FROM (SELECT lang, d / greatest(s, 1)::DOUBLE AS r FROM (SELECT lang, len({sql_tokens('document')}) AS d, len({sql_tokens('summary')}) AS s FROM ({_REC.replace('recs AS (', '').removesuffix(')').replace('SELECT doc_id AS id', 'SELECT lang, doc_id AS id')}))) GROUP BY lang")
def compression_ratio(spark, sf):
    d = documents(spark, sf).select("lang", prepare.compression_ratio(F.col("text"), text.lead(F.col("text"), 1)).alias("r"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.max("r"), 6).alias("max"))


@query(f"""
SELECT lang, count(k) AS n, {r6('avg(k)')} AS mean, {r6('stddev(k)')} AS std, min(k) AS min, {', '.join(f"{r6(f'quantile_cont(k, {q})')} AS p{int(100 * q)}" for q in (0.25, 0.5, 0.75, 0.95))}, max(k) AS max,
    {r6('100.0::DOUBLE * avg((k > 1024)::INT)')} AS pct_over FROM (SELECT lang, len({sql_tokens('text')})::DOUBLE AS k FROM documents) GROUP BY lang""")
def describe_lengths(spark, sf):
    return prepare.describe_lengths(documents(spark, sf).select("lang", text.token_count(F.col("text")).alias("k")), "k", ["lang"])


@query(f"""
WITH t AS (SELECT doc_id AS id, {sql_trim("coalesce(text, '')")} AS t FROM documents)
SELECT coalesce(CASE WHEN t = '' THEN 'empty' WHEN length(t) > 5000 THEN 'too_long' END, 'accepted') AS outcome, count(*) AS n FROM t GROUP BY 1""")
def request_errors(spark, sf):
    checked = rounds.request_errors(documents(spark, sf).select(F.col("doc_id").alias("id"), "text"), 5000)
    return checked.groupBy(F.coalesce("error", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, ceil(count(*) / 8.0)::BIGINT AS batches FROM documents GROUP BY source")
def batch_counts(spark, sf):
    return documents(spark, sf).groupBy("source").agg(F.count("*").alias("n")).withColumn("batches", caches.batch_count(F.col("n"), 8))


@query()
def rounds_histogram(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    return runs.value_counts(rounds.reduce_in_rounds(rows, budget=100, chunk_tokens=64, overlap=8), "rounds", "extracted")


@query()
def unsupported_flags(spark, sf):
    rows = ev.sample_metrics(fx.samples(spark, sf), novel=(), factcheck=True)
    return rows.groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg("unsupported_pct"), 6).alias("unsupported_pct"))


@query()
def chunk_cache_lru(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("worker"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"))
    return caches.lru_hits(calls, 64)


@query(f"""
WITH {SAMPLES}, sheet AS (SELECT id, human FROM samples WHERE system = 'lead1' AND id % 2 = 0),
pairs AS (SELECT faithfulness AS judge, s.human FROM samples k LEFT JOIN sheet s USING (id) WHERE k.system = 'lead1'), {_QWK}, {_SPEARMAN}
SELECT count(*) AS n, {r6('100.0::DOUBLE * avg((human = judge)::INT)')} AS exact_pct, {r6('100.0::DOUBLE * avg((abs(human - judge) <= 1)::INT)')} AS within1_pct,
    {r6('avg(human)')} AS human_mean, {r6('avg(judge)')} AS judge_mean, {r6('avg(human - judge)')} AS mean_diff, (SELECT {r6('q')} FROM kappa) AS qwk, (SELECT {r6('r')} FROM rho) AS spearman FROM ok""")
def sheet_agreement(spark, sf):
    rows = fx.samples(spark, sf).where("system = 'lead1'")
    key = rows.select(F.col("id").alias("item_id"), F.col("faithfulness").alias("judge"))
    sheet = rows.where("id % 2 = 0").select(F.col("id").alias("item_id"), "human")
    return ev.sheet_agreement(key, sheet, "human", "judge", n_boot=50).drop("ci_low", "ci_high")
