"""Arrow-batched functions for what native expressions cannot say, and registration for SQL.

Each takes and returns columns; work stays inside a row, so none of them shuffles.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import exact, text
from .tables import chunk_rows, sentence_rows

EXTRACT = "input_text string, input_tokens int, selected_sentence_ids array<int>, num_sentences int, was_filtered boolean, was_truncated boolean"
CHUNK = "array<struct<text:string,sentence_ids:array<int>,num_tokens:int,overlap_units:int>>"
CHECK = "array<struct<sentence:string,unsupported:array<string>>>"
REDUCED = "summary string, dropped int, all_flagged boolean"


def _map(function: Callable, ddl: str, *columns: Column, **fixed) -> Column:
    """One value a row."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*row, **fixed) for row in zip(*series)])

    if ddl.startswith(("array", "string", "double", "int", "boolean")) and "," not in ddl.split("<")[0]:
        if len(columns) == 1:
            def one(a: pd.Series) -> pd.Series:
                return run(a)
        else:
            def one(a: pd.Series, b: pd.Series) -> pd.Series:
                return run(a, b)
        return F.pandas_udf(one, ddl)(*columns)

    names = [x.split()[0] for x in ddl.split(", ")]

    def frame(a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(x, **fixed) for x in a], columns=names)

    return F.pandas_udf(frame, ddl)(*columns)


def nfc(c: Column) -> Column:
    return _map(exact.nfc, "string", c)


def unescape(c: Column) -> Column:
    return _map(exact.unescape, "string", c)


def tone_style(c: Column, style: str = "old") -> Column:
    return _map(exact.tone_style, "string", c, style=style)


def split_exact(c: Column, min_chars: int = 2) -> Column:
    return _map(exact.split_sentences, "array<string>", c, min_chars=min_chars)


def normalize(c: Column, form: bool = True, markup: bool = True, controls: bool = True, segments: bool = False, style: str | None = "old", whitespace: bool = True, keep_newlines: bool = True) -> Column:
    """Markup, NFC, control characters, segments, tone marks, white space, in this order; null becomes empty."""
    c = text.text_of(c)
    if markup:
        c = text.strip_markup(c)
    if (markup or form) and not segments:
        c = _map(functools.partial(_letters, markup=markup, form=form, controls=controls, style=style), "string", c)
        style = None
    elif markup or form:
        c = _map(functools.partial(_letters, markup=markup, form=form, controls=False, style=None), "string", c)
    if controls:
        c = text.clean_controls(c)
    if segments:
        c = text.join_segments(c)
    if style:
        c = tone_style(c, style)
    return text.squeeze(c, keep_newlines) if whitespace else c


@functools.cache
def _format_characters() -> dict[int, None]:
    return {c: None for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) in ("Cf", "Cc") and c != 0x85}


def _letters(value: str, markup: bool, form: bool, controls: bool, style: str | None) -> str:
    """Entities, NFC and tone marks in one step; most of it is nothing for plain ASCII. Format characters that ``controls``
    takes out anyway go before the tone marks, since they would part words."""
    if markup and "&" in value:
        value = exact.unescape(value)
    if value.isascii():
        return value
    value = exact.nfc(value) if form else value
    return exact.tone_style(value.translate(_format_characters()) if controls else value, style) if style else value


def bm25_centrality(sents: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return _map(exact.bm25_centrality, "array<double>", sents, k1=k1, b=b)


def lexrank(sents: Column, **options) -> Column:
    return _map(exact.lexrank, "array<double>", sents, **options)


def extract(c: Column, **options) -> Column:
    """Struct ``EXTRACT``."""

    def frame(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([exact.extract(t, **options) for t in batch], columns=[x.split()[0] for x in EXTRACT.split(", ")])

    return F.pandas_udf(frame, EXTRACT)(c)


def chunks(c: Column, **options) -> Column:
    return _map(exact.chunks, CHUNK, c, **options)


_source = functools.lru_cache(maxsize=8)(exact.Source)  # several systems share a document, and rows of one often stand together


def _checked(summary: str | None, source: str | None, check_initial: bool = False) -> list[dict]:
    return [{"sentence": s, "unsupported": u} for s, u in exact.check_summary(summary, _source(source), check_initial)]


def check_summary(summary: Column, source: Column, check_initial: bool = False) -> Column:
    """Every sentence of a summary with its unsupported numbers and names."""
    return _map(_checked, CHECK, summary, source, check_initial=check_initial)


def _kept(sents, source: str | None) -> list[str]:
    return exact.drop_unsupported(list(sents) if sents is not None else [], _source(source))[0]


def drop_unsupported(sents: Column, source: Column) -> Column:
    return _map(_kept, "array<string>", sents, source)


def _merged(sents, threshold: float) -> list[str]:
    return exact.merge_repeats(list(sents) if sents is not None else [], threshold)


def merge_repeats(sents: Column, threshold: float = 0.6) -> Column:
    return _map(_merged, "array<string>", sents, threshold=threshold)


def reduce_parts(parts: Column, source: Column, max_tokens: int = 1024, threshold: float = 0.6, factcheck: str = "off") -> Column:
    """Struct ``REDUCED`` of partial summaries in order."""

    def frame(p: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = [exact.reduce_parts(list(x) if x is not None else [], max_tokens, threshold, y, factcheck) for x, y in zip(p, s)]
        return pd.DataFrame(rows, columns=["summary", "dropped", "all_flagged"])

    return F.pandas_udf(frame, REDUCED)(parts, source)


def _rouge_l(prediction: str | None, reference: str | None) -> float:
    p, r = exact.syllables(prediction), exact.syllables(reference)
    return 200.0 * exact.lcs(p, r) / (len(p) + len(r)) if p or r else 0.0


def rouge_l(prediction: Column, reference: Column) -> Column:
    """For texts of any length; ``text.rouge_l`` is the native form for short ones."""
    return _map(_rouge_l, "double", prediction, reference)


def register(spark: SparkSession, prefix: str = "loom_") -> list[str]:
    """Makes the sequential functions callable in SQL; the native ones are expressions of built-in functions."""
    functions = {
        "nfc": (exact.nfc, "string"), "tone_style": (exact.tone_style, "string"), "unescape": (exact.unescape, "string"),
        "syllables": (exact.syllables, "array<string>"), "sentences": (exact.split_sentences, "array<string>"),
        "merge_repeats": (functools.partial(_merged, threshold=0.6), "array<string>"), "chunks": (exact.chunks, CHUNK),
    }
    for name, (function, ddl) in functions.items():
        spark.udf.register(prefix + name, F.pandas_udf(_batched(function), ddl))
    spark.udtf.register(prefix + "sentence_rows", sentence_rows())
    spark.udtf.register(prefix + "chunk_rows", chunk_rows())
    return [prefix + n for n in functions] + [prefix + "sentence_rows", prefix + "chunk_rows"]


def _batched(function: Callable) -> Callable:
    def batch(s: pd.Series) -> pd.Series:
        return pd.Series([function(x) for x in s])

    return batch
