"""Table functions for SQL: one row a sentence or chunk of a text."""

from __future__ import annotations

from pyspark.sql.functions import udtf

from . import exact


class SentenceRows:
    def eval(self, text: str):
        for pos, s in enumerate(exact.split_sentences(text)):
            yield pos, s


class ChunkRows:
    def eval(self, text: str, max_tokens: int, overlap: int):
        for pos, c in enumerate(exact.chunks(text, max_tokens, overlap)):
            yield pos, c["text"], c["num_tokens"]


def sentence_rows():
    return udtf(SentenceRows, returnType="pos int, sentence string")


def chunk_rows():
    return udtf(ChunkRows, returnType="pos int, chunk string, num_tokens int")
