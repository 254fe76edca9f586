"""Queries see whole texts and all rows."""

import random

import pytest

from corpusloom.functions import exact
from corpusloom.plans import queries


@pytest.fixture
def sf(spark, tmp_path):
    """One long document whose facts stand late, and a short one."""

    def write(*texts):
        rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_reduce_concat_reads_all_sentences(spark, sf):
    sents = [f"Word{chr(97 + i)} comes." for i in range(20)]
    long = " ".join([*sents, sents[3]])
    got = {r.doc_id: r for r in queries.reduce_concat(spark, sf(long, "Short one. Ends here.")).collect()}
    assert got[0].summary == " ".join(sents) == exact.reduce_parts([long], 60, 0.6, long, "drop")[0]
    assert got[1].summary == "Short one. Ends here."


def brute_rouge_l(a, b):
    a, b = exact.syllables(a), exact.syllables(b)
    row = [0] * (len(b) + 1)
    for x in a:
        done = [0]
        for j, y in enumerate(b):
            done.append(row[j] + 1 if x == y else max(row[j + 1], done[-1]))
        row = done
    return 200 * row[-1] / (len(a) + len(b))


def test_rouge_l_of_whole_summaries(spark, sf):
    draw = random.Random(5)
    sents = ["A" + "".join(f" {draw.choice('abcdefghij')}{draw.randrange(9)}" for _ in range(n)) + "." for n in (70, 60, 90, 3, 80)]
    got = {r.system: r.rouge_l for r in queries.rouge_l_summary(spark, sf(" ".join(sents), "One. Two.")).collect()}
    picks = {"lead1": sents[0], "lead3": " ".join(sents[:3]), "tail2": " ".join(sents[-2:]), "long1": sents[2]}
    assert got == {k: pytest.approx(brute_rouge_l(v, " ".join(sents[1:3])), abs=1e-6) for k, v in picks.items()}


def test_all_systems_and_reply_shapes(spark, sf):
    path = sf(*["First thing is here. Second one, 12 pieces. Third part of it. Last words stand."] * 5)
    every = {(s, i) for s in ("lead1", "lead3", "tail2", "long1") for i in range(5)}
    assert {(r.system, r.id) for r in queries.factcheck_names(spark, path).collect()} == every
    assert {(r.system, r.id) for r in queries.first_bigram_position_all(spark, path).collect()} == every
    got = {r.doc_id: (r.score, r.claims) for r in queries.judge_recover_all(spark, path).collect()}
    assert got == {0: (None, ""), 1: (None, '"x", "y"'), 2: (None, ""), 3: (4, '"a" b'), 4: (None, "")}
