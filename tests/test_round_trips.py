"""Rounds, requests, caches in order, streams that start from nothing, null strata, ranks of many values."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import caches, evaluate, prepare, rounds
from corpusloom.plans import jobs
from corpusloom.sources import read, write
from corpusloom.streaming.incremental import generate_stream


def test_rounds(spark):
    long = " ".join(f"Phần {i} kể chuyện làng số {i} trong mùa gặt vừa qua." for i in range(60))
    docs = spark.createDataFrame([(1, "Một câu ngắn."), (2, long), (3, None), (4, long + " Thêm.")], "id int, document string")
    got = {r.id: r for r in rounds.reduce_in_rounds(docs, budget=60, chunk_tokens=40, overlap=5, max_rounds=3).collect()}
    assert (got[1].text, got[1].rounds, got[3].text, got[3].rounds) == ("Một câu ngắn.", 0, "", 0)
    assert got[2].rounds >= 1 and len(got[2].text.split()) <= 60 and not got[1].extracted
    stubborn = rounds.reduce_in_rounds(docs, lambda rows: rows.select("key", F.col("text").alias("summary")), budget=60, chunk_tokens=40, overlap=0, max_rounds=2)
    kept = {r.id: r for r in stubborn.collect()}
    assert kept[2].rounds == 2 and kept[2].extracted and len(kept[2].text.split()) <= 60
    silent = rounds.reduce_in_rounds(docs, lambda rows: rows.select("key", F.lit("").alias("summary")), budget=60, chunk_tokens=40, max_rounds=2).collect()
    assert {r.id: r.text for r in silent}[2] == ""


def test_requests(spark):
    asked = spark.createDataFrame([(1, "  Xin chào buổi sáng. "), (2, " \n"), (3, None), (4, "x" * 50), (5, "<p>\u200b</p>")], "id int, text string")
    got = {r.id: r for r in rounds.answer_requests(asked, "short", max_chars=40).collect()}
    assert {i: r.error for i, r in got.items()} == {1: None, 2: "empty", 3: "empty", 4: "too_long", 5: "nothing_left"}
    assert (got[1].summary, got[1].strategy, got[1].input_tokens, got[1].length, got[2].summary) == ("Xin chào buổi sáng.", "direct", 4, "short", None)
    for bad in (lambda: rounds.answer_requests(asked, "huge"), lambda: rounds.answer_requests(asked.withColumn("x", F.lit(1)))):
        with pytest.raises(ValueError):
            bad()


def test_last_write_wins_whatever_the_files_are_called(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert read.read_cache(spark, path).count() == 0
    for i in range(4):
        write.append_rows(spark.createDataFrame([("a", f"v{i}", "f", "h")], "id string, prediction string, fp string, `in` string").coalesce(1), path)
        for name in os.listdir(path):
            if name.endswith(".json") and not name.startswith("0"):
                new = f"{path}/0{9 - i}-{name}"
                os.rename(f"{path}/{name}", new)
                os.utime(new, (1_700_000_000 + i, 1_700_000_000 + i))
                crc = f"{path}/.{name}.crc"
                if os.path.exists(crc):
                    os.remove(crc)
        assert caches.latest(read.read_cache(spark, path), ["f"]).first().prediction == f"v{i}"


def test_stream_starts_restarts_and_repeats(spark, tmp_path):
    asked, schema = [], "id string, `in` string, text string"

    def generate(rows):
        asked.append(rows.count())
        return rows.select("in", F.upper("text").alias("prediction"))

    def run(checkpoint):
        generate_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "cache"), "f", generate, str(tmp_path / checkpoint)).awaitTermination(60)

    spark.createDataFrame([("1", "h1", "a"), ("2", "h2", "b"), ("3", "h1", "a")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run("c")
    assert {r.id: r.prediction for r in spark.read.json(str(tmp_path / "cache")).collect()} == {"1": "A", "2": "B", "3": "A"} and asked == [2]
    run("c")  # nothing new
    run("other")  # the same batch once more
    assert spark.read.json(str(tmp_path / "cache")).count() == 3


def test_null_strata_are_strata(spark):
    rows = [(None if i % 2 else "s", f"c{i % 7}", float(i % 2)) for i in range(140)]
    r = evaluate.bootstrap_ci(spark.createDataFrame([("x", *x) for x in rows], "system string, stratum string, cluster string, x double"), ["system"], 100).first()
    assert r["mean"] == 0.5 and r.ci_low <= 0.5 <= r.ci_high and (r.ci_low, r.ci_high) == (0.5, 0.5)


def test_bootstrap_spread(spark):
    """Half the width of the interval is about 1.96 standard errors of a mean of clusters."""
    draw = random.Random(3)
    values = [draw.gauss(0, 1) for _ in range(400)]
    rows = spark.createDataFrame([("x", "s", str(i), v) for i, v in enumerate(values)], "system string, stratum string, cluster string, x double")
    r = evaluate.bootstrap_ci(rows, ["system"], 600).first()
    assert (r.ci_high - r.ci_low) / 2 == pytest.approx(1.96 / 20, rel=0.15)


def test_average_ranks_of_many_values(spark):
    draw = random.Random(1)
    values = [draw.choice([draw.random(), 0.5, 7.0]) for _ in range(1500)]
    got = evaluate.with_average_rank(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", "r").collect()
    ordered = sorted(values)
    first = {v: ordered.index(v) for v in set(values)}
    assert all(r.r == (None if r.v is None else first[r.v] + (values.count(r.v) + 1) / 2) for r in got) and len(got) == 1501


def test_sheet_meets_its_key(spark):
    key = spark.createDataFrame([(f"H{i}", 1 + i % 5) for i in range(40)], "item_id string, faithfulness int")
    sheet = spark.createDataFrame([(f"H{i}", 1 + i % 5) for i in range(0, 40, 2)] + [("H1", None)], "item_id string, human_score int")
    r = evaluate.sheet_agreement(key, sheet, n_boot=50).first()
    assert (r.n, r.exact_pct, r.qwk, r.ci_low, r.ci_high) == (20, 100.0, 1.0, 1.0, 1.0)
    for bad in (sheet.union(sheet), spark.createDataFrame([("Q", 1)], sheet.schema)):
        with pytest.raises(ValueError):
            evaluate.sheet_agreement(key, bad)


def test_small_operators(spark, tmp_path):
    calls = spark.createDataFrame([("w", i, k) for i, k in enumerate("abacbbca")] + [("v", 0, "a"), ("v", 1, None)], "worker string, seq int, key string")
    assert {r.worker: (r.calls, r.hits) for r in caches.lru_hits(calls, 2).collect()} == {"w": (8, 3), "v": (2, 0)}
    assert {r.hits for r in caches.lru_hits(calls, 0).collect()} == {0} and {r.worker: r.hits for r in caches.lru_hits(calls, 9).collect()}["w"] == 5
    assert caches.fingerprint({"b": 1, "a": [2]}) == caches.fingerprint({"a": [2], "b": 1}) != caches.fingerprint({"a": [2], "b": 2}) and len(caches.fingerprint(1)) == 16
    model = tmp_path / "m"
    model.mkdir()
    (model / "config.json").write_text("{}")
    before = caches.model_identity(str(model))
    (model / "w.bin").write_bytes(b"x")
    assert before.startswith("sha256:") and before != caches.model_identity(str(model)) and caches.model_identity("name/of-model") == "name/of-model"
    rows = spark.createDataFrame([("s", "1", "Nhà ở Huế có 3 gian.", "Nhà ở Huế.", "Nhà ở Huế có 5 gian."), ("t", "1", "Nhà ở Huế có 3 gian.", "Nhà.", " ")], "system string, id string, document string, summary string, prediction string")
    assert {r.system: r.unsupported_pct for r in evaluate.sample_metrics(rows, factcheck=True).collect()} == {"s": 100.0, "t": 0.0}
    mixed = jobs.training_mix(rows.select("id", "document"), rows.select(F.lit("9").alias("id"), "document"), most_tokens={"document": 3}).collect()
    assert {(r.document, r.document_tokens, r.origin) for r in mixed} == {("Nhà ở Huế", 3, "distilled"), ("Nhà ở Huế", 3, "original")}
    assert rows.select(prepare.compression_ratio(F.col("document"), F.col("prediction")).alias("x")).collect()[1].x == 6.0
    metrics = spark.createDataFrame([("s", "all", 2, 30.0, 4.5), ("t", "all", 2, 20.0, None), ("s", "long", 1, 10.0, 4.0)], "system string, subset string, n int, rouge1 double, faithfulness_mean double")
    card = write.model_card_table(metrics, "s")
    assert "| t | 2 | 20.00 | – |" in card and "| long | 1 | 10.00 |" in card
    short = spark.createDataFrame([("a", i, None) for i in range(3)], "system string, id int, judge int")
    with pytest.raises(ValueError):
        evaluate.balanced_sample(short, ["a"], 5, strict=True)
    assert evaluate.balanced_sample(short, ["a"], 2, require="judge").count() == 0
    assert rows.select(text.token_count(F.col("document")).alias("n")).agg(caches.batch_count(F.sum("n"), 5).alias("b")).first().b == 3
