"""Operators on small tables, with literal results or properties."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import caches, evaluate, latency, prepare
from corpusloom.operators.summarize import batch_generator, summarize
from corpusloom.plans import config
from corpusloom.sources import read, write
from corpusloom.streaming.incremental import prepare_stream


def test_filter_reasons(spark):
    rows = spark.createDataFrame([
        ("ok", "một hai ba bốn năm", "một hai"), ("e", "  ", "x"), ("s", "một hai ba bốn", ""), ("l", "một hai ba", "một hai ba bốn năm"), ("d", "một hai", "một"), ("n", None, None)], "id string, document string, summary string")
    kept, reasons = prepare.filter_records(rows, min_document=3, min_summary=1)
    assert [r.id for r in kept.collect()] == ["ok"]
    assert {r.reason: r["count"] for r in reasons.collect()} == {"empty_document": 2, "empty_summary": 1, "summary_longer_than_document": 1, "short_document": 1}


def test_dedup(spark):
    rows = spark.createDataFrame([
        ("train", 1, "Văn bản A", "a"), ("train", 2, "văn  bản a", "a"), ("train", 3, "Văn bản B", "b"), ("test", 1, "Văn bản B", "b")], "split string, ordinal int, document string, summary string")
    got = {(r.split, r.ordinal): r.drop_reason for r in prepare.dedup_reasons(rows).collect()}
    assert got == {("train", 1): None, ("train", 2): "duplicate_within_train", ("train", 3): "duplicate_cross_split_train", ("test", 1): None}
    assert prepare.deduplicate(rows, cross_split=False).count() == 3


def test_hash_split(spark):
    rows = spark.range(20000).select(text.hash_split(F.col("id")).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20000 for r in rows}
    assert abs(share["train"] - 0.9) < 0.01 and abs(share["test"] - 0.05) < 0.01 and abs(share["validation"] - 0.05) < 0.01


def test_loaders(spark):
    aos = spark.createDataFrame([("u1", [("d1", "s1"), ("d2", None)])], "url string, article array<struct<document:string,summary:string>>")
    soa = spark.createDataFrame([("u1", (["d1", "d2"], ["s1", None]))], "url string, article struct<document:array<string>,summary:array<string>>")
    a, b = ([(r.id, r.document, r.summary) for r in read.load("howto", x, "h").orderBy("id").collect()] for x in (aos, soa))
    assert a == b and [x[1:] for x in a] == [("d1", "s1"), ("d2", "")]
    news = read.load("news", spark.createDataFrame([(5, "t", "ab", None)], "guid int, title string, abstract string, article string"), "n", "test").first()
    assert (news.id, news.document, news.summary) == ("n-test-5", "", "ab")
    with pytest.raises(ValueError):
        read.load("none")


def test_sheet_and_benchmark(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿item_id; human_score \nH001;4\nH002;\n", encoding="utf-8")
    assert [(r.item_id, r.human_score) for r in read.read_sheet(spark, str(tmp_path / "s.csv"), "human_score").collect()] == [("H001", 4), ("H002", None)]
    (tmp_path / "bad.csv").write_text("item_id,human_score\nH001,9\n")
    with pytest.raises(ValueError):
        read.read_sheet(spark, str(tmp_path / "bad.csv"), "human_score")
    (tmp_path / "b.json").write_text(json.dumps({"run": "r", "ids": ["a", "b"], "latency_ms": [1.0, 2.0]}))
    assert [(r.run, r.ids, r.latency_ms) for r in read.read_benchmark(spark, str(tmp_path / "b.json")).collect()] == [("r", "a", 1.0), ("r", "b", 2.0)]
    with pytest.raises(read.MissingColumns):
        read.require_columns(spark.range(1), "x")


def test_agreement(spark):
    same = spark.createDataFrame([(i % 5 + 1, i % 5 + 1) for i in range(20)], "h int, j int")
    assert evaluate.weighted_kappa(same, "h", "j").first().qwk == 1.0 and evaluate.spearman(same, "h", "j").first().spearman == 1.0
    swapped = spark.createDataFrame([(1, 2), (2, 1)], "h int, j int")
    assert evaluate.weighted_kappa(swapped, "h", "j").first().qwk == -1.0
    constant = spark.createDataFrame([(3, 3), (3, 3)], "h int, j int")
    assert evaluate.weighted_kappa(constant, "h", "j").first().qwk is None and evaluate.spearman(constant, "h", "j").first().spearman is None
    assert evaluate.confusion(constant, "h", "j").count() == 25


def test_bootstrap(spark):
    rows = spark.createDataFrame([(s, str(i), f"c{i % 10}", "x", float(i % 7) + (10 if s == "a" else 0)) for s in "ab" for i in range(60)], "system string, id string, cluster string, stratum string, rouge1 double")
    ci = {r.system: r for r in evaluate.bootstrap_ci(rows.withColumn("x", F.col("rouge1")), ["system"], 100).collect()}
    assert all(r.ci_low <= r.mean <= r.ci_high for r in ci.values())
    p = evaluate.paired_bootstrap(rows, ["rouge1"], "a", 100).first()
    assert (p.n, p.diff, p.p_value) == (60, 10.0, 0.0)
    assert evaluate.significance(rows, ["rouge1"], "a", n_boot=20).count() == 3


def test_samples_are_nested_and_balanced(spark):
    rows = spark.range(1000)
    small, large = ({r.id for r in evaluate.nested_sample(rows, n).collect()} for n in (20, 50))
    assert small < large and small == {r.id for r in evaluate.nested_sample(rows.orderBy(F.desc("id")), 20).collect()}
    three = rows.select("id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("system"))
    got = evaluate.balanced_sample(three, ["a", "b", "c"], 50).groupBy("system").count().orderBy("system").collect()
    assert [r["count"] for r in got] == [17, 17, 16]
    paired = evaluate.balanced_sample(three, ["a", "b", "c"], 30, paired=True)
    assert paired.groupBy("id").count().where("count = 3").count() == 10
    assert evaluate.blind_items(three.limit(3)).orderBy("item_id").first().item_id == "H001"


def test_subset_metrics(spark):
    rows = spark.createDataFrame([("s", "d", False, 10.0, 5), ("s", "d", True, 30.0, None), ("s", "e", False, 5.0, 1)], "system string, dataset string, is_long boolean, rouge1 double, faithfulness int")
    got = {r.subset: r for r in evaluate.subset_metrics(rows, ["rouge1"]).collect()}
    assert got["all"].rouge1 == 15.0 and got["long"].n == 1 and got["long"].faithfulness_mean is None and got["dataset=d"].faithfulness_n == 1


def test_greedy_match(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0], 1), (1, 0, [1.0, 1.0], 1), (1, 1, [1.0, 0.0], 1), (1, 1, [0.0, 1.0], 1), (1, 1, [9.0, 9.0], 0), (2, 0, [1.0, 0.0], 1)], "pair int, side int, emb array<double>, mask int")
    got = {r.pair: r for r in evaluate.greedy_match(rows).collect()}
    assert got[1].p == got[1].r == pytest.approx((1 + 0.5**0.5) / 2) and got[2].f == 0.0


def test_latency(spark):
    rows = spark.createDataFrame([(100.0, 50.0, 10, 100), (200.0, 50.0, 10, 300), (300.0, 50.0, 10, 300), (400.0, 50.0, 10, 300)], "latency_ms double, generate_ms double, new_tokens int, input_tokens int")
    r = latency.latency_summary(rows, []).first()
    assert (r.p50, r.p95, r.docs_per_s, r.tokens_per_s) == (250.0, 385.0, 4.0, 200.0)
    buckets = {r.bucket: r for r in latency.latency_by_bucket(rows).collect()}
    assert set(buckets) == {"≤256", "257–512", ">512"} and buckets[">512"].n == 0 and buckets[">512"].p50 is None


def test_tuning(spark):
    scores = spark.createDataFrame([("lp1_min0", 20.0, 1.0), ("x", 30.0, 5.0), ("y", 25.0, 2.0)], "candidate string, rougeL double, repetition_3gram double")
    assert latency.best_candidate(scores, "lp1_min0").first().candidate == "y"
    assert latency.parameter_grid(spark, [0.6, 1.0], [0, 32]).first().candidate == "lp1_min0"


def test_cache(spark):
    cache = spark.createDataFrame([("a", "f1", "h1", "old", 1), ("a", "f1", "h1", "new", 2), ("b", "f1", None, "legacy", 3), ("c", "f2", "h1", "other", 4)], "id string, fp string, `in` string, prediction string, seq int")
    assert caches.latest(cache, ["f1"]).where("id = 'a'").first().prediction == "new"
    inputs = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1"), ("a2", "h1")], "id string, `in` string")
    assert {r.id for r in caches.missing(inputs, cache, ["f1"]).collect()} == {"b", "c", "a2"}
    assert {r.id for r in caches.missing(inputs, cache, ["f1"], accept_legacy=True).collect()} == {"c", "a2"}


def test_summarize(spark):
    long = " ".join(f"Câu {i} nói về chủ đề {i} trong năm nay." for i in range(60))
    docs = spark.createDataFrame([(1, "Một hai ba."), (2, long), (3, None)], "id int, document string")
    got = {r.id: r for r in summarize(docs, batch_generator(lambda xs: [f"Tóm tắt {len(x.split())} từ." for x in xs]), budget=100, chunk_tokens=101, overlap=10, hierarchical_above=200).collect()}
    assert got[1].strategy == "direct" and got[1].summary == "Tóm tắt 3 từ." and got[2].strategy == "hierarchical" and got[2].summary and got[3].summary is not None


def test_config(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": {"p": 1, "q": 2}, "smoke": {"x": {"p": 0}}}))
    (tmp_path / "b.json").write_text(json.dumps({"extends": "a.json", "x": {"q": 3}}))
    c = config.read_config(tmp_path / "b.json")
    assert c["x"] == {"p": 1, "q": 3} and config.with_limit(c, 5)["x"]["p"] == 0
    (tmp_path / "c.json").write_text(json.dumps({"extends": "c.json"}))
    for bad in (lambda: config.read_config(tmp_path / "c.json"), lambda: config.validated({"strategy": "none"}), lambda: config.selected_systems({"systems": {"a": {}}}, ["b"])):
        with pytest.raises(config.ConfigError):
            bad()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Câu {i}. Thêm nữa.") for i in range(40)], "id int, text string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))

    def transform(df):
        return df.select("id", text.lead(F.col("text"), 1).alias("lead"))

    for _ in range(2):  # the second run finds nothing new
        prepare_stream(spark, str(tmp_path / "in"), rows.schema, transform, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, transform(rows).collect()))


def test_sinks(spark, tmp_path):
    assert write.smoke_path("/a/out", True) == "/a/out_smoke" and write.smoke_path("/a/out", False) == "/a/out"
    stats = spark.createDataFrame([("d", "train", 3)], "dataset string, split string, n int")
    assert json.loads(write.stats_json(stats, ["dataset", "split"])) == {"d": {"train": {"n": 3}}}
    assert "| d | train | 3 |" in write.markdown_table(stats, ["dataset"])
    rows = spark.createDataFrame([("s", "1", "doc", "pred", 3)], "system string, id string, document string, prediction string, score int")
    write.write_blind_sheet(rows, str(tmp_path / "sheet"))
    with pytest.raises(Exception):
        write.write_blind_sheet(rows, str(tmp_path / "sheet"))
    assert write.provenance(rows, {})["spark"]
