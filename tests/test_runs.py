"""Whole runs: costs, the judge's cache, user flows, consistency, reports."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import latency, runs
from corpusloom.plans import config
from corpusloom.sources import write

PRICES = {"chars_per_token": 1.0, "input_price": 1e6, "output_price": 0.0, "output_tokens": 0}


def test_corpus_means_of_nothing(spark):
    rows = spark.createDataFrame([], "rouge1 double")
    assert runs.corpus_means(rows, ["rouge1"]).first().asDict() == {"n": 0, "rouge1": 0.0}


def test_judge_asks_once_and_keeps_to_its_budget(spark):
    rows = spark.createDataFrame([("a", 1, "doc {summary}", "p"), ("b", 1, None, None), ("a", 2, "x" * 20, "q")], "system string, id int, document string, prediction string")
    asked = runs.judge_requests(rows, "D {document} S {summary}", "m", "v1", max_chars=13)
    got = {(r.system, r.id): r for r in asked.collect()}
    assert got["a", 1].prompt == "D doc {summary} S p" and got["b", 1].prompt == "D  S "
    assert [got[k].document_truncated for k in (("a", 1), ("b", 1), ("a", 2))] == [False, False, True]
    assert len({r.key for r in got.values()}) == 3
    cache = spark.createDataFrame([(got["a", 1].key, None), (got["b", 1].key, "bad_json")], "key string, error string")
    assert {(r.system, r.id) for r in runs.judge_missing(asked, cache).collect()} == {("b", 1), ("a", 2)}
    assert {(r.system, r.id) for r in runs.judge_missing(asked, cache, retry_errors=False).collect()} == {("a", 2)}

    def ask(todo):
        broken = '{"score": 4, "unsupported_claims": ["a" b], "rationale": "Một. Hai. Ba."}'
        return todo.withColumn("raw", F.when(F.length("prompt") < 6, "nothing").otherwise(broken))

    with pytest.raises(runs.OverBudget):
        runs.run_judge(asked, cache, ask, 1.0, **PRICES)
    new = {(r.system, r.id): r for r in runs.run_judge(asked, cache, ask, 100.0, **PRICES).collect()}
    assert new["a", 2].score == 4 and new["a", 2].error is None
    assert new["b", 1].score is None and new["b", 1].error == "no_json"
    assert runs.check_cost(asked.limit(0), 0.0, **PRICES) == 0.0


def test_consistency(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0)], "id int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.5, None), (3, 9.0, 9.0)], "id int, x double, y double")
    got = {r.metric: (r.n, r.max_diff, r.ok) for r in runs.consistency(a, b, ["id"], ["x", "y"]).collect()}
    assert got == {"x": (2, 0.5, False), "y": (2, None, False)}
    assert all(r.ok for r in runs.consistency(a, a, ["id"], ["x", "y"]).collect())


def test_user_flow(spark):
    docs = spark.createDataFrame([("d", "direct", None), ("h", "hierarchical", 3), ("n", None, None)], "id string, strategy string, n_chunks int")
    got = [(r.id, r.length, r.order, r.chunk_cache_hit, r.generate_calls) for r in runs.user_flow(docs).orderBy("id", "order").collect()]
    assert got[:3] == [("d", "short", 0, False, 1), ("d", "medium", 1, False, 1), ("d", "long", 2, False, 1)]
    assert got[3:6] == [("h", "short", 0, False, 3), ("h", "medium", 1, True, 0), ("h", "long", 2, True, 0)]
    assert got[6] == ("n", "short", 0, False, 1)


def test_samples(spark):
    rows = spark.range(100).withColumn("is_long", F.col("id") % 4 == 0)
    got = runs.stratified_sample(rows, 11).collect()
    assert sum(r.is_long for r in got) == 5 and len(got) == 11
    assert {r.id for r in runs.stratified_sample(rows, 7).collect()} <= {r.id for r in got}
    every = [r.id for r in runs.shuffled(rows).collect()]
    assert sorted(every) == list(range(100)) and [r.id for r in runs.shuffled(rows.orderBy(F.desc("id")), cap=9).collect()] == every[:9]


def test_human_means(spark):
    rows = spark.createDataFrame([(s, i, "t", str(i), float(i + (s == "b"))) for s in ("a", "b") for i in range(6)] + [("a", 9, "t", "9", None)], "system string, id int, stratum string, cluster string, score double")
    means, paired = runs.human_means(rows, ["score"], "b", n_boot=50)
    assert {r.system: (r.n, r["mean"]) for r in means.collect()} == {"a": (6, 2.5), "b": (6, 3.5)}
    assert [(r.system, r.n, r["diff"], r.p_value) for r in paired.collect()] == [("a", 6, 1.0, 0.0)]


def test_win_rate_and_counts(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (2.0, 1.0), (None, 1.0)], "a double, b double")
    assert rows.agg(runs.win_rate(F.col("a"), F.col("b"))).first()[0] == 0.625
    assert {r.b: r.n for r in runs.value_counts(rows, "b").collect()} == {0.0: 1, 1.0: 4}


def test_reports(spark):
    calls = spark.createDataFrame([(i % 2, 100.0 * (i + 1), 50.0, 10, 300 * i, "direct" if i % 2 else "hierarchical", 2) for i in range(4)], "id int, latency_ms double, generate_ms double, new_tokens int, input_tokens int, strategy string, n_chunks int")
    report = write.latency_report(latency.latency_summary(calls, ["strategy"]), latency.latency_by_bucket(calls))
    assert report.startswith("# Latency") and "257–512" in report and "| direct | 2 |" in report
    flow = write.flow_report(latency.flow_rollup(calls))
    assert all(f"## By {x}" in flow for x in ("call", "document", "chunks"))
    scores = spark.createDataFrame([("base", 20.0, 1.0), ("better", 21.0, 1.5), ("repeats", 30.0, 9.0)], "candidate string, rougeL double, repetition_3gram double")
    tuned = write.tuning_report(scores, latency.best_candidate(scores, "base"))
    assert "Picked: better" in tuned and tuned.index("repeats") < tuned.index("| base")
    assert "Picked: none" in write.tuning_report(scores.limit(0), latency.best_candidate(scores.limit(0), "base"))


def test_generation_options():
    assert config.generation_options("short") == {"max_new_tokens": 48, "length_penalty": 0.6}
    assert config.generation_options("long", num_beams=4) == {"max_new_tokens": 256, "min_new_tokens": 64, "length_penalty": 2.0, "num_beams": 4}
    with pytest.raises(config.ConfigError):
        config.generation_options("huge")
