"""Reports with reset, spans of long sequences, mergeable sketches, batch tokenizers, whole evaluation."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecloom.operators import attention_stats as at
from codecloom.operators import corpus_stats as cs
from codecloom.operators.tokens import batch_tokenizer
from codecloom.plans.evaluation import whole_evaluation
from tests.helpers import TINY


def brute_reports(recorded, reports):
    out = {}
    for run, step in reports:
        before = max((s for r, s in reports if r == run and s < step), default=float("-inf"))
        held = [v for r, s, v in recorded if r == run and before < s <= step and v is not None]
        out[(run, step)] = (len(held), np.mean(held), min(held), max(held)) if held else (0, None, None, None)
    return out


@pytest.mark.parametrize("grouped", [True, False])
def test_values_count_in_the_next_report_once(spark, grouped):
    random.seed(2)
    runs = ["a", "b", "only values"] if grouped else ["a"]
    recorded = [(r, random.randint(-20, 500), random.random()) for r in runs for _ in range(200)]
    recorded += [("a", 3, None), ("a", 10_000, 5.0)]  # the last one comes after every report
    reports = {("a", s) for s in (-30, 0, 1, 2, 90, 91, 300, 480)} | {("a", 4000)}
    if grouped:
        reports |= {("b", s) for s in (250, 600)} | {("only reports", 7)}
    by = ["run"] if grouped else []
    values = spark.createDataFrame(recorded, "run string, step bigint, variance double")
    due = spark.createDataFrame(sorted(reports) + sorted(reports)[:1], "run string, step bigint")
    got = at.variance_reports(values, due, by).collect()
    found = {(r.run if grouped else "a", r.step): tuple(r)[-4:] for r in got}
    want = brute_reports(recorded, reports)
    assert found.keys() == want.keys() and len(got) == len(want)
    for key, (n, *metrics) in want.items():
        assert found[key][0] == n
        assert found[key][1:] == (None,) * 3 if n == 0 else np.allclose(found[key][1:], metrics)


def test_reports_without_any_value(spark):
    none = spark.createDataFrame([], "step bigint, variance double")
    due = spark.createDataFrame([(5,), (9,)], "step bigint")
    assert {tuple(r) for r in at.variance_reports(none, due).collect()} == {
        (5, 0, None, None, None), (9, 0, None, None, None)
    }
    assert at.variance_reports(due.withColumn("variance", F.lit(1.0)), due.limit(0)).collect() == []


@pytest.mark.parametrize("span", [1, 3, 4096])
def test_spans_give_the_pairs_of_whole_sequences(spark, span):
    targets = [("r", s, p, p % 4) for s in (1, 2) for p in (0, 2, 5, 11)]
    sources = [("r", s, p, p * 1.5) for s in (1, 2, 3) for p in range(12)]
    t = spark.createDataFrame(targets, "run string, seq_id bigint, pos bigint, layer int")
    x = spark.createDataFrame(sources, "run string, seq_id bigint, pos bigint, norm double")
    got = at.past_token_pairs(t, x, TINY, by=["run"], span=span).select("seq_id", "pos", "src_pos", "norm")
    want = {(s, p, q, q * 1.5) for _, s, p, _ in targets for _, s2, q, _ in sources if s == s2 and q <= p}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_a_long_sequence_is_spread_over_tasks(spark):
    n = 1_000_000
    x = spark.range(n).select(F.lit("r").alias("run"), F.lit(1).cast("bigint").alias("seq_id"), F.col("id").alias("pos"))
    t = x.where(F.col("pos") == n - 1).withColumn("layer", F.lit(0))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        pairs = at.past_token_pairs(t, x, TINY, by=["run"])
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and len(sizes) == 8 and max(sizes) < n / 4


def test_merged_sketches_keep_their_rank_error(spark):
    rng = np.random.default_rng(4)
    parts = [(f"s{k}", rng.integers(0, 50 * (k + 1), size=400 * (k + 1))) for k in range(25)]
    rows = [(name, int(v)) for name, values in parts for v in values] + [("s0", None), ("none", None)]
    given = spark.createDataFrame(rows, "source string, encoded_len bigint").repartition(6)
    stored = cs.length_sketches(given)
    assert stored.count() == 25
    stats = cs.sketch_stats(cs.merge_sketches(stored)).first()
    values = np.sort(np.concatenate([v for _, v in parts]))
    assert stats.total_samples == len(values) and (stats.shortest, stats.longest) == (values[0], values[-1])
    assert np.isclose(stats["mean"], values.mean()) and np.isclose(stats["std"], values.std())
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        low, high = (np.searchsorted(values, stats[name], side=s) / len(values) for s in ("left", "right"))
        assert low - 0.02 <= p <= high + 0.02
    # Adding a source reads stored rows only, and gives the moments of all.
    more = cs.length_sketches(spark.createDataFrame([("new", 9)], "source string, encoded_len bigint"))
    assert cs.merge_sketches(stored.unionByName(more)).first().n == len(values) + 1
    assert cs.merge_sketches(stored.limit(0)).collect() == []


def test_a_batch_tokenizer_is_built_once_a_worker(spark, tmp_path):
    log = str(tmp_path)

    def factory():
        with open(f"{log}/{os.getpid()}", "a") as out:
            out.write("built\n")
        return lambda texts: [[ord(c) for c in text] for text in texts]

    encode = batch_tokenizer(factory)
    texts = spark.range(3000).select(F.when(F.col("id") % 7 != 0, F.concat(F.lit("t"), "id")).alias("t")).repartition(48)
    for _ in range(3):
        rows = texts.select("t", encode(F.col("t")).alias("ids")).collect()
        assert all(r.ids == (None if r.t is None else [ord(c) for c in r.t]) for r in rows)
    calls = {name: len(open(tmp_path / name).readlines()) for name in os.listdir(log)}
    assert calls and set(calls.values()) == {1}


def test_each_input_of_an_evaluation_is_scanned_once(spark, tmp_path):
    schemas = {
        "aligned": "step bigint, batch_id bigint, seq_id bigint, pos bigint, logits array<float>, label bigint",
        "hidden": "step bigint, batch_id bigint, model_layer int, seq_id bigint, pos bigint, vec array<float>",
        "influences": "step bigint, batch_id bigint, target_layer int, src_layer int, influence double",
    }
    rows = {
        "aligned": [(1, b, 1, 0, [float(b)] * 54, 6) for b in range(4)],
        "hidden": [(1, b, 0, 1, 0, [0.0, float(b)]) for b in range(4)],
        "influences": [(1, b, 0, None if b else 0, 2.0) for b in range(4)],
    }
    tables = []
    for name, schema in schemas.items():
        spark.createDataFrame(rows[name], schema).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    got = whole_evaluation(*tables, TINY, max_batches=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and "Join" not in plan
    assert plan.count("LessThan(batch_id,3)") == 2 and plan.count("LessThan(batch_id,1)") == 1
    found = {r.metric: r.value for r in got.collect()}
    assert np.isclose(found["metrics/loss"], np.log(54)) and "metrics/text_ppl" not in found
    # Variances 0, 0.5 and 2 of the first three batches; influence of the first batch alone.
    assert np.isclose(found["metrics/avg_output_variance"], 2.5 / 3)
    assert found["metrics/layer_0_same_layer_influence"] == 1.0
