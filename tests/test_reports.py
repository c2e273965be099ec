import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecloom.functions.alpha import alpha_from_weight
from codecloom.operators import alpha_report as ar
from codecloom.operators import run_metrics as rm
from codecloom.operators import verdicts as vd
from codecloom.operators.corpus_stats import length_stats, stats_document
from codecloom.sources.store import flatten_length_stats
from tests.helpers import one


def weights(spark, values, step=0):
    rows = [(step, f"model.learnable_rope_layers.{i}.alpha_weight", w) for i, w in enumerate(values)]
    rows += [(step, "model.learnable_rope_layers.0.other", 9.0), (step, "model.embed.weight", 9.0)]
    return spark.createDataFrame(rows, "step int, param_name string, value double")


def test_parameters_are_picked_by_name(spark):
    out = ar.rotation_parameters(weights(spark, [0.0, 1.0]), ["step"])
    assert [(r.layer, r.weight) for r in out.orderBy("layer").collect()] == [(0, 0.0), (1, 1.0)]
    assert out.where("layer = 0").first().alpha == pytest.approx(1.05)


def test_alpha_bounds(spark):
    df = spark.createDataFrame([(-50.0,), (50.0,)], "w double")
    found = [r.a for r in df.select(alpha_from_weight(F.col("w")).alias("a")).collect()]
    assert found == pytest.approx([0.1, 2.0])


def test_one_layer_has_no_sample_std(spark):
    out = ar.rotation_parameters(weights(spark, [0.3]), ["step"])
    assert one(ar.alpha_stats(out)).std_samp is None
    assert one(ar.alpha_report(out, ["step"])).std_pop == 0.0
    assert ar.early_late(out, ["step"]).count() == 0


def test_alpha_metrics(spark):
    out = ar.rotation_parameters(weights(spark, [0.0, 1.0]), ["step"])
    found = {r.metric: r.value for r in ar.alpha_metrics(out).collect()}
    assert found["rope_alpha/layer_1/raw_weight"] == 1.0
    assert found["rope_alpha/layer_0/value"] == found["rope_alpha/min"] == pytest.approx(1.05)
    assert len(found) == 8
    graded = out.withColumn("grad_norm", F.when(F.col("layer") == 1, 0.5))
    found = {r.metric: r.value for r in ar.alpha_metrics(graded).collect()}
    assert found["rope_grad/layer_1/norm"] == 0.5 and len(found) == 9
    single = ar.alpha_metrics(out.where("layer = 0"))
    assert "rope_alpha/std" not in {r.metric for r in single.collect()}


def test_name_order_changes_the_halves(spark):
    params = ar.rotation_parameters(weights(spark, [i / 10 for i in range(12)]))
    order = [r.layer for r in ar.layer_order(params, lexicographic=True).orderBy("place").collect()]
    assert order == [0, 1, 10, 11, 2, 3, 4, 5, 6, 7, 8, 9]
    alpha = [0.1 + 1.9 / (1 + math.exp(-i / 10)) for i in range(12)]
    by_number, by_name = one(ar.early_late(params)), one(ar.early_late(params, lexicographic=True))
    assert by_number.early_alpha == pytest.approx(np.mean(alpha[:6]))
    assert by_name.early_alpha == pytest.approx(np.mean([alpha[i] for i in order[:6]]))


@pytest.mark.parametrize(
    "early, late, word",
    [(1.2, 1.1, "early-stronger"), (1.1, 1.2, "late-stronger"), (1.1, 1.12, "similar")],
)
def test_alpha_pattern(spark, early, late, word):
    df = spark.createDataFrame([(early, late)], "early_alpha double, late_alpha double")
    assert one(vd.alpha_pattern(df)).pattern == word


def test_alpha_change(spark):
    df = spark.createDataFrame([(0, 1.055), (1, 1.07), (2, 1.0)], "layer int, alpha double")
    assert [r.verdict for r in vd.alpha_changes(df).collect()] == ["no change", "up", "down"]


@pytest.mark.parametrize(
    "ppl, word", [(49.9, "Excellent"), (50.0, "Good"), (100.0, "Acceptable"), (200.0, "Poor"), (None, "No data")]
)
def test_perplexity_edges(spark, ppl, word):
    df = spark.createDataFrame([(0, ppl)], "layer int, ppl double")
    r = one(vd.perplexity_verdicts(df))
    assert r.verdict == word and r.subject == "layer_0"
    assert r.passed is (None if ppl is None else ppl < 200)


@pytest.mark.parametrize(
    "value, word", [(2.0, "Good"), (2.1, "Excellent"), (1.5, "Acceptable"), (1.0, "Poor"), (None, "No data")]
)
def test_variance_edges(spark, value, word):
    df = spark.createDataFrame([(value,)], "avg_output_variance double")
    assert one(vd.variance_verdict(df)).verdict == word


@pytest.mark.parametrize("value, word", [(0.81, "Excellent"), (0.8, "Good"), (0.6, "Poor")])
def test_confusion_edges(spark, value, word):
    df = spark.createDataFrame([(value,)], "min_diagonal double")
    assert one(vd.confusion_verdict(df)).verdict == word


def test_influence_edges(spark):
    df = spark.createDataFrame(
        [(0, 0.6, 0.2), (1, 0.61, 0.19)], "layer int, same_layer_influence double, cross_layer_influence double"
    )
    rows = [(r.subject, r.verdict, r.passed) for r in vd.influence_verdicts(df).collect()]
    assert rows == [
        ("layer_0", "Low", False), ("layer_0", "High cross-layer leak", False),
        ("layer_1", "Good", True), ("layer_1", "Good isolation", True),
    ]


def test_overall_leaves_out_what_has_no_data(spark):
    df = spark.createDataFrame(
        [([10.0, None], 0.2, None, 0.9)],
        "ppl array<double>, ppl_variance double, avg_output_variance double, min_diagonal double",
    )
    assert [(r.metric, r.verdict) for r in vd.overall_assessment(df).collect()] == [
        ("ppl_variance", "too high"), ("min_diagonal", "excellent")
    ]
    report = [(r.subject, r.verdict) for r in vd.full_report(df).collect()]
    assert report == [
        ("layer_0", "Excellent"), ("layer_1", "No data"), ("all_layers", "High variance"),
        ("outputs", "No data"), ("diagonal", "Excellent"), ("overall", "too high"), ("overall", "excellent"),
    ]


def test_length_stats_equal_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(1, 5000, 500), np.full(300, 77)])  # one hot length
    df = spark.createDataFrame([(int(v),) for v in values], "encoded_len int")
    r = one(length_stats(df))
    assert r.total_samples == len(values)
    for unit, x in (("frames", values), ("sec", values / 12.5)):
        assert r[f"{unit}_mean"] == pytest.approx(x.mean())
        assert r[f"{unit}_std"] == pytest.approx(x.std())
        assert (r[f"{unit}_min"], r[f"{unit}_max"]) == (x.min(), x.max())
        for name, p in (("q25", 25), ("q50", 50), ("median", 50), ("q75", 75)):
            assert r[f"{unit}_{name}"] == pytest.approx(np.percentile(x, p))
    rows = flatten_length_stats(stats_document(length_stats(df))).collect()
    assert len(rows) == 16
    assert length_stats(df.where("false")).count() == 0


def test_eval_mean_skips_nan_and_null(spark):
    df = spark.createDataFrame(
        [("metrics/a", 1.0), ("metrics/a", float("nan")), ("metrics/a", 3.0), ("metrics/b", None), ("metrics/b", float("nan"))],
        "metric string, value double",
    )
    assert [(r.metric, r.value) for r in rm.eval_mean(df).collect()] == [("metrics/a", 2.0)]


def test_names(spark):
    df = spark.createDataFrame([("metrics/a",)], "m string")
    r = one(df.select(rm.strip_prefix(F.col("m")).alias("p"), rm.eval_prefix(F.col("m")).alias("e")))
    assert (r.p, r.e) == ("a", "eval_metrics/a")


def test_cadence(spark):
    df = rm.due_reports(spark.range(2001).withColumnRenamed("id", "step"), 100, 500)
    rows = {r.step: (r.influence_due, r.report_due) for r in df.collect()}
    assert len(rows) == 21
    assert rows[500] == (True, False) and rows[1000] == (True, True) and rows[100] == (False, False)


def test_log_grows(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1, "metrics/a", 1.0)], "step int, metric string, value double")
    rm.append_metrics(df, path)
    rm.append_metrics(df, path)
    assert spark.read.parquet(path).count() == 2
