import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecloom.functions.logits import log_sum_exp, reduce_logits, top_ids
from codecloom.functions.vectors import l2_norm, mean, population_variance, sample_variance
from codecloom.operators import scoring as sc
from codecloom.operators.attention_stats import (
    influence_by_target,
    influence_share,
    output_variance,
    past_token_pairs,
    variance_per_output,
)
from codecloom.plans.evaluation import influence_metrics, metric_row, metric_table
from tests.helpers import TINY, one

N_SEQ, N_POS, V = 3, 9, 64


@pytest.fixture(scope="module")
def batch():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(N_SEQ, N_POS, V)).astype(np.float32) * 4
    labels = rng.integers(0, V, size=(N_SEQ, N_POS))
    labels[rng.random(labels.shape) < 0.2] = -100
    labels[labels >= 52] = 3  # nothing in layer 3
    mask = rng.random(labels.shape) < 0.8
    return logits, labels, mask


@pytest.fixture(scope="module")
def tables(spark, batch):
    logits, labels, mask = batch
    keys = [(s, p) for s in range(N_SEQ) for p in range(N_POS)]
    a = spark.createDataFrame(
        [(s, p, logits[s, p].tolist()) for s, p in keys], "seq_id bigint, pos bigint, logits array<float>"
    )
    b = spark.createDataFrame(
        [(s, p, int(labels[s, p]), bool(mask[s, p])) for s, p in keys],
        "seq_id bigint, pos bigint, label bigint, mask boolean",
    )
    return a, b


def brute_force(batch):
    logits, labels, mask = batch
    out = {}
    for s in range(N_SEQ):
        for p in range(N_POS - 1):
            target = labels[s, p + 1]
            if target == -100 or not mask[s, p + 1]:
                continue
            row = logits[s, p].astype(np.float64)
            nll = math.log(np.exp(row - row.max()).sum()) + row.max() - row[target]
            out[(s, p)] = (target, nll, list(np.lexsort((np.arange(V), -row))[:5]))
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_scores_equal_numpy(spark, batch, tables, wide):
    found = {(r.seq_id, r.pos): r for r in sc.score_positions(*tables, TINY, wide=wide).collect()}
    want = brute_force(batch)
    assert found.keys() == want.keys()
    for key, (label, nll, top) in want.items():
        assert found[key].label == label
        assert found[key].nll == pytest.approx(nll, abs=1e-9)
        assert found[key].topk == top


def test_metrics_equal_numpy(spark, batch, tables):
    scored = sc.score_positions(*tables, TINY)
    totals = sc.score_totals(scored, TINY)
    want = brute_force(batch).values()

    def layer(t):
        return (t - 16) // 12 if 16 <= t < 64 else None

    ppls = []
    confusion = np.zeros((4, 4))
    for k in range(4):
        losses = [nll for label, nll, _ in want if layer(label) == k]
        ppls.append(math.exp(np.mean(losses)) if losses else None)
        for label, _, top in want:
            if layer(label) == k:
                for j in {layer(t) for t in top} - {None}:
                    confusion[k, j] += 1
    found = {r.layer: r.ppl for r in sc.layer_perplexity(totals).collect()}
    assert found[3] is None
    assert [found[k] for k in range(3)] == pytest.approx(ppls[:3])
    summary = one(sc.perplexity_summary(totals))
    valid = np.array([p for p in ppls if p is not None])
    assert summary.avg_audio_ppl == pytest.approx(valid.mean())
    assert summary.ppl_variance == pytest.approx(valid.var() / valid.mean() ** 2)
    assert summary.ppl_std == pytest.approx(valid.std())
    assert summary.ppl_max_diff == pytest.approx(valid.max() - valid.min())
    text = [nll for label, nll, _ in want if label < 6]
    assert one(sc.text_perplexity(totals)).text_ppl == pytest.approx(math.exp(np.mean(text)))
    assert one(sc.lm_loss(totals)).loss == pytest.approx(np.mean([nll for _, nll, _ in want]))

    cells = {(r.true_layer, r.pred_layer): r.n for r in sc.layer_confusion(totals, TINY).collect()}
    assert cells == {(i, j): confusion[i, j] for i in range(4) for j in range(4)}
    sums = confusion.sum(axis=1, keepdims=True)
    share = confusion / np.where(sums == 0, 1, sums)
    got = {(r.true_layer, r.pred_layer): r.share for r in sc.confusion_normalized(totals, TINY).collect()}
    for (i, j), value in got.items():
        assert value == pytest.approx(share[i, j])
    assert all(
        sum(got[i, j] for j in range(4)) == pytest.approx(1.0 if sums[i, 0] else 0.0) for i in range(4)
    )
    s = one(sc.confusion_summary(totals, TINY))
    off = share[~np.eye(4, dtype=bool)]
    assert s.avg_diagonal == pytest.approx(np.diag(share).mean())
    assert s.min_diagonal == 0.0  # the empty row counts
    assert s.avg_off_diagonal == pytest.approx(off.mean())
    assert s.max_off_diagonal == pytest.approx(off.max())


def test_groups_are_kept_apart(spark, tables):
    logits, labels = tables
    run = F.when(F.col("seq_id") == 0, "a").otherwise("b").alias("run_id")
    both = sc.score_positions(logits.select("*", run), labels.select("*", run), TINY, by=["run_id"])
    grouped = sc.score_totals(both, TINY, ["run_id"])
    only = sc.score_totals(
        sc.score_positions(logits.where("seq_id = 0"), labels.where("seq_id = 0"), TINY), TINY
    )
    assert grouped.where("run_id = 'a'").drop("run_id").collect() == only.collect()


def test_equal_logits_have_perplexity_of_their_number(spark):
    df = spark.createDataFrame([([1.0] * 4, 2)], "logits array<float>, label bigint")
    for wide in (False, True):
        r = one(df.select(reduce_logits(F.col("logits"), F.col("label"), TINY, 5, wide).alias("r"))).r
        assert math.exp(r.nll) == pytest.approx(4.0)
        assert r.topk == [0, 1, 2, 3]


def test_label_outside_the_vector_has_no_loss(spark):
    df = spark.createDataFrame([([1.0, 2.0], 7)], "logits array<float>, label bigint")
    for wide in (False, True):
        assert one(df.select(reduce_logits(F.col("logits"), F.col("label"), TINY, 1, wide).alias("r"))).r.nll is None


def test_large_logits_do_not_overflow(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, -1000.0],)], "x array<float>")
    assert one(df.select(log_sum_exp(F.col("x")).alias("v"))).v == pytest.approx(1000 + math.log(2))
    assert one(df.select(top_ids(F.col("x"), 2).alias("v"))).v == [0, 1]


def test_folds_over_computed_arrays_stay_linear(spark):
    x = F.transform(F.sequence(F.lit(1), F.lit(80_000)), lambda i: (i % 97).cast("float"))
    row = one(
        spark.range(1).select(
            sample_variance(x).alias("v"), log_sum_exp(x).alias("l"), l2_norm(x).alias("n")
        ).where("v > 0")
    )
    values = np.arange(1, 80_001) % 97
    assert row.v == pytest.approx(values.var(ddof=1))
    assert row.n == pytest.approx(np.sqrt((values**2.0).sum()))


def test_vector_edges(spark):
    df = spark.createDataFrame([([2.0],), ([],), ([1.0, None, 3.0],)], "x array<double>")
    x = F.col("x")
    rows = df.select(sample_variance(x).alias("s"), population_variance(x).alias("p"), mean(x).alias("m"))
    assert [tuple(r) for r in rows.collect()] == [(None, 0.0, 2.0), (None, None, None), (2.0, 1.0, 2.0)]


def test_label_without_logits_is_reported(spark, tables):
    logits, labels = tables
    missing = sc.unmatched_positions(logits.where("pos <> 2"), labels, TINY)
    assert {r.pos for r in missing.collect()} == {2}


def test_output_variance(spark):
    rows = [(0, [1.0, 3.0]), (0, [0.0, 0.0]), (1, [0.0, 4.0])]
    per = variance_per_output(spark.createDataFrame(rows, "model_layer int, vec array<double>"))
    r = one(output_variance(per))
    assert tuple(r) == (4.5, 1.0, 8.0)
    empty = output_variance(per.where("false"))
    assert tuple(one(empty)) == (None, None, None)


def test_influence(spark):
    # Ids of the tiny layout: 3 is text, 16 and 17 layer 0, 28 layer 1, 15 special.
    tokens = spark.createDataFrame(
        [(0, 0, 3), (0, 1, 16), (0, 2, 28), (0, 3, 15)], "seq_id bigint, pos bigint, token_id bigint"
    )
    targets = spark.createDataFrame([(0, 3, 0), (0, 2, 1)], "seq_id bigint, pos bigint, layer int")
    pairs = past_token_pairs(targets, tokens, TINY)
    assert {(r.pos, r.src_pos) for r in pairs.collect()} == {(3, 0), (3, 1), (3, 2), (3, 3), (2, 0), (2, 1), (2, 2)}
    recorded = pairs.where("layer = 0").select(
        "seq_id", "pos", "src_pos", (F.col("src_pos") + 1).cast("double").alias("influence")
    )
    shares = influence_share(influence_by_target(recorded, targets, tokens, TINY))
    r = one(shares)  # layer 1 has no recorded influence and is absent
    assert r.layer == 0
    assert (r.text_influence, r.same_layer_influence, r.cross_layer_influence) == pytest.approx(
        (0.5, 0.2, 0.3)
    )
    assert {m.metric for m in influence_metrics(shares).collect()} == {
        f"metrics/layer_0_{k}_influence" for k in ("text", "same_layer", "cross_layer")
    }


def test_metric_row_reads_each_input_once(spark, tables, tmp_path):
    paths = [str(tmp_path / n) for n in ("logits", "labels", "hidden")]
    tables[0].write.parquet(paths[0])
    tables[1].write.parquet(paths[1])
    spark.createDataFrame([(0, [1.0, 3.0])], "model_layer int, vec array<double>").write.parquet(paths[2])
    logits, labels, hidden = (spark.read.parquet(p) for p in paths)
    row = metric_row(sc.score_positions(logits, labels, TINY), hidden, TINY)
    table = metric_table(row, TINY)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 3
    found = {r.metric: r.value for r in table.collect()}
    assert len(found) == 12 + 4 + 16
    assert found["metrics/avg_output_variance"] == 2.0
    assert found["metrics/layer_3_ppl"] is None


def test_both_forms_agree_on_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        ([-inf, -inf, 1.0, 2.0], 3), ([-inf, -inf], 0), ([1.0, nan, 3.0], 0), ([1.0, None, 3.0], 2),
        (None, 0), ([], 0), ([1.0, 2.0], None), ([1.0, 2.0], 7), ([1.0, 2.0], -1), ([2.0, 2.0, -inf], 2),
    ]
    df = spark.createDataFrame(rows, "logits array<double>, label bigint").repartition(1)
    out = [
        df.select(reduce_logits(F.col("logits"), F.col("label"), TINY, 2, wide=w).alias("r")).collect()
        for w in (False, True)
    ]
    for a, b in zip(*out):
        assert str(a["r"]["topk"]) == str(b["r"]["topk"])
        x, y = a["r"]["nll"], b["r"]["nll"]
        assert (x is None) == (y is None) and (x is None or x == y or x != x and y != y or abs(x - y) < 1e-12)
    nll = [r["r"]["nll"] for r in out[0]]
    assert abs(nll[0] - 0.31326168751822286) < 1e-12 and nll[1] is None and nll[2] != nll[2]
    assert nll[9] == inf and out[0][4]["r"]["topk"] is None


def test_scoring_of_stored_aligned_logits_moves_no_logits(spark, tables, tmp_path):
    path = str(tmp_path / "aligned")
    sc.align_logits(*tables, TINY).write.parquet(path)
    scored = sc.score_aligned(spark.read.parquet(path), TINY)
    key = ("seq_id", "pos")
    assert scored.orderBy(*key).collect() == sc.score_positions(*tables, TINY).orderBy(*key).collect()
    plan = sc.score_totals(scored, TINY)._jdf.queryExecution().executedPlan().toString()
    # Only the totals of each task are exchanged.
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
