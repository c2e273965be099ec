import hashlib

import pytest
from pyspark.sql import functions as F

from codecloom.operators.ranking import global_rank, seeded_cap
from codecloom.operators.sampling import (
    assign_batches,
    first_batches,
    in_source_order,
    ordered_union,
    sample_targets,
    shuffle_rank,
    source_cap,
)


def md5_order(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


def ids(spark, n, parts=4):
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "utt_id")


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rank_is_the_md5_order(spark, digits):
    df = global_rank(ids(spark, 300), ["utt_id"], 7, digits=digits)
    found = [r.utt_id for r in df.orderBy("rank").collect()]
    assert found == md5_order(range(300), 7)
    assert [r["rank"] for r in df.orderBy("rank").collect()] == list(range(300))


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("cap", [1, 37, 300, 301, 0])
def test_cap_takes_the_first_of_the_md5_order(spark, cap, digits):
    df = seeded_cap(ids(spark, 300), ["utt_id"], cap, 42, digits)
    assert {r.utt_id for r in df.collect()} == set(md5_order(range(300), 42)[:cap])


def test_no_cap_keeps_all(spark):
    assert source_cap(ids(spark, 10), None).count() == 10


def test_cap_moves_no_wide_rows(spark, tmp_path):
    path = str(tmp_path / "wide")
    ids(spark, 100).withColumn("wide", F.sequence(F.lit(1), F.lit(5))).write.parquet(path)
    plan = source_cap(spark.read.parquet(path), 10)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange hashpartitioning" not in main


@pytest.mark.parametrize("size", [1, 3, 8, 64, 1000])
@pytest.mark.parametrize("digits", [1, 4])
def test_batches_follow_the_global_order(spark, size, digits):
    df = assign_batches(ids(spark, 211), size, 7, digits=digits)
    found = {r.utt_id: (r.batch_id, r.batch_pos) for r in df.collect()}
    order = md5_order(range(211), "7:0")
    assert found == {k: (i // size, i % size) for i, k in enumerate(order)}
    assert df.groupBy("batch_id").agg(F.count_distinct("batch_chunk").alias("n")).where("n > 1").count() == 0


def test_partitioning_does_not_matter(spark):
    base = ids(spark, 100, 1)
    for f in (
        lambda d: assign_batches(d, 7, 3),
        lambda d: shuffle_rank(d, 3, epoch=2),
        lambda d: source_cap(d, 20),
    ):
        assert f(base).exceptAll(f(base.repartition(16))).count() == 0


def test_epochs_differ(spark):
    a, b = shuffle_rank(ids(spark, 50), 1, 0), shuffle_rank(ids(spark, 50), 1, 1)
    assert a.exceptAll(b).count() > 0


def test_union_keeps_duplicates_and_order(spark):
    a = spark.createDataFrame([("f", 1, "x"), ("f", 0, "y")], "row_file string, row_ord int, v string")
    df = in_source_order(ordered_union([a, a.where("row_ord = 0"), a]))
    assert [(r.source_ord, r.v) for r in df.collect()] == [
        (0, "y"), (0, "x"), (1, "y"), (2, "y"), (2, "x")
    ]
    with pytest.raises(ValueError):
        ordered_union([])


def test_first_batches(spark):
    df = spark.range(30).withColumnRenamed("id", "batch_id")
    assert first_batches(df).count() == 10


def test_target_sample_is_bounded_per_layer_even_if_one_layer_is_hot(spark):
    df = spark.range(0, 5000, 1, 8).select(
        F.lit(1).alias("seq_id"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 50 == 0, 1).when(F.col("id") % 3 > 0, 0).alias("layer"),
    )
    places = {}
    for row in df.where("layer is not null").collect():
        order = hashlib.md5(f"42:{row.seq_id}:{row.pos}".encode()).hexdigest()
        places.setdefault(row.layer, []).append((order, row.pos))
    for n in (0, 1, 32, 2000, 5000):
        out = sample_targets(df, n)
        assert out.columns == df.columns
        want = {(k, pos) for k, v in places.items() for _, pos in sorted(v)[:n]}
        got = [(r.layer, r.pos) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want


def test_target_sample_of_groups_with_null(spark):
    df = spark.createDataFrame(
        [(s, p, p % 2, None if s == 0 else s) for s in range(3) for p in range(40)],
        "seq_id int, pos int, layer int, step int",
    )
    out = sample_targets(df, 7, by=("step",))
    assert [r["count"] for r in out.groupBy("step", "layer").count().collect()] == [7] * 6
