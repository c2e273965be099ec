import pytest
from pyspark.sql import functions as F

from codecloom.operators.sampling import in_source_order
from codecloom.operators.shards import file_starts, shard, with_row_numbers


@pytest.fixture
def given(spark, tmp_path):
    """Two sources of several files of different sizes, one of them empty."""
    parts = []
    for source, sizes in enumerate(([5, 0, 1, 7], [3])):
        folder = str(tmp_path / f"s{source}")
        for k, size in enumerate(sizes):
            spark.range(100 * k, 100 * k + size).coalesce(1).write.mode("append").parquet(f"{folder}/f{k}")
        rows = spark.read.option("recursiveFileLookup", True).parquet(folder).select(
            F.lit(source).alias("source_ord"), F.regexp_extract("_metadata.file_path", "(f[0-9]/.*)$", 1).alias("row_file"),
            F.col("_metadata.row_index").alias("row_ord"), "id",
        )
        parts.append(rows)
    return parts[0].unionByName(parts[1])


def in_order(df):
    return [(r.source_ord, r.row_no, r.id) for r in df.sort("source_ord", "row_no").collect()]


def test_row_numbers_follow_the_files(given):
    want = [(0, i, v) for i, v in enumerate([*range(5), 200, *range(300, 307)])]
    want += [(1, i, i) for i in range(3)]
    assert in_order(with_row_numbers(given)) == want
    restored = in_source_order(with_row_numbers(given).repartition(4, "id")).collect()
    assert [(r.source_ord, r.row_no, r.id) for r in restored] == want


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_put_together_are_the_input(given, n):
    starts = file_starts(given)
    parts = [in_order(shard(given, n, i, starts)) for i in range(n)]
    for source, total in ((0, 13), (1, 3)):
        rows = [[r for r in part if r[0] == source] for part in parts]
        assert [r for part in rows for r in part] == [r for r in in_order(with_row_numbers(given)) if r[0] == source]
        sizes = [len(part) for part in rows]
        assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True) and sum(sizes) == total


def test_a_shard_outside_is_an_error(given):
    with pytest.raises(ValueError):
        shard(given, 3, 3)


def test_rows_are_not_sorted(given):
    plan = shard(given, 3, 1)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert scans and "rangepartitioning" not in plan
