import pytest
from pyspark.sql import functions as F

from codecloom.sources import metric_store as ms

SCHEMA = "run_id string, step bigint, batch_id bigint, metric string, value double"
ROWS = [("a", s, b, m, float(s)) for s in (0, 5, 15, 25) for b in (None, 1) for m in ("loss", "ppl")]
ROWS += [("007", 5, 1, "loss", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path):
    rows = [tuple(r) for r in ms.read_metrics(spark, path).collect()]
    assert len({r[:4] for r in rows}) == len(rows)
    return {r[:4]: r[4] for r in rows}


def test_a_repeated_write_leaves_one_row_a_metric(spark, tmp_path):
    path = str(tmp_path / "log")
    for _ in range(2):
        ms.write_metrics(frame(spark, ROWS), path, block=10)
    assert held(spark, path) == {r[:4]: r[4] for r in ROWS}
    # Other values of the same keys replace, other keys stay, repeated keys count once.
    again = [("a", 5, None, "loss", 1.0), ("a", 5, None, "loss", 9.0), ("a", 6, 2, "new", 3.0)]
    ms.write_metrics(frame(spark, again), path, block=10)
    want = {r[:4]: r[4] for r in ROWS} | {("a", 5, None, "loss"): 9.0, ("a", 6, 2, "new"): 3.0}
    assert held(spark, path) == want
    ms.write_metrics(frame(spark, []), path, block=10)
    assert held(spark, path) == want


def test_a_write_that_dies_while_staging_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    ms.write_metrics(frame(spark, ROWS), path, block=10)
    bad = frame(spark, [("a", 5, 1, "loss", 7.0), ("a", None, 1, "loss", 7.0)])
    with pytest.raises(Exception, match="without run or step"):
        ms.write_metrics(bad, path, block=10)
    assert held(spark, path) == {r[:4]: r[4] for r in ROWS}


@pytest.mark.parametrize("replaced", [0, 1, 2])
def test_a_write_that_dies_while_replacing_is_finished_by_the_next(spark, tmp_path, replaced):
    path = str(tmp_path / "log")
    ms.write_metrics(frame(spark, ROWS), path, block=10)
    change = [("a", s, None, "loss", -1.0) for s in (0, 15)]
    name = ms.stage_metrics(frame(spark, change), path, block=10)
    # Some blocks are in place, one is gone, when the job dies.
    blocks = spark.read.schema(ms.LOG_SCHEMA).parquet(f"{path}_staged/{name}")
    for block in range(replaced):
        part = blocks.where(F.col("step_block") == block).repartition(1).write.mode("overwrite")
        part.option("partitionOverwriteMode", "dynamic").partitionBy(*ms.BLOCKS).parquet(path)
    if replaced == 1:
        ms.remove(spark, f"{path}/run_id=a/step_block=1")
    want = {r[:4]: r[4] for r in ROWS} | {r[:4]: r[4] for r in change}
    if replaced == 2:
        ms.recover(spark, path)
    else:
        ms.write_metrics(frame(spark, [("b", 1, 1, "x", 1.0)]), path, block=10)
        want[("b", 1, 1, "x")] = 1.0
    assert held(spark, path) == want
    assert ms.children(spark, f"{path}_staged") == []


def test_only_touched_blocks_are_read(spark, tmp_path):
    path = str(tmp_path / "log")
    ms.write_metrics(frame(spark, ROWS), path, block=10)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*.parquet")}
    ms.write_metrics(frame(spark, [("a", 7, 1, "loss", 1.0)]), path, block=10)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*.parquet")}
    gone = {p.parent.name for p in before.keys() - after.keys()}
    assert gone == {"step_block=0"} and all(after[p] == t for p, t in before.items() if p in after)


def test_a_block_is_one_file_while_it_is_staged(spark, tmp_path, monkeypatch):
    """The files of a write follow its blocks, not blocks times tasks."""
    monkeypatch.setattr(ms, "remove", lambda *_: None)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        log = spark.range(400).selectExpr("id step", "id % 3 batch_id", "'m' metric", "1.0D value", "concat('r', id % 2) run_id")
        ms.stage_metrics(log, str(tmp_path / "log"), block=100)
    finally:
        spark.conf.set(coalesce, before)
    (new,) = (tmp_path / "log_staged").glob("new-*")
    assert len(list(new.rglob("*.parquet"))) == 8
