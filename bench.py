"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the number of local cores. Arrays are
produced in full (written to the no-op sink), never just counted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import queries as q  # noqa: E402
from codecloom import fixtures as fx  # noqa: E402
from codecloom.operators import codes, positions, sampling  # noqa: E402
from codecloom.plans import corpus, training_view  # noqa: E402
from codecloom.session import local_session, shared_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def steps(spark):
    sf = SF_DIR

    def registered(name):
        return lambda: consume(q.QUERIES[name](spark, sf))

    saved = shared_path(spark, "bench_corpus")

    def save_corpus():
        corpus.training_columns(q.sequences_of(spark, sf), derived=False).write.parquet(saved)

    def batches():
        rows = spark.read.parquet(saved).select("utt_id", "input_ids", "speaker_emb")
        consume(training_view.training_batches(rows, q.L, 8, q.SEED))

    def capped_codes():
        usable = corpus.usable_rows(q.rows(spark, sf), q.L, q.CAP_SECONDS)
        return codes.add_codes(usable, q.L)

    def capped_positions():
        # The text side counts as one token here: only codes and positions are timed.
        one = F.array(F.lit(q.L.end_of_text).cast("bigint"))
        rows = capped_codes().withColumn("text_tokens", one)
        out = positions.add_canonical_positions(rows, q.L)
        consume(out.select("utt_id", "codes", "position_ids"))

    named = {
        "codec_table": lambda: fx.codec_table(spark, sf),
        "vocabulary": lambda: q.tokenizer(spark, sf),
        "codes_120s": lambda: consume(capped_codes().select("utt_id", "codes")),
        "codes_positions_120s": capped_positions,
        "flatten_codes": lambda: consume(
            codes.add_codes(q.rows(spark, sf), q.L).select("utt_id", "codes")
        ),
        "input_ids": lambda: consume(q.sequences_of(spark, sf).select("utt_id", "input_ids")),
        "frame_positions": lambda: consume(
            positions.add_canonical_positions(q.sequences_of(spark, sf), q.L).select(
                "utt_id", "input_ids", "position_ids"
            )
        ),
        "save_corpus": save_corpus,
        "training_batches": batches,
        "capped_rows": lambda: consume(sampling.source_cap(q.rows(spark, sf), 5000)),
    }
    for name in (
        "corpus_preparation",
        "length_stats",
        "stage_counts",
        "text_tokens_join",
        "token_lookup",
        "vocab_extension",
        "training_shuffle",
        "verdict_report",
        "influence_share",
        "eval_mean",
        "alpha_report",
        "alpha_early_late",
    ):
        named[name] = registered(name)
    return named


def main() -> None:
    spark = local_session(CPUS, "codecloom-bench", "16g")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    timings = {}
    for name, run in steps(spark).items():
        start = time.perf_counter()
        run()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
