"""Functions sent to executors must not need this package there."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from codecloom.functions.logits import arrow_reducer
from codecloom.layout import TokenLayout
from codecloom.operators.positions import sequence_positions
from codecloom.operators.tokens import WordTokenizer, custom_tokenizer
from codecloom.session import local_session

spark = local_session(2, memory="1g")
L = TokenLayout()
df = spark.createDataFrame([("a b", [1.0, 2.0], 1, [5, 64410])],
                           "p string, x array<float>, y bigint, ids array<bigint>")
vocab = spark.createDataFrame([("a", 300)], "word string, token_id bigint")
row = df.select(
    arrow_reducer(2)("x", "y").alias("r"),
    sequence_positions(L)("ids").alias("q"),
    WordTokenizer(vocab, L).column(F.col("p")).alias("t"),
    custom_tokenizer(lambda: lambda s: [len(s)])("p").alias("u"),
).first()
print(row.r.topk, row.q, row.t, row.u)
"""


def test_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)],
        cwd=tmp_path, capture_output=True, text=True, timeout=300,
    )
    assert out.stdout.strip().endswith("[1, 0] [0.0, 1.0] [300, 42, 108] [3]"), out.stderr[-2000:]
