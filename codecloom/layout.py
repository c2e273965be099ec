"""Token id layout: text ids, ten special ids, then one id block per audio layer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TokenLayout:
    # Sizes and special ids of the token layout.
    text_vocab_size: int = 64400
    audio_codebook_size: int = 4032
    num_audio_layers: int = 4
    tokens_per_frame: int = 4
    num_special: int = 10
    start_of_text: int = 1
    end_of_text: int = 2
    ignore_label: int = -100

    @property
    def start_of_speech(self) -> int:
        return self.text_vocab_size + 1

    @property
    def end_of_speech(self) -> int:
        return self.text_vocab_size + 2

    @property
    def start_of_human(self) -> int:
        return self.text_vocab_size + 3

    @property
    def end_of_human(self) -> int:
        return self.text_vocab_size + 4

    @property
    def start_of_ai(self) -> int:
        return self.text_vocab_size + 5

    @property
    def end_of_ai(self) -> int:
        return self.text_vocab_size + 6

    @property
    def pad(self) -> int:
        return self.text_vocab_size + 7

    @property
    def audio_start(self) -> int:
        return self.text_vocab_size + self.num_special

    @property
    def total_vocab_size(self) -> int:
        return self.audio_start + self.num_audio_layers * self.audio_codebook_size

    @property
    def layer_columns(self) -> list[str]:
        return [f"nano_layer_{k + 1}" for k in range(self.num_audio_layers)]

    def layer_start(self, layer: int) -> int:
        return self.audio_start + layer * self.audio_codebook_size

    def audio_layer(self, token: Column) -> Column:
        """Audio layer of a token id; NULL for text, special and out-of-range ids."""
        inside = (token >= F.lit(self.audio_start)) & (token < F.lit(self.total_vocab_size))
        block = F.floor((token - F.lit(self.audio_start)) / F.lit(self.audio_codebook_size))
        return F.when(inside, block.cast("int"))

    def is_text(self, token: Column) -> Column:
        """True for plain text ids; the special ids are neither text nor audio."""
        return token < F.lit(self.text_vocab_size)

    def layer_ranges(self, spark: SparkSession) -> DataFrame:
        """One row per audio layer with its half-open id range [lo, hi)."""
        lo = F.lit(self.audio_start) + F.col("id") * F.lit(self.audio_codebook_size)
        return spark.range(self.num_audio_layers).select(
            F.col("id").cast("int").alias("layer"),
            lo.alias("lo"),
            (lo + F.lit(self.audio_codebook_size)).alias("hi"),
        )

    def custom_tokens(self, spark: SparkSession, base: int | None = None) -> DataFrame:
        """Names and ids of the tokens added after a base text vocabulary."""
        first = self.text_vocab_size if base is None else base
        n = self.num_special + self.num_audio_layers * self.audio_codebook_size
        return spark.range(n).select(
            (F.col("id") + F.lit(first)).alias("token_id"),
            F.concat(F.lit("<custom_token_"), F.col("id").cast("string"), F.lit(">")).alias("token"),
        )


def join_layer_ranges(df: DataFrame, token: str, layout: TokenLayout) -> DataFrame:
    """Attach `layer` by range join with the layout table; ids outside every range get NULL.

    Broadcast is safe: the layout table has `num_audio_layers` rows whatever the data. Codes
    elsewhere use `TokenLayout.audio_layer`, which needs no join at all.
    """
    ranges = F.broadcast(layout.layer_ranges(df.sparkSession))
    inside = (F.col(token) >= F.col("lo")) & (F.col(token) < F.col("hi"))
    return df.join(ranges, inside, "left").drop("lo", "hi")
