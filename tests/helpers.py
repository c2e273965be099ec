from codecloom.layout import TokenLayout

L = TokenLayout()
TINY = TokenLayout(text_vocab_size=6, audio_codebook_size=12)


def values(df, *columns):
    """Rows as tuples, in the order of the first column."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: str(r[0]))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def layers(spark, utterances, extra="encoded_len int"):
    """[(id, [frame, ...]), ...] with four codes per frame -> canonical layer columns."""
    rows = [
        (key, *[[f[k] for f in frames] for k in range(4)], len(frames)) for key, frames in utterances
    ]
    names = ", ".join(f"{c} array<int>" for c in L.layer_columns)
    return spark.createDataFrame(rows, f"utt_id bigint, {names}, {extra}")
