"""Chat formatting by quotation linking, in DataFrame operations only.

A line that starts with `>` marks is quoted; the number of marks is its level. Neighbouring lines of one
level make a passage, a blank line ends it. Passages are normalised (marks off, letters lower-cased, lines
joined, white space collapsed), so a quote that was wrapped anew is the same passage. A passage, its
sentences and its lines are its pieces. Quoted pieces are hashed and joined to the pieces that messages of
the same conversation have as their own; each is credited to the latest earlier message that has it. A
message replies to the original of its outermost linked level: the one credited with most of that level's
letters, the latest of several, so a whole passage outweighs a short line that others share. Messages
without a link start a thread.

The latest earlier holder of a piece is found in blocks of turns, with the last holder of each block
carried on, so a line that a whole long conversation repeats is many small groups.

Threads are found by doubling pointers, so a chain of n replies takes log2(n) rounds, each written to
the shared folder. The result is sorted by conversation, thread and turn: every message comes after
the one it answers, and its body has no quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecloom.llm.common import whole_text, written

MARKS = r"^[ \t]*(?:>[ \t]?)+"
SPACE = r"[\x20\x09-\x0D]+"
# Turns that are searched together for the latest holder of a piece.
TURN_BLOCK = 1024


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), SPACE, " ")))


def passages(text: Column) -> Column:
    """The passages of a text, each as its level, a tab and its normalised lines, ended by line feeds.

    Lines carry their level at both ends, so that two neighbours of one level meet in a repeated number;
    these seams go. Blank lines have the level `-`.
    """
    def marked(line: Column) -> Column:
        norm = normalised_line(line)
        level = F.when(norm == F.lit(""), F.lit("-")).otherwise(quote_level(line).cast("string"))
        return F.concat_ws("\t", level, norm, level)

    lines = F.array_join(F.transform(F.split(text, "\n"), marked), "\n")
    return F.split(F.regexp_replace(lines, "\t([0-9]+|-)\n\\1\t", "\r"), "\n")


def pieces(body: Column) -> Column:
    """A passage as a whole, its sentences and its lines, each once."""
    whole = F.translate(body, "\r", " ")
    sentences = F.split(F.regexp_replace(whole, "([.!?]) ", "$1\n"), "\n")
    return F.array_distinct(F.concat(F.array(whole), sentences, F.split(body, "\r")))


def message_pieces(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, piece, hash): the different pieces of a message's passages, by level."""
    return (
        messages.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
        .select("conv", "turn", F.explode(passages(F.col("text"))).alias("passage"))
        .select("conv", "turn", F.split("passage", "\t").alias("parts"))
        .where(F.col("parts")[0] != F.lit("-"))
        .select(
            "conv", "turn", F.col("parts")[0].cast("int").alias("level"),
            F.explode(pieces(F.col("parts")[1])).alias("piece"),
        )
        .where(F.col("piece") != F.lit(""))
        .distinct()
        .withColumn("hash", F.xxhash64("piece"))
    )


def latest_holders(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """`quoted` rows with `origin`: the latest earlier turn of the conversation with that piece as its own."""
    key = ["conv", "hash", "piece"]
    own = own.join(quoted.select(*key).distinct(), key, "left_semi").select(*key, "turn")
    events = own.select(*key, "turn", F.lit(None).cast("int").alias("level"), F.col("turn").alias("held"))
    asked = quoted.select(*key, "turn", "level", F.lit(None).cast("bigint").alias("held"))
    events = events.unionByName(asked).withColumn("block", F.floor(F.col("turn") / F.lit(TURN_BLOCK)))
    blocks = events.groupBy(*key, "block").agg(F.max("held").alias("last"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*key, "block", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("near", F.max("held").over(inside)).where(F.col("level").isNotNull())
    origin = F.coalesce("near", "carried").alias("origin")
    same = [F.col(f"f.{c}") == F.col(f"c.{c}") for c in (*key, "block")]
    found = found.alias("f").join(carried.alias("c"), same)
    return found.select(*[f"f.{c}" for c in key], "turn", "level", origin).where(F.col("origin").isNotNull())


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, n_linked): one row per message that quotes an earlier one."""
    found = message_pieces(messages)
    # Few rows of a corpus are quoted; they are read several times.
    quoted = written(found.where(F.col("level") > F.lit(0)), "quoted-pieces")
    own = found.where(F.col("level") == F.lit(0))
    linked = latest_holders(quoted, own)
    per_origin = linked.groupBy("conv", "turn", "level", "origin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("piece")).alias("letters")
    )
    best = F.max(F.struct(-F.col("level"), F.col("letters"), F.col("origin"))).alias("best")
    links = per_origin.groupBy("conv", "turn").agg(best, F.sum("n").alias("n_linked"))
    return links.select("conv", "turn", F.col("best.origin").alias("reply_to"), "n_linked")


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, n_linked, root, depth) by doubling pointers along `reply_to`."""
    state = written(
        links.withColumn("root", F.col("reply_to")).withColumn("depth", F.lit(1).cast("bigint")), "threads"
    )
    while True:
        ahead = state.select(
            "conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more")
        )
        moved = state.join(ahead, ["conv", "root"], "left").select(
            "conv", "turn", "reply_to", "n_linked",
            F.coalesce("next", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved"),
        )
        moved = written(moved, "threads")
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state


def threaded_conversations(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per message, sorted by conversation, thread root and turn.

    Columns: the conversation, turn and role; `thread_root` and `reply_to` (turns; `reply_to` is NULL
    for a message that starts a thread), `depth` in the thread, `n_quoted` lines, `n_linked` quoted pieces
    that an earlier message has, `body` (the text without quoted lines) and `chat` (the body under a role header).

    NULL text is empty. A message without a conversation or a turn is not linked; its root is its own
    turn. Rows that repeat a conversation and turn are one message for linking, and all are returned.
    A passage quoted from nowhere in the conversation links nothing. Other columns are ignored.
    """
    messages = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).alias("role"),
        whole_text(text_col).alias("text"),
    )
    threads = thread_roots(reply_links(messages))
    lines = F.split("text", "\n")
    quoted = F.filter(lines, lambda x: x.rlike(MARKS))
    body = F.array_join(F.filter(lines, lambda x: ~x.rlike(MARKS)), "\n")
    rows = messages.select("conv", "turn", "role", F.size(quoted).cast("bigint").alias("n_quoted"), body.alias("body"))
    zero = F.lit(0).cast("bigint")
    header = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"))
    return (
        rows.join(threads, ["conv", "turn"], "left")
        .select(
            F.col("conv").alias(conv_col),
            F.col("turn").alias(turn_col),
            F.col("role").alias(role_col),
            F.coalesce("root", "turn").alias("thread_root"),
            "reply_to",
            F.coalesce("depth", zero).alias("depth"),
            "n_quoted",
            F.coalesce("n_linked", zero).alias("n_linked"),
            "body",
            F.concat(header, F.col("body")).alias("chat"),
        )
        .sort(conv_col, "thread_root", turn_col, role_col)
    )
