r"""Chat formatting in budgeted, turn-aligned windows with loss masks, and reading it back.

Template. A turn is `### role: text</turn>` and a line feed. Inside role and text a backslash is written `\\`, `#` is `\h`, `<` is `\l`, and in a
role `:` is `\c`, so neither `###` nor `</turn>` can occur in them, and unescaping restores every text.

Windows. Prefix sums of the turns' tokens (words, unless the caller counts them) place each turn in span floor(words before it / stride) of its conversation. A span's window has, in
order: the conversation's system turn (if its first turn has the role `system`), whole turns of the previous span that begin at most `history` words before the
span, and the span's own turns. System turns and history that repeat are not targets; loss spans cover the text of the span's own assistant turns,
so that each assistant turn is a target exactly once. A window has at most stride + history words besides its system turn, more only by what its last turn
goes beyond the stride.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

STRIDE = 512
HISTORY = 256
HEAD, BETWEEN, TAIL = "### ", ": ", "</turn>\n"
TARGET = "assistant"
_SPACES = r"[\x20\x09-\x0D]+"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(text: Column, role: bool = False) -> Column:
    """Between doubled backslashes, taken from the left, every other escape is unambiguous."""

    def plain(part: Column) -> Column:
        out = F.replace(F.replace(part, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
        return F.replace(out, F.lit("\\c"), F.lit(":")) if role else out

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def windows(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY, system_role: str = "system", count_col: str | None = None) -> DataFrame:
    """Format all turns: conv_id, window, text, n_repeated (turns at its head that repeat), loss (array of start, length in code points), n_words.

    turns: conv_id, turn, role, text, and a column count_col of each turn's tokens, if the budget is to be one of a model's tokens; by default words between ASCII
    white space count. n_words is the sum of these counts. Turns go in ascending order of turn (nulls first), then role and text; equal rows stay turns of their
    own. A null text or role is empty; a null conv_id is a conversation like any other. An empty table gives no rows; other columns aren't read. No
    step gathers a conversation: prefix sums run over range partitions and a window holds its budget's turns only.
    """
    said = F.coalesce("text", F.lit(""))
    count = F.coalesce(F.col(count_col), F.lit(0)) if count_col else F.size(F.filter(F.split(said, _SPACES), lambda w: w != ""))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), said.alias("text"), count.cast("long").alias("words"))
    rows = rows.withColumn("_one", F.lit(1).cast("long"))
    rows = common.prefix_sums(rows, {"words": "before", "_one": "place"}, ["turn", "role", "text"], ["conv_id"]).drop("_one")
    rows = common.stored(rows.withColumn("span", F.floor(F.col("before") / stride).cast("long")), "turns")
    spans = rows.groupBy("conv_id", "span").agg(F.min("before").alias("begin"), F.min("place").alias("first"))
    system = rows.where((F.col("place") == 0) & (F.col("role") == system_role)).select("conv_id", "role", "text", "words")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    own = rows.select("conv_id", "span", F.lit(2).alias("part"), "place", "role", "text", "words")
    again = rows.alias("t").join(spans.alias("s"), same("t", "s") & (F.col("s.span") == F.col("t.span") + 1) & (F.col("s.begin") - F.col("t.before") <= history))
    again = again.where(~((F.col("t.place") == 0) & (F.col("t.role") == system_role)))
    again = again.select("t.conv_id", "s.span", F.lit(1).alias("part"), "t.place", "t.role", "t.text", "t.words")
    kept = spans.alias("s").where("s.first > 0").join(system.alias("y"), same("s", "y"))
    kept = kept.select("s.conv_id", "s.span", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), "y.role", "y.text", "y.words")
    every = own.unionByName(again).unionByName(kept)
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), role=True), F.lit(BETWEEN))
    every = every.select("conv_id", "span", "part", "place", "words", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(TAIL)
    order = Window.partitionBy("conv_id", "span").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = every.withColumn("at", F.coalesce(F.sum(size).over(order), F.lit(0)).cast("int"))
    target = (F.col("part") == 2) & (F.col("role") == TARGET)
    turn = F.struct("at", F.concat("head", "body", F.lit(TAIL)).alias("rendered"), F.when(target, F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").alias("length"))).alias("loss"), (F.col("part") < 2).alias("again"), "words")
    out = placed.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return out.select(
        "conv_id", F.col("span").alias("window"), F.array_join("turns.rendered", "").alias("text"), F.size(F.filter("turns", lambda t: t["again"])).alias("n_repeated"),
        F.array_compact("turns.loss").alias("loss"), F.aggregate("turns.words", F.lit(0).cast("long"), lambda s, w: s + w).alias("n_words"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """The turns of windows(), from their texts alone, without repeats: conv_id, window, n (place in the window), role, text."""
    pieces = F.filter(F.split("text", TAIL), lambda x: x != "")
    rows = formatted.select("conv_id", "window", "n_repeated", F.posexplode(pieces).alias("n", "piece")).where("n >= n_repeated")
    role = F.substring_index("piece", BETWEEN, 1)
    return rows.select(
        "conv_id", "window", "n",
        unescaped(F.substring(role, len(HEAD) + 1, F.length(role)), role=True).alias("role"),
        unescaped(F.substring("piece", F.length(role) + len(BETWEEN) + 1, F.length("piece"))).alias("text"),
    )


def read_targets(formatted: DataFrame) -> DataFrame:
    """What the loss masks cover, unescaped: conv_id, window, n, text."""
    rows = formatted.select("conv_id", "window", "text", F.posexplode("loss").alias("n", "span"))
    return rows.select("conv_id", "window", "n", unescaped(F.substring("text", F.col("span.start") + 1, F.col("span.length"))).alias("text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from windows(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is of one string, so a conversation's text meets in one row here (and only here).
    """

    def joined(rows: DataFrame, value: Column, name: str, *more: Column) -> DataFrame:
        got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "n", value.alias("v")))).alias("all"), *more)
        return got.withColumn(name, F.array_join("all.v", "")).drop("all")

    turns = joined(read_turns(formatted), F.concat("role", F.lit("\n"), "text", F.lit("\n")), "whole", F.count("*").alias("n_turns"))
    targets = joined(read_targets(formatted), F.col("text"), "target")
    sizes = formatted.groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    rows = sizes.alias("s").join(turns.alias("t"), same("s", "t"), "left").join(targets.alias("l"), same("s", "l"), "left")
    target = F.coalesce("target", F.lit(""))
    return rows.select(
        "s.conv_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), F.sha2(F.coalesce("whole", F.lit("")), 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars",
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and one that holds the template's own control strings; digests read back from the output."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(common.stored(windows(turns.unionByName(more)), "formatted"))
