"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Metrics are columns of counts; a rule bounds the ratio of two of them for texts of enough words. rows() adds the metrics and judge()
compiles the table to a single Boolean expression, so that Spark evaluates everything in one pass without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
_SPACES = r"[\x20\x09-\x0D]+"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that for with was on by he this are not from at or it as be an have "
    "der die das und in zu den von ist mit nicht ein eine auf für dem des sich auch "
    "le la les de des et un une est que pour dans en du au pas par sur avec "
    "el los las y se del al con por una su para es lo como"
).split()


class Rule(NamedTuple):
    """A text of at least `words` words fails unless low <= numerator / denominator <= high; a denominator of 0 never fails."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    words: int = 0


#: The default table: length, symbol, case, punctuation, stop-word and line ratios.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.3),
    Rule("exclamations_per_word", "n_exclamations", "n_words", 0.0, 0.3),
    Rule("capital_share", "n_capitals", "word_chars", 0.0, 0.4),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.04, 1.0, words=50),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", 0.0, 0.4),
)


def repeated_words(hashes: str, window: int = WINDOW) -> list[dict[str, Column]]:
    """Steps of columns that count the words in windows found twice or more; `hashes` names an array of word hashes.

    Each step is a projection of its own. Windows are hashed and sorted with their places; neighbours that are equal mark their places, and
    the marked places, in order, cover min(window, distance to the next) words each. So the time is n log n for any text.
    """
    n, last = F.size(hashes), F.size(hashes) - window
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.slice(hashes, i + 1, window)).alias("h"), i.alias("i")))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")

    def shifted(name: str) -> Column:
        return F.slice(name, F.lit(2), F.greatest(F.size(name) - 1, F.lit(0)))

    marked = F.zip_with("_equal", F.concat(F.array(F.lit(False)), F.transform("_equal", lambda x: x["same"])), lambda x, before: F.when(x["same"] | before, x["i"]))
    cover = F.zip_with("_marked", shifted("_marked"), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
    return [
        {"_sorted": F.sort_array(F.when(n >= window, windows).otherwise(empty))},
        {"_equal": F.zip_with("_sorted", shifted("_sorted"), lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("same")))},
        {"_marked": F.sort_array(F.array_compact(marked))},
        {"n_repeat_words": F.aggregate(cover, F.lit(0).cast("long"), lambda s, x: s + x)},
    ]


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, whatever their names, and the metrics: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_stop_words, n_capitals, n_exclamations, all long. Equal names in docs are replaced. A null text counts as empty."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals", "n_exclamations")
    kept = ("_rest", "_given")

    def without(characters: str) -> Column:
        return F.length("_text") - F.length(F.translate("_text", characters, ""))

    rows = common.packed(docs, [text_col]).select("_rest", common.column(text_col).alias("_given")).withColumn("_text", F.coalesce("_given", F.lit("")))
    rows = rows.withColumn("_words", F.filter(F.split("_text", _SPACES), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(common.WORD_PATTERN)))
    rows = rows.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        without("!").cast("long").alias("n_exclamations"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    for step in repeated_words("_hashes"):
        rows = rows.withColumns(step)
    whole = rows.withColumnRenamed("_given", text_col) if text_col not in names else rows
    return whole.select(*(c for c, name in zip(common.unpacked(docs.columns, [text_col]), docs.columns, strict=True) if name not in names), *names)


def judge(rules: tuple[Rule, ...] = RULES) -> Column:
    """True if no rule of the table fails; over the columns of metrics()."""
    verdict = F.lit(True)
    for r in rules:
        ratio = F.col(r.numerator) / F.when(F.col(r.denominator) > 0, F.col(r.denominator))
        verdict &= F.coalesce((F.col("n_words") < r.words) | ratio.between(r.low, r.high), F.lit(True))
    return verdict


def apply(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics of every row with base_failed (under 20 words, or over 30 % of them in repeated windows) and kept.

    Null, empty and white-space texts have no words and fail the base. Equal rows get equal verdicts, an empty table gives no rows.
    """
    rows = metrics(docs).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & judge(rules))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality metrics and verdicts of all documents."""
    rows = apply(common.documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_capitals", "n_exclamations")
