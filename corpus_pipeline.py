"""A corpus pipeline of five stages: toxicity, language ID, n-gram Jaccard join, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, jaccard, language, mixing, packing, tokens, toxicity

#: Texts that are `und`, or of which no language has at least this share of letters, are rejected.
LEAST_SHARE = 0.5
BLOCK = 256


_OWN = ("doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that are predicted to be toxic; labels of documents that aren't held out are learned from.

    Null and empty texts have no toxic passage and stay; so do all documents if no label of 1 is known. Long texts are scored whole, in slices. Equal rows
    share a verdict and repeated ids are judged by their own texts; an empty table stays empty; other columns pass unchanged, whatever their names.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = toxicity.score(common.packed(docs, _OWN), model, keep=("doc_id", "text", "_rest"))
    return rows.where("predicted = 0").select(*common.unpacked(docs.columns, _OWN))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language, or so mixed that no language has half of the letters.

    Null texts and texts without letters have none and go. If no row has a lang to learn from, nothing has a language. Long texts are labelled whole.
    Equal rows share a verdict; an empty table stays empty; other columns pass unchanged, whatever their names.
    """
    rows = language.identify(common.packed(docs, _OWN), language.learn(docs), keep=("doc_id", "text", "_rest"))
    rows = rows.where((F.col("lang_pred") != language.UNDECIDED) & (F.col("score") >= LEAST_SHARE))
    return rows.select(*common.unpacked(docs.columns, _OWN))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8 or more): that of least doc_id.

    Rows are told apart by a number of their own, so those with null ids have copies too, and those that share an id but not a text stay. Null and
    empty texts have no copies and stay; an empty table stays empty; other columns pass unchanged.
    """
    rows = common.numbered(docs, "rows")
    classes = common.stored(jaccard.join(rows.select(F.col(common.ROW).alias("doc_id"), "text"), k=5, similarity=80), "classes")
    members = classes.select(F.col("doc_id").alias(common.ROW), "component_id").join(rows.select(common.ROW, "doc_id"), common.ROW)
    least = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", common.ROW)).alias("least"))
    kept = common.stored(least.select(f"least.{common.ROW}"), "kept")
    return common.kept(rows, kept).select(*map(common.column, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to their target weights; a row for each part of a document that a slot of the mix takes.

    Null, empty and white-space texts have no words to take and give no row; a long text is taken in parts. Rows that share an id, or have none, are
    mixed as rows of their own; null sources are one source; an empty table stays empty; other columns pass unchanged but n_chars, which is the part's.
    """
    rows = common.numbered(docs, "rows")
    _, spans = mixing.mix(rows, block=BLOCK)
    return mixing.mixed_texts(rows, spans)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into sequences of at most 1024 tokens: doc_id, piece, start, length, ids, sequence_id, offset.

    Parts of one document are packed as texts of their own; a null or empty text is its end id alone; an empty table gives no sequence.
    """
    return packing.pack(docs, tokens.default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models, a pseudorandom mix and a byte-pair vocabulary have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
