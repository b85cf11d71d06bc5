"""The training-data pipeline over documents: five stages, each one of the operators of vigilog.llm.

Every stage gets what its predecessor kept, written as Parquet and read again. A stage takes
(spark, docs, sf_dir) and returns the columns of documents; the last returns the token files' contents.

For all stages: NULLs in any column, empty and very long texts are handled as the operators say; an
empty table gives an empty table; other columns go through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.llm import decontaminate, jaccard, language, mixing, tokens
from vigilog.llm.common import WORD, Scratch, table

#: A document stays if its language's share is at least this, and it has letters at all.
LEAST_SCORE = 0.35
#: Near duplicates share this percentage of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _wrapped(docs: DataFrame, *more) -> DataFrame:
    """The whole row as ``doc``, beside the columns that a stage works with, so that no names clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *more)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages. Texts without letters, among them NULL ones, go, and
    texts that fit none of the languages. If no document has a label, nothing can be learned
    and documents with letters stay."""
    model = language.train(*language.training_sample(docs))
    if model is None:
        return docs.filter(F.regexp("text", F.lit(r"\p{L}")))
    told = language.identify(_wrapped(docs, "text"), model)
    return told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Rows that repeat doc_id and text stay once. Rows without doc_id, and documents without words, stay.
    """
    found = jaccard.join(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    stays = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = _wrapped(docs, "doc_id", F.xxhash64("text").alias("of_text")).join(stays, "doc_id", "left_semi")
    # The join has dealt the rows by doc_id; telling repeated rows apart moves nothing more.
    again = F.row_number().over(Window.partitionBy("doc_id", "of_text").orderBy("of_text"))
    kept = kept.withColumn("again", again).filter("again = 1").select("doc.*")
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item's question and answer. Texts without words stay."""
    found = decontaminate.search(_wrapped(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("leaked")).select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so up to three times; documents it does not take,
    and those without words, go. Rows alike in doc_id and size are taken equally often."""
    taken = mixing.mix(docs.select("doc_id", "text", "source"))
    taken = taken.filter("taken > 0").groupBy(F.col("doc_id").alias("id"), F.col("size").alias("words")).agg(
        F.ceil(F.sum("taken") / F.sum("size")).cast("int").alias("copies"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = _wrapped(docs, "doc_id", size.alias("size"))
    both = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("words")))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents, written to files and read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.digests(docs.select("doc_id", "text"))


STAGES = [
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", token_files),
]
#: A neural network, a similarity join and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
