"""A training-data pipeline: stages over documents, each one an operator of arborel.llm.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents;
the last returns token figures.  Rows that share a doc_id count as one
document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborel.llm import decontam, langid, mergedrop, neardup, queries, substring
from arborel.llm.common import written
from arborel.shipping import ensure

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or unlike every known language go; a missing language is filled in."""
    found = langid.identify(docs, langid.fit(docs), carry=True).where(~F.col("rejected"))
    return found.select("whole.*", "text", "lang_pred").withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the least doc_id stays."""
    found = neardup.near_duplicates(docs, shingle=5, percent=80)
    gone = written(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all but the first document; a text that loses all its words goes."""
    found = substring.remove_repeats(docs, carry=True).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("original"))
    whole = found.select("whole.*", text.alias("text"), cut.alias("_cut"))
    return whole.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.where(~decontam.contaminated()).select("whole.*", "text").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token figures of each text, after decoding it again."""
    return mergedrop.round_trip(docs, queries.coder())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("tokens", tokens)]

#: The first stage is a trained model, so SQL can't express the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ensure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
