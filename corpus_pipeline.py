"""The corpus pipeline: quality, boilerplate lines, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import ftrl, linedup, minhash, packing, surrogates
from maskwright.llm.common import durable, release, table

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has it."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; it learns from the labelled rows of documents."""
    weights = ftrl.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ftrl.score(docs.select(*_COLUMNS), weights, to="__score").where(F.col("__score") >= ftrl.THRESHOLD).select(*_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that stand on many sites; every document stays."""
    return _documents(linedup.clean(docs.select(*_COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id."""
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    once = docs.select(*_COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return _documents(minhash.one_of_each_id(once))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates."""
    return _documents(surrogates.pseudonymize(docs.select(*_COLUMNS), surrogates.session_key(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: The first stage's model and the last stage's tokenizer are out of reach of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
