"""Comparison of spans with expected ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analyze import Analyzer
from .anonymize import anonymize


def detection_failures(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, failure, entity_type): expected spans that are missing or too unsure, and forbidden types that were found.

    found: id, entity_type, start, end, score; corpus: id, expected array, forbid array.
    """
    wanted = corpus.select("id", F.explode("expected").alias("e")).select("id", "e.*")
    missing = wanted.alias("w").join(found.alias("f"), (F.col("w.id") == F.col("f.id")) & (F.col("w.entity_type") == F.col("f.entity_type")) & (F.col("w.start") == F.col("f.start")) & (F.col("w.end") == F.col("f.end")) & (F.col("f.score") >= F.col("w.min_score")), "left_anti")
    banned = corpus.select("id", F.explode("forbid").alias("entity_type")).join(found, ["id", "entity_type"], "left_semi")
    return missing.select("id", F.lit("missing").alias("failure"), "entity_type").union(banned.select("id", F.lit("forbidden").alias("failure"), "entity_type"))


def golden_failures(corpus: DataFrame, analyzer: Analyzer, min_score: float = 0.4) -> DataFrame:
    """(id, text, expected_text) of the corpus rows that default operators rewrite to something else.

    corpus: id, language, text, expected_text.
    """
    done = anonymize(analyzer.analyze(corpus, language=F.col("language"), min_score=min_score))
    return done.where(~F.col("anonymized.text").eqNullSafe(F.col("expected_text"))).select("id", F.col("anonymized.text").alias("text"), "expected_text")


def agreement(ours: DataFrame, theirs: DataFrame, min_score: float = 0.4, without: Sequence[str] = ()) -> DataFrame:
    """One row: spans that both have, spans that either has, and their ratio. Columns: id, entity_type, start, end, score."""
    keys = ["id", "entity_type", "start", "end"]
    of = lambda df: df.where((F.col("score") >= min_score) & ~F.col("entity_type").isin(*without) if without else F.col("score") >= min_score).select(*keys).distinct()
    both = of(ours).withColumn("a", F.lit(1)).join(of(theirs).withColumn("b", F.lit(1)), keys, "full_outer")
    counted = both.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("agreed"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.col("agreed") / F.col("total")))
