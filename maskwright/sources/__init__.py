"""Readers of texts and of test corpora, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPECTED = "array<struct<entity_type:string,start:int,end:int,min_score:double>>"
DETECTION = f"id string, source string, language string, text string, expected {EXPECTED}, forbid array<string>"
GOLDEN = "id string, language string, text string, entities array<string>, expected_text string"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a malformed one is an error."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_detection_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, DETECTION)


def read_golden_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, GOLDEN)


def read_texts(spark: SparkSession, path: str, kind: str = "parquet", text: str = "text", **options: str) -> DataFrame:
    """Any source that Spark reads, with its text column checked."""
    df = spark.read.format(kind).options(**options).load(path)
    if text not in df.columns:
        raise ValueError(f"{path} has no column {text}")
    return df


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, if its files make fewer partitions than there are: few files, or one row group.

    Detection is work on each row, so a scan on one core would hold up the rest. Large tables have partitions
    enough and come back as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def from_strings(spark: SparkSession, texts: list[str | None], language: str = "en") -> DataFrame:
    return spark.createDataFrame([(i, x, language) for i, x in enumerate(texts)], "id long, text string, lang string")


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    out = df.write.format(kind).mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)
