"""Detection and rewriting of streams. Both work row by row, so they need no state and no watermark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.analyze import Analyzer
from ..operators.anonymize import Operator, anonymize


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    stream = spark.readStream.format(kind).schema(schema)
    return (stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else stream).load(path)


def anonymize_stream(stream: DataFrame, analyzer: Analyzer, operators: Mapping[str, Operator] | None = None, text: str = "text", language=None, min_score: float = 0.4) -> DataFrame:
    return anonymize(analyzer.analyze(stream, text, language, min_score=min_score), operators, text)


def write_stream(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet", once: bool = True) -> StreamingQuery:
    """Append to files; once handles what is there and ends."""
    out = stream.writeStream.format(kind).outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start(path)
