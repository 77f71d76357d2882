"""Shared plumbing of the training-data operators: tables, durable cuts, splitting of hot keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one.

    Only where it is unset and all runs on one machine, as in tests, a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_before.get() if set_before.isDefined() else ""
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, and what is
    read later is what was written once, whatever executors are lost in between."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/maskwright-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._maskwright_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what durable() wrote, once nothing reads it any more."""
    path = getattr(df, "_maskwright_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def keyed(*cols: F.Column, seed: int = 0) -> F.Column:
    return F.xxhash64(*cols, F.lit(seed))


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def slices(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows whose lengths add up to at most limit, or one row each beyond it."""
    a = total = 0
    for i, n in enumerate(lengths):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)
