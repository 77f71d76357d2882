"""Removal of lines that spread over many sites.

Each line's hash gathers a HyperLogLog sketch of the sites it stands on, merged by aggregation, so a
line on a third of all pages costs one sketch for each task. Lines whose estimate lies within the
sketch's error of the threshold get an exact count of distinct sites. Boilerplate lines then go from every
document but the first that holds them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: A line on at least this many sites is boilerplate; log2 of a sketch's registers.
MIN_SITES, LG_REGISTERS = 10, 12
_LAST = 9223372036854775807


def _line_hash(line: F.Column) -> F.Column:
    return F.xxhash64(line)


def _lines(docs: DataFrame) -> DataFrame:
    line = docs.select("id", "t", "site", F.explode(F.split("text", "\n", -1)).alias("line"))
    return line.where(F.trim("line") != "").select("id", "t", "site", _line_hash(F.col("line")).alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, first): hashes of lines on at least min_sites sites, with the smallest id that holds them."""
    lines = _lines(docs)
    error = 4 * 1.04 / 2 ** (LG_REGISTERS / 2)
    sketches = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)).alias("sites"), F.min("id").alias("first"))
    spread = sketches.select("h", "first", F.hll_sketch_estimate("sites").alias("n")).where(F.col("n") >= min_sites * (1 - error) - 1)
    spread = durable(spread)
    sure = spread.where(F.col("n") > min_sites * (1 + error) + 1)
    near = spread.where(F.col("n") <= min_sites * (1 + error) + 1).select("h", "first")
    counted = lines.where(F.col("site").isNotNull()).join(near, "h").groupBy("h", "first", "site").agg(F.lit(1).alias("one")).groupBy("h", "first").agg(F.count(F.lit(1)).alias("n"))
    return sure.select("h", "first").union(counted.where(F.col("n") >= min_sites).select("h", "first"))


def clean(df: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """df (doc_id, text, source, ...) with its own columns, text cleaned, and n_lines and n_removed beside them.

    Lines end at newline characters and compare whole; blank lines are never boilerplate. A row without
    a site counts for none. A null text stays null with no lines; a text that loses all lines becomes
    empty. The document with the smallest id (null is the largest) keeps its copies of a line; rows that
    repeat that id keep theirs too. An empty table gives no rows. Columns named like helpers here stay untouched.
    """
    whole = F.struct(*(df[x] for x in df.columns)).alias("row")
    rows = df.select(whole, F.coalesce(df["doc_id"].cast("long"), F.lit(_LAST)).alias("id"))
    # Rows of one id, or without any, may be very many: each text of theirs has its own set of lines that go.
    rows = rows.withColumn("t", F.xxhash64("row.text"))
    docs = rows.select("id", "t", F.col("row")[site].cast("string").alias("site"), F.col("row.text").alias("text"))
    found = durable(boilerplate(docs, min_sites))
    gone = _lines(docs).select("id", "t", "h").join(found, "h").where("id > first").groupBy("id", "t").agg(F.collect_set("h").alias("gone"))
    out = rows.join(gone, ["id", "t"], "left").withColumn("lines", F.split("row.text", "\n", -1))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("gone", _line_hash(x)) | (F.trim(x) == "")))
    out = out.withColumn("kept", kept)
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    count = lambda x: F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(x).cast("long")
    names = [x for x in df.columns if x not in ("n_lines", "n_removed")]
    return out.select(*(text.alias(x) if x == "text" else F.col("row")[x].alias(x) for x in names), count(F.size("lines")).alias("n_lines"), count(F.size("lines") - F.size("kept")).alias("n_removed"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_removed")


OP8_SQL = """
WITH l AS (
  SELECT doc_id, source, line, i FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), b AS (
  SELECT line, min(doc_id) AS first FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), k AS (
  SELECT l.doc_id, l.line, l.i, coalesce(l.doc_id > b.first, false) AS gone FROM l LEFT JOIN b ON l.line = b.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines,
  CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed
FROM k GROUP BY doc_id
"""
