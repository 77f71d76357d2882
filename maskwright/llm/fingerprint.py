"""Document fingerprints by a homomorphic multiset hash, as DataFrame functions.

A paragraph hashes to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors,
each component modulo a power of two. So the order of paragraphs is no matter, and a paragraph enters or
leaves a fingerprint by one addition or subtraction.

The vector has two parts. Four 64-bit components, hashed from the whole paragraph, decide equality. 128 narrow
components count the signs of hashed pairs of neighbouring words; since a paragraph's counts add up too,
this part is a sum of the same kind, and the distance of two sums estimates how many pairs two texts share.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

#: Narrow components, two to a 64-bit sum, and their modulus in a fingerprint; wide components, in halves.
LANES, LANE_BITS, WIDE = 128, 16, 4
_PAIR = 0x0000000100000001
_SUMS = LANES // 2


def _features(text: Column) -> Column:
    """Of each paragraph: itself, marked by a null partner, and its pairs of neighbouring words."""
    words = lambda p: F.split(p, " ", -1)
    pair = lambda p: F.transform(F.arrays_zip(words(p).alias("a"), F.slice(words(p), F.lit(2), F.size(words(p))).alias("b")), lambda x: F.struct(x["a"].alias("a"), F.coalesce(x["b"], F.lit("\n")).alias("b")))
    return F.transform(F.split(text, "\n", -1), lambda p: F.concat(F.array(F.struct(p.alias("a"), F.lit(None).cast("string").alias("b"))), pair(p)))


def _sums() -> list[Column]:
    """Aggregates over exploded features (a, b): sums of wide halves, of packed signs, and the number of pairs."""
    whole = F.col("b").isNull()
    wide = []
    for i in range(WIDE):
        value = F.xxhash64(F.lit(1000 + i), F.col("a"))
        wide += [F.sum(F.when(whole, value.bitwiseAND(F.lit(0xFFFFFFFF)))).alias(f"w{2 * i}"), F.sum(F.when(whole, F.shiftrightunsigned(value, 32))).alias(f"w{2 * i + 1}")]
    lanes = [F.sum(F.when(~whole, F.shiftrightunsigned(F.col(f"h{i // 32}"), i % 32).bitwiseAND(F.lit(_PAIR)))).alias(f"s{i}") for i in range(_SUMS)]
    return [*wide, *lanes, F.count(F.col("b")).alias("n")]


def _signed() -> Column:
    """The narrow components as plain differences: twice the ones less the number of pairs."""
    n = F.col("n")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    each = [c for i in range(_SUMS) for x in [F.coalesce(F.col(f"s{i}"), F.lit(0).cast("long"))] for c in (low(x) * 2 - n, F.shiftrightunsigned(x, 32) * 2 - n)]
    return F.array(*each)


def _text_of(wide: list[Column], lanes: Column) -> Column:
    """The fingerprint's spelling: every component in hexadecimal, modulo its power of two."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    high = F.concat(*(digits(F.pmod(F.coalesce(x, F.lit(0).cast("long")), F.lit(1 << 32)), 8) for x in wide))
    return F.concat(high, F.array_join(F.transform(lanes, lambda x: digits(F.pmod(x, F.lit(1 << LANE_BITS)), LANE_BITS // 4)), ""))


def lanes_of(fingerprint: Column) -> Column:
    """The narrow components that a fingerprint spells, as signed numbers."""
    size, half = LANE_BITS // 4, 1 << LANE_BITS - 1
    at = F.sequence(F.lit(0), F.lit(LANES - 1))
    value = lambda i: F.conv(F.substring(fingerprint, i * size + WIDE * 16 + 1, F.lit(size)), 16, 10).cast("long")
    return F.transform(at, lambda i: F.pmod(value(i) + half, F.lit(1 << LANE_BITS)) - half)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two arrays of narrow components: 1 less the distance's share of both lengths, squared."""
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double") * y)
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: x - y), F.lit(0.0), lambda s, y: s + y.cast("double") * y)
    total = square(a) + square(b)
    return F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart / total))


def fingerprints(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """For each row of df, told apart by keys, and each of texts (name -> column): {name} and {name}_lanes.

    A null text counts as empty. Rows that agree in keys count as one row. The rows' words are summed where they lie, so
    nothing but sums is shuffled, if anything is.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.coalesce(F.col(c), F.lit("")).alias("text")) for i, c in enumerate(texts.values()))))
    rows = df.select(*keys, each.alias("x")).select(*keys, "x.which", F.explode(_features(F.col("x.text"))).alias("p")).select(*keys, "which", F.explode("p").alias("f"))
    hashed = rows.select(*keys, "which", F.col("f.a").alias("a"), F.col("f.b").alias("b")).select("*", F.xxhash64(F.lit(1), "a", "b").alias("h0"), F.xxhash64(F.lit(2), "a", "b").alias("h1"))
    summed = hashed.groupBy(*keys, "which").agg(*_sums())
    spelt = summed.select(*keys, "which", _signed().alias("lanes"), *(f"w{i}" for i in range(2 * WIDE))).select(
        *keys, "which", "lanes", _text_of([F.col(f"w{i}") for i in range(2 * WIDE)], F.col("lanes")).alias("fp")
    )
    pick = [c for i, name in enumerate(texts) for c in (F.max(F.when(F.col("which") == i, F.col("fp"))).alias(name), F.max(F.when(F.col("which") == i, F.col("lanes"))).alias(f"{name}_lanes"))]
    return spelt.groupBy(*keys).agg(*pick)


def combine(a: Column, b: Column, subtract: bool = False) -> Column:
    """The fingerprint of the paragraphs of both, or of a's without b's: components added or subtracted."""
    sign = -1 if subtract else 1
    part = lambda x, i, n: F.conv(F.substring(x, i + 1, F.lit(n)), 16, 10).cast("long")
    digits = lambda x, n: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << 4 * n)))), n, "0")
    join = lambda start, n, count: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: digits(part(a, i * n + start, n) + sign * part(b, i * n + start, n), n)), "")
    return F.concat(join(0, 8, 2 * WIDE), join(WIDE * 16, LANE_BITS // 4, LANES))


def _constant(value: list, kind: str) -> Column:
    """A list as one literal: a plan does not grow with it."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _rank(x: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most x, by binary search."""
    if not cuts:
        return F.lit(0)
    table = _constant(cuts, "array<bigint>")

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        below = F.get(table, middle) <= x
        go = s["low"] < s["high"]
        return F.struct(F.when(go & below, middle + 1).otherwise(s["low"]).alias("low"), F.when(go & ~below, middle).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), halve, lambda s: s["low"])


class _Order:
    """Rows (doc_id, h, ...) in buckets by descending doc_id, nulls last, and ascending h, the text's hash.

    Ids are cut at their quantiles. An id that several quantiles fall on, and rows without an id, get that
    many buckets, cut by h; so no bucket is filled by one id, and no window spans the table.
    """

    def __init__(self, df: DataFrame, buckets: int):
        shares = [str(i / buckets) for i in range(1, buckets)] or ["0.5"]
        found = df.select(F.expr(f"approx_percentile(doc_id, array({', '.join(shares)}), 10000)"), F.count(F.lit(1)), F.count("doc_id")).collect()[0]
        weights = Counter(found[0] or [] if buckets > 1 else [])
        self.cuts, self.buckets, self.opens, self.equals = sorted(weights), 0, [], []
        for value in [*reversed(self.cuts), None]:
            self.opens.insert(0, self._take(1))
            parts = weights[value] if value is not None and weights[value] > 1 else 0
            self.equals.insert(0, {"id": value, "at": self._take(parts), "parts": parts})
        self.nulls = -(-buckets * (found[1] - found[2]) // found[1]) if found[1] else 0
        self.null_at = self._take(self.nulls)

    def _take(self, n: int) -> int:
        self.buckets += n
        return self.buckets - n

    def bucket(self) -> Column:
        share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
        part = lambda n: F.least(F.floor(share * n), n - 1)
        rank = _rank(F.col("doc_id"), self.cuts)
        same = F.get(_constant(self.equals, "array<struct<id:bigint,at:int,parts:int>>"), rank)
        known = F.when((F.col("doc_id") == same["id"]) & (same["parts"] > 0), same["at"] + part(same["parts"])).otherwise(F.get(_constant(self.opens, "array<int>"), rank))
        return F.when(F.col("doc_id").isNull(), F.lit(self.null_at) + part(F.lit(max(1, self.nulls)))).otherwise(known).cast("int")


def with_next(df: DataFrame, buckets: int) -> DataFrame:
    """df (doc_id, text) with bucket, place, ghost and next_text: the text of the row that follows by descending
    doc_id, of the first row for the last. Ties go by the text's hash, then the text; null ids come last.

    The first row of each bucket is also sent to the bucket before it, where it is a ghost that comes last; so
    one shuffle suffices.
    """
    df = df.select("doc_id", "text", F.xxhash64("text").alias("h"))
    order = _Order(df, buckets)
    rows = df.withColumn("bucket", order.bucket())
    tops = {r.bucket: r.top for r in rows.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("top")).collect()}
    there = sorted(tops)
    heads: list[dict | None] = [None] * order.buckets
    for i, b in enumerate(there):
        heads[b] = {"id": tops[b].doc_id, "h": ~tops[b].h, "to": there[i - 1]}
    mine = F.get(_constant(heads, "array<struct<id:bigint,h:bigint,to:int>>"), F.col("bucket"))
    ghosts = F.when(F.col("doc_id").eqNullSafe(mine["id"]) & (F.col("h") == mine["h"]), mine["to"])
    sent = F.filter(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("ghost")), F.struct(ghosts.alias("b"), F.lit(True).alias("ghost"))), lambda x: x["b"].isNotNull())
    rows = rows.select("doc_id", "text", "h", F.explode(sent).alias("x")).select("doc_id", "text", "h", F.col("x.b").alias("bucket"), "x.ghost")
    window = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h", F.col("text").asc_nulls_first())
    return rows.repartition(max(buckets, 1), "bucket").select("doc_id", "text", "bucket", "ghost", F.row_number().over(window).alias("place"), F.lead(F.struct("text")).over(window)["text"].alias("next_text"))


def compare(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text of df (doc_id, text, ...) and of its edited text, and their likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next document's. Null texts count as empty; two texts without any word pair are alike (1.0); rows
    that repeat each give a row; a single row is its own next; an empty table gives no rows. Further
    columns are ignored. Each text is hashed once as itself, though it is also some other one's next.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(docs, buckets or 4 * shuffle_partitions(df.sparkSession))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.when(F.col("ghost"), "").otherwise(F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited", edited).select("bucket", "place", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    found = fingerprints(rows, ["bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256"], {"fingerprint": "text", "edited_fingerprint": "edited"})
    found = found.withColumn("next_lanes", F.lead("fingerprint_lanes").over(Window.partitionBy("bucket").orderBy("place"))).where(~F.col("ghost"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint_lanes"), F.col("edited_fingerprint_lanes")).alias("near_edited"), likeness(F.col("fingerprint_lanes"), F.col("next_lanes")).alias("near_next"),
    )


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
