"""Near-duplicates by circulant MinHash: banding, then exact Jaccard confirmation on whole shingle sets.

All coordinates of a signature come from two permutations of the 32-bit numbers: the first scatters a
set's shingles, the second is shifted circularly by one place more for each coordinate. Texts of equal
sets form one class, and only one row of a class goes on. Band values make buckets:

1. In each bucket every class is checked against the bucket's smallest class, on the full sets. Work
   and rows stay linear in the bucket, and copies of one text, however many, meet in one component.
2. Buckets that still hold several components are finished: the members outside the bucket's
   largest component are indexed by shingle, in blocks, and all its members of a size that can be
   like theirs are streamed past them. What is dealt out are ids; sets join them in their blocks, which are
   bounded by the shingles in them. After this each pair that shares a bucket is confirmed, refuted,
   or already connected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, release, schema, shuffle_partitions, table
from .graph import components
from .hashing import mix, shingles

BANDS, ROWS = 32, 4
#: Shingles of one indexed block, and of the members streamed past it in one task.
INDEXED, STREAMED = 1 << 20, 1 << 21
_LANES = 1 << 12


def _permute(x: np.ndarray, a: int, b: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    for shift, factor in ((16, a), (15, b), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=out)
        if factor is not None:
            np.multiply(out, np.uint32(factor), out=out)
        x = out
    return out


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit hashes: size minima of one permutation, shifted each time."""
    base = (found >> np.uint64(32)).astype(np.uint32)
    base = _permute(base, 0x7FEB352D, 0x846CA68B, np.empty_like(base), np.empty_like(base))
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    step = max(1, _LANES // 8)
    for a in range(0, len(base), step):
        shifted = base[None, a : a + step] - shifts
        spare = np.empty_like(shifted)
        np.minimum(best, _permute(shifted, 0x21F0AAAD, 0x735A2D97, shifted, spare).min(axis=1), out=best)
    return best


def bands(found: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit value for each band of the signature; the band's number is part of it."""
    parts = signature(found, count * rows).reshape(count, rows).astype(np.uint64)
    out = mix(np.arange(count, dtype=np.uint64) + np.uint64(1))
    for j in range(rows):
        out = mix(out ^ parts[:, j])
    return out.astype(np.int64)


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sketch(words: int, count: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, values = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                keys.append(set_key(found) if len(found) else None)
                values.append(bands(found, count, rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "key", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x, words) for x in batch.column(1).to_pylist()]
            same = [set_key(x) == k for x, k in zip(found, batch.column(2).to_pylist(), strict=True)]
            nodes = [n for n, ok in zip(batch.column(0).to_pylist(), same, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([x.tobytes() for x, ok in zip(found, same, strict=True) if ok], pa.binary())], names=["node", "set"])

    return run


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def similar(a: int, b: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _against_first(percent: int):
    """Rows (a, salt, role, node, set) in order: sets of role 0 are a's own, the others are compared with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in batches:
            a, salt, role, node, sets = (batch.column(i) for i in range(5))
            left, right = [], []
            for x, s, r, n, raw in zip(a.to_pylist(), salt.to_pylist(), role.to_pylist(), node.to_pylist(), sets, strict=True):
                if (x, s) != group:
                    group, own = (x, s), []
                found = np.frombuffer(raw.as_buffer(), np.uint64)
                if r == 0:
                    own.append(found.copy())
                elif any(similar(len(y), len(found), common_count(y, found), percent) for y in own if 100 * min(len(y), len(found)) >= percent * max(len(y), len(found))):
                    left.append(x)
                    right.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _against_block(percent: int):
    """Rows (block, role, label, node, set) in order: sets of role 0 are indexed, the others streamed past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None
        for batch in batches:
            left, right = [], []
            for x, r, label, node, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if x != block:
                    block, held, index = x, [], None
                found = np.frombuffer(raw.as_buffer(), np.uint64)
                if r == 0:
                    held.append((label, node, found.copy()))
                    continue
                if not held:
                    continue
                if index is None:
                    sizes = np.array([len(y[2]) for y in held])
                    values, owners = np.concatenate([y[2] for y in held]), np.repeat(np.arange(len(held)), sizes)
                    order = np.argsort(values, kind="stable")
                    index = values[order], owners[order]
                low, high = np.searchsorted(index[0], found, "left"), np.searchsorted(index[0], found, "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(index[1][at], minlength=len(held))
                for i in np.flatnonzero(100 * shared >= percent * (sizes + len(found) - shared)).tolist():
                    if held[i][0] != label:
                        left.append(held[i][0])
                        right.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _first_links(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets are alike. A node of very many edges is dealt out over salts."""
    salts = 4 * shuffle_partitions(edges.sparkSession)
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    own = edges.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), "set"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("node"), "set")
    other = edges.join(sets.select(F.col("node").alias("b"), "set"), "b").select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node"), "set")
    rows = own.union(other).repartition(shuffle_partitions(edges.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(_against_first(percent), schema("a long, b long"))


def _last_links(members: DataFrame, labels: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, indexed: int = INDEXED, streamed: int = STREAMED) -> DataFrame | None:
    """Links between the components that still share a bucket, as pairs of labels.

    Sets whose sizes differ by more than percent cannot be alike. Sizes fall into classes by that ratio, so a
    set only meets those of its own class and the two next to it.
    """
    known = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    mixed = durable(known.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("most < all"))
    if mixed.isEmpty():
        return None
    step = max(math.log(100 / percent) * 1.001, 1e-6)
    rows = known.join(mixed.select("band", "main"), "band").join(sizes, "node")
    rows = durable(rows.select("band", "node", "label", (F.col("label") != F.col("main")).alias("rest"), "n", F.floor(F.log("n") / step).alias("size")))
    near = lambda: F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1))
    width = rows.where("rest").groupBy("band", "size").agg((F.lit(1) + F.floor(F.sum("n") / indexed)).cast("int").alias("width"))
    passing = durable(rows.select("band", "node", "label", "n", near().alias("size")).join(width, ["band", "size"]))
    depth = durable(passing.groupBy("band", "size").agg(F.first("width").alias("width"), (F.lit(1) + F.floor(F.sum("n") / streamed)).cast("int").alias("depth")))
    across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    held = rows.where("rest").join(depth, ["band", "size"]).select("band", "size", "node", "label", F.lit(0).alias("role"), dealt("width").alias("i"), across("depth").alias("j"))
    past = passing.drop("width").join(depth, ["band", "size"]).select("band", "size", "node", "label", F.lit(1).alias("role"), across("width").alias("i"), dealt("depth").alias("j"))
    placed = held.union(past).select(F.xxhash64("band", "size", "i", "j").alias("block"), "role", "label", "node")
    ready = placed.join(sets, "node").select("block", "role", "label", "node", "set").repartition(shuffle_partitions(members.sparkSession), "block").sortWithinPartitions("block", "role")
    return ready.mapInArrow(_against_block(percent), schema("a long, b long"))


def near_duplicates(df: DataFrame, percent: int = 80, words: int = 5, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Columns doc_id, n_shingles, component_id and kept, a row for each row of df (doc_id, text, ...).

    Two texts are linked if 100 * intersection >= percent * union over their sets of distinct word
    shingles (A-Z as a-z; words are runs of bytes other than space and 0x09-0x0D). component_id is the
    smallest id reachable, kept says that it is the row's own. Null, empty and blank texts have an
    empty set and are linked with nothing. Rows that repeat an id are one document: linked, and kept or
    not together. A row with a null id takes no part: component_id null, kept true. An empty table
    gives no rows. Further columns are ignored, whatever their names.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sketched = durable(docs.mapInArrow(_sketch(words, count, rows), schema("doc_id long, n_shingles long, key binary, bands array<long>")))
    usable = sketched.where("key is not null and doc_id is not null")
    classes = durable(usable.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    spread = classes.select("node", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("band", "lead")
    members = durable(spread.join(buckets, "band"))
    edges = durable(members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    wanted = classes.join(nodes, "node", "left_semi").select(F.col("node").alias("doc_id"), "key")
    sets = durable(docs.join(wanted, "doc_id").select("doc_id", "text", "key").mapInArrow(_sets(words), schema("node long, set binary")).dropDuplicates())
    of_row = sketched.select("doc_id", "n_shingles", "key").join(classes.select("key", "node"), "key", "left").select("doc_id", "n_shingles", "node")
    of_row = durable(of_row)
    many = of_row.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    same = of_row.join(many, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    labels = components(_first_links(edges, sets, percent).union(same))
    later = _last_links(members, labels, classes.select("node", "n"), sets, percent)
    if later is not None:
        joined = components(later).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = labels.union(members.select("node", F.col("node").alias("label")).distinct().join(labels, "node", "left_anti"))
        labels = labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    labels = durable(labels.distinct())
    for old in (sketched, classes, members, edges, sets):
        release(old)
    out = of_row.join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each_id(df: DataFrame) -> DataFrame:
    """df with one row for each doc_id, the one with the smallest text; rows with a null id all stay."""
    many = df.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__id"))
    if many.isEmpty():
        return df
    repeated = df.join(many, df["doc_id"] == F.col("__id"), "left_semi")
    first = repeated.groupBy("doc_id").agg(F.min(F.struct("text", *(x for x in df.columns if x not in ("doc_id", "text")))).alias("x")).select("doc_id", "x.*").select(*df.columns)
    return df.join(many, df["doc_id"] == F.col("__id"), "left_anti").union(first)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""
