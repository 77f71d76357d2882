"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates lie in vertical layout: one contiguous row for each dimension. For a block of queries the
partial scores grow dimension block by dimension block; after each, a candidate whose partial score
plus the most that the remaining dimensions can add (the product of both sides' remaining norms)
falls below the query's k-th best so far is dropped, and the survivors are compacted.

Queries are dealt into blocks and candidates into chunks, both by hash and of bounded size. Each block
meets each chunk in one task, where the block's queries come first and the chunk's rows stream past
them; only k rows for each query and task leave it. Nothing goes through the driver but counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, schema, shuffle_partitions, table

#: Queries of a block and candidates of a chunk, about; candidates that are scored at once; dimensions of a step.
QUERY_BLOCK, CHUNK, CANDIDATE_BLOCK, DIMENSION_BLOCK = 4096, 131_072, 4096, 8
#: Sums below this are exact in double precision.
_EXACT = 2.0**52
_LEAST, _MOST = -(2**63), 2**63 - 1


def _matrix(values: pa.Array, width: int | None = None) -> np.ndarray:
    lengths = np.asarray(values.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width or 0, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width))
    if len(flat):
        rows = np.repeat(np.arange(len(lengths)), lengths)
        places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, places] = flat
    return out


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _whole(row: np.ndarray, scale: float) -> list[int]:
    """floor(scale * x) of each component, of any size."""
    return [math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * int(scale) if scale == int(scale) else math.floor(x * scale) for x in row.tolist()]


def exact_scores(query: np.ndarray, rows: np.ndarray, scale: float) -> np.ndarray:
    """Inner products in whole numbers without bounds; those beyond 64 bits become the nearest that has them."""
    own = [(i, x) for i, x in enumerate(_whole(query, scale)) if x]
    out = []
    for row in rows:
        other = _whole(row, scale)
        out.append(min(_MOST, max(_LEAST, sum(x * other[i] for i, x in own if i < len(other)))))
    return np.array(out, np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(ids))
    # ~ reverses the order of whole numbers, the least one included.
    return near[np.lexsort((ids[near], ~scores[near]))[:k]]


def scan_block(query: np.ndarray, ids: np.ndarray, columns: np.ndarray, tail: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the candidates that may score at least bound.

    columns: dimensions x candidates; tail: by dimension block, each candidate's norm from there on.
    """
    left = np.sqrt(np.append(np.cumsum((query**2)[::-1])[::-1], 0.0))
    partial, alive = np.zeros(columns.shape[1]), None
    for block, start in enumerate(range(0, len(query), DIMENSION_BLOCK)):
        end = min(start + DIMENSION_BLOCK, len(query))
        part = columns[start:end] if alive is None else columns[start:end, alive]
        partial = partial + query[start:end] @ part
        if np.isfinite(bound) and end < len(query):
            rest = tail[block + 1] if alive is None else tail[block + 1, alive]
            keep = partial + left[end] * rest * (1 + 1e-9) >= bound - 1e-6
            if keep.sum() < 0.7 * len(keep):
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                partial = partial[keep]
                if not len(partial):
                    break
    return (ids if alive is None else ids[alive]), partial


class _Block:
    """The queries of one block and their best candidates so far."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, scale: float):
        self.keys, self.ids, self.raw, self.k, self.scale = keys, ids, vectors, k, scale
        self.reach = np.abs(vectors).max(initial=0.0, axis=1)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def scan(self, ids: np.ndarray, raw: np.ndarray) -> None:
        """Candidates whose sums could be inexact in double precision are scored in whole numbers, the others by bounds."""
        width = max(raw.shape[1], self.raw.shape[1])
        raw, queries = _wide(raw, width), _wide(self.raw, width)
        size = np.abs(raw).max(initial=0.0, axis=1)
        unit = (abs(self.scale) + 1) ** 2 * max(width, 1)
        tame = (size + 1) * unit < _EXACT
        columns = np.ascontiguousarray(np.floor(raw[tame] * self.scale).T)
        squares = np.cumsum((columns**2)[::-1], axis=0)[::-1]
        tail = np.sqrt(squares[::DIMENSION_BLOCK])
        most = size[tame].max(initial=0.0)
        for i in range(len(self.ids)):
            if (most + 1) * (self.reach[i] + 1) * unit < _EXACT:
                bound = float(self.best[i][1][-1]) if len(self.best[i][0]) == self.k else -np.inf
                found, scores = scan_block(np.floor(queries[i] * self.scale), ids[tame], columns, tail, bound)
                self._keep(i, found, scores.astype(np.int64))
                rest = ~tame
            else:
                rest = np.ones(len(ids), bool)
            if rest.any():
                self._keep(i, ids[rest], exact_scores(queries[i], raw[rest], self.scale))

    def _keep(self, i: int, found: np.ndarray, scores: np.ndarray) -> None:
        other = found != self.ids[i]
        ids, values = np.concatenate([self.best[i][0], found[other]]), np.concatenate([self.best[i][1], scores[other]])
        at = _best(ids, values, self.k)
        self.best[i] = ids[at], values[at]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(x[0]) for x in self.best]
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.keys, sizes)), pa.array(np.repeat(self.ids, sizes)), pa.array(np.concatenate(none + [x[0] for x in self.best])), pa.array(np.concatenate(none + [x[1] for x in self.best]))],
            names=["q", "query_id", "vec_id", "score"],
        )


def _search(k: int, scale: float):
    """Rows (block, chunk, role, q, vec_id, v) in order: in each (block, chunk) the queries, role 0, come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, block = None, [], None
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            cuts = [0, *(np.flatnonzero((np.diff(where) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if place != (here := tuple(where[:2, a].tolist())):
                    if block is not None:
                        yield block.rows()
                    place, held, block = here, [], None
                for start in range(a, b, CANDIDATE_BLOCK):
                    part = batch.slice(start, min(b - start, CANDIDATE_BLOCK))
                    ids, vectors = part.column(4).to_numpy().astype(np.int64), _matrix(part.column(5))
                    if where[2, a] == 0:
                        held.append((part.column(3).to_numpy().astype(np.int64), ids, vectors))
                        continue
                    if block is None:
                        if not held:
                            continue
                        width = max(x[2].shape[1] for x in held)
                        block = _Block(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([_wide(x[2], width) for x in held]), k, scale)
                    block.scan(ids, vectors)
        if block is not None:
            yield block.rows()

    return run


def usable(df: DataFrame, vector: str = "embedding") -> F.Column:
    """Vectors that are there and hold only finite numbers."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def top_k(df: DataFrame, k: int = 10, scale: float = 1024.0, every: int = 100, id_col: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The k highest integer inner products for each row whose id is divisible by every.

    Components become floor(scale * x). Rows with a null id, and vectors that are null or hold null,
    NaN or infinite components, take no part; vectors of unequal length compare as if the missing
    components were 0; of an empty vector all scores are 0. Scores are exact whatever the size of the
    components; one beyond 64 bits counts as the nearest number that has them. Ties go to the smaller id;
    rows that repeat an id are candidates each of their own. Fewer candidates than k give fewer rows; an
    empty table gives none. Further columns are ignored.
    """
    spark = df.sparkSession
    kept = df.where(usable(df, vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    queries = durable(kept.where(F.col("vec_id") % every == 0).distinct().withColumn("q", F.xxhash64("vec_id", "v")))
    rows = kept.count()
    blocks, chunks = 1 + queries.count() // query_block, max(1 + rows // chunk, min(shuffle_partitions(spark), 1 + rows // CANDIDATE_BLOCK))
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    asked = queries.select(dealt(blocks, "q", F.lit(3)).alias("block"), across(chunks).alias("chunk"), F.lit(0).alias("role"), "q", "vec_id", "v")
    # By their places, so that equal rows spread too.
    given = kept.withColumn("n", F.monotonically_increasing_id()).select(across(blocks).alias("block"), dealt(chunks, "vec_id", "n").alias("chunk"), F.lit(1).alias("role"), F.lit(0).cast("long").alias("q"), "vec_id", "v")
    rows = asked.union(given).repartition(min(blocks * chunks, 16 * shuffle_partitions(spark) + blocks), "block", "chunk").sortWithinPartitions("block", "chunk", "role")
    found = rows.mapInArrow(_search(k, scale), schema("q long, query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
