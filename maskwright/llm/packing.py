"""Packing of token sequences by minimum bin slack.

A document's ids are cut at every multiple of the capacity; the rests, shorter than that, are what
there is to pack. Of them only the number of each length matters, a histogram no longer than the
capacity whatever the corpus. The search over it runs on the driver: the longest remaining piece opens
a window, a bitset subset-sum over the remaining lengths finds the total closest to the capacity, and
backtracking gives how many of each length make it up. That multiset is laid out as often as the
remaining counts allow. Pieces then find their window and offset by their rank among the pieces of
their length, so no piece travels further than one shuffle.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, schema, slices, table

BLOCK_CHARS = 4_000_000


def padding(total: int, capacity: int) -> int:
    """Tokens added to a sequence: up to capacity, none where the length is a power of two."""
    return 0 if total & (total - 1) == 0 else capacity - total


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each remaining length fill one window best; the longest length is always among them."""
    longest = max(counts)
    room = capacity - longest
    reach, states = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        step = 1
        while left > 0 and not reach >> room & 1:
            take = min(step, left)
            states.append((length, take, reach))
            reach |= (reach << take * length) & ((2 << room) - 1)
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    rest = min((x for x in range(room + 1) if reach >> x & 1), key=lambda x: (padding(longest + x, capacity), -x))
    used = Counter({longest: 1})
    for length, take, earlier in reversed(states):
        if not earlier >> rest & 1:
            used[length] += take
            rest -= take * length
    return dict(used)


def layout(counts: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """For each length, rows (first rank, pieces of it in a window, first window, first offset); and the number of windows."""
    left = {k: v for k, v in counts.items() if v > 0}
    taken: Counter = Counter()
    rows, windows = defaultdict(list), 0
    while left:
        used = best_fill(left, capacity)
        times = min(left[x] // n for x, n in used.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows[length].append((taken[length], n, windows, offset))
            taken[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        windows += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}, windows


def tokenizer_of(path: str, pattern: str) -> tuple[str, dict[bytes, int], dict[str, int]]:
    """Ranks of a byte-level tokenizer file, its vocabulary's ids following the order of its merges; and its added tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    merged = {a + b for a, b in (x.split(" ") if isinstance(x, str) else x for x in model["merges"])}
    added = {x["content"]: x["id"] for x in file.get("added_tokens") or []}
    return pattern, {bytes(byte_of[c] for c in token): rank for token, rank in model["vocab"].items() if token not in added and (len(token) == 1 or token in merged)}, added


def _cut(shared, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, ranks, added = shared.value
        encoding = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts, doc_ids = [x or "" for x in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for a, b in slices([len(x) for x in texts], BLOCK_CHARS):
                out: list[list] = [[] for _ in range(8)]
                for doc_id, text in zip(doc_ids[a:b], texts[a:b], strict=True):
                    ids = np.append(encoding.encode_to_numpy(text, allowed_special="all").astype("<u4"), np.array([end_id], "<u4"))
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        row = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, seen[len(piece)], piece.astype(np.int32) if with_ids else None)
                        seen[len(piece)] += 1
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:7]), pa.array(out[7], pa.list_(pa.int32()))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "ids"])

    return run


def _place(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                own = rows[int(length[at[0]])]
                first, n, base, start = own[np.searchsorted(own[:, 0], rank[at], side="right") - 1].T
                window[at] = base + (rank[at] - first) // n
                offset[at] = start + (rank[at] - first) % n * length[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(window), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(df: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each document's ids into pieces and lay the pieces out in windows of capacity tokens.

    A null text counts as empty and still has its end id, so each row gives at least one piece; rows
    that repeat are packed each on their own; a null id stays null. An empty table gives no pieces.
    Sequence ids run from 0 without gaps. with_ids adds the pieces' ids. Further columns are ignored.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_of(path, pattern))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = durable(rows.mapInArrow(_cut(shared, capacity, end_id, with_ids), schema("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long, ids array<int>")))
    by_part = pieces.groupBy("part", "length").count()
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    placed, _ = layout(counts, capacity)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kinds = {x.name: x.dataType.simpleString() for x in pieces.schema}
    ranked = pieces.join(first, ["part", "length"]).select(*names, (F.col("first") + F.col("nth")).alias("rank"))
    out = ", ".join(f"{x} {kinds[x]}" for x in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(spark.sparkContext.broadcast(placed), names), schema(out))


def pack_documents(df: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
