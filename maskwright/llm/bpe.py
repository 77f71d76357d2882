"""Byte-level BPE by corpus-level merge replay.

A block of texts is split by the vocabulary's pattern and reduced to its distinct pieces. All of them
lie end to end in one array of symbols; an inverted index leads from each adjacent pair to its
places. The merges then run once over the whole block in rank order: each takes its pair's places
from the index, joins them, and enters only the new pairs with their touched neighbours. Pieces that an
earlier block of the same worker has already encoded are looked up instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import schema, slices, table

#: Characters of text that are encoded together, and pieces that a worker remembers.
BLOCK_CHARS, REMEMBERED = 4_000_000, 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes by a table of ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        self.known: dict[str, bytes] = {}

    def _rank(self, pair: int) -> int:
        """The id that a pair of ids merges into, -1 if none."""
        found = self.pairs.get(pair)
        if found is None:
            found = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
            self.pairs[pair] = found
        return found

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian 32-bit values, by one replay of the merges over all."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        size = int(ends[-1]) if len(pieces) else 0
        symbol = np.full(size + 1, -1, np.int64)
        symbol[:size] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.arange(1, size + 2, dtype=np.int64)
        before = np.arange(-1, size, dtype=np.int64)
        first = np.zeros(size + 1, bool)
        first[np.concatenate([[0], ends])] = True
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[tuple[int, int]] = []

        def enter(left: np.ndarray) -> None:
            """Put the pairs that begin at these places into the index."""
            if not len(left):
                return
            pair = (symbol[left] << 32) | symbol[after[left]]
            order = np.argsort(pair, kind="stable")
            pair, left = pair[order], left[order]
            cuts = np.flatnonzero(np.diff(pair)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pair)], strict=True):
                key = int(pair[a])
                rank = self._rank(key)
                if rank >= 0:
                    if key in index:
                        index[key].append(left[a:b])
                    else:
                        index[key] = [left[a:b]]
                        heapq.heappush(waiting, (rank, key))

        places = np.arange(size)
        enter(places[~first[1 : size + 1]])
        while waiting:
            rank, key = heapq.heappop(waiting)
            found = index.pop(key)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b = key >> 32, key & 0xFFFFFFFF
            at = at[symbol[at] == a]
            nxt = after[at]
            keep = (symbol[nxt] == b) & ~first[nxt]
            at, nxt = at[keep], nxt[keep]
            if a == b and len(at) > 1:  # of overlapping places every other one from the left
                joined = np.concatenate([[False], nxt[:-1] == at[1:]])
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at, nxt = at[run % 2 == 0], nxt[run % 2 == 0]
            if not len(at):
                continue
            symbol[at] = rank
            symbol[nxt] = -1
            beyond = after[nxt]
            after[at] = beyond
            before[beyond] = at
            left = before[at[~first[at]]]
            right = at[~first[beyond]]
            enter(np.unique(np.concatenate([left, right])))
        alive = symbol[:size] >= 0
        ids = symbol[:size][alive].astype("<u4").tobytes()
        bounds = np.concatenate([[0], np.cumsum(alive)[ends - 1]]) * 4 if len(pieces) else [0]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] if len(pieces) else []

    def _learn(self, pieces: set[str]) -> None:
        new = [x for x in pieces if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        self.known.update(zip(new, self.replay([x.encode() for x in new]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit values."""
        out: list[bytes] = []
        for a, b in slices([len(x) for x in texts], BLOCK_CHARS):
            split = [self.pattern.findall(x) for x in texts[a:b]]
            new: set[str] = set()
            for pieces in split:
                new.update(pieces)
            self._learn(new)
            known = self.known
            out += [b"".join([known[x] for x in pieces]) for pieces in split]
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[x] for x in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[int, tuple[object, Codec]] = {}


def worker_codec(shared) -> Codec:
    """The codec that this Python worker has made of a broadcast (pattern, ranks)."""
    value = shared.value
    if id(value) not in _codecs:
        _codecs.clear()
        _codecs[id(value)] = value, Codec(value[1], value[0])
    return _codecs[id(value)][1]


def _digests(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared)
        names = np.array([str(x).encode() for x in range(max(codec.tokens) + 1)], object)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts, ids_sha, text_sha = [], [], []
            for a, b in slices([len(x) for x in texts], BLOCK_CHARS):
                for ids in codec.encode(texts[a:b]):
                    numbers = np.frombuffer(ids, "<u4")
                    counts.append(len(numbers))
                    ids_sha.append(hashlib.sha256(b" ".join(names[numbers].tolist())).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _arrays(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices([len(x) for x in texts], BLOCK_CHARS):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def share(spark: SparkSession, path: str, pattern: str):
    """The vocabulary as a broadcast: its size is the file's, whatever the corpus."""
    return spark.sparkContext.broadcast((pattern, load_ranks(path)))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's token ids: columns doc_id, ids array<int>.

    A null text counts as empty; an empty text has no ids. Rows, repeated or not, are encoded each on
    their own, and further columns are not looked at.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_arrays(share(df.sparkSession, path, pattern)), schema("doc_id long, ids array<int>"))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """Add the text that an array of token ids stands for; null ids give null."""
    shared = share(df.sparkSession, path, pattern)

    @F.pandas_udf("string")
    def spelled(column: pd.Series) -> pd.Series:
        codec = worker_codec(shared)
        return column.map(lambda x: None if x is None else codec.decode(np.asarray(x, "<u4").tobytes()).decode("utf-8", "replace"))

    return df.withColumn(to, spelled(F.col(ids)))


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode the ids again: counts and SHA-256 digests of both, a row for each document."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_digests(share(df.sparkSession, path, pattern)), schema("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
