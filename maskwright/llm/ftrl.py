"""Quality scores by hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

A text becomes tokens: runs of letters, marks and digits, and runs of other visible characters. A token that
repeats the one before counts as one shared "again" token, and a word all in capitals adds a shared
"capitals" token. Unigrams and bigrams are hashed into a fixed number of slots, weighted by their share of
the text, and scored as one sparse dot product. Many texts are hashed at once, as arrays of code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import schema, slices, table
from .hashing import mix

BITS = 18
#: At most this many labelled rows, the ones with the smallest hashed ids, are learnt from, so many times.
TRAINING_ROWS, PASSES = 12_000, 6
THRESHOLD = 0.3
#: Characters of text that are hashed together.
BLOCK_CHARS = 1 << 19
_AGAIN, _CAPITALS, _BIGRAM = 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9E3779B97F4A7C15
_BASE = 0x9E3779B97F4A7C15
_SPACE, _WORD, _MARK = 0, 1, 2
_tables: dict[str, np.ndarray] = {}


def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its kind, its lower case as a hash, and its case: 1 upper, 2 lower or title."""
    if "kind" not in _tables:
        kind, lower, case = np.full(0x110000, _MARK, np.uint8), np.arange(0x110000, dtype=np.uint64), np.zeros(0x110000, np.uint8)
        # No letter, mark, number or space lies outside these.
        for i in (*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200)):
            c = chr(i)
            if c.isspace():
                kind[i] = _SPACE
            elif unicodedata.category(c)[0] in "LMN":
                kind[i] = _WORD
                case[i] = 1 if c.isupper() else 2 if c.islower() or c.istitle() else 0
                if case[i] == 1 and len(c.lower()) == 1:
                    lower[i] = ord(c.lower())
        _tables.update(kind=kind, lower=mix(lower + np.uint64(0x5DEECE66D)), case=case)
    return _tables["kind"], _tables["lower"], _tables["case"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(max(n, BLOCK_CHARS), base, np.uint64)
            row[0] = 1
            _tables[name] = np.cumprod(row)
    return _tables["up"], _tables["down"]


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of all unigrams and bigrams of texts, with repetitions, in no order."""
    kinds, lower, cases = _characters()
    texts = [x or "" for x in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[points]
    first = np.flatnonzero((kind != _SPACE) & (kind != np.concatenate([[_SPACE], kind[:-1]])))
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.searchsorted(np.cumsum(sizes), first, "right")
    up, down = _powers(len(points))
    known = mix(np.add.reduceat(np.where(kind == _SPACE, np.uint64(0), lower[points]) * up[: len(points)], first) * down[first])
    case = cases[points]
    length = np.add.reduceat((kind != _SPACE).astype(np.int64), first)
    capitals = (length > 1) & np.logical_or.reduceat(case == 1, first) & ~np.logical_or.reduceat(case == 2, first)
    beside = owner[1:] == owner[:-1]
    again = np.concatenate([[False], beside & (known[1:] == known[:-1])])
    known[again] = np.uint64(_AGAIN)
    pairs = (mix(known[:-1]) + known[1:] * np.uint64(_BIGRAM))[beside]
    found = np.concatenate([known, np.full(int(capitals.sum()), _CAPITALS, np.uint64), pairs])
    return np.concatenate([owner, owner[capitals], owner[1:][beside]]), (mix(found) >> np.uint64(64 - bits)).astype(np.int64)


def vectors(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value) in order, each slot once: a text's values have Euclidean length 1; one without tokens has none."""
    owner, slots = features(texts, bits)
    keys, counts = np.unique(owner << bits | slots, return_counts=True)
    owner = keys >> bits
    total = np.bincount(owner, counts, len(texts))
    return owner, keys & ((1 << bits) - 1), np.sqrt(counts / total[owner])


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; slot 0 of bias is a feature that is always 1."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.001):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        at, x = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(slots: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """Weights learnt from sparse rows in a fixed shuffled order; the last is the bias. Without rows, all are 0."""
    model, rng = Ftrl(bits), np.random.Generator(np.random.PCG64(seed))
    for _ in range(PASSES):
        for i in rng.permutation(len(labels)):
            model.update(slots[i], values[i], labels[i])
    return model.weights().astype(np.float32)


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text."""
    bits, out = int(len(weights) - 1).bit_length() - 1, []
    for a, b in slices([len(x or "") + 1 for x in texts], BLOCK_CHARS):
        owner, slots, values = vectors(texts[a:b], bits)
        out.append(np.bincount(owner, weights[slots] * values, b - a) + weights[-1])
    return 1.0 / (1.0 + np.exp(-np.clip(np.concatenate([np.zeros(0), *out]), -35, 35)))


def _vectors(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices([len(x or "") + 1 for x in texts], BLOCK_CHARS):
                owner, slots, values = vectors(texts[a:b], bits)
                cuts = pa.array(np.searchsorted(owner, np.arange(b - a + 1)), pa.int32())
                made = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (slots.astype(np.int32), values.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*made, batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], names=["slots", "x", "label", "place"])

    return run


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, bits: int = BITS) -> np.ndarray:
    """Train on at most rows labelled texts; without any, every text scores 0.5.

    Of a labelled id that several rows bear, the smallest text is learnt from. The chosen ids are broadcast:
    there are at most rows of them. Their vectors, not their texts, go to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("double").alias("label"))
    known = known.where(~held_out(F.col("id"))).withColumn("place", F.xxhash64("id", F.lit(11))).orderBy("place", "id").limit(rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(known), "id").groupBy("id", "label", "place").agg(F.min("text").alias("text")).select("text", "label", "place")
    made = chosen.mapInArrow(_vectors(bits), schema("slots array<int>, x array<float>, label double, place long")).toArrow().combine_chunks()
    if not made.num_rows:
        return np.zeros((1 << bits) + 1, np.float32)
    slots, values = made.column("slots").chunk(0), made.column("x").chunk(0)
    starts, slots, values = slots.offsets.to_numpy(), slots.values.to_numpy(), values.values.to_numpy()
    y = made.column("label").to_numpy()
    order = np.lexsort((np.diff(starts), y, made.column("place").to_numpy()))
    cut = lambda x: [x[starts[i] : starts[i + 1]] for i in order]
    return train(cut(slots), cut(values), y[order], bits)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", to: str = "score") -> DataFrame:
    """Add the probability of label 1; a null or empty text gets the bias's alone."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        return pd.Series(scores(column.tolist(), shared.value))

    return df.withColumn(to, scored(F.col(text)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns doc_id, held_out, score, predicted for each row of docs, repeated rows included.

    Labels that are null or belong to no document are ignored; of an id's several labels the
    highest holds; a document with a null id is scored and is not held out. Further columns are ignored.
    """
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
