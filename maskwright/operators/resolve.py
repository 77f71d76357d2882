"""Duplicates and conflicts among spans, within one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ordered(spans: Column, *keys) -> Column:
    """Spans sorted by keys, each a function of a span."""
    keyed = F.transform(spans, lambda s: F.struct(*(k(s).alias(f"k{i}") for i, k in enumerate(keys)), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def by_place(spans: Column) -> Column:
    """By start; at one start the longer first, then the surer, then the earlier recognizer."""
    return _ordered(spans, lambda s: s["start"], lambda s: -s["end"], lambda s: -s["score"], lambda s: s["ord"])


def drop_contained(spans: Column) -> Column:
    """Without spans that lie within a better span of their own type; better is surer, then longer, then earlier.

    Containment is transitive, so it is enough to look for any better span that contains one.
    """

    def better(a: Column, b: Column) -> Column:
        length = lambda s: s["end"] - s["start"]
        return (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((length(a) > length(b)) | ((length(a) == length(b)) & (a["ord"] < b["ord"]))))

    inside = lambda a, b: (a["entity_type"] == b["entity_type"]) & (a["start"] <= b["start"]) & (b["end"] <= a["end"])
    return F.when(F.size(spans) < 2, spans).otherwise(F.filter(spans, lambda c: ~F.exists(spans, lambda k: inside(k, c) & better(k, c))))


def without_conflicts(spans: Column) -> Column:
    """Greedily the best of overlapping spans, of whatever type: surer, then longer, then further left; by place."""
    ranked = _ordered(spans, lambda s: -s["score"], lambda s: s["start"] - s["end"], lambda s: s["start"], lambda s: s["ord"])
    none = F.slice(spans, 1, 0)
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    kept = F.aggregate(ranked, none, lambda acc, c: F.when(F.exists(acc, lambda k: overlap(c, k)), acc).otherwise(F.concat(acc, F.array(c))))
    return _ordered(F.when(F.size(spans) < 2, spans).otherwise(kept), lambda s: s["start"], lambda s: s["end"])
