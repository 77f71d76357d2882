"""Detection over a DataFrame of texts.

Every step is an expression on one row, so a plan has no shuffle and runs as well on a stream. Which
recognizers take part is settled when the plan is made, from the registry, the language and the entities.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import SPANS, empty_spans, matches
from .context import Enhancer
from .registry import Registry
from .resolve import by_place, drop_contained


@dataclass
class Analyzer:
    """registry is required; an enhancer of None switches the context boost off; engine adds an artifacts column."""

    registry: Registry
    enhancer: Enhancer | None = field(default_factory=Enhancer)
    default_language: str = "en"
    engine: object | None = None

    def __post_init__(self) -> None:
        if self.registry is None:
            raise ValueError("an analyzer needs a registry")
        if self.engine is not None and hasattr(self.engine, "load"):
            self.engine.load()

    def _can_pass(self, recognizer, min_score: float) -> bool:
        """Whether any span of a recognizer can reach min_score: what cannot need not be looked for."""
        if not hasattr(recognizer, "patterns") or recognizer.validate is not None or recognizer.validators:
            return True
        boosted = self.enhancer is not None and bool(recognizer.context)
        best = max(p.score for p in recognizer.patterns)
        return (min(1.0, max(self.enhancer.floor, best + self.enhancer.factor)) if boosted else best) >= min_score

    def raw(self, text: Column, language: Column | str, entities: Sequence[str] = (), min_score: float = 0.0, artifacts: Column | None = None) -> Column:
        """All matches, numbered in the registry's order. A language column picks each recognizer's rows."""
        languages = [language] if isinstance(language, str) else self.registry.languages()
        chosen = [x for code in languages for x in self.registry.get(code, entities) if min_score <= 0 or self._can_pass(x, min_score)]
        groups: dict[tuple, list[tuple[int, object]]] = {}
        for order, x in enumerate(chosen):
            key = (x.name, x.entities, getattr(x, "patterns", None), getattr(x, "labels", None))
            groups.setdefault(key, []).append((order, x))
        parts, searches, with_digits = [], [], []
        for same in groups.values():
            order, x = same[0]
            only = None if isinstance(language, str) else language.isin(*[y.language for _, y in same])
            if hasattr(x, "searches"):
                (with_digits if x.digits else searches).extend(x.searches(order, only))
            else:
                found = x.detect(text, order, artifacts)
                parts.append(found if only is None else F.when(only, found).otherwise(empty_spans()))
        if searches or with_digits:
            parts.insert(0, matches(text, searches, with_digits))
        if not parts:
            return empty_spans()
        spans = parts[0] if len(parts) == 1 else F.concat(*parts)
        if entities:
            spans = F.filter(spans, lambda s: s["entity_type"].isin(*entities))
        return F.when(text.isNull() | (text == ""), empty_spans()).otherwise(spans)

    def analyze(self, df: DataFrame, text: str = "text", language: str | Column | None = None, entities: Sequence[str] = (), min_score: float = 0.0, to: str = "spans") -> DataFrame:
        """df with an array of spans: boosted, without contained duplicates, at least min_score, by place.

        language is a code or a column of codes; texts in a language without recognizers, null and empty texts get
        no spans.
        """
        code = language if language is not None else self.default_language
        artifacts = None
        if self.engine is not None:
            df = self.engine.process(df, text)
            artifacts = F.col("artifacts")
        source = F.col(text)
        df = df.withColumn("__raw", self.raw(source, code, entities, min_score, artifacts))
        spans = F.col("__raw")
        if self.enhancer is not None:
            languages = [code] if isinstance(code, str) else self.registry.languages()
            spans = self.enhancer.enhance(source, spans, [x for c in languages for x in self.registry.get(c, entities)])
        df = df.withColumn("__spans", F.when(F.size("__raw") == 0, F.col("__raw")).otherwise(spans))
        spans = drop_contained(F.col("__spans"))
        if min_score > 0:
            # Containment and threshold commute, so the threshold goes first and leaves less to compare.
            df = df.withColumn("__spans", F.filter("__spans", lambda s: s["score"] >= min_score))
        drop = ["__raw", "__spans", *["artifacts"] * (self.engine is not None)]
        return df.withColumn(to, by_place(spans).cast(SPANS)).drop(*drop)


def span_rows(df: DataFrame, spans: Column | str = "spans", keep: Sequence[str] = ()) -> DataFrame:
    """The columns to keep, and s, for each span.

    An outer explode with a filter behind it: a plain one would have its own filter on the array pushed down
    through every projection, and all of the detection done again there.
    """
    return df.select(*keep, F.explode_outer(spans).alias("s")).where(F.col("s").isNotNull())


def explode_spans(df: DataFrame, text: str = "text", spans: str = "spans", keep: Sequence[str] = ()) -> DataFrame:
    """One row for each span, with the text it covers."""
    rows = span_rows(df.withColumn("__text", F.col(text)), spans, [*keep, "__text"])
    return rows.select(*keep, "s.*", F.substring("__text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))
