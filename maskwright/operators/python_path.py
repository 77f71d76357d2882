"""Recognizers and operators that are Python functions.

They run in Arrow batches, apart from the expressions that everything else is made of, and are there for what
no expression can say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import SPANS, empty_spans
from .anonymize import ITEM
from .resolve import without_conflicts

_RESULT = f"struct<text:string,items:array<{ITEM}>>"
#: (start, end, score) in code points.
Found = Iterable[tuple[int, int, float]]


@dataclass(frozen=True)
class FunctionRecognizer:
    """Finds one entity type by a function of a text; an error in it fails the query."""

    name: str
    entity: str
    language: str
    function: Callable[[str], Found]
    context: tuple[str, ...] = ()

    @property
    def entities(self) -> tuple[str, ...]:
        return (self.entity,)

    def detect(self, text: Column, order: int = 0, artifacts: Column | None = None) -> Column:
        name, entity, function, first = self.name, self.entity, self.function, order * 100_000_000

        @F.pandas_udf(SPANS)
        def found(texts: pd.Series) -> pd.Series:
            row = lambda i, s: {"entity_type": entity, "start": s[0], "end": s[1], "score": float(s[2]), "recognizer": name, "pattern": name, "original_score": float(s[2]), "context_boost": 0.0, "ord": first + i}
            return texts.map(lambda x: [row(i, s) for i, s in enumerate(function(x))] if x else [])

        return F.coalesce(found(text), empty_spans())


def register_table_function(spark: SparkSession, name: str, recognizers: Sequence[FunctionRecognizer]) -> None:
    """Make function recognizers callable in SQL: SELECT ... FROM t, LATERAL name(text, language).

    A row for each match: entity_type, start, end, score, recognizer, value. A recognizer takes part if it is of the
    language asked for; null and empty texts, a null language, and languages without recognizers give no rows.
    """
    known = [(x.name, x.entity, x.language, x.function) for x in recognizers]

    class Detect:
        def eval(self, text: str, language: str):
            for recognizer, entity, code, function in known if text else ():
                if code == language:
                    for start, end, score in function(text):
                        yield entity, start, end, float(score), recognizer, text[start:end]

    spark.udtf.register(name, F.udtf(Detect, returnType="entity_type string, start int, end int, score double, recognizer string, value string"))


def anonymize_with(df: DataFrame, functions: Mapping[str, Callable[[str], str]], text: str = "text", spans: str = "spans", to: str = "anonymized") -> DataFrame:
    """Like anonymize, with Python functions by entity type, or DEFAULT; each item's operator is the function's name.

    A type without a function becomes its name in angle brackets. Null texts stay null.
    """
    known = dict(functions)

    def rewrite(value: str | None, kept: Iterable[Mapping]) -> dict:
        if value is None:
            return {"text": None, "items": []}
        out, items, at, length = [], [], 0, 0
        for s in kept if kept is not None else []:
            if not 0 <= s["start"] <= s["end"] <= len(value):
                raise ValueError("span out of range")
            function = known.get(s["entity_type"], known.get("DEFAULT"))
            new = function(value[s["start"] : s["end"]]) if function else f"<{s['entity_type']}>"
            before = value[at : s["start"]]
            start = length + len(before)
            length, at = start + len(new), s["end"]
            out += [before, new]
            items.append({"entity_type": s["entity_type"], "start": start, "end": length, "operator": function.__name__ if function else "replace"})
        return {"text": "".join([*out, value[at:]]), "items": items}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in (text, "__kept"))
            made = pa.array([rewrite(x, k) for x, k in zip(texts, kept, strict=True)], arrow)
            columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, made], names=[*names, to])

    names = [x for x in df.columns if x != to]
    item = pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("operator", pa.string())])
    arrow = pa.struct([("text", pa.string()), ("items", pa.list_(item))])
    schema = df.select(*names).withColumn(to, F.lit(None).cast(_RESULT)).schema
    return df.withColumn("__kept", without_conflicts(F.col(spans))).mapInArrow(run, schema)
