"""Regular-expression matches as arrays of spans with code-point offsets, inside the JVM.

Patterns are written once, for a linear-time engine with ASCII word boundaries. Here they are
turned into java.util.regex: boundaries become ASCII look-arounds, and patterns whose backtracking
could run away have a possessive form of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validators import let

_WORD = "[0-9A-Za-z_]"
#: `\b` before a word character, after one, and in general.
LEFT, RIGHT = rf"(?<!{_WORD})", rf"(?!{_WORD})"
EITHER = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

SPAN = "struct<entity_type:string,start:int,end:int,score:double,recognizer:string,pattern:string,original_score:double,context_boost:double,ord:bigint>"
SPANS = f"array<{SPAN}>"


@dataclass(frozen=True)
class Pattern:
    """A named expression with a confidence score.

    regex uses `\\b`; java overrides its translation; gate is a cheap necessary condition on the text.
    """

    name: str
    regex: str
    score: float
    java: str | None = None
    gate: Callable[[Column], Column] | None = field(default=None, compare=False)

    def for_java(self) -> str:
        return self.java or translate(self.regex)


def translate(regex: str) -> str:
    """Replace every `\\b` by look-arounds; at the start of a pattern, branch or group it precedes a word character."""
    out, i = [], 0
    while i < len(regex):
        if regex.startswith(r"\b", i):
            at_start = i == 0 or regex[i - 1] in "(|"
            out.append(LEFT if at_start else RIGHT)
            i += 2
        elif regex[i] == "\\":
            out.append(regex[i : i + 2])
            i += 2
        else:
            out.append(regex[i])
            i += 1
    return "".join(out)


def empty_spans() -> Column:
    return F.array().cast(SPANS)


def make_span(entity: Column, start: Column, end: Column, score: Column, recognizer: Column, pattern: Column, original: Column, boost: Column, order: Column) -> Column:
    return F.struct(
        entity.cast("string").alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"),
        recognizer.cast("string").alias("recognizer"), pattern.cast("string").alias("pattern"), original.cast("double").alias("original_score"), boost.cast("double").alias("context_boost"), order.cast("long").alias("ord"),
    )


#: Around a match in a marked text; the first character alone is escaped before.
_EDGE, _ESCAPE = "\x01\x02", "\x01\x03"
#: Numbers that are added up at once.
_RUN = 256


def running(numbers: Column) -> Column:
    """For each number the sum of those before it. Runs are added up apart, so that no long array is copied for each of its elements."""

    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(values, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")))

    def joined(runs: Column) -> Column:
        firsts = sums(F.transform(runs, lambda r: r["at"]))["before"]
        return F.flatten(F.zip_with(runs, firsts, lambda r, first: F.transform(r["before"], lambda x: x + first)))

    count = F.floor((F.size(numbers) + _RUN - 1) / _RUN).cast("int")
    runs = F.transform(F.sequence(F.lit(0), count - 1), lambda i: sums(F.slice(numbers, i * _RUN + 1, F.lit(_RUN))))
    return F.when(F.size(numbers) <= _RUN, sums(numbers)["before"]).otherwise(let(runs, joined))


@dataclass(frozen=True)
class Search:
    """A pattern to look for; order numbers it, and its matches follow in it. only: for which rows."""

    pattern: Pattern
    entity: str
    recognizer: str
    order: int
    validate: Callable[[Column], Column] | None = None
    only: Column | None = None


def matches(text: Column, searches: Sequence[Search], with_digits: Sequence[Search] = ()) -> Column:
    """All leftmost, non-overlapping matches of each pattern as spans. with_digits: patterns whose matches all hold a digit.

    For each pattern a text is tried for a first match, and if there is one searched once for all: matches are marked and
    the marked text is split. What is made of the parts is spelt once for all patterns; offsets are sums over the
    lengths of the parts. A null or empty text gives an empty array.
    """
    escaped = text.contains(_EDGE[0])
    safe = F.when(escaped, F.replace(text, F.lit(_EDGE[0]), F.lit(_ESCAPE))).otherwise(text)
    every = [*searches, *with_digits]
    rules = list(dict.fromkeys(x.validate for x in every if x.validate is not None))
    about = [{"e": x.entity, "r": x.recognizer, "p": x.pattern.name, "s": x.pattern.score, "o": x.order * 1_000_000, "v": rules.index(x.validate) if x.validate else -1} for x in every]
    table = F.from_json(F.lit(json.dumps(about)), "array<struct<e:string,r:string,p:string,s:double,o:bigint,v:int>>")

    def parts(x: Search) -> Column:
        """Gaps at even places, matches at odd ones; null without any."""
        java = x.pattern.for_java()
        there = text.rlike(java)
        if x.pattern.gate:
            there = x.pattern.gate(text) & there
        if x.only is not None:
            there = x.only & there
        return F.when(there, F.split(F.regexp_replace(safe, java, f"{_EDGE}$0{_EDGE}"), _EDGE, -1))

    def verdict(hit: Column, rule: Column) -> Column:
        out = F.lit(None).cast("boolean")
        for i, f in enumerate(rules):
            out = F.when(rule == i, f(hit)).otherwise(out)
        return out

    def spans(found: Column, about: Column) -> Column:
        placed = F.arrays_zip(found.alias("hit"), running(F.transform(found, F.length)).alias("start"))
        judged = F.transform(F.filter(placed, lambda x, i: i % 2 == 1), lambda x: F.struct(x["hit"].alias("hit"), x["start"].alias("start"), verdict(x["hit"], about["v"]).alias("valid")))
        return F.transform(F.filter(judged, lambda x: F.coalesce(x["valid"], F.lit(True))), lambda x, i: span(x, i, about))

    def span(x: Column, i: Column, about: Column) -> Column:
        score = F.when(x["valid"], 1.0).otherwise(about["s"])
        return make_span(about["e"], x["start"], x["start"] + F.length(x["hit"]), score, about["r"], about["p"], about["s"], F.lit(0.0), about["o"] + i)

    plain = lambda found: F.when(escaped, F.transform(found, lambda x: F.replace(x, F.lit(_ESCAPE), F.lit(_EDGE[0])))).otherwise(found)
    found = F.array(*map(parts, searches)).cast("array<array<string>>")
    if with_digits:
        found = F.concat(found, F.when(text.rlike("[0-9]"), F.array(*map(parts, with_digits))).otherwise(F.array().cast("array<array<string>>")))
    numbered = F.filter(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda x: x["x"].isNotNull())
    build = lambda x: let(F.get(table, x["i"]), lambda about: let(plain(x["x"]), lambda found: spans(found, about)))
    return F.when(text.isNull(), empty_spans()).otherwise(F.flatten(F.transform(numbered, build)))


def span_text(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])
