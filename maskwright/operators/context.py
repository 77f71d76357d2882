"""Higher scores for spans that have a recognizer's context words before them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.matching import make_span
from ..functions.validators import let

_WORDS = r"[\p{L}\p{Nd}]+"
#: Characters next to a span that are searched first; more only if they hold too few words.
_NEAR = 256


@dataclass(frozen=True)
class Enhancer:
    """On a hit the score rises by factor, to floor at least and 1 at most; the boost noted is factor itself."""

    factor: float = 0.35
    floor: float = 0.4
    before: int = 5
    after: int = 0

    def window(self, text: Column, start: Column, end: Column) -> Column:
        """The words around a span, lower-cased, with single spaces."""
        words = lambda part: F.regexp_extract_all(part, F.lit(_WORDS), F.lit(0))
        parts = []
        if self.before:
            near = words(F.substring(text, F.greatest(F.lit(1), start - _NEAR + 1), F.least(start, F.lit(_NEAR))))
            whole = words(F.substring(text, F.lit(1), start))
            last = lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - self.before + 1), F.lit(self.before))
            parts.append(let(near, lambda x: F.when((F.size(x) > self.before) | (start <= _NEAR), last(x)).otherwise(let(whole, last))))
        if self.after:
            near = words(F.substring(text, end + 1, F.lit(_NEAR)))
            whole = words(F.substring(text, end + 1, F.length(text)))
            first = lambda x: F.slice(x, F.lit(1), F.lit(self.after))
            parts.append(let(near, lambda x: F.when(F.size(x) > self.after, first(x)).otherwise(let(whole, first))))
        if not parts:
            return F.lit("")
        return F.lower(F.array_join(F.concat(*parts) if len(parts) > 1 else parts[0], " "))

    def enhance(self, text: Column, spans: Column, recognizers: Iterable) -> Column:
        """Spans with raised scores; the words are matched anywhere in the window, parts of words included."""
        known = {x.name: [w.lower() for w in x.context if w] for x in recognizers if x.context}
        if not known:
            return spans
        table = F.create_map(*[y for name, words in known.items() for y in (F.lit(name), F.array(*[F.lit(w) for w in words]))])

        def raised(s: Column) -> Column:
            words = F.try_element_at(table, s["recognizer"])
            hit = let(self.window(text, s["start"], s["end"]), lambda w: F.exists(words, lambda x: F.instr(w, x) > 0))
            score = F.least(F.lit(1.0), F.greatest(F.lit(self.floor), s["score"] + self.factor))
            span = make_span(s["entity_type"], s["start"], s["end"], score, s["recognizer"], s["pattern"], s["original_score"], F.lit(self.factor), s["ord"])
            return F.when(words.isNotNull() & F.coalesce(hit, F.lit(False)), span).otherwise(s)

        return F.transform(spans, raised)
