"""An ordered list of recognizers. Order matters: it settles ties between spans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from . import recognizers as R


class Registry:
    def __init__(self, recognizers: Iterable = ()):
        self._all = list(recognizers)

    def __iter__(self):
        return iter(self._all)

    def __len__(self) -> int:
        return len(self._all)

    def add(self, recognizer) -> Registry:
        """Append; several may have one name."""
        self._all.append(recognizer)
        return self

    def remove(self, name: str) -> Registry:
        """Take out all of that name, in every language."""
        self._all = [x for x in self._all if x.name != name]
        return self

    def get(self, language: str, entities: Sequence[str] = ()) -> list:
        """Those of a language that find any of entities; all of them if none are given."""
        return [x for x in self._all if x.language == language and (not entities or set(entities) & set(x.entities))]

    def supported_entities(self, language: str) -> list[str]:
        return list(dict.fromkeys(e for x in self.get(language) for e in x.entities))

    def languages(self) -> list[str]:
        return list(dict.fromkeys(x.language for x in self._all))


def default_registry(*languages: str, domains: Sequence[str] | None = None) -> Registry:
    """Generic recognizers for each language, with those of the United States for en and of France for fr."""
    out = Registry()
    for language in languages or ("en", "fr"):
        for x in R.generic(language, domains):
            out.add(x)
        for x in R.us() if language == "en" else R.fr() if language == "fr" else ():
            out.add(x)
    return out
