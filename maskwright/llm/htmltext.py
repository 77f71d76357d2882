"""Main text of web pages by maximum-scoring subsequence.

A page becomes a row of items: tags, which score below zero, and runs of words, which score above zero
for each word; the weights are log odds counted on labelled pages. One linear scan finds the contiguous
run of items with the highest sum. Of that region the text is kept, without what stands in elements
that are never part of an article (menus, forms, scripts, hidden ones) or that hold few words and are
named as adverts, comments and their like: their words score nothing, so they neither draw the region
in nor cut it in two.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import schema, table

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>]|[\"'](?=[^\"']*>))*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {x: re.compile(rf"</{x}\s*[^>]*(?:>|\Z)", re.IGNORECASE) for x in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "object", "svg", "canvas", "audio", "video", "map", "label", "fieldset"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in a class, id or role that hint at an element that is no part of an article.
_NOISE = set(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs topbar header masthead footer sidebar sidebars aside widget widgets "
    "related recommended recommendations teaser share sharing social cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "subscribe subscription newsletter signup login register search searchbox form comment comments commentlist respond reply replies disqus discussion "
    "pagination pager toolbar skip hidden disclaimer copyright complementary contentinfo search navigation paywall".split()
)
_PIECE = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_KEPT_CLASSES = {"html", "body", "main", "article"}
#: What follows one of these in a class or id says nothing about the element itself.
_MODIFIERS = {"has", "with", "without", "no", "not"}
#: Elements whose ids name what they say.
_ANCHORED = {"p", "section"}
#: Elements of running text. Within articles, a class of theirs that has other words too, as in social-history, says what the text is about.
_TEXTS = {"p", "figure", "figcaption", "blockquote", "q", "pre", "td", "li", "dd"}
#: A hint alone masks at most this many words, or, beside articles, fewer than they have.
FEW_WORDS = 25

# Open elements that a tag closes, and those beyond which it does not look for them.
_ROWS = {"tr", "td", "th"}
_PARTS = {"thead", "tbody", "tfoot", "caption", "colgroup"}
_CELL_END, _ITEM_END = {"table"}, (_NEVER | _PARTS | _ROWS | _HEADINGS | {"article", "blockquote", "body", "center", "dd", "details", "dl", "dt", "figure", "header", "html", "li", "main", "ol", "section", "table", "ul"})
_P_END = {"html", "table", "td", "th", "caption", "object", "button"}
_CLOSES: dict[str, tuple[set[str], set[str]]] = dict.fromkeys(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split(), ({"p"}, _P_END)
) | {"dd": ({"p"}, _P_END), "dt": ({"p"}, _P_END)}
_CLOSES_FIRST: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, _ITEM_END - {"li"}), "dd": ({"dd", "dt"}, _ITEM_END - {"dd", "dt"}), "dt": ({"dd", "dt"}, _ITEM_END - {"dd", "dt"}),
    "td": ({"td", "th"}, _CELL_END), "th": ({"td", "th"}, _CELL_END), "tr": (_ROWS | {"caption", "colgroup"}, _CELL_END), **dict.fromkeys(_PARTS, (_ROWS | _PARTS, _CELL_END)),
    "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}


def _hinted(name: str, value: str, inside_article: bool) -> bool:
    if name in _HEADINGS:
        return False
    for word in value.split():
        found = set()
        for piece in (x.lower() for x in _PIECE.split(word) if x):
            if piece in _MODIFIERS:
                break
            found.add(piece)
        if inside_article and name in _TEXTS and found - _NOISE:
            continue
        found &= _NOISE
        if found and not (inside_article and found == {"header"}):
            return True
    return False


def _noisy(name: str, attributes: str, inside_article: bool) -> tuple[bool, set[str]]:
    """Whether an element is never part of an article; which of its class, id and role hint at that by a word."""
    hinted: set[str] = set()
    if name in _NEVER or name == "header" and not inside_article:
        return True, hinted
    if not attributes or name in _KEPT_CLASSES:
        return False, hinted
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            if _hinted(name, value, inside_article):
                hinted.add(key)
        elif key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
            return True, hinted
    return "hidden" in attributes.lower().split(), hinted


class _Element:
    __slots__ = ("name", "parent", "masked", "hinted", "inside", "holds", "own", "words")

    def __init__(self, name: str, parent: _Element | None, masked: bool, hinted: set[str]):
        self.name, self.parent, self.masked, self.hinted = name, parent, masked, hinted
        #: Whether it stands in an article, or in a main part without one; whether it holds an article or main part.
        self.inside = self.holds = False
        self.own = self.words = 0

    def is_article(self) -> bool:
        return self.name == "article" or self.name == "main" and not self.holds

    def hint_counts(self) -> bool:
        return bool(self.hinted - {"id"} if self.inside and self.name in _ANCHORED else self.hinted)


def _settle(elements: list[_Element]) -> None:
    """Turn hints into masks where the element holds no article and few words, and hand masks down.

    elements: parents before children. Inner elements are settled before the outer ones that count their
    words; elements beside articles after all articles.
    """
    nested = [e for e in elements if e.parent is not None]
    for e in nested:
        e.masked = e.masked or e.parent.masked
    for e in reversed(nested):
        e.parent.holds |= e.holds or e.name in ("article", "main") and not e.masked
    for e in nested:
        e.inside = e.parent.inside or e.parent.is_article()
    beside = 0
    for last in (False, True):
        for e in elements:
            e.words = 0 if e.masked else e.own
        for e in reversed(elements):
            if not e.masked and not e.holds and (e.inside or last) and (e.words <= FEW_WORDS or not e.inside and e.words < beside) and e.hint_counts():
                e.masked, e.words = True, 0
            if e.parent is not None:
                e.parent.words += e.words
        beside = sum(e.words for e in elements if e.is_article() and not e.inside)
    for e in nested:
        e.masked = e.masked or e.parent.masked


def items(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, separates): kind is a tag's name, "word", "link", "beside" or "masked"; separates if a block ends there.

    Where articles hold at least half of the words, those outside of them, but for a title, are beside.
    """
    row: list[tuple[str, str, bool, _Element | None]] = []
    elements: list[_Element] = []
    stack: list[_Element] = []
    # Places in the stack of open elements, by name.
    places: defaultdict[str, list[int]] = defaultdict(list)
    masked = links = place = 0
    n = len(page)

    def pop() -> None:
        nonlocal masked
        last = stack.pop()
        places[last.name].pop()
        masked -= last.masked

    def close(names: set[str], bounds: set[str]) -> None:
        bound = max((places[x][-1] for x in bounds if places[x]), default=-1)
        to = min((places[x][bisect_right(places[x], bound)] for x in names if places[x] and places[x][-1] > bound), default=len(stack))
        while len(stack) > to:
            pop()

    while place <= n:
        m = _MARKUP.search(page, place)
        start = m.start() if m else n
        top = stack[-1] if stack else None
        if start > place:
            text = page[place:start]
            headed = places["header"] and not any(places[x] for x in _HEADINGS)
            kind = "masked" if masked or headed else "link" if links else "word"
            row.append((kind, text, False, top))
            if top and kind == "word":
                top.own += len(text.split())
        if not m:
            break
        place = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in _RAW:
            if not closing and not m[0].endswith("/>"):
                end = _RAW_END[name].search(page, place)
                place = end.end() if end else n
            row.append((name, "", True, top))
            continue
        separates = name not in _INLINE
        if name == "a":
            links = 0 if closing else 1
        if not closing:
            for closes in (_CLOSES_FIRST, _CLOSES):
                if name in closes:
                    close(*closes[name])
            top = stack[-1] if stack else None
        if name in _VOID or not closing and name in _INLINE and "=" not in m[3]:
            row.append((name if not closing else "/" + name, "", separates, top))
            continue
        if not closing:
            bad, hinted = _noisy(name, m[3], bool(places["article"] or places["main"]))
            if name in _INLINE and not bad and not hinted:
                row.append((name, "", separates, top))
                continue
            top = _Element(name, top, bad, hinted)
            row.append((name, "", separates, top))
            elements.append(top)
            places[name].append(len(stack))
            stack.append(top)
            masked += bad
            continue
        row.append(("/" + name, "", separates, top))
        if places[name]:
            to = places[name][-1]
            while len(stack) > to:
                pop()
        if place >= n:
            break
    _settle(elements)
    within = sum(e.words for e in elements if e.is_article() and not e.inside)
    mostly = within > 0 and 2 * within >= sum(e.words for e in elements if e.parent is None)
    for kind, text, separates, element in row:
        if element and element.masked:
            kind = "masked"
        elif mostly and kind in ("word", "link") and not (element and (element.inside or element.is_article() or element.name == "h1")):
            kind = "beside"
        yield kind, text, separates


#: Kinds of text, which count by words, and those of them that are given out.
_COUNTED, _GIVEN = ("word", "link", "beside", "masked"), ("word", "link", "beside")


def _kinds(page: str) -> Iterator[tuple[str, int]]:
    for kind, text, _ in items(page):
        if kind in _COUNTED:
            yield kind, len(text.split())
        else:
            yield kind, 1


def labelled_pages() -> list[tuple[str, str, str]]:
    """(before, article, after): small pages in common layouts, with the part that is the article marked."""
    words = "the river ran slowly past old mills while people in town spoke of rain and of harvests to come".split()
    say = lambda n, k: " ".join(words[(i * 7 + k) % len(words)] for i in range(n))
    out = []
    for k in range(24):
        menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words[: 4 + k % 6])
        blocks = []
        for i in range(3 + k % 7):
            text = say(30 + 11 * ((i + k) % 5), i)
            if (i + k) % 3 == 1:
                text += f' <a href="/{words[i]}">{say(2, i)}</a> {say(9, k)}'
            form = (i + 2 * k) % 8
            if form == 5:
                blocks.append(f"<h2>{say(4, i)}</h2><ul>" + "".join(f"<li>{say(7, j)}</li>" for j in range(4)) + "</ul>")
            elif form == 6:
                blocks.append(f"<div><blockquote>{text}</blockquote></div><div>{say(12, k)}</div>")
            elif form == 7:
                blocks.append(f"<table><tr><td>{say(3, i)}</td><td>{say(6, k)}</td></tr></table>")
            else:
                blocks.append(f"<p>{text}" + ("</p>" if (i + k) % 4 else "<br>"))
        body = "".join(blocks)
        heading = f"<h1>{say(8, k)}</h1>"
        links = "".join(f'<div><a href="/{w}">{w}</a> | </div>' for w in words[: 3 + k % 9])
        if k % 3 == 0:
            out.append((f"<html><head><title>{say(6, k)}</title></head><body><nav><ul>{menu}</ul></nav><div>{say(9, k)}</div><article>", heading + body, f"</article><section><p>{say(14, k)}</p></section><footer>{say(5, k)}</footer></body></html>"))
        elif k % 3 == 1:
            out.append((f"<html><body><div>{links}</div><main><div>", heading + body, f"</div></main><div>{links}</div><div>{say(4, k)}</div></body></html>"))
        else:
            out.append((f"<html><body><table><tr><td>{links}</td><td>", heading + f"<div>{body}</div>", f"</td><td><ul>{menu}</ul></td></tr></table><hr>{say(3, k)}</body></html>"))
    return out


def learn(pages: list[tuple[str, str, str]]) -> dict[str, float]:
    """Log odds of each kind of item inside and outside the marked part: words above zero, tags below."""
    inside, outside = Counter(), Counter()
    for before, article, after in pages:
        whole, own = Counter(), Counter()
        for kind, n in _kinds(before + article + after):
            whole[kind] += n
        for kind, n in _kinds(article):
            own[kind] += n
        inside.update(own)
        outside.update({k: max(0, whole[k] - own[k]) for k in whole})
    kinds = inside.keys() | outside.keys()
    total_in, total_out = sum(inside.values()) + len(kinds), sum(outside.values()) + len(kinds)
    out = {}
    for kind in kinds:
        odds = math.log((inside[kind] + 1) / total_in) - math.log((outside[kind] + 1) / total_out)
        out[kind] = max(0.25, odds) if kind == "word" else min(-0.05, odds)
    out["masked"] = 0.0
    out["link"] = max(-0.5, out.get("link", -0.5)) if out.get("link", -0.5) < 0 else 0.0
    out[""] = -0.25
    for edge in ("article", "/article", "main", "/main"):
        out[edge] = min(out.get(edge, 0.0), -3.0)
    return out


WEIGHTS = learn(labelled_pages())


def best_run(scores: Iterable[float]) -> tuple[int, int]:
    """[a, b): the contiguous run of the largest sum, in one scan; the one that ends first among equals, empty if none is above zero."""
    best, found = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The page's article, white space made single, blocks joined by one space; empty if it has none."""
    row = list(items(page or ""))
    other = weights[""]
    first, last = best_run(weights[kind] * len(text.split()) if kind in _COUNTED else weights.get(kind, other) for kind, text, _ in row)
    # A block belongs to the article as a whole: a sentence that ends with a link does not lose it.
    while first < last < len(row) and not row[last][2] and not row[last - 1][2]:
        last += 1
    while 0 < first < last and not row[first][2] and not row[first - 1][2]:
        first -= 1
    parts: list[str] = []
    for kind, text, separates in row[first:last]:
        if kind in _GIVEN:
            parts.append(text)
        elif separates:
            parts.append(" ")
    return " ".join(html.unescape("".join(parts)).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(df: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Columns page_id, url, text, n_chars, a row for each row of df.

    Null and empty pages, and pages of markup alone, give an empty text; null ids and urls stay null;
    rows that repeat are each extracted; a page cut off anywhere is read as far as it goes. A link of
    several words within the article belongs to it. Further columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return rows.mapInArrow(_extract, schema("page_id long, url string, text string, n_chars long"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
