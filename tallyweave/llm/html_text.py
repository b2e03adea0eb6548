"""Main text of web pages: the maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import arrow_map, texts_of

#: Pages that weights are learnt from, at most.
MAX_LABELLED = 2000
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|xmp|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]++|<)", re.S | re.I)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
# Fixed values of HTML: elements without end tag, elements that break a line, and elements or
# class words that never hold the article's own text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav "
    "ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_ASIDE = frozenset(
    "nav header footer aside form menu dialog button select iframe noscript template svg object "
    "canvas audio video".split())
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disclaimer footer form header menu modal nav navbar navigation "
    "newsletter notice notices popup promo related replies reply respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_READER_WORDS = frozenset("comment comments replies reply respond".split())
_STATE_WORDS = frozenset("closed disabled enabled off on open".split())
_ENDS_PARAGRAPH = _BLOCK - frozenset("body html head option optgroup".split())


#: What an element's name and classes say of it: nothing, that it may stand beside the article,
#: that it does, or that it does whatever it holds.
_PLAIN, _MAYBE, _SURE, _NEVER = range(4)


def _mark(name: str, rest: str) -> int:
    """``_NEVER`` for elements beside the article and for reader comments, ``_SURE`` for forms and
    headers (which may be put round a whole page) and whole class names (``sidebar``), ``_MAYBE``
    for class names that have such a word in them (``right-sidebar``, ``ad-box``)."""
    if name in _ASIDE:
        return _SURE if name in ("form", "header") else _NEVER
    found = _PLAIN
    if rest and name not in ("body", "html", "main", "article"):
        for m in _CLASS.finditer(rest):
            for token in (m[1] or m[2] or m[3] or "").lower().split():
                parts = _PARTS.findall(token)
                if _ASIDE_WORDS.isdisjoint(parts):
                    continue
                if parts[0] in _READER_WORDS and _STATE_WORDS.isdisjoint(parts):
                    return _NEVER
                found = max(found, _SURE if token in _ASIDE_WORDS else _MAYBE)
    return found


class _Tree:
    """Elements of a page in order of their start tags: parent, mark, and words inside."""

    def __init__(self):
        self.parents, self.marks, self.names, self.words = [-1], [_PLAIN], [""], [0]

    def add(self, parent: int, name: str, mark: int) -> int:
        self.parents.append(parent)
        self.names.append(name)
        self.marks.append(mark)
        self.words.append(0)
        return len(self.names) - 1

    def _around(self, at: int) -> Iterator[int]:
        while at > 0:
            at = self.parents[at]
            yield at

    def beside(self) -> list[bool]:
        """Which elements stand beside the article.

        Neither the ``article`` or ``main`` element with most words nor what holds it is beside,
        unless it lies in a ``_NEVER`` element; nor is a ``_MAYBE`` element with more than half of
        the words outside of ``_SURE`` and ``_NEVER`` ones: there the class tells of the layout.
        """
        n = len(self.names)
        sure, never = [False] * n, [False] * n
        for i in range(1, n):
            sure[i] = sure[self.parents[i]] or self.marks[i] >= _SURE
            never[i] = never[self.parents[i]] or self.marks[i] == _NEVER
        # an article is weighed by all its words: a class may have marked what holds it
        whole, counted = list(self.words), [0 if s else w for s, w in zip(sure, self.words)]
        for i in range(n - 1, 0, -1):
            whole[self.parents[i]] += whole[i]
            counted[self.parents[i]] += counted[i]
        holds = {0}
        articles = [i for i in range(1, n) if self.names[i] in ("article", "main")
                    and not never[i]]
        at = max(articles, key=lambda i: (whole[i], -i), default=0)
        for i in articles:  # an article with most of the words of the one around it
            if 2 * whole[i] > whole[at] and at in self._around(i):
                at = i
        while at > 0:
            holds.add(at)
            at = self.parents[at]
        out = [False] * n
        for i in range(1, n):
            if i in holds:
                continue
            mark = self.marks[i]
            if mark == _MAYBE and 2 * counted[i] > counted[0]:
                mark = _PLAIN
            out[i] = out[self.parents[i]] or mark != _PLAIN
        return out


def _events(page: str, tree: _Tree) -> Iterator[tuple[str, str, bool, int, bool]]:
    """(kind, text, in an article, element, beside it in any case) in page order."""
    stack: list[tuple[str, bool, int]] = []  # name, in an article, element
    block = ["body"]

    def close(name: str) -> None:
        while stack:
            top = stack.pop()[0]
            if top in _BLOCK:
                block.pop()
            if top == name:
                return

    for m in _PIECE.finditer(page):
        inside, element = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        if m["text"] is not None:
            tree.words[element] += len(m["text"].split())
            yield block[-1], m["text"], inside, element, False
        elif m["raw"] is not None:
            yield "<" + m["raw"].lower(), "", inside, element, True
        elif m["name"] is not None:
            name, rest = m["name"].lower(), m["rest"]
            if m["end"]:
                if any(s[0] == name for s in stack):
                    close(name)
                yield "<" + name, "", inside, element, False
                continue
            if name in _ENDS_PARAGRAPH and block[-1] == "p":
                close("p")
            if name == "li" and block[-1] == "li":
                close("li")
            inside, element = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            if name not in _VOID and not rest.endswith("/"):
                mark = _mark(name, rest)
                if mark != _PLAIN or name in ("article", "main"):
                    element = tree.add(element, name, mark)
                stack.append((name, inside or name in ("article", "main"), element))
                if name in _BLOCK:
                    block.append(name)
            yield "<" + name, "", inside, element, False


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, text, in an article, beside it) in page order.

    Kind is ``<name`` for a tag and the enclosing block's name for text.
    """
    tree = _Tree()
    events = list(_events(page, tree))
    beside = tree.beside()
    for kind, text, inside, element, always in events:
        yield kind, text, inside, always or beside[element]


def token_counts(page: str) -> Counter:
    """Tags and words by kind and by side, of a page that marks its article; else empty."""
    counts: Counter = Counter()
    marked = False
    for kind, text, inside, beside in tokens(page):
        marked |= inside
        counts[kind, inside and not beside] += len(text.split()) if kind[0] != "<" else 1
    return counts if marked else Counter()


def learn_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each kind between articles and the rest; words are kept positive where the
    article has them at all, tags negative."""
    words = [sum(n for (k, side), n in counts.items() if side == s and k[0] != "<")
             for s in (False, True)]
    weights = {}
    for kind in {k for k, _ in counts}:
        out, own = counts.get((kind, False), 0), counts.get((kind, True), 0)
        odds = math.log((own + 0.5) / (words[True] + 1)) - math.log((out + 0.5) / (words[False] + 1))
        weights[kind] = min(-0.1, odds) if kind[0] == "<" else max(-3.0, min(3.0, odds))
    return weights


def main_text(page: str, weights: dict[str, float]) -> str:
    """Text of the contiguous region with the largest sum of word and tag weights.

    One linear scan keeps the best sum that ends at each token, the first of equal ones. Parts that
    are marked as menus, notices and the like are left out before, at the price of one tag; see
    ``_Tree.beside`` for what counts as marked.
    """
    pieces: list[tuple[float, str | None, str]] = []  # weight, text or None for a tag, kind
    was_beside = False
    for kind, text, _, beside in tokens(page):
        if beside:
            if not was_beside:
                pieces.append((weights.get("<aside", -1.0), None, "<aside"))
        elif kind[0] == "<":
            pieces.append((weights.get(kind, -1.0) if kind[1:] in _BLOCK else 0.0, None, kind))
        else:
            n = len(text.split())
            pieces.append((n * weights.get(kind, 0.5), text, kind))
        was_beside = beside
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, (weight, _, _) in enumerate(pieces):
        if total <= 0:
            total, start = 0.0, i
        total += weight
        if total > best:
            best, region = total, (start, i + 1)
    blocks, current = [], []
    for _, text, kind in pieces[region[0]:region[1]]:
        if text is not None:
            current.append(html.unescape(text))
        elif kind[1:] in _BLOCK:
            blocks.append("".join(current))
            current = []
        elif kind == "<br":
            current.append(" ")
    blocks.append("".join(current))
    lines = (" ".join(b.split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def page_weights(pages: DataFrame, id_col: str, html_col: str,
                 max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Weights from at most ``max_labelled`` pages, those with the least id hashes; pages with an
    ``article`` or ``main`` element are the labelled ones among them."""
    ids = (pages.select(F.col(f"`{id_col}`").alias("id")).distinct()
           .orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    table = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html"))
    chosen = table.join(F.broadcast(ids), "id")

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for page in texts_of(batch.column(0)):
                total.update(token_counts(page))
            rows = [(k, s, n) for (k, s), n in total.items()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*rows)], ["kind", "own", "n"])
        return work
    counts = (arrow_map(chosen.select("html"), "kind string, own boolean, n long", make)
              .groupBy("kind", "own").agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "kind", "own").limit(1000).collect())
    return learn_weights({(r["kind"], r["own"]): r["n"] for r in counts})


def extract_text(pages: DataFrame, id_col: str, html_col: str,
                 weights: dict[str, float]) -> DataFrame:
    """All columns of ``pages`` but ``html_col`` in the struct ``row``, and text, n_chars.

    Blocks are joined by LF in page order; white space inside a block becomes one blank, character
    references are decoded, and ``br`` is white space. ``n_chars`` counts code points.

    Cases: null and empty pages and pages without words give an empty text; of several best
    regions the first counts; markup that is never closed ends with the page; very long pages are scanned once, token by token; repeated rows are
    extracted each; an empty table gives an empty result; further columns stay in ``row``.
    """
    rest = [c for c in pages.columns if c != html_col]
    table = pages.select(F.col(f"`{html_col}`").alias("html"),
                         F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p, shared.value) for p in texts_of(part.column(0))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])
        return work
    return arrow_map(table, f"row {table.schema['row'].dataType.simpleString()}, text string, "
                            "n_chars long", make)
