"""Main text of web pages: the maximum-scoring run of their words and tags.

A page becomes a row of words and tags. Words score by the kind of element they stand in and tags by
their name, as log odds of lying inside the article, learned from pages that mark it themselves
(`article` or `main`); a tag never scores above a small negative value, and below it only where it was often seen outside.
What is left out below, words and tags, is neither counted nor scored, so a block amid an article does not cut it and the lists
of menus say nothing of those of articles. One scan finds the run with the highest sum. A run of which
most words lie in one `article` (or `main`) is closed over the whole of it. Of its
words, those in elements that are never article text (menus, forms, scripts, adverts, notices,
sidebars, comments and the like, by element, or by role, class or id as whole names) are left out, and the rest is put
together by blocks. A name on a wrapper (`sidebar`, `widget`) does not hold for an `article` or `main` in it, but those among
comments, adverts and related pages, and in elements that are never article text or not shown, stay out.

Null and empty pages, and pages without a word that scores above zero, give an empty text. Of equally high runs
the first is taken, and the longest of those that start there. Pages may be cut off or
badly nested at any point. Every page is read whole. Repeated rows are
extracted each by itself. An empty table gives no rows. Only the columns page_id, url and html are read.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repricer.llm.common import unit

#: Pages that mark their article themselves of which the weights are learned, about.
SAMPLE = 2000
#: What a weight is cut to, and what a tag scores at most.
MOST = 3.0
TAG = -0.05
#: Tags of a kind seen outside articles before it scores less than TAG.
EVIDENCE = 200
#: Elements of HTML by what they mean here.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_ARTICLE = frozenset(
    "head nav header footer aside form button select option datalist dialog menu script style textarea title noscript"
    " iframe noembed noframes xmp template svg math canvas audio video object map".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img".split()
)
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main figcaption td th li dd dt".split())
_KNOWN = CONTENT | INLINE | NOT_ARTICLE | VOID | frozenset(
    "html body div section ul ol dl table tbody thead tfoot tr caption figure details summary center".split()
)
#: Words of class, id and role that mark what is not article text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie"
    " cookies consent gdpr notice notices alert newsletter subscribe subscription signup login nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar aside footer header masthead related recommended recommendations share sharing social"
    " comment comments disqus reply replies respond widget toolbar pagination pager search complementary contentinfo"
    " dialog skip hidden".split()
)
#: Words beside them in one name that only say where or in what it is (`site-header`, but not `has-sidebar`).
PLAIN = frozenset(
    "site page main global user top bottom left right primary secondary the of container wrapper wrap inner outer box block bar"
    " area section region list item items links link button buttons slot unit group posts articles stories form".split()
)
#: Marks of what may be articles itself; an article among these is no wrapper's content.
ARTICLES = frozenset(
    "ad ads adv advert adverts advertisement advertising related recommended recommendations comment comments disqus reply"
    " replies respond".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_MARK = re.compile(r"[A-Za-z]+")
#: What the start of an element closes: the open element, if the nearest that is not inline is one of these.
_CLOSES = {
    "li": ("li", "p"),
    "dd": ("dd", "dt", "p"),
    "dt": ("dd", "dt", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _words(name: str) -> list[str]:
    return [w.lower() for w in _MARK.findall(_CAMEL.sub(" ", name))]


@functools.lru_cache(maxsize=4096)
def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether class, id, role, label or style say that an element is not article text, and that no article in it is either.

    A name marks as a whole: it has a word of MARKS, and the others are of MARKS or PLAIN. The words of a label are one name.
    """
    marked = False
    for m in _ATTRIBUTE.finditer(attributes):
        attribute, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true" or attribute == "style" and _NOT_SHOWN.search(value):
            return True, True
        if attribute in ("class", "id", "role", "aria-label"):
            for name in [value] if attribute == "aria-label" else value.split():
                words = set(_words(name))
                if words & MARKS and words <= MARKS | PLAIN:
                    if words & ARTICLES:
                        return True, True
                    marked = True
    return marked, False


class _Open:
    """The open elements, the blocks among them, and whether the place is never article text (`firm`: nor is an article there)."""

    def __init__(self):
        self.elements: list[tuple[str, bool, bool, int]] = []
        self.blocks = ["body"]
        self.out = self.firm = False
        #: The innermost article or main, by number from 1, that the place is in.
        self.article = self.articles = 0

    def push(self, name: str, never: bool, firm: bool) -> None:
        self.elements.append((name, self.out, self.firm, self.article))
        self.firm |= firm
        # an article is what the marks of the wrappers around it do not mean
        self.out = self.firm or never or self.out and name not in ("article", "main")
        if name in ("article", "main") and not self.out:
            self.articles += 1
            self.article = self.articles
        if name not in INLINE:
            self.blocks.append(name if name in CONTENT else "other")

    def close(self, first: int) -> None:
        """Closes the elements from the given one on."""
        _, self.out, self.firm, self.article = self.elements[first]
        for name, *_ in self.elements[first:]:
            if name not in INLINE:
                self.blocks.pop()
        del self.elements[first:]

    def last(self, fits) -> int | None:
        return next((k for k in range(len(self.elements) - 1, -1, -1) if fits(self.elements[k][0])), None)


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool, int]]:
    """(kind, text, begins, out, article) for each run of text and each tag, in order.

    `kind` is `word:` with the block that the text stands in, or `tag:` with the element's name; `begins` says that
    a tag starts or ends a block, `out` that the place is in an element that is never article text, or the tag one of such an
    element; `article` is the number of the innermost article or main, 0 outside.
    """
    opened, at = _Open(), 0
    while at < len(page):
        match = _TOKEN.search(page, at)
        text = page[at : match.start() if match else len(page)]
        if text:
            yield f"word:{'out' if opened.out else opened.blocks[-1]}", text, False, opened.out, opened.article
        if match is None:
            return
        at, name, attributes = match.end(), (match[2] or "").lower(), match[3] or ""
        if not name:
            continue
        kind, block = f"tag:{name if name in _KNOWN else 'other'}", name not in INLINE and name != "br"
        if match[1]:
            first = opened.last(lambda element, name=name: element == name)
            place = opened.out, opened.article
            if first is not None:
                opened.close(first)
            yield kind, "", block, *place
            continue
        if name not in INLINE and name not in VOID:
            ends = _CLOSES.get(name, ("p",))
            nearest = opened.last(lambda element: element not in INLINE)
            if nearest is not None and opened.elements[nearest][0] in ends:
                opened.close(nearest)
        if name not in VOID and name not in RAW:
            if name in NOT_ARTICLE:
                never, firm = True, True
            else:
                never, firm = _marked(attributes) if name not in ("html", "body", "main", "article") else (False, False)
            opened.push(name, never, firm)
        # a line break is white space
        yield kind, " " if name == "br" else "", block, opened.out or name in RAW, opened.article
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)


def _features(page: str) -> list[tuple[str, str, bool, bool, int, int]]:
    """The tokens with their number of words."""
    return [(*token, len(token[1].split())) for token in tokens(page)]


def _score(kind: str, out: bool, words: int, weights: dict[str, float]) -> float:
    if out:
        return 0.0
    return words * weights.get(kind, -1.0) if kind[0] == "w" else weights.get(kind, TAG)


def score_page(page: str, weights: dict[str, float]) -> tuple[list, int, int]:
    """The page's tokens and the bounds of the run with the highest sum, found in one scan."""
    found = _features(page)
    best, bounds, running, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, _, _, out, _, words) in enumerate(found):
        if running <= 0:
            running, start = 0.0, i
        running += _score(kind, out, words, weights)
        if running > best or running == best and bounds[1] and start == bounds[0]:
            best, bounds = running, (start, i + 1)
    return found, *bounds


def _closed(found: list, first: int, last: int) -> tuple[int, int]:
    """The run's bounds, moved out to those of the article that most of its words are in."""
    words: Counter[int] = Counter()
    for _, _, _, out, article, n in found[first:last]:
        words[article] += 0 if out else n
    article, most = max(words.items(), key=lambda x: x[1], default=(0, 0))
    if not article or 2 * most < sum(words.values()):
        return first, last
    places = [i for i, token in enumerate(found) if token[4] == article]
    return min(first, places[0]), max(last, places[-1] + 1)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best run, by blocks."""
    found, first, last = score_page(page or "", weights)
    first, last = _closed(found, first, last)
    blocks, now = [], []
    for _, text, begins, out, *_ in found[first:last]:
        if begins:
            blocks.append("".join(now))
            now = []
        elif text and not out:
            now.append(text)
    blocks.append("".join(now))
    clean = (" ".join(html.unescape(block).split()) for block in blocks)
    return "\n\n".join(block for block in clean if block)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pages with one marked article: how often each kind of token lies inside it and outside."""
    for batch in batches:
        counts: Counter[tuple[str, bool]] = Counter()
        for page in batch["html"]:
            marked = re.search(r"<(article|main)\b", page, re.I)
            name, inside = marked[1].lower(), False
            for kind, _, _, out, _, words in _features(page):
                if kind == f"tag:{name}":
                    inside = not inside
                elif not out:
                    counts[kind, inside] += words or kind[0] == "t"
        yield pd.DataFrame([(k, n if i else 0, 0 if i else n) for (k, i), n in counts.items()], columns=["kind", "inside", "outside"])


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights of the kinds of tokens (there are as many as elements of HTML), from about `sample` pages."""
    marks = lambda name: F.regexp_count("html", F.lit(rf"(?i)<{name}\b"))
    marked = pages.select("page_id", "html").filter("html IS NOT NULL").filter(
        (marks("main") == 1) | (marks("main") == 0) & (marks("article") == 1)
    )
    share = min(1.0, sample / max(1, marked.count()))
    counts = (
        marked.filter(unit("page_id", seed=3) < share)
        .mapInPandas(_count, "kind string, inside long, outside long")
        .groupBy("kind")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .collect()
    )
    weights = {f"word:{name}": 1.0 for name in CONTENT} | {"word:body": 0.2, "word:other": 0.2, "word:out": 0.0}
    words_in = sum(r["inside"] for r in counts if r["kind"][0] == "w") + 1
    words_out = sum(r["outside"] for r in counts if r["kind"][0] == "w") + 1
    for r in counts:
        odds = math.log((r["inside"] + 1) / (r["outside"] + 1))
        if r["kind"][0] == "w":
            weights[r["kind"]] = max(-MOST, min(MOST, odds))
        elif r["outside"] < EVIDENCE:
            weights[r["kind"]] = TAG
        else:  # against the words, of which most pages have far more inside
            weights[r["kind"]] = max(-MOST, min(TAG, odds - math.log(words_in / words_out)))
    return weights


def extracted(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Columns page_id, url, text and n_chars, a row per page; weights are learned from the pages if not given."""
    weights = learn(pages) if weights is None else weights

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([main_text(page, weights) for page in texts], dtype=object)

    return pages.select("page_id", "url", extract("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
