"""Main text of web pages as the maximum-scoring run of a page's words and tags.

Words score by the elements they stand in, tags score below zero; a linear scan finds the contiguous region with the best
sum. The weights are log odds, counted on a bounded sample of labelled pages; names known beforehand start from a prior.
Inside the region, words that score zero or less (an advert within the article) are left out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id, sampled

#: Pages that the weights are counted on at most, chosen by hash.
MAX_PAGES = 2000
#: Bounds of the weight of a name with a prior, of any other, of the sum of the positive ones, and the words a prior counts for. A prior is
#: a pseudo-count: names that many words speak for or against get what the pages say.
LOWEST, HIGHEST, LEARNT, MOST, PRIOR_WORDS = -6.0, 3.0, 1.0, 5.0, 200

# Names in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNREAD = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title"
CLOSED_BY_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

# Words in names of elements, classes and ids that a page's builder gives to what is not, or is, the article.
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising adverts alert aside author banner bar billboard breadcrumb breadcrumbs button comment commentlist comments consent "
    "cookie cookies copyright dialog disqus disclaimer download feedback foot footer form gdpr head header hidden links login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification outbrain overlay pager pagination popup print promo promoted promotion rail recommended related replies reply respond search share "
    "sharing shoutbox sidebar sign signup skip social sponsor sponsored subscribe subscription taboola tags toc toolbar tooltip topbar widget".split()
)
CONTENT = frozenset("article articlebody body blog content entry main p post story text".split())
#: A header within an article, or named after one by these words, is the article's own.
HEADERS, OWNERS = frozenset(("t:header", "c:header", "c:head")), frozenset(("c:article", "c:entry", "c:post", "c:story"))

#: Attributes: a quote opens a value only behind an equals sign; elsewhere it is a character like others.
ATTRIBUTES = r"""(?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)", re.S)
UNREAD_TAGS = frozenset(UNREAD.split("|"))
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
UNSEEN = re.compile(r"""\bstyle\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)\b(?:display\s*:\s*none|visibility\s*:\s*hidden)\b""", re.I)
#: An element around so large a share of a page's words, and of whose words so large a share lies in one element of the content, is a wrapper.
WRAPS = 0.5


def unseen(attributes: str) -> bool:
    """Whether an element says itself that it is not shown: by the attribute hidden or its own style."""
    return bool(HIDDEN.search(QUOTED.sub(" ", attributes)) or UNSEEN.search(attributes))


def names(tag: str, attributes: str, within_article: bool = False) -> tuple[str, ...]:
    """Features of an element: its tag, and the words of its class, id and role; 'hidden' if it is not shown. The header of an article is none."""
    out = {f"t:{tag}"}
    for m in NAMED.finditer(attributes) if attributes else ():
        for word in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[1]).lower()):
            if word:
                out.add(f"c:{word}")
    if attributes and unseen(attributes):
        out.add("c:hidden")
    return tuple(out - HEADERS if within_article or out & OWNERS else out)


def prior(name: str) -> float:
    word = name[2:]
    return LOWEST if word in BOILERPLATE else HIGHEST if word in CONTENT and name != "t:body" else 0.0


class Weights(dict):
    """Weights by name; a name never seen has its prior."""

    tag_costs: dict[str, float] = {}

    def __missing__(self, name: str) -> float:
        return prior(name)


class Open:
    """The open elements of a page, with what is asked of them kept up to date: no question walks the stack."""

    def __init__(self, weights: Weights):
        self.stack: list[tuple[str, int, tuple[str, ...], float, float]] = []  # tag, element, names new with it, sums without it
        self.weights, self.tags, self.names, self.up, self.down = weights, Counter(), Counter(), 0.0, 0.0

    def push(self, tag: str, element: int, own: tuple[str, ...], wrapper: bool) -> None:
        fresh = tuple(n for n in own if not self.names[n] and not (wrapper and self.weights[n] < 0))
        self.stack.append((tag, element, fresh, self.up, self.down))
        self.tags[tag] += 1
        for n in fresh:
            self.names[n] += 1
            w = self.weights[n]
            self.up, self.down = (self.up + w, self.down) if w > 0 else (self.up, self.down + w)

    def pop(self) -> None:
        tag, _, fresh, self.up, self.down = self.stack.pop()
        self.tags[tag] -= 1
        for n in fresh:
            self.names[n] -= 1

    def leave(self, wanted: tuple[str, ...], within: frozenset | set = frozenset()) -> None:
        """Closes the innermost of the wanted elements and all in it, unless an element of within lies between."""
        if not any(self.tags[t] for t in wanted):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in wanted:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in within:
                return

    def score(self) -> float:
        """One for a bare word, more or less by the distinct names of the elements around it."""
        return 1 + min(self.up, MOST - 1) + self.down


def pieces(html: str, open_: Open, wrappers: frozenset | set = frozenset()):
    """(kind, value): kind is 'open', 'close' or 'text', open_ has the elements around a text. Elements are numbered as they come."""
    at = element = 0
    last_end = {m[1].lower(): m.start() for m in re.finditer(rf"</({UNREAD})(?=[\s/>])", html, re.I)}
    while m := TOKEN.search(html, at):
        if m.start() > at:
            yield "text", html[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag
            open_.leave((tag,))
            continue
        if tag in UNREAD_TAGS:  # skipped to its end; without one scripts and styles take the rest, others end at the next tag
            yield "open", tag
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at) if last_end.get(tag, -1) >= at else None
            after = end.end() if end else -1 if tag in ("script", "style") else html.find("<", at)
            at = after if after >= 0 else len(html)
            continue
        if tag == "br":
            yield "text", " "
        if tag not in INLINE:
            open_.leave(("p",), {"table", "td", "div", "section", "article"})
        if tag in CLOSED_BY_SIBLING:
            open_.leave(CLOSED_BY_SIBLING[tag], {"ul", "ol", "dl", "table", "select"})
        yield "open", tag
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            element += 1
            open_.push(tag, element, names(tag, m[3], open_.tags["article"] > 0), element in wrappers)
    if at < len(html):
        yield "text", html[at:]


def wrappers_of(html: str, weights: Weights) -> set[int]:
    """Elements with unwelcome names that wrap the whole page: a page-wide form, a layout named after its sidebar."""
    open_, words, parent, kind = Open(weights), Counter(), {}, {}
    for piece, value in pieces(html, open_):
        if piece == "text":
            n = len(value.split())
            if n and open_.stack:
                words[open_.stack[-1][1]] += n
            words[0] += n
        elif piece == "close" or not open_.stack:
            continue
        for i in range(len(open_.stack) - 1, -1, -1):  # elements opened since the last piece
            tag, e, fresh, _, _ = open_.stack[i]
            if e in parent:
                break
            parent[e] = open_.stack[i - 1][1] if i else 0
            signs = [weights[n] for n in fresh if abs(weights[n]) >= LEARNT]
            kind[e] = -1 if any(w < 0 for w in signs) else 1 if signs else 0
    for e in sorted(parent, reverse=True):  # children have larger numbers
        if parent[e]:
            words[parent[e]] += words[e]
    best = Counter()  # the most words that one element of content within holds
    for e in sorted(parent, reverse=True):
        best[parent[e]] = max(best[parent[e]], best[e], words[e] if kind[e] > 0 else 0)
    return {e for e, k in kind.items() if k < 0 and words[e] > WRAPS * words[0] and best[e] > WRAPS * words[e]}


def best_run(scores: list[float]) -> tuple[float, tuple[int, int]]:
    """The largest sum of a contiguous run and its bounds, the first of equals; zero and an empty run if no sum is above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return best, span


def main_text(html: str | None, weights: Weights) -> str:
    """The text blocks of the best region, one a line; empty if no region scores above zero, as for null and empty html.

    A line break is white space. Elements without an end tag reach to the end of what they can hold; head and title hold no text.
    """
    items: list[tuple[float, str | None, bool]] = []  # score, text, whether a block ends here
    html, open_ = html or "", Open(weights)
    for kind, value in pieces(html, open_, wrappers_of(html, weights)):
        if kind == "text":
            n = len(value.split())
            items.append((n * open_.score() if n else 0.0, value, False))
        else:
            items.append((weights.tag_costs.get(value, -0.1), None, value not in INLINE))
    _, span = best_run([score for score, _, _ in items])
    blocks, parts = [], []
    for score, text, ends in [*items[span[0] : span[1]], (0.0, None, True)]:
        if text is not None and (score > 0 or not text.strip() and parts):
            parts.append(text)
        elif text is None and not ends:
            parts.append("")
        if ends:
            blocks.append(" ".join(unescape("".join(parts)).split()))
            parts = []
    return "\n".join(b for b in blocks if b)


def labelled(html: str):
    """Whether each word is content, as pages that mark their one article tell: (names, words, content); and tags."""
    if len(re.findall(r"<article[\s>]", html, re.I)) != 1:
        return
    open_ = Open(Weights())
    for kind, value in pieces(html, open_):
        if kind == "text":
            own = {n for n, k in open_.names.items() if k}
            yield own, len(value.split()), "t:article" in own and open_.down == 0
        else:
            yield {f"/{value}"}, 1, open_.names["t:article"] > 0 and open_.down == 0


def learn(pages: DataFrame, max_pages: int = MAX_PAGES) -> Weights:
    """Log odds of names and costs of tags from pages(page_id, html) with exactly one article element; others teach nothing."""

    def count(batches):
        for b in batches:
            seen = defaultdict(lambda: [0, 0])
            for html in b["html"]:
                for own, n, content in labelled(html):
                    for name in [*own, "/words"] if own and not next(iter(own)).startswith("/") else own:
                        seen[name][int(content)] += n
            yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["name", "other", "content"])

    chosen = sampled(pages.where("html is not null").select("page_id", "html"), "page_id", max_pages)
    counted = chosen.mapInPandas(count, "name string, other long, content long")
    rows = counted.groupBy("name").agg(F.sum("other").alias("other"), F.sum("content").alias("content")).collect()
    seen = {r["name"]: (r["other"], r["content"]) for r in rows}
    all_other, all_content = (max(1, x) for x in seen.get("/words", (1, 1)))
    out, costs = Weights(), {}
    for name, (other, content) in seen.items():
        odds = np.log((content + 1) / all_content) - np.log((other + 1) / all_other)
        if name.startswith("/"):
            costs[name[1:]] = float(np.clip(odds, -1.0, -0.1))
        else:
            share = (other + content) / (other + content + PRIOR_WORDS)
            held = prior(name)
            learnt = share * odds + (1 - share) * held
            low, high = (LOWEST, HIGHEST) if held else (-LEARNT, LEARNT)
            out[name] = float(np.clip(learnt, low, high))
    out.tag_costs = costs
    return out


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """pages' page_id and url with text, the main text of html; null, empty and article-less html may give an empty text.

    Repeated rows and ids give a row each, equal html equal texts; an empty table gives no rows.
    """
    plain, costs = dict(weights), weights.tag_costs

    def each(batches):
        known = Weights(plain)
        known.tag_costs = costs
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [main_text(h, known) for h in b["html"]]})

    return by_id(pages.select("page_id", "url", "html"), each, "url string, text string", "page_id")


def op6(spark, sf_dir):
    """The main text of every page. Repeated ids give a row each; an empty table gives none and teaches nothing."""
    from .common import table

    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages)).withColumn("n_chars", F.length("text").cast("long"))
