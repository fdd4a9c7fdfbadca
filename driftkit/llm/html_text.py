"""Main text of web pages: a maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags. A word scores by where it
stands (its block, whether it is a link's, whether an article element is around
it), a tag costs something; the contiguous run with the largest sum, found in
one scan, is the content. The weights are log odds learned from labelled pages:
those whose author marked the content with an article or main element. Parts
that are never content (menus, forms, scripts, adverts, comments and the like)
are left out before the scan and so do not cut an article in two.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

# Each character is read in one way only, so that no page takes more than linear time.
_ATTRIBUTES = r"""(?>[^<>"']+|"[^"]*"|'[^']*'|["'])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<(?P<raw>script|style|textarea)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attributes>{_ATTRIBUTES}(?=>|\Z)|[^<>]*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Element names of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_NEVER = set("head title nav aside footer form menu dialog search fieldset label input option".split())
# Of these, what may also be around a whole page: read after all where it wraps the content.
_AROUND = {"form", "fieldset"}
# Left out too; without an end tag further on they are read as empty.
_EMBEDDED = set("noscript template svg iframe object canvas select button audio video".split())
_CONTENT = {"article", "main"}
# Words in class, id and role names of parts that are not content.
_FOREIGN = set(
    "ad ads adv advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation navigations newsletter notice notices popup promo "
    "promoted related remark replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget complementary contentinfo".split()
)
# Words that name a part together with one of these, and whose text a comment or reply is.
_PARTS = set(
    "area article articles aside bar block blocks bottom box button buttons container entry form global group head heading icon "
    "icons inner item items left link links list main media menu mobile module nav outer page panel post posts primary region "
    "right row secondary section site small story stories text this title top us widget widgets wrap wrapper".split()
)
_REPLIES = {"comment", "comments", "disqus", "replies", "respond"}


@dataclass
class Block:
    """One block of text, where it stands, and what precedes it."""

    element: str  # the innermost block element
    tags: Counter = field(default_factory=Counter)  # the tags since the block before
    parts: list[str] = field(default_factory=list)
    links: int = 0  # words in links
    marked: bool = False  # inside an article or main element
    foreign: bool = False  # in a part that is never content
    article: bool = False  # inside an article element

    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


def _foreign_name(attributes: str) -> str:
    """The first class, id, role or label that names a part that is never content; "" without one.

    A name counts as a whole: one word is of _FOREIGN and the others are of it
    or of _PARTS. "share-bar" is such a name, "no-sidebar" and "related-work" are not.
    """
    for kind, value in _NAMED.findall(attributes):
        value = value.strip("\"'")
        for name in [value] if kind.lower() == "aria-label" else value.split():
            own = {w.lower() for w in _WORDS.findall(name)}
            if not _FOREIGN.isdisjoint(own) and own <= _FOREIGN | _PARTS:
                return name
    return ""


def blocks(html: str | None, every: bool = False) -> tuple[list[Block], bool]:
    """The blocks of a page in order; whether content is marked.

    Parts that are never content are left out, or given as ``foreign`` blocks if ``every`` block is asked for.
    A part left out for its name, and a form, is read after all if it wraps the
    content: it holds an article or main element or most of the words, and no
    article is outside. Wrappers within wrappers cost one more reading a level.
    """
    spared: set[int] = set()
    while True:
        out, any_mark, named = _read(html, every, spared)
        if not named:
            break
        n = {b: len(b_.text().split()) for b, b_ in enumerate(out) if not b_.foreign}
        if any(n[b] and out[b].article for b in n):
            break
        marked, total = sum(n[b] for b in n if out[b].marked), sum(n.values()) + sum(w for w, _, _ in named.values())
        more = {
            at for at, (w, marks, replies) in named.items()
            if not replies and (marked == 0 and (marks or 2 * w > total) or marks and 2 * w > total)
        }
        if not more:
            break
        spared |= more
    return [b for b in out if b.text()], any_mark


def _read(html: str | None, every: bool, spared: set[int]) -> tuple[list[Block], bool, dict[int, list]]:
    """The blocks, whether content is marked, and [words, marks, replies] of each outermost part that may be spared.

    These are forms and parts left out for their names; ``spared`` are those (by the place of their tag) that are read.
    """
    out, stack = [], []  # stack: (tag, left out, content mark)
    opened: Counter = Counter()  # the tags on the stack
    named: dict[int, list] = {}
    part, depth = None, 0  # the part left out for its name around here, and how deep it stands
    any_mark, tags, block = False, Counter(), None
    skipped = links = marks = articles = 0
    last_end: dict[str, int] = {}  # where the last end tag of an embedded element begins

    def pop() -> str:
        nonlocal skipped, links, marks, articles, part
        tag, left_out, mark = stack.pop()
        opened[tag] -= 1
        skipped -= left_out
        marks -= mark
        articles -= tag == "article"
        links -= tag == "a"
        if part is not None and len(stack) <= depth:
            part = None
        return tag

    for m in _TOKEN.finditer(html or ""):
        tag, text = m["tag"], m["text"]
        if text is not None:
            if part is not None and skipped == 1:
                part[0] += len(text.split())
            if skipped and not every:
                continue
            if block is None or block.foreign != (skipped > 0):
                if not text.strip():
                    continue
                near = next((t for t, _, _ in reversed(stack) if t in _BLOCKS), "body")
                block = Block(near, tags, marked=marks > 0 and not skipped, foreign=skipped > 0, article=articles > 0)
                out.append(block)
                tags = Counter()
            block.parts.append(text)
            if links:
                block.links += len(text.split())
            continue
        if tag is None:
            continue
        tag, ends = tag.lower(), m["end"] == "/"
        if every or not skipped:
            tags["/" * ends + tag] += 1
        if tag in _BLOCKS:
            block = None
        elif tag == "br" and block is not None and not skipped:
            block.parts.append(" ")
        if ends:
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in _VOID or m["attributes"].endswith("/") and tag not in _BLOCKS:
            continue
        if tag in _EMBEDDED:
            if tag not in last_end:
                ends_at = (e.start() for e in re.finditer(rf"</{tag}(?=[\s/>]|\Z)", html, re.I | re.A))
                last_end[tag] = max(ends_at, default=-1)
            if last_end[tag] < m.start():
                continue
            if tag in ("select", "button") and opened[tag]:  # these do not nest
                while pop() != tag:
                    pass
        closed = {"p", "b", "i", "em", "strong", "u", "span", "a", "font"} if tag in _BLOCKS else ()
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            while stack and stack[-1][0] in {tag, "p", "dd", "dt"} - ({"tr"} if tag in ("td", "th") else set()):
                pop()
        elif closed and any(t == "p" for t, _, _ in stack[-4:]):  # a block ends an open paragraph
            while stack and stack[-1][0] in closed:
                pop()
        mark = tag in _CONTENT
        left_out = tag in _NEVER or tag in _EMBEDDED or tag == "header" and not marks
        if tag in _AROUND and (m.start() in spared or part is not None):  # within a part that part decides first
            left_out = False
        elif (tag in _AROUND or not left_out) and not mark and tag not in ("body", "html") and not skipped and m.start() not in spared:
            name = tag if tag in _AROUND else _foreign_name(m["attributes"])
            left_out = name != ""
            if name:
                words = {w.lower() for w in _WORDS.findall(name)}
                part, depth = [0, 0, not _REPLIES.isdisjoint(words)], len(stack)
                named[m.start()] = part
        if part is not None and skipped == 1:
            part[1] += mark
        stack.append((tag, left_out, mark))
        opened[tag] += 1
        skipped += left_out
        marks += mark
        articles += tag == "article"
        links += tag == "a"
        any_mark |= mark and not skipped
    return out, any_mark, named


@dataclass(frozen=True)
class Weights:
    """Log odds that a word is content, by feature; what a tag costs, by name."""

    words: dict[str, float]
    tags: dict[str, float]
    prior: float

    def of(self, block: Block, any_mark: bool) -> tuple[float, float]:
        """The sum over the words of a block, and the cost of the tags before it."""
        n = len(block.text().split())
        weight = self.prior + sum(self.words.get(f, 0.0) for f in features(block, any_mark))
        return n * weight, sum(k * self.tags.get(t, -0.1) for t, k in block.tags.items())


def features(block: Block, any_mark: bool) -> list[str]:
    n = len(block.text().split())
    linked = "many" if 2 * block.links >= n else "some" if block.links else "none"
    mark = "none" if not any_mark else "in" if block.marked else "out"
    return [f"block:{block.element}", f"links:{linked}", f"mark:{mark}", f"length:{min(6, n.bit_length())}"]


#: Without labelled pages: paragraphs and headings are content, links are not. An author's mark outweighs all else.
DEFAULT = Weights(
    {"block:p": 1.5, "block:h1": 1.0, "block:h2": 1.0, "block:h3": 1.0, "links:many": -4.0, "mark:in": 100.0, "mark:out": -100.0}, {}, 0.2
)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run with the largest positive sum, the first of equals; (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, found = total, (start, k + 1)
    return found


def main_text(html: str | None, weights: Weights = DEFAULT) -> str:
    """The blocks of the best run, one line each; "" for a page without any.

    Nothing inside the run is dropped, but for what stands outside of all marks
    on a page whose author marked the content.
    """
    parts, any_mark = blocks(html)
    scores = []
    for block in parts:
        words, tags = weights.of(block, any_mark)
        scores += [tags, words]
    a, b = best_run(scores)
    return "\n".join(p.text() for k, p in enumerate(parts) if a <= 2 * k + 1 < b and (p.marked or not any_mark))


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
    """What labelled pages show: words in and out of the marked part by feature, and tags likewise."""
    seen: Counter = Counter()
    for batch in batches:
        for html in batch.column(0).to_pylist():
            parts, any_mark = blocks(html, every=True)
            if not any_mark:
                continue
            for block in parts:
                n = len(block.text().split())
                for f in ["all", *features(block, True)]:
                    seen[f, block.marked] += n
                for t, k in block.tags.items():
                    seen["tags", block.marked] += k
                    seen[f"tag:{t}" if t.lstrip("/") in _BLOCKS | _VOID | _INLINE else "tag:other", block.marked] += k
    names = sorted(seen)
    yield {"name": [f for f, _ in names], "inside": [m for _, m in names], "n": [seen[k] for k in names]}


_INLINE = set("a abbr b bdi cite code del em font i img ins kbd mark q s samp small span strong sub sup time u var".split())


def learn_weights(pages: DataFrame, html: str = "html", most: int = 20_000) -> Weights:
    """Weights from about ``most`` labelled pages, drawn by a hash of the page; ``DEFAULT`` without any.

    A feature weighs the log of its share of the marked words over its share of
    the others; a tag costs 0.1, or its log odds where it is commoner outside.
    There are as many counts as element names, however many pages.
    """
    rows = pages.select(pages[html].cast("string").alias("html")).filter(F.col("html").rlike(r"(?i)<(article|main)\b"))
    share = min(1.0, most / max(1, rows.count()))
    drawn = rows.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = by_batch(drawn, "name string, inside boolean, n long", _observed).groupBy("name", "inside").agg(F.sum("n").alias("n"))
    n = {(r["name"], r["inside"]): r["n"] for r in counts.collect()}
    if not n.get(("all", True)):
        return DEFAULT

    def odds(name: str, every: str) -> float:
        share = [(n.get((name, side), 0) + 1) / (n.get((every, side), 0) + 20) for side in (True, False)]
        return float(np.clip(np.log(share[0] / share[1]), -2, 2))

    names = {f for f, _ in n}
    words = {f: odds(f, "all") for f in names if not f.startswith(("tag:", "mark:")) and f not in ("all", "tags")}
    words |= {k: v for k, v in DEFAULT.words.items() if k not in words}
    tags = {f[4:]: min(-0.1, odds(f, "tags")) for f in names if f.startswith("tag:")}
    return Weights(words, tags, DEFAULT.prior)


def extract(pages: DataFrame, weights: Weights, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(``page_id``, ``url``, ``text``, ``n_chars``) of every row.

    A null or empty page has the text "" and 0 characters; null keys and urls
    stay null; repeated rows give equal rows. ``n_chars`` counts code points.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(pages[key].cast("long"), pages[url].cast("string"), pages[html].cast("string"))
    return by_batch(rows, "page_id long, url string, text string, n_chars long", work)
