"""Operator 8: main text of HTML pages by a maximum-scoring run of tokens.

A page is cut into tags and words in one pass.  A token's weight is the log ratio
of its kind's frequency inside and outside the content of labelled pages; pages
that mark their content themselves (one article or main element) are the labels.
The mark serves learning alone: a page's text is chosen by the weights, with or
without a mark, and the marking tag is itself no feature.  Words inside content score positive,
tags of menus, adverts and footers negative, and words in such containers a little
negative.  A linear scan keeps the contiguous run with the greatest sum;
the text is what lies in that run outside boilerplate containers.

Elements are closed as HTML has it: an end tag closes the innermost open element of its
name at any depth, and an element whose end tag may be left out (li, option, p, td, tr
and the like) ends where its sibling begins.

Kinds are tag names of HTML and container groups, so the weight table has a fixed
bound; unseen kinds take a fixed prior.  Weights come from all labelled pages,
summed map-side.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one space.

Results: null or empty html gives an empty text.  Ties take the earliest, then the
shortest run.  Repeated rows and null ids are kept, one output row each.  Only the
named columns are read.  An empty table gives an empty result; without any labelled
page the priors alone decide.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches

# Elements of HTML by what they hold.
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search
section summary table tbody td tfoot th thead title tr ul""".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|xmp|noframes"
LANDMARKS = {"nav": "nav", "menu": "nav", "footer": "footer", "aside": "aside", "form": "form", "button": "form",
             "select": "form", "option": "form", "fieldset": "form", "label": "form", "dialog": "notice", "head": "head",
             "title": "head", "header": "header", "search": "form", "audio": "media", "video": "media"}
# Words of class, id and role attributes that name a boilerplate container.
GROUPS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar banner site-header",
    "footer": "footer foot copyright colophon legal contentinfo",
    "aside": "sidebar aside side rail widget widgets related recommended recommendations popular trending complementary",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay paywall disclaimer toast",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion outbrain taboola dfp",
    "form": "form search signup signin login subscribe subscription newsletter",
    "comments": "comment comments commentlist reply replies respond discussion disqus reviews",
    "social": "share sharing social follow",
}
GROUP_OF = {w: g for g, ws in GROUPS.items() for w in ws.split()}
# Words that say of the rest of a class name what the element merely has or holds.
NEUTRAL = frozenset("has with no without main content layout body".split())
# What an element's own name says outweighs its class: these always hold the page or its content.
NEVER_BOILERPLATE = frozenset("html body main".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][A-Za-z0-9:-]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
ATTR = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPLIT = re.compile(r"[^A-Za-z0-9-]+|(?<=[a-z])(?=[A-Z])")

# Elements whose end tag may be left out: what a start tag ends, and the elements inside
# which it does not look further out.
SCOPE = frozenset("""table caption td th button object template article section nav aside main header footer form
fieldset select details dialog figure blockquote""".split())
P_SCOPE = frozenset("table caption td th button object template".split())
P_ENDERS = frozenset("""address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2
h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dt dd""".split())
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "rt": ("rt rp", "ruby"), "rp": ("rt rp", "ruby"),
}
SIBLINGS = ({t: (tuple(e.split()), SCOPE | set(b.split())) for t, (e, b) in ENDS.items()}
            | {"option": (("option",), frozenset(["select", "datalist", "optgroup"])),
               "optgroup": (("option", "optgroup"), frozenset(["select"])),
               "td": (("td", "th"), frozenset(["tr", "table"])), "th": (("td", "th"), frozenset(["tr", "table"])),
               "tr": (("td", "th", "tr", "caption", "colgroup"), frozenset(["table"]))}
            | {t: (("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), frozenset(["table"]))
               for t in ("thead", "tbody", "tfoot")})

WORD, CONTENT = "word", ("article", "main")
PRIOR_WORD, PRIOR_TAG, SMOOTH = 1.0, -0.5, 0.5
MAX_WEIGHT = 12.0
# A word in a boilerplate container counts against a run, but only this share of a content word: a
# run may pass an advert inside an article, whose words are left out of the text anyway.
BOILER_SHARE = 0.1


def container_group(tag: str, attrs: str, in_content: bool) -> str | None:
    """The boilerplate group an element opens, by its name, else by the words of its class, id and role."""
    if tag in NEVER_BOILERPLATE:
        return None
    if tag == "article":
        named = {w.lower() for m in ATTR.finditer(attrs) for w in re.split(r"\s+", "".join(x or "" for x in m.groups()))}
        return "comments" if any(GROUP_OF.get(w) == "comments" for w in named) else None
    if tag == "header":
        return None if in_content else "header"
    if tag in LANDMARKS:
        return LANDMARKS[tag]
    if attrs and tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
        if HIDDEN.search(attrs):
            return "hidden"
        for m in ATTR.finditer(attrs):
            for name in re.split(r"\s+", m.group(1) or m.group(2) or m.group(3) or ""):
                # the first telling part of a name decides: sidebar-content is a sidebar, has-sidebar is none
                parts = [name.lower(), *re.split(r"[-_]+", SPLIT.sub("-", name).lower())]
                told = next((p for p in parts if p in GROUP_OF or p in NEUTRAL), None)
                group = GROUP_OF.get(told) if told else None
                if group and not (group == "header" and in_content):
                    return group
    return None


def tag_kind(tag: str, group: str | None) -> str:
    """A tag's kind; inside a boilerplate container it is another kind than outside."""
    return ("in:" if group else "tag:") + (tag if tag in BLOCKS or tag in INLINE else "other")


class _Open:
    """The open elements of a page, and per tag name their places, so that any depth is one look-up."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str | None]] = []  # open elements and the group they stand in
        self.places: dict[str, list[int]] = {}

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def push(self, tag: str, group: str | None) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, group))

    def cut(self, at: int) -> str | None:
        """End the element at place ``at`` and all inside it; the group it stood in."""
        group = self.stack[at][1]
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()
        return group

    def ended_by(self, tag: str) -> int:
        """Place of the outermost element without an end tag that a start tag ``tag`` ends, or -1."""
        ends, scope = SIBLINGS.get(tag, ((), ()))
        found = -1
        for tags, bounds in ((ends, scope), (("p",) if tag in P_ENDERS else (), P_SCOPE)):
            open_ = [at for t in tags if (at := self.last(t)) >= 0]
            if open_:
                limit = max(self.last(b) for b in bounds)
                found = min([at for at in open_ if at > limit] + ([found] if found >= 0 else []), default=found)
        return found


def tokens(page: str):
    """Yield (kind, weight count, text, block break, boilerplate group, inside the content mark)."""
    opened = _Open()
    group, content = None, 0
    for m in TOKEN.finditer(page):
        text = m.group("text")
        if text is not None:
            yield WORD, len(text.split()), text, False, group, content > 0
            continue
        tag = (m.group("tag") or m.group("tag2") or m.group("raw") or "").lower()
        if m.group("raw"):
            yield "tag:" + tag, 1, "", tag not in INLINE, "raw", content > 0
            continue
        if not tag:
            continue
        closing = bool(m.group("close") or m.group("close2"))
        if not closing:
            if tag == "body":  # ends an unclosed head
                opened, group = _Open(), None
            at = opened.ended_by(tag)
            if at >= 0:
                group = opened.cut(at)
            g = group or container_group(tag, m.group("attrs") or "", content > 0)
            if tag in CONTENT:
                content += 1
            kind = f"group:{g}" if g and not group else tag_kind(tag, group)
            if tag not in VOID and not (m.group("attrs") or "").endswith("/"):
                opened.push(tag, group)
                group = g
            yield kind, 1, "", tag in BLOCKS, g, content > 0
        else:
            at = opened.last(tag)
            # a stray close inside an unclosed inline run ends only what it names
            yield tag_kind(tag, group), 1, "", tag in BLOCKS, group, content > 0
            if at >= 0:
                group = opened.cut(at)
            if tag in CONTENT and content:
                content -= 1


def label_counts(page: str) -> Counter | None:
    """(kind, inside) counts of a page that marks its content by exactly one article or main element."""
    low = page.lower()
    if low.count("<article") + low.count("<main") != 1:
        return None
    n: Counter = Counter()
    for kind, k, _, _, group, inside in tokens(page):
        if kind in ("tag:article", "tag:main") or not k:
            continue
        if kind != WORD or not group:
            n[(kind, inside)] += k
    return n


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Log ratio of each kind's share inside and outside content, over all labelled pages."""

    def run(batch: pa.RecordBatch) -> dict:
        total: Counter = Counter()
        for p in batch.column(0).to_pylist():
            total.update(label_counts(p) or {} if p else {})
        return {"kind": [k for k, _ in total], "inside": [i for _, i in total], "n": list(total.values())}

    rows = (map_batches(pages.select(pages[html_col].alias("html")), run, "kind string, inside boolean, n long")
            .groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("n_in"),
                                 F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("n_out"))
            .collect())  # one row per kind: bounded by the fixed tables above
    total_in, total_out = sum(r.n_in for r in rows), sum(r.n_out for r in rows)
    if not total_in or not total_out:
        return {}
    return {r.kind: max(-MAX_WEIGHT, min(MAX_WEIGHT, math.log((r.n_in + SMOOTH) / (total_in + SMOOTH))
                                         - math.log((r.n_out + SMOOTH) / (total_out + SMOOTH)))) for r in rows}


def _weight(weights: dict[str, float], kind: str, group: str | None) -> float:
    if kind == WORD:
        word = max(0.1, weights.get(WORD, PRIOR_WORD))
        return -BOILER_SHARE * word if group else word
    if kind.startswith(("group:", "in:")):
        return min(PRIOR_TAG, weights.get(kind, PRIOR_TAG * (8 if kind.startswith("group:") else 1)))
    # a tag that content also uses costs little; it never pays
    return min(-0.05, weights.get(kind, PRIOR_TAG))


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page: the best run by a linear scan, without boilerplate containers."""
    if not page:
        return ""
    toks = list(tokens(page))
    best = total = 0.0
    start = lo = hi = 0
    for i, (kind, k, _, _, group, _) in enumerate(toks):
        w = _weight(weights, kind, group)
        if total <= 0:
            total, start = 0.0, i
        total += w * k
        if total > best:
            best, lo, hi = total, start, i + 1
    out: list[str] = []
    block: list[str] = []
    for kind, _, text, breaks, group, _ in toks[lo:hi]:
        if kind == WORD:
            if not group:
                block.append(text)
        elif breaks and block:
            out.append("".join(block))
            block = []
    out.append("".join(block))
    return " ".join(b for b in (" ".join(html.unescape(x).split()) for x in out) if b)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars (its code points)."""
    weights = learn_weights(pages, html_col)
    id_type = pages.schema[id_col].dataType.simpleString()
    url_type = pages.schema[url_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        texts = [extract(p, weights) for p in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"),
                                    pages[html_col].alias("html")), run,
                       f"page_id {id_type}, url {url_type}, text string, n_chars long")
