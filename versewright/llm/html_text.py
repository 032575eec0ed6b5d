"""Main text of web pages by tag-path ratios.

A page is read once into text leaves, each with its root-to-leaf tag path and the elements around it. Per path the text
length and the punctuation of all its leaves are aggregated and put in ratio to their number; the two ratios are smoothed
over neighbouring paths in page order and fused by their product. Paths whose fused ratio reaches a share of its standard
deviation over the page hold content. The deepest element around almost all content leaves is the article's core, and every block
in it is text but for lists of links without a content leaf: short paragraphs and headings stay. From there the article widens to the smallest element around all
content leaves: of what stands beside the core, parts with content leaves, headings and paragraphs stay, but no lists of
links. Elements for navigation, footers, forms and what is hidden neither vote nor stay. Names (adverts, notices,
comments, sidebars, ...) are weak evidence: a part so named stays if most of the page's content is in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

# Element names of the markup language by what they mean here.
RAW = "script style noscript template textarea title iframe svg math canvas object audio video select xmp".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
BOILERPLATE = frozenset("head nav footer aside form button dialog menu fieldset".split())
# Words in class, id and role attributes that name what is no article.
NOT_ARTICLE = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay
    nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside complementary footer contentinfo masthead toolbar topbar
    comment comments commentlist disqus replies reply respond share sharing social follow related recommended recommendations newsletter subscribe subscription signup login search widget""".split()
)
BESIDE = frozenset("no with has without free".split())  # names with such a part say what stands beside
REMARKS = frozenset("comment comments commentlist disqus replies reply respond".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HEADER = frozenset(("header", "banner", "site-header", "page-header"))

# What stands in quotes may hold any character; outside them a < ends the attempt, and nothing is tried twice: linear.
ATTRIBUTES = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){ATTRIBUTES}>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attrs>{ATTRIBUTES})>",
    re.DOTALL | re.IGNORECASE,
)
LABELS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：।]")
#: Share of the standard deviation that content reaches, and of the content's text that the article's core holds.
REACH, MOST = 0.5, 0.9


class Element:
    __slots__ = ("name", "parent", "path", "out", "named", "under", "depth", "mass", "size", "linked", "inside", "block", "within")

    def __init__(self, name: str, parent: Element | None, label: str, out: bool, named: str = ""):
        self.name, self.parent, self.out, self.mass, self.inside = name, parent, out, 0, False
        self.named, self.size, self.linked = named, 0, 0  # the word that says it is no article; bytes of text, and in links
        self.under = bool(named) or (parent is not None and parent.under)
        self.path = hash((parent.path, name, label)) if parent else 0  # stands for the path of tags from the root
        self.depth = parent.depth + 1 if parent else 0
        self.block = parent.block if parent and name in INLINE else self  # the nearest element around it that isn't inline
        self.within = name in ("article", "main") or (parent is not None and parent.within)


def _word(name: str, tag: str) -> str:
    """The word by which a name says that it is no article: the whole name, its first part or its last."""
    if name in NOT_ARTICLE:
        return name
    parts = re.split(r"[-_]+", name)
    if len(parts) == 1 or BESIDE.intersection(parts) or (tag == "article" and not name.startswith("comment")):
        return ""
    return next((w for w in (parts[-1], parts[0]) if w in NOT_ARTICLE), "")


def _meaning(attrs: str, name: str, within: bool) -> tuple[str, bool, str]:
    """The label of an element in paths, whether it is no article for sure, and the word in its names that says so."""
    out, label, named = name == "header" and not within, "", ""
    if not attrs:
        return label, out, named
    out = out or bool(HIDDEN.search(attrs))
    for kind, a, b, c in LABELS.findall(attrs):
        value = (a or b or c).lower()
        if kind.lower() == "class":
            label = "." + value
        for n in value.split():
            out = out or (n in HEADER and not within)
            named = named or _word(n, name)
    return label, out, named


def leaves(page: str) -> tuple[list[list], list[Element]]:
    """[element, block, text] of each text of a page in order, and its elements, parents first; a block goes on over inline elements."""
    root = Element("", None, "", False)
    elements, opened = [root], Counter()  # opened: how many elements of a name are open
    now, block, at, found = root, 0, 0, []

    def text(upto: int) -> None:
        if upto > at:
            found.append([now, block, page[at:upto]])

    def close(upto: Element) -> None:
        """Close what is open up to an element, that one too."""
        nonlocal now
        while now is not upto:
            opened[now.name] -= 1
            now = now.parent
        opened[upto.name] -= 1
        now = upto.parent

    for m in TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name in VOID:
            if name == "br":
                found.append([now, block, " "])
            elif name == "hr":
                block += 1
            continue
        inline = name in INLINE
        if not inline:
            block += 1
        if m["end"]:
            if opened[name]:
                e = now
                while e.name != name:
                    e = e.parent
                close(e)
        else:
            if not inline:  # a paragraph ends where another block starts, and takes open inline elements with it
                e = now.block
                if e.name == "p" or (e.name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    close(e)
            label, out, named = _meaning(m["attrs"], name, now.within)
            whole = name in ("html", "body", "main")
            out = (out and not whole) or name in BOILERPLATE or now.out
            if not m["attrs"].endswith("/") or inline:
                now = Element(name, now, label, out, "" if whole else named)
                opened[name] += 1
                elements.append(now)
    text(len(page))
    return found, elements


def smooth(values: list[float]) -> list[float]:
    """Weighted means of neighbours, 1-2-1; the ends stand for what lies beyond."""
    padded = [values[0], *values, values[-1]]
    return [(a + 2 * b + c) / 4 for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)]


def content_paths(found: list[tuple[Element, str]]) -> set[int]:
    """The tag paths whose fused ratio of text and punctuation to leaves is high."""
    stats: dict[int, list[int]] = {}
    for e, text in found:
        s = stats.setdefault(e.path, [0, 0, 0])
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    if not stats:
        return set()
    texts, marks = [s[0] / s[2] for s in stats.values()], [s[1] / s[2] for s in stats.values()]
    fused = [t * (1 + p) for t, p in zip(smooth(texts), smooth(marks), strict=True)]
    own = [t * (1 + p) for t, p in zip(texts, marks, strict=True)]
    least = min(REACH * pstdev(fused), max(map(min, fused, own)))
    return {path for path, f, o in zip(stats, fused, own, strict=True) if min(f, o) >= least}  # good neighbours alone don't make content


def weigh(found: list[tuple[Element, str]], elements: list[Element]) -> int:
    """Give elements the mass of the content leaves in them, and return the whole."""
    paths, total = content_paths(found), 0
    for e in elements:
        e.mass = e.size = e.linked = 0
    for e, text in found:
        n = len(text.strip())
        e.size += n
        if e.path in paths:
            e.mass += len(text)
            total += len(text)
    for e in reversed(elements[1:]):
        if e.name == "a":
            e.linked = e.size
        e.parent.mass += e.mass
        e.parent.size += e.size
        e.parent.linked += e.linked
    return total


def judge_names(found: list[tuple[Element, str]], elements: list[Element]) -> None:
    """Parts named for what is no article are out, but for those that hold main, the only article or most of the content.

    Remarks are measured by what has no such name, as they may outweigh what they remark on; others by all but remarks.
    Where there is an article or main with text outside of them all, however short, only what holds one can stay.
    """
    named = [e for e in elements if e.named and not e.out]
    if not named:
        return
    weigh(found, elements)
    outermost = [e for e in named if not e.parent.under]
    plain = elements[0].mass - sum(e.mass for e in outermost)
    rest = plain + sum(e.mass for e in outermost if e.named not in REMARKS)
    holders, marked = set(), any(e.within and e.size and not e.out and not e.under for e in elements)
    for e in elements:
        if e.out or e.named or not (e.name == "main" or (e.name == "article" and e.mass > plain)):
            continue
        up = e.parent
        while up is not None and up.named not in REMARKS and up not in holders:
            holders.add(up)
            up = up.parent
    for e in elements[1:]:
        if e.named and e not in holders:
            enough = e.mass * (1 - MOST) >= plain * MOST if e.named in REMARKS else 2 * e.mass > rest
            small = e.size and 2 * e.linked > e.size  # links are navigation, however many
            parent_named = e.parent.under and not e.parent.out  # within a part that stayed by its mass, names count again
            e.out = e.out or small or marked or not (enough and e.mass) or (parent_named and e.named in REMARKS)
        e.out = e.out or e.parent.out


def beside(top: Element, elements: list[Element], total: int) -> None:
    """Mark what stands beside the core and belongs to it, up to the element around all content and its title."""
    children: dict[Element, list[Element]] = {}
    for e in elements[1:]:
        children.setdefault(e.parent, []).append(e)
    limit, e = None, top
    while e is not None:
        limit, e = (e if e.name in ("article", "main") else limit), e.parent
    e = top
    while e.parent is not None:
        up = e.parent
        if e is limit and e.mass >= total:
            break
        others = [c for c in children[up] if c is not e and not c.out and c.size]
        taken = [c for c in others if 2 * c.linked <= c.size and (c.mass or c.name in TEXTUAL)]
        if e.mass >= total and not any(c.name in TEXTUAL for c in taken) and up.name in ("body", "html", ""):
            break
        for c in taken:
            c.inside = True
        e = up


def extract(page: str) -> str:
    """The main text: its blocks in page order, one to a line; empty if there is none.

    Unclosed tags are text, an unclosed comment, script or style goes up to the end. Each character is looked at a bounded
    number of times, so very long pages, deep nesting and broken markup take time in proportion to their length.
    """
    found, elements = leaves(page)
    judge_names([(e, t) for e, _, t in found if not e.out and t.strip()], elements)
    voters = [(e, t) for e, _, t in found if not e.out and t.strip()]
    if not voters:
        return ""
    total = weigh(voters, elements)
    holders = [e for e in elements if e.mass >= MOST * total]
    top = max(holders, key=lambda e: e.depth)
    named = [e for e in holders if e.name in ("article", "main")]
    if named:
        top = max(named, key=lambda e: e.depth)
    else:  # a paragraph alone is no article: what stands beside it belongs to it
        while top.parent is not None and (top.name in INLINE or top.name in ("p", "li", "td", "tr", "dd", "dt", "blockquote", "pre") or re.fullmatch("h[1-6]", top.name)):
            top = top.parent
    top.inside = True
    beside(top, elements, total)
    chain, e = set(), top  # bare text between the parts that stay, where it is content
    paths = content_paths(voters)
    while e.parent is not None:
        e = e.parent
        if e.path in paths:
            chain.add(e)
    for e in elements[1:]:
        links = not e.mass and 2 * e.linked > e.size and e.name not in INLINE and e.name not in TEXTUAL  # no selected path in it
        e.inside = (e.inside or e.parent.inside) and not links
    lines, last, parts = [], None, []

    def close() -> None:
        line = " ".join(html.unescape("".join(parts)).split())
        if line:
            lines.append(line)

    for e, block, text in found:
        if e.out or not (e.inside or e in chain):
            continue
        if block != last:
            close()
            parts, last = [], block
        parts.append(text)
    close()
    return "\n".join(lines)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row. A null page is an empty one, whose text is empty; ids and urls pass as they are.

    Each row is read by itself, so repeated rows and ids, null ids and ties give a row each; an empty table gives none.
    Pages are read whole, in time that grows with their length, whatever is malformed in them. Other columns of df are
    not looked at, so their names may be any.
    """
    common.bounded_batches(df.sparkSession)
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField(url_col, df.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches):
        for batch in batches:
            texts = [extract(p or "") for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in fields])

    return df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].alias("html")).mapInArrow(run, T.StructType(fields))
