"""Main text of web pages by composite text density.

For every element the density is its characters per tag, adjusted for links: for C characters and T tags, of which LC
and LT belong to links, and a body of C_b characters with LC_b in links, it is

    C / T * log(C / LC * T / LT) / log(ln(C * LC / (C - LC) + LC_b * C / C_b + e) + e - 1)

with counts of 0 taken as 1 where they divide (e - 1 keeps the base's logarithm above 0 on pages without links). The
density sum of an element is the sum of its children's densities, where text of its own counts as one more child, of the
element's density; the element of the largest sum is the core of the article, and the smallest density on its path from the
body is the threshold. If the core lies in an article or
main element, that element is the content, with the page's other elements of that kind whose density reaches the threshold; if
it holds such elements, they are. Otherwise the content is the core and, along its path, every sibling subtree
whose density reaches the threshold.

Elements that cannot be the article (scripts, forms, navigation, and those whose class, id or role says so) are left
out beforehand; a form, class or id does not leave out what holds the heading, an article or most of the text. Pages are
parsed one at a time within tasks, in time that grows with their length whatever they hold; no row moves.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends the open elements of its row, up to the nearest of the scopes.
ENDS = {t: frozenset({"p"}) for t in BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}} | {
    "li": frozenset({"p", "li"}), "dt": frozenset({"p", "dt", "dd"}), "dd": frozenset({"p", "dt", "dd"}), "td": frozenset({"p", "td", "th"}), "th": frozenset({"p", "td", "th"}),
    "tr": frozenset({"p", "td", "th", "tr"}), "tbody": frozenset({"p", "td", "th", "tr", "thead", "tbody"}), "tfoot": frozenset({"p", "td", "th", "tr", "thead", "tbody"}), "option": frozenset({"option"}), "body": frozenset({"head"}),
}
SCOPES = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"})}
SCOPE = frozenset("table ul ol dl menu button body html article section div main aside nav header footer form blockquote".split())
#: Elements that are never article text.
NEVER = RAW | frozenset("head nav footer aside form button select option input svg math canvas audio video object map menu dialog datalist fieldset label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status tablist".split())
#: Words of a class or an id that tell of page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner promo promotion sponsor sponsored sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager skip hidden sponsorship outbrain taboola rail paywall".split()
)
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
PLAIN = re.compile(r"[^>\"']*+")
CLOSERS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("chars", "density", "density_sum", "kids", "link_chars", "link_tags", "parent", "tag", "tags", "weak")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids, self.weak = tag, parent, [], 0


#: What furniture() tells: left out at once, or unless spare() finds the article in it (by a whole class word, by a part of one or as a form).
OUT, WORD, PART = 3, 2, 1


def furniture(tag: str, attrs: str, within_article: bool) -> int:
    if tag in NEVER and tag != "form" or tag == "header" and not within_article:
        return OUT
    found = PART if tag == "form" else 0
    for name, *values in ATTR.findall(attrs or ""):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            words = {w.lower() for w in WORDS.findall("".join(values))}
            if words & FURNITURE or "header" in words and not within_article and tag in ("div", "section"):
                if tag not in ("html", "body", "article", "main") or bool(words & {"comment", "comments", "reply", "ad", "sponsored", "related", "promo"}) and tag == "article":
                    found = max(found, WORD if set(value.split()) & (FURNITURE | {"header"}) else PART)
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return OUT
    return found


def spare(root: Node) -> None:
    """Takes furniture by class or as form out of the tree, but not what holds an h1, an article or main, or most of the text outside links.

    Text alone does not spare an element named by a whole word, such as comments, if the page has a heading outside furniture.
    """
    order, pending = [], [(root, False, False)]
    headed = False
    while pending:
        n, link, inside = pending.pop()
        link, inside = link or n.tag == "a", inside or n.weak > 0
        headed |= n.tag in ("h1", "h2", "h3") and not inside
        n.chars = 0 if link else sum(len(k.strip()) for k in n.kids if not isinstance(k, Node))
        n.tags = int(n.tag in ("h1", "article", "main") and not n.weak)  # for now, whether it holds one of these
        order.append(n)
        pending += [(k, link, inside) for k in n.kids if isinstance(k, Node)]
    for n in reversed(order[1:]):
        n.parent.chars += n.chars
        n.parent.tags |= n.tags
    for n in order:
        n.kids = [k for k in n.kids if not isinstance(k, Node) or not k.weak or k.tags or 2 * k.chars > root.chars and not (k.weak == WORD and headed)]


class Tags:
    """Where the tags of a page end: at the first > outside quotes, or at the first at all if quotes stay open."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.open: set[int] = set()  # quotes after which no > is outside quotes

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at `at`; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        begin, met = at, []
        while True:
            at = PLAIN.match(self.page, at).end()
            if at == len(self.page) or at in self.open:
                break
            if (c := self.page[at]) == ">":
                return at
            met.append(at)
            if at == self.last[c]:
                break
            at = self.page.find(c, at + 1) + 1
        self.open.update(met)
        return self.page.find(">", begin)


def parse(page: str) -> Node:
    """The tree of the elements that may hold the article; texts are strings among an element's kids."""
    root = node = Node("html", None)
    stack: list[tuple[str, Node, bool]] = []  # open elements; for those left out, the node that was current before
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
    left_out, articles, at, tags = 0, 0, 0, Tags(page)

    def close(k: int) -> None:
        nonlocal node, left_out, articles
        for tag, before, out in reversed(stack[k:]):
            node = before
            left_out -= out
            articles -= tag in ("article", "main")
            places[tag].pop()
        del stack[k:]

    def text(s: str) -> None:
        if s and not left_out:
            node.kids.append(html.unescape(s) if "&" in s else s)

    def ended(tag: str, ends: frozenset[str]) -> None:
        """Closes the first open element of `ends` within the nearest scope."""
        scope = max((places[t][-1] for t in SCOPES.get(tag, SCOPE) if places.get(t)), default=-1)
        inner = [p[i] for t in ends if (p := places.get(t)) and (i := bisect_right(p, scope)) < len(p)]
        if inner:
            close(min(inner))

    def opened(tag: str, attrs: str) -> None:
        nonlocal node, left_out, articles
        if ends := ENDS.get(tag):
            ended(tag, ends)
        if tag in VOID:
            if not left_out:
                node.kids.append(" " if tag == "br" else Node(tag, node))
        elif tag != "html" and not (attrs.endswith("/") and tag not in BLOCKS and tag != "a"):
            out = furniture(tag, attrs, bool(articles))
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, node, out == OUT))
            articles += tag in ("article", "main")
            left_out += out == OUT
            if not left_out:
                new = Node(tag, node)
                new.weak = out
                node.kids.append(new)
                node = new

    while (lt := page.find("<", at)) >= 0:
        begin = at
        if page.startswith("<!--", lt):
            at = page.find("-->", lt + 4)
            at = at + 3 if at >= 0 else len(page)
            text(page[begin:lt])
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            at = end + 3 if end >= 0 else len(page)
            text(page[begin:lt])
            text(page[lt + 9 : end if end >= 0 else len(page)])
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1 or len(page)
            text(page[begin:lt])
        elif page.startswith("</", lt) and (m := NAME.match(page, lt + 2)):
            at = page.find(">", m.end()) + 1 or len(page)
            text(page[begin:lt])
            if open_ := places.get(m[0].lower()):
                close(open_[-1])
        elif (m := NAME.match(page, lt + 1)) and (end := tags.end(m.end())) >= 0:
            at = end + 1
            text(page[begin:lt])
            tag = m[0].lower()
            if tag in RAW:
                closer = CLOSERS[tag].search(page, at)
                at = closer.end() if closer else len(page)
            else:
                opened(tag, page[m.end() : end])
        else:  # no tag: the text goes on
            at = lt + 1
            text(page[begin:at])
    text(page[at:])
    spare(root)
    return root


def measure(root: Node) -> None:
    """Counts of every element, then its density."""
    order, pending = [], [root]
    while pending:
        n = pending.pop()
        order.append(n)
        pending += [k for k in n.kids if isinstance(k, Node)]
    for n in reversed(order):
        n.chars = n.link_chars = n.tags = n.link_tags = 0
        for k in n.kids:
            if isinstance(k, Node):
                n.chars += k.chars
                n.link_chars += k.link_chars
                n.tags += k.tags + 1
                n.link_tags += k.link_tags + (k.tag == "a")
            else:
                n.chars += len(k.strip())
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
    links = root.link_chars / max(1, root.chars)
    for n in order:
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c * n.link_chars / max(1, c - n.link_chars) + links * c + math.e)
        n.density = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base + math.e - 1) if c else 0.0


def topmost(core: Node, tag: str) -> list[Node]:
    """The elements of a tag below the core that have text and lie in no other of them, in page order."""
    out, pending = [], [k for k in reversed(core.kids) if isinstance(k, Node)]
    while pending:
        n = pending.pop()
        if n.tag == tag and n.chars:
            out.append(n)
        elif n.chars:
            pending += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out


def content(root: Node) -> list[Node]:
    """The elements whose texts are the article, in page order."""
    measure(root)
    core, most, pending = root, -1.0, [root]
    while pending:
        n = pending.pop()
        nodes = [k for k in n.kids if isinstance(k, Node)]
        own = any(not isinstance(k, Node) and k.strip() for k in n.kids)
        n.density_sum = sum(k.density for k in nodes) + (n.density if own else 0.0)
        if n.density_sum > most:
            core, most = n, n.density_sum
        pending += reversed(nodes)
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for kind in ("article", "main"):
        if inside := [n for n in path if n.tag == kind]:
            wide = inside[-1]  # an article may be split over several elements, wherever they lie
            return [k for k in topmost(root, kind) if k is wide or k.density >= threshold > 0]
    for kind in ("article", "main"):  # articles within the core, also short ones beside longer text
        if within := topmost(core, kind):
            return within
    keep, on_path, pending = [], set(map(id, path)), [root]
    while pending:
        n = pending.pop()
        if n is core or id(n) not in on_path:
            if n is core or n.density >= threshold > 0:
                keep.append(n)
        else:
            pending += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return keep


def blocks(n: Node) -> list[str]:
    """The texts of the blocks below an element: white space becomes one space, and empty blocks are none."""
    out, run = [], []

    def flush() -> None:
        if s := " ".join("".join(run).split()):
            out.append(s)
        run.clear()

    pending: list[Node | str | None] = [n]
    while pending:
        k = pending.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            run.append(k)
        else:
            if k.tag in BLOCKS:
                flush()
                pending.append(None)
            pending += reversed(k.kids)
    flush()
    return out


def main_text(page: str | None) -> str:
    root = parse(page or "")
    return "\n".join(b for n in content(root) for b in blocks(n))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages.

    A null or empty html gives an empty text, and so does a page without text. Null ids and urls stay null; repeated rows
    are extracted each; an empty table gives an empty result. Other columns are not read.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
