"""Main text of web pages by tree scoring.

A page becomes a tree (missing end tags implied, unknown ones ignored).  What is never part of an article goes first:
scripts, forms, navigation, asides, footers, hidden parts, and elements whose class, id or role names such a part.
Every block with text of its own then passes points to its ancestors: one, one for each comma, and up to three for
its length; half as many at each further level.  An element's points are discounted by the share of its text that
stands in links, and the best element is the container.  What holds it (article, main part, wrappers) stays with it, and
so do its siblings if they are no lists of links (``kept_nodes``).  All blocks of what stays are written in page order:
character references decoded, white space inside a block one space, blocks joined by a line break, nothing else dropped.

Defined cases: null or empty html, and pages with no text, give an empty text; a page without any scored container
gives all text that is left; repeated rows give repeated results; nesting of any depth and unclosed quotes, comments
and tags are read in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tandem.llm.storage import ready

# Fixed lists: names of elements in HTML, and words that name parts of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp svg math object".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog fieldset option label datalist audio video canvas map".split()) | RAW
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("html body article main section div center table".split())
ENDS_ITSELF = {"li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr", "td", "th"]),
               "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPE = frozenset("table td th ul ol dl body html article section div main".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar sidebars aside rail "
                      "comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices alert popup "
                      "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
                      "breadcrumb breadcrumbs crumbs menu nav navbar navigation topnav footer foot header masthead toolbar pager pagination "
                      "widget form search skip print legal copyright outbrain taboola hidden".split())
GOOD_WORDS = frozenset("article body content entry main post story text page".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
NEVER_BAD = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())

WRAPPERS = CONTAINERS - {"html", "body", "article", "main"}
BESIDE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl table figure details".split())
LINKED = WRAPPERS | frozenset("ul ol dl p header hgroup".split())
PROSE = frozenset("p pre blockquote".split())
#: Share of link text up to which a part belongs to the text, and from which it is a list of links.
FEW_LINKS, MANY_LINKS = 0.25, 0.5

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                   r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                   r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>|(?P<text>[^<]++|<)""", re.S)
NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])""", re.I)
WORD = re.compile(r"[a-z0-9]+")
COMMA = re.compile("[,،，、]")
_closers: dict[str, re.Pattern] = {}


def _closer(tag: str) -> re.Pattern:
    if tag not in _closers:
        _closers[tag] = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)
    return _closers[tag]


class Tree:
    """Nodes by number, parents before children; ``content`` holds texts (str) and children (int) in page order."""

    def __init__(self) -> None:
        self.tag, self.parent, self.content, self.bonus = ["#root"], [-1], [[]], [0.0]

    def add(self, tag: str, parent: int, bonus: float) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.content.append([])
        self.bonus.append(bonus)
        self.content[parent].append(len(self.tag) - 1)
        return len(self.tag) - 1


def judge(tag: str, rest: str, in_article: bool) -> tuple[bool, float]:
    """Is the element no part of an article; else the points that its names give it."""
    if tag in DROPPED:
        return True, 0.0
    if tag == "header" and not in_article:
        return True, 0.0
    bonus = 20.0 if tag in ("article", "main") else 0.0
    if not rest.strip():
        return False, bonus
    words: list[str] = []
    for name, a, b, c in NAMED.findall(rest):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return tag not in ("html", "body"), bonus
        if name == "role" and value in BAD_ROLES and tag not in NEVER_BAD:
            return True, 0.0
        if name in ("class", "id"):
            words += WORD.findall(value)
    good = any(w in GOOD_WORDS for w in words)
    if tag not in NEVER_BAD and any(w in BAD_WORDS for w in words) and not (good and tag in ("div", "section") and words[0] in GOOD_WORDS):
        return True, 0.0
    return False, bonus + (5.0 if good else 0.0)


def parse(html: str) -> Tree:
    """The tree without what is no part of an article."""
    tree = Tree()
    open_ = [0]  # numbers of the open nodes
    names = ["#root"]
    gone = 0  # open elements inside an element that goes
    gone_names: list[str] = []
    count: dict[str, int] = {}  # open elements by name
    at, n = 0, len(html)

    def close(to: int) -> None:
        while len(open_) > to:
            count[names.pop()] -= 1
            open_.pop()

    def last(tag: str) -> int:
        k = len(names) - 1
        while names[k] != tag:
            k -= 1
        return k

    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if not gone:
                tree.content[open_[-1]].append(text)
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        ends, rest = (m["end"], m["rest"]) if m["tag"] else (m["end2"], m["rest2"])
        if ends:
            if gone:
                if tag in gone_names:
                    while gone_names.pop() != tag:
                        pass
                    gone = len(gone_names)
                elif tag in ("body", "html", "article", "main") and count.get(tag):
                    gone_names, gone = [], 0
                    close(last(tag))
            elif count.get(tag):
                close(last(tag))
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                stop = _closer(tag).search(html, at)
                at = stop.end() if stop else n
            continue
        if tag in VOID:
            if not gone:
                if tag == "br":
                    tree.content[open_[-1]].append(" ")
                elif tag == "hr":
                    tree.add("hr", open_[-1], 0.0)
            continue
        if gone:
            if tag == "body" and "head" in gone_names:
                gone_names, gone = [], 0
            else:
                gone_names.append(tag)
                gone = len(gone_names)
                continue
        if tag in BLOCKS and count.get("p"):
            k = last("p")
            if not any(t in SCOPE for t in names[k + 1:]):
                close(k)
        if tag in ENDS_ITSELF:
            for k in range(len(names) - 1, 0, -1):
                if names[k] in ENDS_ITSELF[tag]:
                    close(k)
                    if tag != "tr" or names[-1] not in ("td", "th", "tr"):
                        break
                elif names[k] in SCOPE:
                    break
        bad, bonus = judge(tag, rest, count.get("article", 0) > 0)
        if bad:
            gone_names, gone = [tag], 1
            continue
        open_.append(tree.add(tag, open_[-1], bonus))
        names.append(tag)
        count[tag] = count.get(tag, 0) + 1
    return tree


class Scored:
    """Points and link density of every node; characters of text and of link text below it."""

    def __init__(self, tree: Tree):
        n = len(tree.tag)
        size, linked, own, commas = [0] * n, [0] * n, [0] * n, [0] * n
        home = [0] * n  # the block that a node's inline text belongs to
        in_link = [False] * n
        for i in range(1, n):
            up = tree.parent[i]
            home[i] = i if tree.tag[i] in BLOCKS else home[up]
            in_link[i] = in_link[up] or tree.tag[i] == "a"
        for i in range(n - 1, -1, -1):
            for x in tree.content[i]:
                if isinstance(x, str):
                    k = len(x.strip())
                    if k:
                        size[i] += k
                        linked[i] += k if in_link[i] else 0
                        own[home[i]] += k
                        commas[home[i]] += len(COMMA.findall(x))
            if i:
                size[tree.parent[i]] += size[i]
                linked[tree.parent[i]] += linked[i]
        self.size, self.linked = size, linked
        self.density = [l / s if s else 0.0 for l, s in zip(linked, size)]
        points = list(tree.bonus)
        for i in range(n):
            if own[i]:
                part = (1.0 + commas[i] + min(3.0, own[i] / 100)) * (1 - self.density[i])
                up = i
                while up > 0 and part > 1e-3:
                    if tree.tag[up] in CONTAINERS:
                        points[up] += part
                        part /= 2
                    up = tree.parent[up]
        self.points = [p * (1 - d) if s else 0.0 for p, d, s in zip(points, self.density, size)]


def above(tree: Tree, node: int) -> list[int]:
    """The node and its ancestors, without the root of the tree."""
    out = []
    while node > 0:
        out.append(node)
        node = tree.parent[node]
    return out


def link_blocks(tree: Tree, told: Scored, up: int, path: set[int]) -> set[int]:
    """Blocks below ``up``, beside the container's path, that are mostly links."""
    found, stack = set(), [x for x in tree.content[up] if not isinstance(x, str) and x not in path]
    while stack:
        x = stack.pop()
        if tree.tag[x] in LINKED and told.density[x] >= MANY_LINKS:
            found.add(x)
        else:
            stack += [c for c in tree.content[x] if not isinstance(c, str)]
    return found


def has_prose(tree: Tree, told: Scored, node: int) -> bool:
    """A paragraph that is a sentence or long stands below the node."""
    stack = [node]
    while stack:
        i = stack.pop()
        if tree.tag[i] in PROSE and told.density[i] < FEW_LINKS:
            text = " ".join(blocks(tree, [i]))
            if len(text) > 80 or text.endswith((".", "!", "?")):
                return True
            continue
        stack += [x for x in tree.content[i] if not isinstance(x, str)]
    return False


def kept_nodes(tree: Tree) -> tuple[list[int], set[int]]:
    """What is written, in page order, and what is left out below it.

    From the best container the way goes up to the article that holds it, or else to the main part, or else through all
    wrappers that are no lists of links.  So a long section does not win over its own article, whatever its length.
    Beside it stay, by their link density and not by their share of the points, headings, paragraphs, lists, tables and
    containers of prose; beside an article other articles of at least a fifth of its points.
    """
    told = Scored(tree)
    points, density = told.points, told.density
    able = [i for i in range(1, len(tree.tag)) if points[i] > 0 and tree.tag[i] in CONTAINERS]
    if not able:
        return [0], set()
    best = max(able, key=lambda i: (points[i], -i))
    path = above(tree, best)
    articles = [i for i in path if tree.tag[i] == "article"]
    if articles:
        root = articles[-1]
        level = [x for x in tree.content[tree.parent[root]] if not isinstance(x, str)]
        least = max(points[root] * 0.2, 3.0)
        kept = [x for x in level if x == root or tree.tag[x] == "article" and points[x] >= least]
        before = level[level.index(root) - 1] if level.index(root) else -1
        if before > 0 and tree.tag[before] == "h1" and "h1" not in {tree.tag[i] for i in below(tree, root)}:
            kept.insert(0, before)  # the title stands right before an article without one
        return kept, set()
    mains = [i for i in path if tree.tag[i] == "main"]
    root, dropped, on_path = best, set(), set(path)
    size = linked = 0  # of the lists of links that are left out
    for up in path[1:]:
        if root == (mains[-1] if mains else -1):
            break
        found = link_blocks(tree, told, up, on_path)
        size, linked = size + sum(told.size[x] for x in found), linked + sum(told.linked[x] for x in found)
        if not mains and (tree.tag[up] not in WRAPPERS or told.linked[up] - linked >= FEW_LINKS * (told.size[up] - size)):
            break
        root = up
        dropped |= found
    kept = []
    for x in tree.content[tree.parent[root]]:
        if isinstance(x, str):
            continue
        beside = not mains and density[x] < FEW_LINKS and (tree.tag[x] in BESIDE or tree.tag[x] in WRAPPERS and has_prose(tree, told, x))
        if x == root or beside:
            kept.append(x)
    return kept, dropped


def below(tree: Tree, root: int) -> list[int]:
    out, stack = [], [root]
    while stack:
        i = stack.pop()
        out.append(i)
        stack += [x for x in tree.content[i] if not isinstance(x, str)]
    return out


def blocks(tree: Tree, roots: list[int], dropped: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks below the roots, in page order, without what is dropped."""
    out: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                out.append(text)
            piece.clear()

    for root in roots:
        flush()
        stack = [(root, iter(tree.content[root]))]
        while stack:
            node, left = stack[-1]
            for x in left:
                if isinstance(x, str):
                    piece.append(x)
                    continue
                if x in dropped:
                    flush()
                    continue
                if tree.tag[x] in BLOCKS:
                    flush()
                stack.append((x, iter(tree.content[x])))
                break
            else:
                stack.pop()
                if tree.tag[node] in BLOCKS:
                    flush()
        flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = parse(html)
    return "\n".join(blocks(tree, *kept_nodes(tree)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars."""
    ready(pages.sparkSession)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(_rows, "page_id long, url string, text string, n_chars long")


def op8(pages: DataFrame) -> DataFrame:
    return extract(pages)
