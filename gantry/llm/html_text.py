"""Main text of web pages by composite text density.

A small parser builds the DOM. Every node gets its characters, link characters, tags and link tags; its composite
density is characters per tag, adjusted by the logarithm of how the characters outside links stand to those inside
and to the body's share. The subtree with the largest sum of child densities is the core; the smallest density on the
path from the core to the body is the threshold. What lies beside that path is searched for nodes that reach the
threshold, and of each the largest-sum subtree is kept; so is what stands between kept blocks and has few links, the
heading before them, and text that stands in the body itself.

Names only weigh in: text in elements for menus, footers, asides and forms counts as link text, `article` and `main`
elements count four times in the choice of the core, and a core within one grows to it. Within what density keeps,
elements that are boilerplate by such a name or by a whole class name are left out, unless they hold an article or, on
a page without articles, half of the text. A part of a compound name ("user-comments") is evidence of the same kind where it
stands outside articles (a few words count inside them too), but never against an element with half of the page's text. Where
the core is an article, what stands beside it without one is left out, but for a heading right before it. What is never shown (scripts, styles, hidden elements) is not parsed.

Cases: null, empty or text-free html gives an empty text; broken or cut markup is closed at the end; plain text without
tags is one block; nesting of any depth is walked without recursion.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import add_columns, column_bytes

#: Element, role and class names, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg select option canvas audio video".split())
NOISE = frozenset("nav footer aside form button dialog menu fieldset label".split())
ARTICLE = frozenset("article main".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside dialog menu caption".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption".split())
CHROME = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header site-header page-header masthead footer site-footer page-footer sidebar aside widget notice cookie cookies cookie-notice cookie-banner consent gdpr banner ad ads ad-banner advert adverts advertisement advertising sponsor sponsored promo promotion popup modal overlay newsletter newsletter-signup subscribe subscription signup login comment comments comment-list comments-area comment-section disqus discussion respond reply replies share sharing share-buttons social social-share related related-posts recommended pagination pager skip-link toolbar topbar copyright disclaimer".split()
)
#: Words that tell of boilerplate as a part of a compound class name or id, and those that do so even inside an article.
PARTS = "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pagination popup promo promotion related share sharing sidebar social sponsor sponsored subscribe subscription widget".split()
PARTS_INSIDE = "advert adverts advertisement comments disqus newsletter sponsored".split()
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I | re.S)
_SPACE = re.compile(r"\s+")
_PART, _PART_INSIDE = (re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words)})(?![^\s_-])") for words in (PARTS, PARTS_INSIDE))


class Node:
    __slots__ = ("article", "best", "block", "chars", "children", "density", "link_chars", "link_tags", "name", "noise", "parent", "tags", "total")

    def __init__(self, name: str, parent: Node | None, noise: int = 0):
        self.name, self.parent = name, parent
        #: 0, or 1 for boilerplate by its class, 2 by its element's or role's name, 3 by a part of a compound name.
        self.noise = noise
        self.block = name in BLOCK or parent is None
        self.children: list = []  # nodes and strings in page order
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.article = False  # holds an article, or is one
        self.best = self  # of the subtree, by the sum of child densities


def _attributes(name: str, attributes: str, inside: bool) -> tuple[bool, int]:
    """Whether an element is hidden, and its kind of noise; `inside` an article a header is part of the text."""
    noise = 2 if name in NOISE or (name == "header" and not inside) else 0
    if not attributes.strip():
        return False, noise
    for m in _NAMES.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True, noise
        if name in ("body", "html") or name in ARTICLE:
            continue
        if key == "role" and value in ROLES:
            noise = 2
        elif key in ("class", "id") and not noise:
            noise = 1 if not CHROME.isdisjoint(value.split()) else 3 if (_PART_INSIDE if inside else _PART).search(value) else 0
    return False, noise


def parse(page: str) -> Node:
    """The tree of a page; text is decoded, what is never shown is left out."""
    root = Node("#root", None)
    here, at, end = root, 0, len(page)
    open_names: dict[str, int] = {}
    hidden: Node | None = None

    def close(upto: Node) -> None:
        nonlocal here, hidden
        while True:
            node = here
            if node is root:
                return
            open_names[node.name] -= 1
            here = node.parent
            if node is hidden:
                hidden = None
            if node is upto:
                return

    def find(names: frozenset | set, stop: frozenset | set) -> Node | None:
        node = here
        while node is not root:
            if node.name in names:
                return node
            if node.name in stop:
                return None
            node = node.parent
        return None

    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and hidden is None:
            here.children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if open_names.get(name):
                close(find({name}, frozenset()))
            continue
        if name in CLOSES_P and open_names.get("p") and (p := find({"p"}, {"table", "button"})):
            close(p)
        if name == "li" and open_names.get("li") and (li := find({"li"}, {"ul", "ol", "menu"})):
            close(li)
        elif name in ("dt", "dd") and (d := find({"dt", "dd"}, {"dl"})):
            close(d)
        elif name in ("td", "th", "tr") and (d := find({"td", "th"} if name != "tr" else {"tr"}, {"table"})):
            close(d)
        if name in RAW and not m[3].endswith("/"):
            closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        if name == "head":
            closing = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
            if closing:
                at = closing.start() if closing[0][:2] != "</" else closing.end()
                continue
        gone, noise = _attributes(name, m[3], any(open_names.get(x) for x in ARTICLE))
        node = Node(name, here, noise)
        if hidden is None and not gone:
            here.children.append(node)
        if name in VOID or m[3].endswith("/"):
            continue
        if gone and hidden is None:
            hidden = node
        open_names[name] = open_names.get(name, 0) + 1
        here = node
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in node.children if isinstance(x, Node))
    return out


def _plain_length(text: str) -> int:
    return len(text) - sum(map(str.isspace, text)) if len(text) < 64 else len("".join(text.split()))


def weigh(root: Node, names: bool = True) -> list[Node]:
    """Counts, composite density and the sum of child densities for every node."""
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars += sum(_plain_length(x) for x in node.children if not isinstance(x, Node))
        node.tags += 1
        node.article |= node.name in ARTICLE and node.chars > 0
        if node.parent is not None:
            node.parent.chars, node.parent.tags, node.parent.article = node.parent.chars + node.chars, node.parent.tags + node.tags, node.parent.article or node.article
    body = next((n for n in nodes if n.name == "body"), root)
    for node in nodes:  # noise that holds an article is none, and on pages without articles what holds half of the text
        if node.noise and (not names or node.article or ((node.noise == 3 or not body.article) and 2 * node.chars >= body.chars)):
            node.noise = 0
    for node in reversed(nodes):
        if node.name == "a" or node.noise >= 2:
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            node.parent.link_chars, node.parent.link_tags = node.parent.link_chars + node.link_chars, node.parent.link_tags + node.link_tags
    of_body = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if not node.chars or node.noise >= 2:
            continue
        plain = max(node.chars - node.link_chars, 1)
        base = math.log(node.chars * node.link_chars / plain + of_body * node.chars + math.e)
        ratio = node.chars / max(node.link_chars, 1) * node.tags / max(node.link_tags, 1)
        node.density = node.chars / node.tags * math.log(max(ratio, 1.0)) / base
    for node in nodes:
        if node.parent is not None:
            node.parent.total += node.density
    for node in reversed(nodes):
        up = node.parent
        if up is not None and (node.best.total, node.best.density) >= (up.best.total, up.best.density) and (up.best is not up or (node.best.total, node.best.density) > (up.total, up.density)):
            up.best = node.best
    return nodes


def kept(root: Node, nodes: list[Node]) -> set[int]:
    """Ids of the nodes whose whole text is kept."""
    with_text = [n for n in nodes if n.chars]
    if not with_text:
        return set()
    body = next((n for n in nodes if n.name == "body"), root)
    core = max(with_text, key=lambda n: (n.total * (4 if n.name in ARTICLE else 1), n.density))
    node = core
    while node is not None:  # the outermost article around the core
        core, node = (node if node.name in ARTICLE else core), node.parent
    path, node = [], core
    while node is not None and node is not body and node is not root:
        path.append(node)
        node = node.parent
    out = {id(core)} if path else set()
    # where the body itself is the core, all of its blocks are but those that are mostly links
    threshold = min((n.density for n in path), default=0.0)
    above = {id(n) for n in path} | {id(body), id(root)}
    search = [n for n in nodes if id(n) in above or n.name == "html"]
    alone = bool(path) and core.name in ARTICLE
    for parent in search:
        if parent is core and id(core) in out:
            continue
        for child in (x for x in parent.children if isinstance(x, Node) and id(x) not in above and x.name != "html"):
            stack = [child]
            while stack:
                x = stack.pop()
                if not x.chars or (alone and not x.article):
                    continue
                if x.block and (x.density >= threshold > 0 or (not path and 2 * x.link_chars < x.chars)):
                    best = x.best if path else x
                    out.add(id(best))
                    if best is x:
                        continue
                stack.extend(c for c in x.children if isinstance(c, Node))
    for parent in search:
        _fill(parent, out, above)
    return out


def _has(node: Node, ids: set[int]) -> bool:
    return any(id(n) in ids for n in _order(node))


def _fill(parent: Node, out: set[int], above: set[int]) -> None:
    """What stands between kept children with few links, and a heading right before them, is kept too."""
    blocks = [x for x in parent.children if isinstance(x, Node) and x.block and x.chars]
    at = [k for k, x in enumerate(blocks) if id(x) in above or _has(x, out)]
    if not at:
        return
    there, plain = set(at), lambda x: not x.noise and 2 * x.link_chars < x.chars
    for k, x in enumerate(blocks):
        if k not in there and plain(x) and (at[0] < k < at[-1] or (k == at[0] - 1 and 2 * sum(n.chars for n in _order(x) if n.name in HEADING) >= x.chars)):
            out.add(id(x))


def _blocks(root: Node, keep: set[int]) -> list[str]:
    """Text of each kept block, white space as one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                out.append(text)
            run.clear()

    loose = lambda x: x is root or x.name in ("body", "html")
    stack: list = [(root, False)]
    while stack:
        x, on = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if on:
                run.append(x)
        elif x.name == "br":
            run.append(" ")
        elif not x.noise:
            on = on or id(x) in keep
            if x.block:
                flush()
                stack.append((None, False))
            for c in reversed(x.children):
                # text of the body itself, bare or in inline elements that aren't links, is always kept
                stack.append((c, on or (loose(x) and (isinstance(c, str) or (not c.block and 2 * c.link_chars < c.chars)))))
    flush()
    return out


def main_text(page: str, names: bool = True) -> str:
    """The text of a page; without `names`, by density alone."""
    root = parse(page)
    return "\n".join(_blocks(root, kept(root, weigh(root, names))))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `text` and `n_chars` in place of columns of these names."""

    def make():
        def run(batch: pa.RecordBatch) -> list:
            texts = [main_text(x.decode("utf-8", "replace")) for x in column_bytes(batch, html)]
            return [[x.encode("utf-8", "replace").decode() for x in texts], [len(x) for x in texts]]

        return run

    return add_columns(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make, html)


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.col("n_chars").cast("long").alias("n_chars"))
