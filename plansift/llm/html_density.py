"""Main text of web pages by composite text density.

Of every node of the page's tree the characters, the characters within links,
the tags and the link tags below it are counted. Its density is the characters
per tag, scaled by a logarithm whose base grows with the share of link text,
so that lists of links come out low. The densities of a node's children are
summed and the node with the greatest sum is the body of the text, whatever its
tag. The least density on the path from the page's body to it is the threshold
that a neighbouring subtree must reach to be read with it. Where such a
neighbour shows that the text goes on beside it, or within an article or main
part, what is around is read whole as long as that has half the density at
least (:func:`main_nodes`).

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are taken out of the tree first, by tag, role or class; by
role and class only blocks, never tags within running text, and by class not
where a part holds the article or most of the page's text.

Defined cases: null html is the empty page; a page without text gives the
empty string; unclosed and crossing tags are repaired; pages without any tag
are text; rows that repeat an id give a row each; an empty table gives no rows;
extra columns are never read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.rows import map_columns

#: Comments, declarations, tags with quoted attributes, tags with stray quotes, and a bare ``<``. No part can match
#: in two ways, so a tag that never ends costs one pass.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>\"[^\"]*+\"|'[^']*+'|[^<>\"']++)*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w=\"'-])(hidden)(?![\w=-])")

# Tags of HTML by what they are.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style textarea title xmp noembed noframes".split()}
BLOCK = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that may be the body of a text; a paragraph or what stands in one is a part of it.
CONTAINERS = {"#root", "html", "body", "article", "main", "div", "section", "blockquote", "center", "td", "pre", "details"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Tags whose start ends an open paragraph.
ENDS_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "option", "legend", "summary"}
#: Tags that end an open tag of the same kind within the container named.
ENDS_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Tags that never hold text of the article.
OUT = set(
    "head script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas map audio video dialog menu datalist".split()
)
IN_HEAD = set("head title meta link base script style noscript template".split())
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "note"}
# Words of class names and ids that tell what a part is.
OUT_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsors sponsored promo promos promotion promotions banner banners sidebar sidebars aside "
    "nav navbar navigation navigator subnav menu menus submenu breadcrumb breadcrumbs crumbs footer footers foot masthead topbar cookie cookies consent gdpr notice notices alert alerts disclaimer "
    "newsletter subscribe subscription signup login share sharing social related recommend recommended recommendation recommendations comment comments commentlist disqus reply replies respond responses "
    "pagination pager toolbar popup popups modal modals overlay overlays widget widgets skip skiplink search searchform copyright tags tagcloud taglist taglinks siteheader pageheader globalheader".split()
)
#: Words that may stand beside one of those in one name.
BESIDE_WORDS = set(
    "box boxes block blocks list container wrapper wrap section area bar link links post posts article articles item items form top bottom left right main site page global primary secondary "
    "inner outer content header group panel button buttons icon icons cloud thread text message byline toc entry entries blog user users reader readers mobile desktop module component region view "
    "unit slot zone title heading count counter holder frame strip column col row sticky fixed floating inline story news stories print email mail site skip a the of for and by to in".split()
)
#: Those of parts that may well hold most of a page's text.
NEVER_MAIN = re.compile(r"comment|disqus|repl(?:y|ies)|respon|cookie|consent|gdpr|notice|alert|newsletter|subscri|popup|modal|overlay", re.I)
HEADER_NAMES = {"header", "top", "logo"}
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Tags that a class name never takes out.
KEPT = {"html", "body", "article", "main"}


class Node:
    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "marked", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0
        self.marked = 0


#: What :func:`_unwanted` says of a tag: out by its class, or so and never a page's main part, or out in any case.
BY_CLASS, PART, GONE = 1, 2, 3


def _names_out(name: str) -> bool:
    """Whether a class name or id tells a part that is not the article, as ``sidebar`` or ``post-comments`` and not ``has-sidebar`` or ``related-work``."""
    words = [w for w in re.split(r"[\W_]+", HUMP.sub("-", name).lower()) if w and not w.isdigit()]
    plain = [w.rstrip("0123456789") for w in words]
    return "".join(plain) in OUT_WORDS or any(w in OUT_WORDS for w in plain) and all(w in OUT_WORDS or w in BESIDE_WORDS for w in plain)


def _unwanted(tag: str, attributes: str, within: bool) -> int:
    """What a start tag tells of its part; ``within`` if it is inside of an article or main part."""
    if tag in OUT or tag == "header" and not within:
        return GONE
    marked = 0
    if not attributes:
        return marked
    block = tag in BLOCK
    for m in ATTRIBUTE.finditer(attributes):
        if m[5]:
            return GONE
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return GONE
        if not block:
            continue
        if name == "role" and value.lower() in OUT_ROLES and tag not in ("html", "body"):
            return GONE
        if name == "aria-hidden" and value.lower() == "true" or name == "itemprop" and value.lower() == "comment":
            return GONE
        if name in ("class", "id"):
            own = value.split()
            if tag not in KEPT and not within and any(w.lower() in HEADER_NAMES for w in own):
                marked = max(marked, BY_CLASS)
            own = [w for w in own if _names_out(w)]
            if own and (tag not in KEPT or tag == "article" and re.search(r"comment|reply|respon", value, re.I)):
                marked = max(marked, PART if any(map(NEVER_MAIN.search, own)) else BY_CLASS)
    return marked


def _prune(root: Node) -> None:
    """Take out what is marked by class, but not what holds the page's article or main part or most of its text.

    The amount of text counts only where no article or main part is beside.
    Within an article, and for comments and notices beside one, an article
    held is no reason to stay; nor, for those, is the amount of text.
    """
    nodes = _each(root)
    if not any(n.marked for n in nodes):
        return
    within, gone = {id(root): False}, {}
    for n in nodes:
        for c in n.children:
            if isinstance(c, Node):
                within[id(c)] = within[id(n)] or n.tag == "article" and not n.marked
    held = {id(n): 0 for n in nodes}
    for n in reversed(nodes):
        held[id(n)] += n.tag in ("article", "main") and not n.marked
        if n.parent is not None:
            held[id(n.parent)] += held[id(n)]
    around = {id(root): 0}
    for n in nodes:
        for c in n.children:
            if isinstance(c, Node):
                around[id(c)] = around[id(n)] + (n.tag in ("article", "main") and not n.marked)
    all_held = held[id(root)]
    stays, alone = {}, {}
    for n in nodes:
        if n.marked:
            alone[id(n)] = held[id(n)] + around[id(n)] == all_held  # no article or main beside it
            stays[id(n)] = held[id(n)] > 0 and not within[id(n)] and n.tag != "article" and (n.marked == BY_CLASS or alone[id(n)])
    # text that counts: not that of parts that are out in any case
    chars = {id(n): 0 for n in nodes}
    for n in reversed(nodes):
        chars[id(n)] += sum(len(c.strip()) for c in n.children if not isinstance(c, Node))
        if n.parent is not None and not (n.marked == PART and not stays[id(n)]):
            chars[id(n.parent)] += chars[id(n)]
    for n in nodes:
        gone[id(n)] = n.parent is not None and gone[id(n.parent)] or bool(n.marked) and not (stays[id(n)] or n.marked == BY_CLASS and alone[id(n)] and not within[id(n)] and 2 * chars[id(n)] > chars[id(root)])
    for n in nodes:
        n.children = [c for c in n.children if not (isinstance(c, Node) and gone[id(c)])]


class _Open:
    """The open nodes from the root on, and how many there are of each tag, so that no question costs a walk over all of them."""

    def __init__(self, root: Node):
        self.nodes, self.counts = [root], Counter()

    @property
    def last(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.counts[node.tag] += 1

    def pop(self) -> str:
        tag = self.nodes.pop().tag
        self.counts[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """Close the last open node of that tag and all within it."""
        while self.pop() != tag:
            pass

    def within(self) -> bool:
        return bool(self.counts["article"] or self.counts["main"])

    def close_same(self, tags: tuple[str, ...], holders: set[str]) -> None:
        """Close the last open node of those tags and all within it, unless one of the holders is open inside of it."""
        if any(self.counts[t] for t in tags):
            for k in range(len(self.nodes) - 1, 0, -1):
                at = self.nodes[k].tag
                if at in tags:
                    while len(self.nodes) > k:
                        self.pop()
                    return
                if at in holders:
                    return


#: Tags of which one ends another.
LIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


def parse(page: str) -> Node:
    """The tree of a page without what is unwanted; text nodes are strings with references decoded."""
    root = Node("#root", None)
    open_ = _Open(root)
    skip: list[str] = []  # open tags below an unwanted one
    skipped: Counter = Counter()
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not skip:
            open_.last.children.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        alone = attributes.endswith("/")
        if not tag:
            if m[0] == "<" and not skip:
                open_.last.children.append("<")
            continue
        if skip and not closing and (skip[0] == "head" and tag not in IN_HEAD or skip[0] in ("nav", "header") and tag in ("article", "main")):
            skip.clear()  # a tag that was never closed ends where something begins that it cannot hold
            skipped.clear()
        if skip:
            if tag in RAW and not closing:
                ends = RAW[tag].search(page, at)
                at = ends.end() if ends else end
            elif tag in VOID or alone:
                pass
            elif not closing:
                skip.append(tag)
                skipped[tag] += 1
            elif skipped[tag]:
                while (gone := skip.pop()) != tag:
                    skipped[gone] -= 1
                skipped[tag] -= 1
            elif tag in ("body", "html", "article", "main") and open_.counts[tag]:
                # an unwanted tag that was never closed ends with what holds it
                skip.clear()
                skipped.clear()
                open_.close(tag)
            continue
        if closing:
            if open_.counts[tag]:
                open_.close(tag)
            elif tag in ("br", "p"):
                open_.last.children.append(Node("br", open_.last))
            continue
        # what a start tag ends by itself
        if tag in ENDS_P:
            open_.close_same(("p",), BLOCK)
        if tag in ENDS_SAME:
            open_.close_same(LIKE.get(tag, (tag,)), ENDS_SAME[tag])
        if tag in RAW:
            ends = RAW[tag].search(page, at)
            at = ends.end() if ends else end
            continue
        marked = _unwanted(tag, attributes, open_.within())
        if marked == GONE:
            if tag not in VOID and not alone:
                skip.append(tag)
                skipped[tag] += 1
            continue
        node = Node(tag, open_.last)
        node.marked = marked
        open_.last.children.append(node)
        if tag not in VOID and not (alone and tag in ("svg", "path")):
            open_.push(node)
    _prune(root)
    return root


def _each(root: Node) -> list[Node]:
    """All nodes, parents before children, without recursion: trees may be deep."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Set the counts, densities and density sums of every node."""
    nodes = _each(root)
    linked = {id(root): False}
    for n in nodes:
        inside = linked[id(n)]
        for c in n.children:
            if isinstance(c, Node):
                linked[id(c)] = inside or c.tag == "a"
            else:
                k = len(c) if not c.isspace() else 0
                n.chars += k
                n.link_chars += k * inside
    for n in reversed(nodes):
        for c in n.children:
            if isinstance(c, Node):
                n.chars += c.chars
                n.link_chars += c.link_chars
                n.tags += c.tags + 1
                n.link_tags += c.link_tags + (c.tag == "a")
    total = nodes[0]
    share = total.link_chars / max(total.chars, 1)
    for n in reversed(nodes):
        if n.chars:
            tags, links, plain = max(n.tags, 1), max(n.link_tags, 1), max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
            scale = math.log(max(n.chars / max(n.link_chars, 1) * tags / links, 1.0) + 1.0) / math.log(base + 1.0)
            n.density = n.chars / tags * scale
        n.sum = sum(c.density for c in n.children if isinstance(c, Node)) + sum(len(c) for c in n.children if not isinstance(c, Node) and not c.isspace())
    return nodes


#: What is around the densest subtree is read whole if it has this share of its density at least.
UNDILUTED = 0.5


def main_nodes(root: Node) -> list[Node]:
    """The subtrees to read, in page order.

    From the node with the greatest sum of densities, and from a paragraph or
    a tag within one to the block around it, the text grows outwards while what
    is around is not diluted: within an article or main part, or where another
    block beside it reaches the threshold. Around the last such part, blocks
    that reach the threshold are read too, and headings before it.
    """
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    own = [n for n in _each(body) if n.chars]
    if not own:
        return []
    best = max(own, key=lambda n: n.sum)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    inside = max((k for k, n in enumerate(path) if n.tag in ("article", "main")), default=0)

    def dense(n: Node) -> list[Node]:
        """The blocks within ``n``, beside the path, that reach the threshold."""
        return [c for c in n.children if isinstance(c, Node) and c.tag in BLOCK and c.chars and c.density >= threshold and 2 * c.link_chars <= c.chars and c not in on_path]

    on_path = set(path)
    at = next((k for k, n in enumerate(path) if n.tag in CONTAINERS), len(path) - 1)
    while at + 1 < len(path) and path[at].tag not in ("article", "main") and path[at + 1].density >= UNDILUTED * path[at].density and (at < inside or dense(path[at + 1])):
        at += 1
    # blocks that are links for the most part are menus, but within an article or main part
    if at > inside or path[at].tag not in ("article", "main") and inside == 0:
        for n in _each(path[at]):
            n.children = [c for c in n.children if not (isinstance(c, Node) and c.tag in BLOCK and c.link_tags >= 3 and 2 * c.link_chars > c.chars)]
    found = [path[at]]
    for k in range(at + 1, len(path)):
        if path[k - 1].tag in ("article", "main"):
            break  # what is beside an article is not of it
        before, after, seen = [], [], False
        near = set(dense(path[k]))
        for c in path[k].children:
            if c is path[k - 1]:
                seen = True
            elif isinstance(c, Node) and (c in near or c.tag in HEADINGS and c.chars and not seen):
                (after if seen else before).append(c)
        found = before + found + after
    return found


def blocks(node: Node) -> list[str]:
    """The texts of the blocks under a node, with white space folded, in page order."""
    out: list[str] = []
    run: list[str] = []
    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None or (isinstance(x, Node) and x.tag in BLOCK):
            text = " ".join("".join(run).split())
            run = []
            if text:
                out.append(text)
        if isinstance(x, str):
            run.append(x)
        elif isinstance(x, Node):
            if x.tag in BLOCK:
                todo.append(None)
            todo += reversed(x.children)
    text = " ".join("".join(run).split())
    return out + [text] * bool(text)


def main_text(page: str) -> str:
    """The article of a page as text."""
    return " ".join(b for n in main_nodes(parse(page)) for b in blocks(n))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""

    def make():
        def work(ids: list, urls: list, htmls: list) -> tuple:
            texts = [main_text(h or "") for h in htmls]
            return ids, urls, texts, [len(t) for t in texts]

        return work

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_columns(own, make, "page_id long, url string, text string, n_chars long")
