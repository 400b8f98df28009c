"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of element nodes: a node is a
path of presentations (tag and class names, numbered among equal siblings)
from the root, counted once per page.  Two distributions are kept per node,
over the pages that have it:

* style: the sequence of its children's presentations,
* content: its own text.

Siblings of one presentation move from number to number as pages get longer,
so each of their blocks also counts by what it says: the text of a block (with
its inline elements) is counted per host, parent and presentation, once per
page, beside the pages that have such a block there.

Importance of a node is the entropy of its distributions over the pages that
show it, in units of their number's logarithm: 1 if every page differs, 0 if
all agree.  A leaf's importance comes from its content; an inner node's is
``(1 - DECAY) * style + DECAY * mean importance of its children``, worked out
from the deepest level up, however deep the tree is.  A node that fewer than
``FEW`` pages show has importance 1, as nothing is known (and so have all
nodes below it, which no more pages show).

On each page the text of blocks of low importance (below ``LEAST``) goes; a
block inside a low one is judged by its own importance, so wrappers that look
alike on every page take no text with them, whatever their number.  A text
that all but ``LEAST`` of the pages have goes under any number; and of several
equal siblings one of low importance stays if less than ``LEAST`` of the pages
have its text, so a constant sibling takes no other with it.  Gone are also
branches whose presentation names a part that is never the article: menus,
headers and footers outside it, sidebars, notices, adverts, forms, comments,
scripts and styles.  Random adverts and menus change from page to page, so
entropy alone can't tell them from the article: the names decide there, and
entropy decides for unnamed boilerplate.  Where a page marks its main part
(``article``, else ``main``), that part is read if it has at least ``HALF`` as
much of the text that is left, without links, as any wider part; so a teaser
in an ``article`` hides no text outside.  Inside a main part a low block goes
if at least ``HALF`` of the host's pages have it, or if it is mostly links, so
that an article published several times on a host stays; and so does a main
part of which nothing but headings would be left.

Spark side: pages are parsed twice, once for the statistics and once for the
extraction.  Statistics are summed by (host, node, distribution, value) and
then by (host, node), both with map-side partial sums, so a host with a third
of all pages is no hot key.  What comes back to the pages of a host is its
list of low-importance nodes, however long: broadcast if the lists are short,
or else only those that a page itself has, joined by host
and node.

Defined cases: null or empty pages have no text; a url without a host counts
as host ''; broken markup is read as a browser would: open paragraphs and
list items end where a block starts, unknown end tags are ignored and what is
left open ends with the page.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import cut
from driftwood.session import ship_package

FEW, LEAST, DECAY = 5, 0.2, 0.9
#: What ``low`` holds besides paths of low importance: hashes of block texts
#: that at least LEAST (OFTEN), or all but LEAST (MOST) of the pages have.
OFTEN, MOST = 0x5851F42D4C957F2D, 0x14057B7EF767814F
#: Share of a host's pages that have a block which goes inside a main part (with
#: the mark MANY), and of the text that a main part must have.
HALF, MANY = 0.5, 0x2545F4914F6CDD1D
#: Depths of rows that are no nodes: pages of a group of siblings, its texts.
GROUP, TEXT = -1, -2
#: Low-importance nodes of all hosts together, and of one host, that are
#: broadcast at most; beyond either, pages are joined with their own.
BROADCAST_NODES, HOST_NODES = 1_000_000, 5_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text.
SILENT = frozenset("script style template noscript svg math head title iframe object canvas audio video".split())
#: Elements that are never part of the article, wherever they are.
OUTSIDE = frozenset("nav aside form footer menu dialog button select textarea input fieldset".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table
    tbody td tfoot th thead tr ul option""".split())
#: What a start tag ends if it is open, up to the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
              "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Names of parts that are never the article: a class, role or id is one if it
#: is such a name or made of nothing but such names, ``BESIDE`` and numbers.
PARTS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar
    navigation menu breadcrumb breadcrumbs sidebar side aside widget related footer header masthead cookie cookies
    consent notice notices alert popup modal newsletter subscribe signup share sharing social comment comments
    commentlist reply replies disqus respond search login form pagination pager toolbar skip complementary
    contentinfo""".split())
BESIDE = frozenset("""site page main top bottom left right upper lower global primary secondary mobile desktop sticky
    fixed box bar block list item items wrapper wrap container inner outer content area section panel link links
    button buttons btn icon icons group row col column slot unit thread text title label posts articles stories law
    info gdpr policy message overlay to wp""".split())
COMPOUNDS = frozenset("entry-footer post-footer article-footer post-navigation post-comment share-post".split())
#: Ids that count inside the article too, where others come from headings.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def one_spaced(text: str) -> str:
    """White space as one space, none at the ends."""
    return " ".join(text.split())


@lru_cache(20_000)
def names_part(token: str, core: frozenset = PARTS) -> bool:
    token = token.lower().partition("--")[0].replace("_", "-").strip("-")
    words = [w for w in token.split("-") if w and not w[0].isdigit()]
    return token in COMPOUNDS and core is PARTS or any(w in core for w in words) and all(
        w in PARTS or w in BESIDE for w in words)


class Node:
    __slots__ = ("tag", "names", "id", "children", "parent", "look", "path", "several")

    def __init__(self, tag: str, names: str = "", parent: Node | None = None, id: str = ""):
        self.tag, self.names, self.parent, self.id = tag, names, parent, id  # names: class and role
        self.children: list = []  # nodes and strings
        self.look = tag
        if names or id:
            looks = sorted(set(f"{names} {id}".lower().split()))
            self.look = f"{tag}.{'.'.join(looks)}" if looks else tag
        self.path, self.several = 0, False  # several: has siblings of its look


class Builder(HTMLParser):
    """A forgiving DOM: see the defined cases above."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in BLOCKS:
            self.close({"p"}, {"body", "article", "main", "section", "div", "td", "th", "li", "table", "button"})
        if tag in ENDS:
            self.close(ENDS[tag], CONTAINERS[tag])
        names = " ".join(v for k, v in attrs if v and k in ("class", "role"))
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        node = Node(tag, names + " hidden" * hidden, self.at, " ".join(v for k, v in attrs if v and k == "id"))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as HTML reads it: the slash means nothing

    def close(self, tags: set, containers: set) -> None:
        node = self.at
        while node.parent is not None and node.tag not in containers:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if tag not in BLOCKS and node.tag in BLOCKS:
                return  # an inline end tag closes no block
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = Builder()
    if html:
        b.feed(html)
        b.goahead(1)  # what an unfinished tag or reference holds
    stack = [b.root]
    b.root.path = xxhash.xxh3_64_intdigest("html")
    while stack:
        node = stack.pop()
        seen: dict[str, int] = {}
        kids = [c for c in node.children if isinstance(c, Node)]
        for c in kids:
            seen[c.look] = n = seen.get(c.look, 0) + 1
            c.path = xxhash.xxh3_64_intdigest(f"{c.look}[{n}]", node.path)
        stack += kids
        if len(seen) < len(kids):
            for c in kids:
                c.several = seen[c.look] > 1
    return b.root


def inner(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def text_of(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in SILENT:
            stack.extend(reversed(n.children))
    return one_spaced("".join(out))


def group_and_text(node: Node) -> tuple[int, int]:
    """Hashes of a block's group (parent and look) and, within it, of its
    text: all but that of the blocks inside; 0 if there is none."""
    out, stack = [], node.children[::-1]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "br":
            out.append(" ")
        elif n.tag not in SILENT and n.tag not in BLOCKS:
            stack.extend(reversed(n.children))
    group = xxhash.xxh3_64_intdigest(node.look, node.parent.path if node.parent else 0)
    text = one_spaced("".join(out))
    return group, xxhash.xxh3_64_intdigest(text, group) if text else 0


def observations(root: Node) -> Iterator[tuple]:
    """(path, parent path, depth, kind, value) of every node of a page: style
    "s" or content "c"; and once each, of its groups of equal siblings
    (depth ``GROUP``) and of their blocks' texts (depth ``TEXT``)."""
    seen, stack = set(), [(root, 0, 0)]
    while stack:
        node, parent, depth = stack.pop()
        if node.tag in SILENT:
            continue
        kids = inner(node)
        own = one_spaced("".join(c for c in node.children if isinstance(c, str)))
        if kids:
            yield node.path, parent, depth, "s", xxhash.xxh3_64_intdigest(">".join(k.look for k in kids))
        if own or not kids:
            yield node.path, parent, depth, "c", xxhash.xxh3_64_intdigest(own)
        if node.tag in BLOCKS:
            group, text = group_and_text(node)
            if group not in seen:
                seen.add(group)
                yield group, 0, GROUP, "g", 0
            if text and text not in seen:
                seen.add(text)
                yield group, 0, TEXT, "t", text
        stack.extend((k, node.path, depth + 1) for k in kids)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)),
                      F.lit(""))


SIGNED = 1 << 64


def signed(x: int) -> int:
    return x - SIGNED if x >= 1 << 63 else x


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, parent, depth, n, style, content, text): the style tree's
    nodes with the entropies of their distributions, the groups of siblings
    and their texts; ``pages`` has host and html."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [(h, signed(p), signed(q), d, kind, signed(v)) for h, html in zip(part["host"], part["html"])
                   for p, q, d, kind, v in observations(parse(html))]
            yield pd.DataFrame(out, columns=["host", "path", "parent", "depth", "kind", "value"])

    seen = pages.mapInPandas(run, "host string, path long, parent long, depth int, kind string, value long")
    n = F.col("n").cast("double")
    counted = seen.groupBy("host", "path", "parent", "depth", "kind", "value").agg(F.count("*").alias("n"))
    # one condition over n and depth: a filter by depth would go below the
    # counting, which then runs twice
    texts = (counted.where(F.when(F.col("depth") == TEXT, F.col("n")).otherwise(0) >= FEW)
             .select("host", "path", "parent", "depth", "n", F.lit(None).cast("double").alias("style"),
                     F.lit(None).cast("double").alias("content"), F.col("value").alias("text")))
    spread = (counted
              .groupBy("host", "path", "parent", "depth", "kind")
              .agg(F.sum("n").alias("pages"), F.sum(n * F.log(n)).alias("nlogn")))
    m = F.col("pages")
    entropy = F.when(m < FEW, 1.0).otherwise((F.log(m) - F.col("nlogn") / m) / F.log(m))
    nodes = (spread.withColumn("h", F.least(F.lit(1.0), F.greatest(F.lit(0.0), entropy)))
             .groupBy("host", "path", "parent", "depth")
             .agg(F.max("pages").alias("n"), F.max(F.when(F.col("kind") == "s", F.col("h"))).alias("style"),
                  F.max(F.when(F.col("kind") == "c", F.col("h"))).alias("content"))
             .where(F.when(F.col("depth") == TEXT, F.lit(0)).otherwise(F.col("n")) > 0)
             .withColumn("text", F.lit(None).cast("long")))
    return cut(nodes.unionByName(texts))


def important(nodes: DataFrame, decay: float = DECAY) -> list[DataFrame]:
    """(host, path, parent, n, imp) of the nodes, a DataFrame per level.  The
    levels are worked out from the deepest that ``FEW`` pages of a host share
    up to the root; below it every importance is 1."""
    deepest = nodes.where(F.col("n") >= FEW).agg(F.max("depth")).first()[0]
    columns = ["host", "path", "parent", "n", "imp"]
    levels = []
    above = nodes.where(F.col("depth") == (-1 if deepest is None else deepest) + 1) \
        .withColumn("imp", F.lit(1.0)).select(columns)
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        below = (above.groupBy("host", F.col("parent").alias("path"))
                 .agg((F.sum(F.col("imp") * F.col("n")) / F.sum("n")).alias("below")))
        inner_imp = F.greatest((1 - decay) * F.coalesce("style", F.lit(0.0)) + decay * F.col("below"),
                               F.coalesce("content", F.lit(0.0)))
        imp = F.when(F.col("n") < FEW, 1.0).when(F.col("below").isNull(), F.coalesce("content", "style", F.lit(1.0)))
        above = cut(nodes.where(F.col("depth") == depth).join(below, ["host", "path"], "left")
                    .withColumn("imp", imp.otherwise(inner_imp)).select(columns))
        levels.append(above)
    return levels or [above]


def frequent_texts(tree: DataFrame, least: float = LEAST) -> DataFrame:
    """(host, path, n, item): texts (path is the hash) by their share of the
    pages of their group, marked ``OFTEN`` and ``MOST`` in item."""
    groups = tree.where(F.col("depth") == GROUP).select("host", "path", F.col("n").alias("pages"))
    share = F.col("n") / F.col("pages")
    marks = F.array(F.when(share >= least, OFTEN), F.when(share >= 1 - least, MOST))
    return (tree.where(F.col("depth") == TEXT).join(groups, ["host", "path"])
            .select("host", "text", "n", F.explode(F.array_compact(marks)).alias("mark"))
            .select("host", F.col("text").alias("path"), "n", F.col("text").bitwiseXOR(F.col("mark")).alias("item")))


def removable(nodes: DataFrame, least: float = LEAST, decay: float = DECAY) -> DataFrame:
    """(host, path, item): nodes whose importance is below ``least``, and
    the marked ``frequent_texts``; again with ``MANY`` if ``HALF`` of the
    host's pages have them: item is path (or the text's hash) with the marks."""
    now = None
    for i, level in enumerate(important(nodes, decay)):
        now = level if now is None else now.unionByName(level)
        now = cut(now) if i % 64 == 63 else now  # else a very deep tree makes a very long plan
    low = (now.where(F.col("imp") < least).select("host", "path", "n", F.col("path").alias("item"))
           .unionByName(frequent_texts(nodes, least)))
    pages = nodes.where(F.col("depth") == 0).select("host", F.col("n").alias("pages"))
    many = F.when(F.col("n") >= HALF * F.col("pages"), F.col("item").bitwiseXOR(F.lit(MANY)))
    return (low.join(pages, "host")
            .select("host", "path", F.explode(F.array_compact(F.array("item", many))).alias("item")))


def strings(node: Node) -> Iterator[str]:
    """All strings of a branch that can be text."""
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            yield n.strip()
        elif n.tag not in SILENT:
            stack.extend(n.children)


def link_share(node: Node) -> float:
    total = linked = 0
    stack = [(node, False)]
    while stack:
        n, inside = stack.pop()
        if isinstance(n, str):
            size = len(n.strip())
            total += size
            linked += size * inside
        elif n.tag not in SILENT:
            stack.extend((c, inside or n.tag == "a") for c in n.children)
    return linked / total if total else 0.0


def named(node: Node, in_main: bool, low: set | frozenset = frozenset()) -> bool:
    """Whether tag or names say that the branch is never the article.  Ids of
    headings say nothing; those of sections, and of all else inside the main
    part, only what importance confirms, comments apart."""
    if node.tag in SILENT or node.tag in OUTSIDE or "hidden" in node.names.split():
        return True
    if node.tag == "header":
        return not in_main
    if node.tag in ("article", "main", "body", "html"):
        return False
    heading = node.tag in HEADINGS
    if any(names_part(x) for x in node.names.split() if not (heading and x.lower() == "header")):
        return True
    if heading or not node.id:
        return False
    ids = node.id.split()
    if any(names_part(x, COMMENTS) for x in ids):
        return True
    return (not (in_main or node.tag == "section") or node.path in low) and any(map(names_part, ids))


def unimportant(node: Node, low: set, in_main: bool) -> bool:
    """Whether the block's own text goes; blocks inside are judged apart."""
    if not low or node.tag not in BLOCKS or node.tag in ("article", "main", "body", "html"):
        return False
    text = group_and_text(node)[1]

    def among(mark: int) -> bool:
        return text ^ MOST ^ mark in low or node.path ^ mark in low and (
            not node.several or text ^ OFTEN ^ mark in low)

    return in_main and among(MANY) or among(0) and (not in_main or link_share(node) > 0.5)


def marked_parts(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a tag; articles inside a comment section and
    the like don't count."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == tag:
            found.append(node)
        elif node is root or not named(node, False):
            stack.extend(reversed(inner(node)))
    return found


def kept(parts: list[Node], in_main: bool, low: set) -> tuple[list[str], int, int]:
    """Text blocks that stay, and the length of their text without links and
    of that without headings."""
    blocks, words, sizes = [], [], [0, 0]

    def flush():
        text = one_spaced("".join(words))
        words.clear()
        if text:
            blocks.append(text)

    top = set(map(id, parts))
    stack = [("open", p, False, False, False) for p in reversed(parts)]
    while stack:
        what, node, mute, link, heading = stack.pop()
        if isinstance(node, str):
            if not mute:
                words.append(node)
                size = 0 if link else len(node.strip())
                sizes[0] += size
                sizes[1] += 0 if heading else size
        elif what == "close":
            flush()
        elif node.tag == "br":
            words.append(" ")
        elif id(node) in top or not named(node, in_main, low):
            if node.tag in BLOCKS:
                mute = unimportant(node, low, in_main)  # inline elements go with the block they are in
                flush()
                stack.append(("close", node, mute, link, heading))
            link, heading = link or node.tag == "a", heading or node.tag in HEADINGS or node.tag in ("hgroup", "header")
            stack.extend(("open", c, mute, link, heading) for c in reversed(node.children))
    flush()
    return blocks, *sizes


def extract(html: str | None, low: set) -> str:
    """Text blocks of the main part, joined by an empty line."""
    root = parse(html)
    found = []
    for tag in ("article", "main"):
        if parts := marked_parts(root, tag):
            one = kept(parts, True, low)
            if not one[2] and low:  # all of it on many pages: published again, not boilerplate
                one = kept(parts, True, set())
            found.append(one)
    if not found or found[0][1] < HALF * sum(len(t) for t in strings(root)):
        found.append(kept([root], False, low))
    blocks, *_ = next(x for i, x in enumerate(found) if all(x[1] >= HALF * y[1] for y in found[i + 1:]))
    return "\n\n".join(blocks)


def low_of_pages(src: DataFrame, low: DataFrame) -> DataFrame:
    """(page, low array<long>) by the digest of host and html: the items of
    the host's that the page's own blocks have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [(h, page, signed(p)) for h, page, html in zip(part["host"], part["page"], part["html"])
                   for p in {q for o in observations(parse(html)) for q in ((o[4],) if o[2] == TEXT else (o[0],))}]
            yield pd.DataFrame(out, columns=["host", "page", "path"])

    has = src.where(F.col("page").isNotNull()).select("host", "page", "html") \
        .mapInPandas(run, "host string, page binary, path long")
    return has.join(low, ["host", "path"]).groupBy("page").agg(F.collect_set("item").alias("low"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", broadcast: int = BROADCAST_NODES, longest: int = HOST_NODES) -> DataFrame:
    """(id, url, text) of every page; see the module's notes."""
    ship_package(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                       F.col(html_col).cast("string").alias("html"))
    low = cut(removable(style_tree(src.select("host", "html"))))

    def run(html: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([extract(h, set() if x is None else {int(v) % SIGNED for v in x})
                          for h, x in zip(html, low)], dtype=object)

    run.__annotations__ = {"html": pd.Series, "low": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, "string")
    # few boilerplate nodes altogether: pages stay where they are; otherwise
    # joins by node and by page, whose hot keys AQE splits
    size = low.groupBy("host").count().agg(F.sum("count"), F.max("count")).first()
    if (size[0] or 0) <= broadcast and (size[1] or 0) <= longest:
        joined = src.join(F.broadcast(low.groupBy("host").agg(F.collect_list("item").alias("low"))), "host", "left")
    else:
        src = src.withColumn("page", F.unhex(F.sha2(F.concat_ws("\n", "host", F.col("html")), 256)))
        joined = src.join(low_of_pages(src, low), "page", "left")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), udf("html", "low").alias("text"))
