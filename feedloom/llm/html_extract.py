"""Main text by a site style tree.

All pages of a host are merged into one tree of style nodes: the path of block elements with their classes. A node's
presentation importance is the entropy, to the base of its pages, of the child sequences that it shows; a node with
text of its own has a content importance, one less the mean entropy of its texts over the pages. A text's importance is
its own content's, and for SHARE of it the composite of the node above: that node's presentation, and more of its
texts' contents the fewer they are.

Elements and classes that tell what a branch is are a prior on its importance: one whose role is known to be none
(NOT_CONTENT and so on) has ROLE times its content's importance and goes as a whole; article and main elements let text
within stay down to LOW less PRIOR, and text beside one from LOW plus PRIOR on. All removal reads the host's table of
importances; a page alone removes only what no browser shows as text (UNSEEN). An article in a removed branch is none.

A class or id counts as a whole, a number at its end aside, never on the body, and not on what holds a page's only
articles; comments that are articles of their own go where the page has another article. Parts of a class
(has-sidebar, article-header) are left to the entropy.

Pages of a host with the same nodes and texts, apart from branches without a role, count as one, however many copies
there are; on a host with fewer than LEAST such pages only the priors speak. A node is named by a hash of its path, so
any depth costs the same. Statistics are distinct by (host, page, node, feature), combined in each batch and before the
shuffle, then counted by (host, node, feature) likewise, so no task has a whole host; the tables that a host's pages
need are the low nodes only, and Spark itself broadcasts them if small or splits a hot host's pages if not.

Defined results: null and empty html has an empty text. Broken markup is read as browsers do: an unfinished tag at the
end is dropped, unclosed elements end with their parent. Null urls are one host. Repeated rows and ids are pages of
their own. Very long and very deep pages are read whole. An empty table gives an empty result. Columns besides page_id,
url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, tidy
from .url_filters import with_parts

LOW = 0.3
GAMMA = 0.9
#: Part of a text's importance that is its surroundings', and what an article takes off LOW inside and adds outside.
SHARE = 0.1
PRIOR = 0.1
#: What is left of a branch's importance where its element or class says that it is no main text.
ROLE = 0.1
#: A host with fewer distinct pages shows too little to judge by.
LEAST = 4

BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre script section select style summary svg table tbody td template textarea tfoot th thead title tr ul video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Start tags that end an open element of their kind.
ENDED_BY = {"p": BLOCKS - {"button", "object", "iframe", "noscript", "script", "style", "template", "textarea", "title", "svg", "canvas", "video", "option", "optgroup", "select"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": BLOCKS - frozenset("noscript object script style template title".split())}
#: What stops the search for an element to end.
SCOPES = frozenset("table td th ul ol dl article section aside nav main div body select".split())

#: No text of the page.
UNSEEN = frozenset("head iframe noscript object script style svg template title".split())
#: Roles that are known: 0 for elements and class words, 1 for the article itself.
NOT_CONTENT = frozenset("aside button dialog footer form header menu nav select textarea".split())
NOT_CONTENT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
NOT_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget widgets".split()
)
CONTENT = frozenset(("article", "main"))

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile("[A-Za-z]+")


@dataclass
class Node:
    """A block element: its style node, role (0, 1, or None if unknown), whether it lies in an article, has its role by
    a class or id alone, or holds an article, and, in order, its texts and children."""

    tag: str
    path: int
    role: int | None = None
    inside: bool = False
    named: bool = False
    holds: bool = False
    parts: list = field(default_factory=list)


def _role(tag: str, attributes: str) -> tuple[int | None, str, bool]:
    """Role, class words without numbers, and whether the role is by a class or id alone."""
    words: list[str] = []
    tokens: set[str] = set()
    hidden = False
    for name, *values in ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
        value = "".join(values).lower()
        name = name.lower()
        if name in ("class", "id"):
            words += WORD.findall(value)
            tokens.update(t.rstrip("0123456789-_") for t in value.split())
        elif name == "role" and value in NOT_CONTENT_ROLES:
            hidden = True
    style = ".".join(sorted(set(words)))
    if hidden or tag in NOT_CONTENT:
        return 0, style, False
    if tag not in CONTENT and tag not in ("html", "body") and NOT_CONTENT_WORDS.intersection(tokens):
        return 0, style, True
    return (1 if tag in CONTENT else None), style, False


def parse(source: str | None) -> Node:
    """The tree of block elements; inline markup only parts its text's letters."""
    root = Node("html", node_id("html"))
    stack, text, at = [root], [], 0
    source = source or ""

    def flush() -> None:
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                stack[-1].parts.append(said)
            text.clear()

    def close(to: int) -> None:
        flush()
        del stack[to:]

    while m := TAG.search(source, at):
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name == "br":
            text.append(" ")
        if name not in BLOCKS and name not in RAW:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    close(i)
                    break
                if stack[i].tag in SCOPES and name in ("p", "li", "dd", "dt", "td", "th", "tr"):
                    flush()
                    break
            else:
                flush()
            continue
        flush()
        if name in ("html", "body") and any(n.tag == name for n in stack):
            continue
        for i in range(len(stack) - 1, 0, -1):
            if name in ENDED_BY.get(stack[i].tag, ()):
                close(i)
                break
            if stack[i].tag in SCOPES and stack[i].tag not in ("td", "th"):
                break
        if name == "hr":
            continue
        role, style, named = _role(name, m[3])
        up = stack[-1]
        label = f"{name}.{style}" if style else name
        node = Node(name, node_id(f"{up.path}/{label}"), role, up.inside or role == 1, named)
        if name not in UNSEEN:
            up.parts.append(node)
        if role == 1:
            for n in reversed(stack):
                if n.tag in UNSEEN or n.role == 0 and not n.named:
                    break
                n.holds = True
        if name in RAW:
            end = re.compile(f"</{name}[\\s/>]", re.I).search(source, at)
            stop = end.start() if end else len(source)
            if name == "textarea" and (said := " ".join(html.unescape(source[at:stop]).split())):
                node.parts.append(said)
            closing = source.find(">", stop)
            at = len(source) if closing < 0 else closing + 1
        else:
            stack.append(node)
    text.append(source[at:])
    flush()
    if not any(n.role == 1 for n in nodes(root, live=True)):
        for n in nodes(root):
            if n.named and n.holds:
                n.role = None
    return root


def nodes(root: Node, live: bool = False) -> Iterator[Node]:
    """All nodes, or those outside branches of role 0."""
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += [p for p in n.parts if isinstance(p, Node) and not (live and p.role == 0)]


def node_id(path: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(path), "big", signed=True)


def branch_id(n: Node) -> int:
    """A branch whose role is none; apart from the node, which may have no such role on another page."""
    return node_id(f"{n.path} branch")


def branches(root: Node) -> Iterator[Node]:
    """The topmost nodes of role 0."""
    return (p for n in nodes(root, live=True) for p in n.parts if isinstance(p, Node) and p.role == 0)


def said(branch: Node) -> str:
    return "\0".join(p for n in nodes(branch) for p in n.parts if isinstance(p, str))


#: Kinds of features: a node's children, a text of its own, the page, the text of a branch of role 0.
CHILDREN, TEXT, PAGE, BRANCH = range(4)


def features(root: Node) -> tuple[int, set[tuple[int, int, int, int, bool]]]:
    """What a page shows: its own identity, and (node, node above, kind, value, whether that above is an article)."""
    tree = list(nodes(root, live=True))
    page = node_id("\0".join(str(x) for n in tree for x in (n.path, *(p for p in n.parts if isinstance(p, str)))))
    own = {(0, 0, PAGE, page, False)}
    above = {id(p): n for n in tree for p in n.parts if isinstance(p, Node)}
    for n in tree:
        below = [p.path for p in n.parts if isinstance(p, Node) and p.role != 0]
        up = above.get(id(n), n)
        own.update((n.path, up.path, TEXT, node_id(p), up.role == 1) for p in n.parts if isinstance(p, str))
        if below:
            own.add((n.path, 0, CHILDREN, node_id("|".join(map(str, below))), False))
    own.update((branch_id(b), 0, BRANCH, node_id(said(b)), False) for b in branches(root))
    return page, own


def importances(pages: DataFrame) -> DataFrame:
    """host, node, importance of every style node with text outside branches of role 0, and of these branches, for
    pages(host, html); on a host of fewer than LEAST distinct pages of the branches only."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set = set()
            own: set = set()
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                root = parse(source)
                page, shows = features(root)
                if (host, page) in seen:  # branches of role 0 may differ
                    shows = {x for x in shows if x[2] == BRANCH}
                seen.add((host, page))
                own.update((host, page, *x) for x in shows)
            columns = list(zip(*own, strict=True)) if own else [()] * 7
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "page", "node", "up", "kind", "feature", "in_article"])

    found = pages.select("host", "html").mapInArrow(tidy(told), "host string, page long, node long, up long, kind int, feature long, in_article boolean")
    # copies are one page; by two shuffles, so that what every page of a host shares is combined before the second
    counted = found.distinct().groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("k"), F.max("up").alias("up"), F.max("in_article").alias("in_article"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    said_ = F.col("kind").isin(TEXT, BRANCH)
    sums = counted.groupBy("host", "node").agg(
        F.sum(of(CHILDREN, F.col("k"))).alias("m"),
        F.sum(of(CHILDREN, F.col("k") * F.log("k"))).alias("m_log"),
        F.count(F.when(said_, 1)).alias("texts"),
        F.sum(F.when(said_, F.log("k"))).alias("logs"),
        F.count(of(PAGE, F.lit(1))).alias("size"),
        F.max(of(TEXT, F.col("up"))).alias("up"),
        F.max(of(TEXT, F.col("in_article"))).alias("in_article"),
        F.count(of(BRANCH, F.lit(1))).alias("branch"),
    )
    sums = staged(sums, "style-sums")
    # distinct pages of a host bound a text's pages, but for texts of branches, of which copies may differ
    size = sums.filter("size > 0").select("host", F.col("size").alias("pages"))
    own = sums.join(size, "host")
    content = F.when(F.col("texts") > 0, F.when(F.col("pages") >= LEAST, F.greatest(F.lit(0.0), 1 - F.col("logs") / F.col("texts") / F.log("pages"))).otherwise(1.0))
    shown = F.when(F.col("m") > 1, (F.log("m") - F.col("m_log") / F.col("m")) / F.log(F.greatest(F.col("m"), F.lit(2)))).when(F.col("m") == 1, 1.0)
    own = staged(own.select("host", "node", "up", "in_article", "branch", "pages", content.alias("content"), shown.alias("shown")), "style-nodes")
    texts = own.filter(f"content IS NOT NULL AND branch = 0 AND pages >= {LEAST}").select("host", "node", "up", "in_article", "content")
    below = texts.groupBy("host", "up").agg(F.avg("content").alias("below"), F.count("*").alias("n"))
    weight = F.pow(F.lit(GAMMA), F.col("n"))
    above = below.join(own.select("host", F.col("node").alias("up"), "shown"), ["host", "up"], "left")
    above = above.select("host", "up", ((1 - weight) * F.coalesce("shown", F.lit(1.0)) + weight * F.col("below")).alias("around"))
    around = F.when(F.col("in_article"), 1.0).otherwise(F.col("around"))
    judged = texts.join(above, ["host", "up"]).select("host", "node", ((1 - SHARE) * F.col("content") + SHARE * around).alias("importance"))
    return judged.unionByName(own.filter("branch > 0").select("host", "node", (ROLE * F.col("content")).alias("importance")))


def text_of(root: Node, importance: dict[int, float], low: float = LOW) -> str:
    """Blocks in page order whose importance reaches ``low``, or what an article makes of it; 1 for nodes not told."""
    whole = any(n.role == 1 for n in nodes(root, live=True))
    out: list[str] = []
    todo: list = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, tuple):
            out.append(n[0])
            continue
        least = low - PRIOR if n.inside else low + PRIOR if whole else low
        if n.role == 0 and importance.get(branch_id(n), 1.0) < least:
            continue
        own = importance.get(n.path, 1.0) >= least
        todo += [p if isinstance(p, Node) else (p,) for p in reversed(n.parts) if isinstance(p, Node) or own]
    return "\n".join(out)


def extracted(pages: DataFrame, low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = with_parts(pages.select("page_id", "url", "html")).drop("path")
    poor = importances(rows).filter(F.col("importance") < low + PRIOR)
    poor = staged(poor.groupBy("host").agg(F.collect_list(F.struct("node", F.col("importance").cast("float").alias("importance"))).alias("low")), "low-nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [text_of(parse(h), {x["node"]: x["importance"] for x in p or ()}, low) for h, p in zip(b.column("html").to_pylist(), b.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(poor, "host", "left").select("page_id", "url", "html", "low")
    return joined.mapInArrow(tidy(run), f"page_id {joined.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
