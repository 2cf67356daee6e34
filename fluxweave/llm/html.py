"""Main text of HTML pages with a site style tree.

Pages are parsed once, in time in proportion to their length, and the DOMs of a host are merged: elements with the same
path of tags and classes are one node. Nodes get importance from entropy. A node's content importance is one less the
mean, over its distinct texts, of log(pages with the text) / log(pages with the node + PRIOR); its presentation importance
is the entropy of its sequences of child elements, to the base of those pages. PRIOR stands for pages not seen, on which
the node said something else, so that a host of few pages needs more agreement. The two are added with their weights.

Two kinds of branches are removed from each page:

* nodes of low importance, which say the same on nearly all pages of their host;
* side branches: where one child of a node is a container that holds most of the node's information (words times
  importance, over all pages of the host), its generic siblings (div, section, list, table and the like, also header,
  nav, footer and so on) that hold less than SHARE of it. Inside an article or main element nothing is judged so.

Fixed HTML semantics come on top: elements that are never article text by their tag, by a hidden attribute, by an ARIA
role, or by a class or id that is as a whole the usual name of an advert, menu, notice or list of comments. Of a page with
article or main elements only what lies in them counts, unless the text that is left outside them is long and much more
(a teaser). A page of which the tree would leave nothing keeps what the semantics leave.

Null and empty html give an empty text, an empty table gives no rows. Repeated rows are extracted alike; they count as
pages each. Elements nested deeper than DEEP count as parts of the element at that depth. The merged counts are sums by
host, node and text, so a host with very many pages is no burden. No text is cut or capped. Columns of the table may
have any names; only the three that are named are looked at.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.common import release, slices, staged

#: Pages that the prior stands for; importance below which a node goes; weight of content; share of its parent's
#: information below which a side branch goes, and above which its sibling is the container of the text.
PRIOR, LOW, CONTENT_WEIGHT, SHARE, MOST = 6, 0.2, 0.9, 0.1, 0.5
#: How much more text, and how much at least, must stand outside the article for it to be a teaser.
TEASER_TIMES, TEASER_LEAST = 4, 500
DEEP = 64
#: Hosts and nodes that may be broadcast, at about 50 bytes each; shares of a host's pages where there are more.
SMALL, SALTS = 200_000, 64

_ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"(?<![^\s/\"'])(class|id|role|hidden|aria-hidden)(?=[\s=>/]|\Z)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements by how they are read.
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
_DROPPED = frozenset("nav aside footer form button select option input menu dialog svg canvas object audio video map fieldset datalist applet head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Elements that may be side branches.
_GENERIC = frozenset("div section ul ol dl table header nav aside footer form menu center span".split())
#: Whole class names and ids that say what an element is, wherever it stands and outside articles alone.
_ALWAYS = frozenset("ad ads advert adverts advertisement comment comments comment-list commentlist comments-area respond disqus_thread".split())
_OUTSIDE = frozenset("nav navbar menu breadcrumb breadcrumbs sidebar footer header site-header site-footer cookie-notice cookie-banner cookie-consent newsletter skip-link".split())
#: What a start tag ends, and what it doesn't end beyond.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "option": ("option",)}
_WALLS = frozenset("ul ol dl table tbody article section div main body td th".split())

_PATHS: dict[tuple[int, str, str], int] = {}


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _path(parent: int, tag: str, name: str) -> int:
    key = (parent, tag, name)
    found = _PATHS.get(key)
    if found is None:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        found = _hash(f"{parent}>{tag}.{name}")
        if len(name) < 200:
            _PATHS[key] = found
    return found


def _unwanted(tag: str, attrs: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is no article text by HTML semantics, and its class for the path."""
    if tag in _DROPPED or tag == "header" and not inside:
        return True, ""
    if not attrs or attrs.isspace():
        return False, ""
    name, names = "", []
    for key, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True, ""
        if key == "role" and value.strip() in _ROLES:
            return True, ""
        if key == "class":
            name = re.sub(r"\d+", "#", value)
        if key in ("class", "id"):
            names += value.split()
    if tag in ("html", "body", "main"):
        return False, name
    return not _ALWAYS.isdisjoint(names) or not inside and tag != "article" and not _OUTSIDE.isdisjoint(names), name


class Page:
    """What one page holds: ``blocks`` (path, parent path, text, lies in an article, left out), ``nodes`` of each path
    (paths from the root down, whether each is generic, how many lie outside an article) and ``styles`` (path, child
    sequence)."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, int, str, bool, bool]] = []
        self.styles: list[tuple[int, int]] = []
        self.nodes: dict[int, tuple[tuple[int, ...], tuple[bool, ...], int]] = {}
        #: Open elements: tag, path, left out, lies in an article, child sequence, place of the nearest block element,
        #: nodes down to it, whether each is generic, how many lie outside, whether an inline element hides its text.
        self.open: list[list] = [["", 0, False, False, 0, 0, (), (), 0, False]]
        #: Places in ``open`` of each tag, and of the elements that closing stops at.
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.words: list[str] = []
        at, length, last, spare = 0, len(html), html.rfind(">"), 4 * len(html) + (1 << 20)
        while True:
            begin = html.find("<", at)
            if begin < 0 or begin > last:  # no tag can end any more
                break
            if html.startswith("<!--", begin):
                close = html.find("-->", begin + 4)
                self.text(html[at:begin])
                at = close + 3 if close >= 0 else length
                continue
            found = _NAME.match(html, begin + 1)
            if not found:
                if html[begin + 1 : begin + 2] in ("!", "?", "/"):
                    self.text(html[at:begin])
                    at = html.find(">", begin) + 1 or length
                else:
                    self.text(html[at : begin + 1])
                    at = begin + 1
                continue
            if begin > at:
                self.text(html[at:begin])
            # Quoted values may hold ">". Where a quote stays open the tag ends at the next ">"; such vain searches have
            # a budget, so that a page full of them is still read in proportion to its length.
            close = _ATTRS.match(html, found.end()) if spare > 0 else None
            if close:
                at = close.end()
            else:
                spare -= length - begin
                at = html.find(">", found.end()) + 1
            tag = found.group().lower()
            if tag[0] == "/":
                self.end(tag[1:])
            elif tag in _RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(html, at)
                at = close.end() if close else length
            else:
                self.start(tag, html[found.end() : at - 1])
        self.text(html[at:])
        while len(self.open) > 1:
            self.pop()
        self.flush()

    def text(self, raw: str) -> None:
        if raw and not self.open[-1][9]:
            self.words.append(raw)

    def flush(self) -> None:
        if self.words:
            text = " ".join(unescape("".join(self.words)).split())
            self.words = []
            if text:
                _, path, left_out, inside, _, at, nodes, kinds, outside, _ = self.open[self.open[-1][5]]
                self.blocks.append((path, self.open[self.open[max(0, at - 1)][5]][1], text, inside, left_out))
                self.nodes[path] = (nodes, kinds, outside)

    def start(self, tag: str, attrs: str) -> None:
        if tag in _VOID:
            if tag == "br":
                self.text(" ")
            elif tag == "hr":
                self.flush()
            return
        inline = tag in _INLINE
        if not inline:
            self.flush()
            self.close(("p",))
            if tag in _CLOSES:
                self.close(_CLOSES[tag])
        top = self.open[-1]
        inside = top[3] or tag in ("article", "main")
        unwanted, name = (True, "") if top[2] and inline else _unwanted(tag, attrs, top[3])
        left_out = top[2] or unwanted
        if inline:
            if unwanted and not top[2]:
                self.words.append(" ")
            entry = [tag, top[1], top[2], inside, 0, top[5], top[6], top[7], top[8], top[9] or unwanted and not top[2]]
        elif len(top[6]) >= DEEP:
            entry = [tag, top[1], left_out, inside, 0, len(self.open), top[6], top[7], top[8], top[9]]
        else:
            top[4] = _path(top[4], tag, name)
            path = _path(top[1], tag, name)
            entry = [tag, path, left_out, inside, 0, len(self.open), (*top[6], path), (*top[7], tag in _GENERIC or tag == "article"), top[8] if top[3] else top[8] + 1, top[9]]
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in _WALLS:
            self.walls.append(len(self.open))
        self.open.append(entry)

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def close(self, tags: tuple[str, ...]) -> None:
        """End the innermost open element of these tags unless a containing element stands between."""
        at = max(map(self.last, tags))
        if at and (not self.walls or at >= self.walls[-1]):
            while len(self.open) > at:
                self.pop()

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at:
            while len(self.open) > at:
                self.pop()
        elif tag not in _INLINE and tag not in _VOID:
            self.flush()

    def pop(self) -> None:
        at = len(self.open) - 1
        tag, path, _, _, children, block, nodes, *_ = self.open[at]
        if block == at:
            self.flush()
            self.styles.append((path, children))
        self.open.pop()
        self.places[tag].pop()
        if self.walls and self.walls[-1] == at:
            self.walls.pop()


def chosen(blocks: list[tuple[int, int, str, bool, bool]], low=frozenset()) -> list[str]:
    """The texts of a page that are left without the nodes ``low``; what ``extract`` does with columns."""
    wanted = [b for b in blocks if not b[4]]
    kept = [b for b in wanted if b[0] not in low] or wanted
    inner, outer = [b[2] for b in kept if b[3]], [b[2] for b in kept if not b[3]]
    size = sum(map(len, outer))
    teaser = size >= TEASER_LEAST and size > TEASER_TIMES * sum(map(len, inner))
    return inner if inner and not teaser else [b[2] for b in kept]


_SCHEMA = """page_id long, url string, host string,
    blocks array<struct<path:long,parent:long,print:long,words:int,text:string,inside:boolean>>,
    nodes array<struct<path:long,nodes:array<long>,generic:array<boolean>,outside:int>>, styles array<struct<path:long,print:long>>"""


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, blocks, nodes, styles) of every row; blocks that are left out have no text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_SCHEMA))

    def run(batches):
        try:
            for part in slices(batches):
                blocks, nodes, styles = [], [], []
                for html in part.column(3).to_pylist():
                    page = Page(html)
                    blocks.append([{"path": p, "parent": q, "print": _hash(t), "words": t.count(" ") + 1, "text": None if out else t, "inside": i} for p, q, t, i, out in page.blocks])
                    nodes.append([{"path": p, "nodes": n, "generic": g, "outside": o} for p, (n, g, o) in page.nodes.items()])
                    styles.append([{"path": p, "print": s} for p, s in dict.fromkeys(page.styles)])
                columns = [part.column(0), part.column(1), part.column(2), *(pa.array(x, arrow.field(3 + k).type) for k, x in enumerate((blocks, nodes, styles)))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            _PATHS.clear()
            release()

    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, _SCHEMA)


def text_nodes(parsed: DataFrame) -> DataFrame:
    """(host, path, importance, words, nodes, generic, outside): each node that has text of its own; words are those of
    all pages, times the importance of what they say."""
    per_page = parsed.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["parent"].alias("parent"), b["print"].alias("print"), b["words"].alias("words"))))).alias("b")).select("host", "b.*")
    texts = per_page.groupBy("host", "path", "parent", "print").agg(F.count("*").alias("n"), F.max("words").alias("words"))
    stands = parsed.select("host", F.explode("nodes").alias("x")).groupBy("host", F.col("x.path").alias("path"))
    stands = stands.agg(F.count("*").alias("pages"), F.first("x.nodes").alias("nodes"), F.first("x.generic").alias("generic"), F.first("x.outside").alias("outside"))
    # Pages do not depend on a text, so the sums over texts need no join of text with page counts.
    weighed = texts.groupBy("host", "path", "parent").agg(F.avg(F.log("n")).alias("logs"), F.sum(F.col("words") * F.col("n")).alias("all"), F.sum(F.col("words") * F.col("n") * F.log("n")).alias("said"))
    content = weighed.join(stands, ["host", "path"]).withColumn("base", F.log(F.col("pages") + PRIOR))
    content = content.withColumn("content", 1 - F.col("logs") / F.col("base")).withColumn("told", F.col("all") - F.col("said") / F.col("base"))
    shapes = parsed.select("host", F.explode("styles").alias("s")).groupBy("host", F.col("s.path").alias("parent"), F.col("s.print").alias("print")).agg(F.count("*").alias("n"))
    total = shapes.groupBy("host", "parent").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    look = total.where("m > 1").select("host", "parent", ((F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).alias("look"))
    scored = content.join(look, ["host", "parent"], "left").withColumn("importance", CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.coalesce("look", F.lit(1.0)))
    return scored.select("host", "path", "importance", F.greatest("told", F.lit(0.0)).alias("words"), "nodes", "generic", "outside")


def side_branches(texts: DataFrame) -> DataFrame:
    """(host, node): roots of branches with little of their parent's information beside a container with most of it."""
    chain = texts.select("host", "path", "words", "nodes", "outside", F.posexplode(F.arrays_zip("nodes", "generic")).alias("at", "x"))
    chain = chain.select("host", "path", "words", "at", "outside", F.col("x.nodes").alias("node"), F.col("x.generic").alias("generic"), F.coalesce(F.get("nodes", F.col("at") - 1), F.lit(0)).alias("parent"))
    nodes = chain.groupBy("host", "parent", "node").agg(F.sum("words").alias("words"), F.bool_or(F.col("path") != F.col("node")).alias("container"), F.bool_or("generic").alias("generic"), F.bool_or(F.col("at") < F.col("outside")).alias("outside"))
    parents = nodes.groupBy("host", "parent").agg(F.sum("words").alias("all"), F.max(F.struct("words", "container")).alias("most"))
    parents = parents.where(F.col("most.container") & (F.col("most.words") >= MOST * F.col("all")) & (F.col("all") > 0)).select("host", "parent", "all")
    return nodes.where("generic and outside").join(parents, ["host", "parent"]).where(F.col("words") < SHARE * F.col("all")).select("host", "node")


def low_nodes(parsed: DataFrame) -> DataFrame:
    """(host, low array<long>): paths of each host's nodes that are removed; hosts without any are absent."""
    texts = staged(text_nodes(parsed), "nodes")
    low = texts.groupBy("host", "path").agg(F.max("importance").alias("importance")).where(F.col("importance") < LOW).select("host", "path")
    below = texts.select("host", "path", F.explode("nodes").alias("node")).join(side_branches(texts), ["host", "node"]).select("host", "path")
    return low.union(below).groupBy("host").agg(F.collect_set("path").alias("low"))


def with_low_nodes(parsed: DataFrame, low: DataFrame, small: int = SMALL, salts: int = SALTS) -> DataFrame:
    """``parsed`` with its host's low nodes. A list of at most ``small`` nodes in all, counted first, goes to every
    executor and no text moves; a longer one meets the pages by host and salt, so that a host's pages are spread."""
    hosts, nodes = low.agg(F.count("*"), F.coalesce(F.sum(F.size("low")), F.lit(0))).first()
    if hosts + nodes <= small:
        return parsed.join(F.broadcast(low), "host", "left")
    spread = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return parsed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    parsed = staged(parse(pages, id_col, url_col, html_col), "pages")
    joined = with_low_nodes(parsed, staged(low_nodes(parsed), "low"))
    wanted = joined.select("page_id", "url", "low", F.filter("blocks", lambda b: b["text"].isNotNull()).alias("blocks"))
    left = F.when(F.col("low").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.array_contains("low", b["path"])))
    kept = wanted.select("page_id", "url", F.get(F.transform(F.array(left), lambda x: F.when(F.size(x) > 0, x).otherwise(F.col("blocks"))), 0).alias("kept"))
    size = lambda wanted: F.aggregate(F.filter("kept", wanted), F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    inner, outer = size(lambda b: b["inside"]), size(lambda b: ~b["inside"])
    whole = (inner == 0) | (outer >= TEASER_LEAST) & (outer > TEASER_TIMES * inner)
    text = F.array_join(F.transform(F.when(whole, F.col("kept")).otherwise(F.filter("kept", lambda b: b["inside"])), lambda b: b["text"]), " ")
    return kept.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
