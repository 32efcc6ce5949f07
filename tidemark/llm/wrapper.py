"""Main text of web pages by wrapper induction on the pages of a host.

One page of each host is its reference: the one whose length is nearest to the lower quartile of its pages, ties by
id. Every page is aligned with its host's reference by simple tree matching, and every block of text of every
page, menus and footers included, votes at the node of the reference that it is aligned with. Votes count distinct
contents (a page's CONTENT longest blocks stand for it), so that copies of one page are one vote. A node with
MIN_PAGES contents or more tells which part of the wrapper it is:

* constant: one text makes up CONSTANT of its contents. That text is template; another text at the node isn't.
* low variety: outside articles, its texts recur, so that there are at most VARIETY texts a content. The texts that
  recur are template; one that is on a single content isn't.
* menu: outside articles, most of its characters are in links. Blocks that are mostly links are template there.
* content: its texts vary and are as long as prose. What only weak hints of markup speak against stays.

What varies from page to page as the article does, and blocks that the wrapper doesn't know, are told by markup:
navigation, headers outside articles, footers, asides and forms go, and elements whose class, id or role names an advert,
notice, comments and the like (strong hints). Outside articles so do weaker names and runs of links (weak hints),
where the wrapper doesn't say content. Everything else stays, in an article or not.

References are one page a host; they, and the wrappers made from them, are broadcast when they are proven small, else
joined by salted hosts. Votes are summed on each task before they are shuffled, and go by (host, node, text), so a
popular host is spread out. Each page is parsed once: its blocks are written to the shared folder and read again when
the wrapper is known. A wrapper has at most as many nodes as its reference and 1 / RECURS texts at each.

Blocks are decoded, their white space is turned into single spaces, and they are joined by \\n in page order.
Cases: null html is empty and gives the empty text; null or odd URLs share the empty host; repeated rows are
handled each; a host with fewer than MIN_PAGES contents has no wrapper; unclosed, stray or deeply nested tags are
tolerated. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, SALTS, checkpoint_folder, checkpointed, quoted
from tidemark.llm.htmltree import INLINE, RAW, Matcher, Node, numbered, parse

CONSTANT, VARIETY, RECURS = 0.6, 0.5, 0.005
MIN_PAGES = 10
LINKED = 0.5
PROSE = 80
CONTENT = 3
STRONG, WEAK, ARTICLE = 1, 2, 4

_OUT = frozenset("nav aside footer form select menu dialog head audio video canvas datalist".split())
_EDGE = (r"(?:^|[\s_-])(?:", r")(?:$|[\s_-])")
_STRONG = re.compile("ads?|advert\\w*|adsense|sponsor\\w*|menu|nav\\w*|breadcrumbs?|footer|side-?bar|cookies?\\w*|consent|gdpr|notices?|newsletter|subscri\\w*|popup|modal|overlay|comments?\\w*|disqus|complementary|contentinfo|navigation".join(_EDGE))
_WEAK = re.compile("header|aside|banner|promo\\w*|alert|shar(?:e|ing)|social|related|recommend\\w*|respond|repl(?:y|ies)|form|login|search\\w*|widget\\w*|copyright|pagination|pager".join(_EDGE))
_ARTICLE = ("article", "main")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _hint(node: Node, in_article: bool) -> int:
    """What an element's tag and names say against it."""
    if node.tag in _OUT or node.tag == "header" and not in_article:
        return STRONG
    if not node.names or node.tag in ("html", "body", "main"):
        return WEAK if node.tag == "button" else 0
    if _STRONG.search(node.names):
        return STRONG
    return WEAK if node.tag == "button" or _WEAK.search(node.names) else 0


def blocks(root: Node) -> list[tuple[str, int, int, int]]:
    """(text, number of the block's node, characters in links, flags) of all blocks but raw ones, in page order."""
    made: list[tuple[str, int, int, int]] = []
    held: list[tuple[str, bool]] = []
    owner = [root.number, 0]

    def flush() -> None:
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            made.append((text, owner[0], sum(len(t.strip()) for t, link in held if link), owner[1]))
        held.clear()

    # An explicit stack: pieces are strings or nodes; "end" restores the owner after a block.
    stack: list[tuple] = [("in", root, 0, False)]
    while stack:
        step, what, flags, in_link = stack.pop()
        if step == "text":
            held.append((what, in_link))
        elif step == "end":
            flush()
            owner[:] = what
        else:
            node: Node = what
            if node.tag == "br":
                held.append((" ", in_link))
            if node.tag in RAW or node.tag == "br":
                continue
            inside = flags | (ARTICLE if node.tag in _ARTICLE or "main" in node.names.split() else 0)
            inside |= _hint(node, bool(inside & ARTICLE))
            link = in_link or node.tag == "a"
            if node.tag not in INLINE or inside != flags:
                flush()
                stack.append(("end", list(owner), inside, link))
                owner[:] = [node.number, inside]
            stack.extend(("text" if isinstance(p, str) else "in", p, inside, link) for p in reversed(node.pieces))
    flush()
    return _runs(made)


def _runs(made: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """made with a weak hint at runs of three or more blocks outside articles that are links alone."""
    out, first = list(made), 0
    for i in range(len(made) + 1):
        if i < len(made) and not made[i][3] & ARTICLE and made[i][2] >= 0.9 * len(made[i][0]):
            continue
        if i - first >= 3:
            out[first:i] = [(t, n, linked, flags | WEAK) for t, n, linked, flags in made[first:i]]
        first = i + 1
    return out


def page_blocks(page: str | None, reference: Node | None, matcher: Matcher) -> list[tuple[str, int, int, int, int]]:
    """(text, aligned node of the reference or -1, CRC-32 of the text, characters in links, flags) of a page's blocks."""
    root = parse(page or "")
    numbered(root)
    aligned = matcher.align(root, reference) if reference is not None else {}
    return [(t, aligned.get(n, -1), crc32(t.encode("utf-8", "surrogatepass")), linked, flags) for t, n, linked, flags in blocks(root)]


def content(found: list[tuple[str, int, int, int, int]]) -> int:
    """What stands for a page's content: a hash of its CONTENT longest blocks."""
    return crc32(repr(sorted(((len(b[0]), b[2]) for b in found), reverse=True)[:CONTENT]).encode())


class References:
    """Parsed reference pages, kept by their html while they repeat."""

    def __init__(self) -> None:
        self.trees: dict[str, Node] = {}

    def tree(self, page: str | None) -> Node | None:
        if page is None:
            return None
        if page not in self.trees:
            if len(self.trees) >= 200:
                self.trees.clear()
            root = parse(page)
            numbered(root)
            self.trees[page] = root
        return self.trees[page]


def _with(pages: DataFrame, told: DataFrame) -> DataFrame:
    """pages with what is told of their host; broadcast if that is proven small, else by salted hosts."""
    size = told.select([F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(8)).alias(c) for c in told.columns])
    total = size.agg(F.sum(sum((F.col(c) for c in size.columns), F.lit(0)))).first()[0] or 0
    if total <= BROADCAST_BYTES:
        return pages.join(F.broadcast(told), "host", "left")
    parts = told.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return pages.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("long")).join(parts, ["host", "part"], "left").drop("part")


def references(pages: DataFrame) -> DataFrame:
    """(host, reference): one page of each host that has one with content."""
    there = pages.where(F.length("html") > 0)
    quarter = checkpointed(there.groupBy("host").agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY length(html))").cast("long").alias("quarter")))
    near = F.struct(F.abs(F.length("html") - F.col("quarter")).alias("off"), F.col("page_id"), F.xxhash64("html"))
    return _with(there, quarter).groupBy("host").agg(F.min_by("html", near).alias("reference"))


_BLOCK = pa.struct([("text", pa.string()), ("node", pa.int32()), ("crc", pa.int64()), ("linked", pa.int32()), ("flags", pa.int32())])
_ALIGNED = "page_id long, url string, host string, content long, blocks array<struct<text:string,node:int,crc:bigint,linked:int,flags:int>>"


def aligned(pages: DataFrame, reference: DataFrame) -> DataFrame:
    """(page_id, url, host, content, blocks) of every page, written and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, trees = Matcher(), References()
        for batch in batches:
            made = [page_blocks(page.as_py(), trees.tree(ref.as_py()), matcher) for page, ref in zip(batch.column(3), batch.column(4))]
            contents = [content(found) for found in made]
            rows = pa.array([[dict(zip(("text", "node", "crc", "linked", "flags"), b)) for b in found] for found in made], pa.list_(_BLOCK))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(contents, pa.int64()), rows], names=["page_id", "url", "host", "content", "blocks"])

    folder = f"{checkpoint_folder(pages.sparkSession)}/wrapper-{uuid.uuid4().hex}"
    _with(pages, reference).select("page_id", "url", "host", "html", "reference").mapInArrow(run, _ALIGNED).write.parquet(folder)
    return pages.sparkSession.read.schema(_ALIGNED).parquet(folder)


def wrappers(found: DataFrame) -> DataFrame:
    """(host, wrapper): for each node of a host's reference that tells something: node, texts that are template there, menu, content."""
    each = found.select("host", "content", F.explode(F.filter("blocks", lambda b: b["node"] >= 0)).alias("b"))
    voted = each.groupBy("host", "b.node", "b.crc", "content").agg(F.max(F.length("b.text")).alias("chars"), F.max("b.linked").alias("linked"), F.max(F.col("b.flags").bitwiseAND(F.lit(ARTICLE))).alias("article"))
    texts = voted.groupBy("host", "node", "crc").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("article").alias("article"))
    texts = checkpointed(texts)
    slots = texts.groupBy("host", "node").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), (F.max("article") > 0).alias("article")).where(F.col("all") >= MIN_PAGES)
    share = F.col("linked") / F.col("chars")
    slots = checkpointed(
        slots.select("host", "node", "all", (~F.col("article") & (F.col("kinds") <= VARIETY * F.col("all"))).alias("recurring"), (~F.col("article") & (share > LINKED)).alias("menu"), ((F.col("kinds") > 0.9 * F.col("all")) & (F.col("chars") >= PROSE * F.col("all")) & (share < 0.3)).alias("content"))
    )
    constant = (F.col("n") >= MIN_PAGES) & (F.col("n") >= CONSTANT * F.col("all"))
    again = F.col("recurring") & (F.col("n") >= RECURS * F.col("all"))
    template = texts.where("n > 1").join(slots, ["host", "node"]).where(constant | again).groupBy("host", "node").agg(F.sort_array(F.collect_list("crc")).alias("texts"))
    told = slots.join(template, ["host", "node"], "left").where(F.col("menu") | F.col("content") | F.col("texts").isNotNull())
    part = F.struct(F.coalesce("texts", F.array().cast("array<bigint>")).alias("texts"), "menu", "content")
    return told.groupBy("host").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", part)))).alias("wrapper"))


def _kept(wrapper: Column, hints: bool):
    """Whether a block stays, given its host's wrapper."""

    def kept(b: Column) -> Column:
        part = F.try_element_at(wrapper, b["node"])
        template = F.coalesce(F.array_contains(part["texts"], b["crc"]), F.lit(False))
        menu = F.coalesce(part["menu"], F.lit(False)) & (b["linked"] > LINKED * F.length(b["text"]))
        if not hints:
            return ~template & ~menu
        has = lambda flag: b["flags"].bitwiseAND(F.lit(flag)) > 0
        weak = has(WEAK) & ~has(ARTICLE) & ~F.coalesce(part["content"], F.lit(False))
        return ~template & ~menu & ~has(STRONG) & ~weak

    return kept


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hints: bool = True, induced: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages. Without ``hints`` only the wrapper decides, without ``induced`` only the hints."""
    slim = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), quoted(html_col).cast("string").alias("html")).withColumn("host", host(F.col("url")))
    found = aligned(slim, checkpointed(references(slim)))
    told = _with(found, checkpointed(wrappers(found) if induced else wrappers(found.limit(0))))
    text = F.array_join(F.transform(F.filter("blocks", _kept(F.col("wrapper"), hints)), lambda b: b["text"]), "\n")
    return told.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
