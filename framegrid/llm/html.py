"""Main-text extraction with removal of a site's template.

A page is parsed into blocks of text. Element subtrees are hashed, their hashes are counted for each
host over its distinct pages in Spark, and subtrees that recur across many pages of the host are
deleted first, wherever they stand. What is left is judged by role: elements that HTML or their name
marks as no part of the article (menus, footers, adverts, reader comments and so on) go too, since much
of their text may change from page to page, or a host may have too few pages to count. A class or id
only names a role if one of its tokens as a whole does, and not where the element holds an article, main
or more than half of the page's text: layout wrappers are named after what stands beside the article too.

The page's text is what main holds, in a page without main what its articles hold, else all of it. What
the article element holds is judged more carefully than what stands around it: paragraphs and headings
in it are never deleted, its container elements only where they recur on a large share of the host's
pages, so that a passage which many articles quote stays, and its list items, like paragraphs and list
items that stand in main alone, only where nearly all of the host's pages have them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import map_batches, shared_dir

#: A subtree outside the article goes when it recurs on so many distinct pages of its host.
MIN_PAGES = 5
#: One inside the article goes when it also recurs on this share of them.
INNER_SHARE = 0.3
#: A list item in the article, and a paragraph or list item in main alone, when it recurs on this share.
LEAF_SHARE = 0.9
#: So many template hashes at most go to every worker, some 50 MB there; more are joined.
BROADCAST_SUBTREES = 500_000

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:(?:[^>"']|"[^"]*"|'[^']*')*+(?=>))|[^>]*)>""", re.S
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names and the words of class names (fixed values of HTML and of common usage).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = frozenset(
    "head script style title noscript template iframe object svg canvas audio video nav header footer aside form button select "
    "textarea input dialog menu map noframes noembed xmp plaintext".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("aside center details div dl fieldset figure footer form header menu nav ol section table ul".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended comment comments disqus replies pagination pager widget skip toolbar".split()
)
#: Words that may stand beside those in a token; any other word (has, with, free, layout ...) gives it another sense.
FILLER = frozenset(
    "area article articles bar block body bottom box button buttons center col column container content desktop dfp dialog div "
    "entry fixed floating form google gpt group heading header icon icons iframe image img info inline inner item items label large "
    "law leaderboard left link links list main media message mobile next outer panel placeholder policy post posts previous primary "
    "respond right row secondary section site skyscraper slot small space sticky text thread title top unit wrap wrapper zone".split()
)
#: Of these the articles in them are others than the page's, so they only stay where the page has none besides.
OTHERS = frozenset("comment comments disqus replies related recommended".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An opening tag of the first kind closes an open element of the second, up to a boundary of the third.
_CLOSES_P = BLOCKS - {"br", "option", "optgroup", "caption", "legend", "html", "body", "tbody", "thead", "tfoot", "tr", "td", "th"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_SCOPE = frozenset("article aside blockquote body center details div fieldset figure footer form header html main nav section table td th ul ol dl li".split())


@dataclass(eq=False)
class _Named:
    """An element that a class or id names as no part of the article; the page's end decides on it."""

    others: bool
    size: int = 0  # characters of text in it that are still there
    article: int = 0  # those of them in an article or main in it
    kept: bool = False


@dataclass
class _Element:
    tag: str
    dropped: bool
    article: int  # 2 inside an article element, 1 inside main, else 0
    sign: list[str] = field(default_factory=list)
    first: int = 0  # the first block that may lie in it
    named: tuple[_Named, ...] = ()  # those it lies in, from outside
    around: int = 0  # so many of them lie around its article or main
    ends: bool = False  # its end also ends a block
    main: bool = False


@dataclass
class Block:
    text: str
    article: int
    paths: list[int] = field(default_factory=list)
    named: tuple[_Named, ...] = ()
    around: int = 0
    dropped: bool = False
    main: bool = False


@dataclass
class Page:
    """All blocks of a page, and the hashes of all its subtrees that may be template."""

    every: list[Block] = field(default_factory=list)
    subtrees: set[int] = field(default_factory=set)

    def main_text(self, template: Container[int] = frozenset()) -> tuple[list[Block], int]:
        """(the blocks of the main text, how many blocks lay in a subtree of ``template`` and went first)."""
        left = [b for b in self.every if not any(h in template for h in b.paths)]
        removed = len(self.every) - len(left)
        left = _decide([b for b in left if not b.dropped])
        if any(b.main for b in left):
            return [b for b in left if b.main], removed
        best = max((b.article for b in left), default=0)
        return [b for b in left if b.article == best], removed

    @property
    def blocks(self) -> list[Block]:
        """The main text's blocks where no template is known."""
        return self.main_text()[0]


def _is_noise(tag: str, attrs: str) -> bool:
    """Whether tag, role or hiding drop the element."""
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _naming(tag: str, attrs: str) -> set[str]:
    """The words of NOISE in those tokens of class and id that hold no word of another sense."""
    found: set[str] = set()
    if not attrs or tag in ("html", "body", "main"):
        return found
    for name, value in _ATTR.findall(attrs):
        if name.lower() in ("class", "id"):
            for token in value.strip("\"'").split():
                words = {w.lower() for w in _WORD.findall(token) if len(w) > 1}
                if words & NOISE and words <= NOISE | FILLER:
                    found |= words & NOISE
    return found & {"comment", "comments"} if tag == "article" else found


def _decide(blocks: list[Block]) -> list[Block]:
    """The blocks that stay when each named element goes or stays as a whole."""
    every = {n: None for b in blocks for n in b.named}
    if not every:
        return blocks
    for n in every:
        n.size = n.article = 0
    for b in blocks:
        for k, n in enumerate(b.named):
            n.size += len(b.text)
            n.article += len(b.text) if k < b.around else 0
    total = sum(len(b.text) for b in blocks)
    for n in every:
        n.kept = not n.others and (n.article > 0 or 2 * n.size > total)
    left = [b for b in blocks if all(n.kept for n in b.named)]
    article = any(b.article for b in left)
    for n in every:
        n.kept |= n.others and (not left or n.article > 0 and not article)
    return [b for b in blocks if all(n.kept for n in b.named)]


def parse(html: str | None, host: str = "") -> Page:
    """Blocks and subtree hashes of one page; malformed markup is read as browsers do where that matters.

    The hash of a subtree covers host, tags and text; its lowest bit tells whether it lies inside an
    article or main, the next whether it is a single paragraph or list item there.
    """
    page, stack = Page(), [_Element("", False, 0)]
    pieces: list[str] = []
    open_blocks: list[Block] = []

    def flush() -> None:
        if not pieces:
            return
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            for e in stack:
                e.sign.append(text)
            top = stack[-1]
            open_blocks.append(Block(text, top.article, [], top.named, top.around, top.dropped, top.main))

    def close() -> None:
        e = stack[-1]
        leaf = e.article > 0 and e.tag == "li" or e.article == 1 and e.tag == "p"
        if leaf or e.tag in CONTAINERS or e.article == 0 and e.tag in BLOCKS and e.tag not in ("html", "body", "main", "article"):
            if e.sign and "\0article" not in e.sign:
                h = xxhash.xxh64_intdigest(f"{host}\0{e.tag}\0" + "\0".join(e.sign)) & ~3
                h = (h | (3 if leaf else 1 if e.article else 0)) - (1 << 63)
                page.subtrees.add(h)
                for b in open_blocks[e.first :]:
                    b.paths.append(h)
        stack.pop()
        stack[-1].sign.append(f"/{e.tag}")

    def close_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            close()

    at, text, size = 0, html or "", len(html or "")
    while at < size:
        m = _TOKEN.search(text, at)
        if not m:
            pieces.append(text[at:])
            break
        if m.start() > at:
            pieces.append(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and all(e.tag != "p" for e in stack):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth) if tag in BLOCKS or stack[depth].dropped or stack[depth].ends else _close_inline(stack, depth)
                    break
                if tag not in BLOCKS and stack[depth].tag in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            flush()
        if tag == "br" or tag in VOID:
            continue
        if tag in _CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].tag in _SCOPE:
                    break
        if tag in _SIBLINGS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in _SIBLINGS[tag]:
                    close_to(depth)
                    if tag != "tr" or stack[-1].tag not in ("td", "th", "tr"):
                        break
                elif stack[depth].tag in _BOUNDARY[tag]:
                    break
        if tag in ("article", "main"):
            for e in stack:
                e.sign.append("\0article")
        up = stack[-1]
        inside = 2 if tag == "article" or up.article == 2 else 1 if tag == "main" or up.article else 0
        noise = _is_noise(tag, m[3])
        if up.dropped and tag in HEADINGS and up.tag in ("header", "hgroup") and up.article and not stack[-2].dropped:
            dropped = False  # the title in an article's own header
        else:
            dropped = up.dropped or noise
        words = set() if dropped or dropped != up.dropped else _naming(tag, m[3])
        named = (*up.named, _Named(bool(words & OTHERS))) if words else up.named
        if noise or words or dropped != up.dropped:
            flush()
        around = len(up.named) if tag in ("article", "main") and not words else up.around
        stack.append(_Element(tag, dropped, inside, [], len(open_blocks), named, around, bool(words), tag == "main" or up.main))
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(text, at)
            at = end.start() if end else size
            flush()
            stack.pop()
    close_to(1)
    page.every = open_blocks
    return page


def _close_inline(stack: list[_Element], depth: int) -> None:
    """End an inline element; what it opened and left open ends with it."""
    signs = [s for e in stack[depth:] for s in e.sign]
    del stack[depth:]
    stack[-1].sign.extend([*signs, "/"])


def host_of(url_col: str = "url"):
    """The lower-cased host of a URL, an empty string for null or none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _subtrees(pages: DataFrame) -> DataFrame:
    """(page_id, host, twin, body, subtrees): ``body`` is the hash of the page's main text by roles alone."""

    def run(batches):
        for batch in batches:
            found = [parse(h, host) for host, h in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            bodies = [xxhash.xxh64_intdigest("\0".join(b.text for b in p.blocks)) - (1 << 63) for p in found]
            lists = pa.array([sorted(p.subtrees) for p in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bodies, pa.int64()), lists], ["page_id", "host", "twin", "body", "subtrees"])

    return map_batches(pages.select("page_id", "host", "twin", "html"), run, "page_id long, host string, twin long, body long, subtrees array<long>")


def templates(subtrees: DataFrame, min_pages: int = MIN_PAGES, inner_share: float = INNER_SHARE, leaf_share: float = LEAF_SHARE) -> DataFrame:
    """(subtree): the hashes that recur on enough distinct pages of their host.

    A page counts by its main text, so copies of a page count once.
    """
    each = subtrees.select("host", "body", F.explode("subtrees").alias("subtree")).distinct()
    often = each.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    hosts = subtrees.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    inner = F.col("subtree").bitwiseAND(F.lit(1)) == 1
    share = F.when(F.col("subtree").bitwiseAND(F.lit(2)) == 2, leaf_share).otherwise(inner_share)
    return often.join(hosts, "host").filter(~inner | (F.col("n") >= share * F.col("pages"))).select("subtree")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, inner_share: float = INNER_SHARE, broadcast_subtrees: int = BROADCAST_SUBTREES) -> DataFrame:
    """(page_id, url, text, n_removed, n_blocks): the main text of each row of ``pages``.

    ``n_removed`` of the page's ``n_blocks`` blocks lay in template subtrees and were deleted before
    roles were judged. Up to ``broadcast_subtrees`` template hashes, which are counted first, go to the
    workers as one sorted array; beyond that each page's own are joined to it, with the same result.

    Blocks are joined in page order by one space; the text is empty if none is left, also for a null or
    empty html. A null url counts as a host of its own kind, an empty name. Copies of a page count once
    for the template; each row is judged by its own html, whatever others have its page_id, and a null
    page_id is passed on. A page of any length is read whole; an empty table gives an empty result;
    further columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host_of().alias("host"), F.xxhash64("html").alias("twin"), F.col("html").cast("string"))
    path = f"{shared_dir(spark)}/subtrees-{uuid.uuid4()}"
    _subtrees(rows).write.parquet(path)
    subtrees = spark.read.parquet(path)
    templates(subtrees, min_pages, inner_share).write.parquet(f"{path}-templates")
    found = spark.read.parquet(f"{path}-templates")
    if found.count() <= broadcast_subtrees:
        known = spark.sparkContext.broadcast(frozenset(found.toArrow().column("subtree").to_pylist()))
        return map_batches(rows.drop("twin"), _extracted(lambda row: known.value), _SCHEMA)
    removed = (
        subtrees.select("page_id", "host", "twin", F.explode("subtrees").alias("subtree")).join(found, "subtree")
        .groupBy("page_id", "host", "twin").agg(F.collect_set("subtree").alias("removed"))
    )
    removed.write.parquet(f"{path}-removed")
    removed = spark.read.parquet(f"{path}-removed").select(F.col("page_id").alias("of"), F.col("host").alias("at"), F.col("twin").alias("like"), "removed")
    same = rows.page_id.eqNullSafe(removed.of) & (rows.host == removed["at"]) & (rows.twin == removed.like)
    joined = rows.join(removed, same, "left").select("page_id", "url", "host", "html", "removed")
    return map_batches(joined, _extracted(lambda row: frozenset(row[4] or ())), _SCHEMA)


_SCHEMA = "page_id long, url string, text string, n_removed long, n_blocks long"


def _extracted(template_of: Callable[[tuple], Container[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, sizes = [], [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = parse(row[3], row[2])
                blocks, gone = page.main_text(template_of(row))
                texts.append(" ".join(b.text for b in blocks))
                removed.append(gone)
                sizes.append(len(page.every))
            made = [pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["page_id", "url", "text", "n_removed", "n_blocks"])

    return run
