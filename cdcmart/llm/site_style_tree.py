"""HTML extraction by site style trees.

The pages of a host are merged by style: elements with the same path of tag names and
classes are one node. A node's presentation importance is the entropy of the child lists
it shows over the host's pages, that of a block of text one minus the entropy of that text
over the pages that have the node. A branch weighs both: ``(1 - GAMMA)`` of its own
presentation plus ``GAMMA`` of the mean importance of the blocks below it. Branches and
blocks under ``LOW`` on nodes that ``MIN_PAGES`` pages or more show are removed from each page.
Pages that are copies of one another count once.

What the mark-up itself declares comes first: elements whose tag, role, class or id names a
menu, header, footer, sidebar, notice, advert, form, script, style or comment are not
content; if a page has ``article`` or ``main`` elements, only those are. Inside them fewer class
names speak (``_IN_ARTICLE``: an article has headers and alerts of its own), and an id only
as a whole and not on headings, whose ids are slugs; the tree decides on all other blocks and
branches there too. Headings of an article go only with a branch they stand in.

Articles published twice on a host, or with a changed passage, are no boilerplate: pages count
once for each text of their article, and a block of an article once for each longest other
block it stands with.

A block ends where a block element begins or ends and at ``br``. Text is decoded, white
space within a block becomes one space, blocks are joined by line feeds.

Defined cases: null html is empty and has empty text; null or odd urls share one host; broken
mark-up (open comments, missing end tags, stray signs) is read as browsers do roughly; pages
repeated keep their text; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.llm.common import checkpointed, maybe_in, skew_join

GAMMA = 0.9
LOW = 0.2
MIN_PAGES = 8
#: Elements deeper than this count to the ancestor at this depth.
DEPTH = 24

# fixed values: names of HTML elements and of page regions
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea xmp iframe noembed noframes noscript template title svg math".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_CLOSED_BY_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
_BARRIER = frozenset("table ul ol dl article main section div body html".split())
_NOT_CONTENT = frozenset("nav footer aside form head button select input dialog menu object applet audio video canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_REGIONS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promotions "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager sidebar sidebars aside "
    "header masthead topbar footer foot copyright comment comments disqus respond replies reply "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar search searchbox skip".split()
)
# fixed values: region names that mean the same inside an article; headings
_IN_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar sidebars comment comments disqus respond replies "
    "newsletter subscribe subscription share sharing social related recommended recommendations widget widgets popup modal overlay".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<(" + "|".join(sorted(_RAW)) + r")\b[^>]*+(?<!/)>.*?(?:</\1\b[^>]*+>|\Z)"
    r"|<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[^a-z0-9]+")


@dataclass
class Element:
    """An open element: ``path`` is its style, ``banned`` whether it or an ancestor is no content."""

    tag: str
    path: str
    banned: bool
    in_main: bool
    depth: int
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    path: str
    text: str
    banned: bool
    in_main: bool
    heading: bool


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _declared(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in _NOT_CONTENT or (tag == "header" and not in_main):
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if in_main:
        if tag not in _HEADINGS and attributes.get("id", "").lower() in _IN_ARTICLE:
            return True
        return "class" in attributes and not _IN_ARTICLE.isdisjoint(_WORDS.split(attributes["class"].lower()))
    if tag in ("html", "body", "main", "article"):
        named = attributes.get("class", "") if tag == "article" else ""
    else:
        named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return bool(named.strip()) and not _REGIONS.isdisjoint(_WORDS.split(named.lower()))


def blocks_of(page: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """Blocks of text in page order, and (path, child list) of each element that is content."""
    root = Element("", "", False, False, 0)
    stack, blocks, shown = [root], [], []
    parts: list[str] = []

    def end_block() -> None:
        if not parts:
            return
        text = "".join(parts)
        parts.clear()
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            at = next((e for e in reversed(stack) if e.tag not in _INLINE), root)
            blocks.append(Block(at.path, text, stack[-1].banned, stack[-1].in_main, at.tag in _HEADINGS))

    def close(element: Element) -> None:
        if not element.banned:
            shown.append((element.path, " ".join(element.children)))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            close(stack.pop())

    at = 0
    for found in _TOKEN.finditer(page):
        if found.start() > at:
            parts.append(page[at : found.start()])
        at = found.end()
        _, closing, name, rest, closing_odd, name_odd, rest_odd = found.groups()
        if name is None:
            if name_odd is None:  # a comment, a declaration, or an element whose content is no text
                if found[0].startswith("<![CDATA["):
                    parts.append(entities.escape(found[0][9:].removesuffix("]]>")))
                continue
            closing, name, rest = closing_odd, name_odd, rest_odd
        tag = name.lower()
        if closing:
            if tag not in _INLINE:
                end_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if stack[i].banned and not stack[i - 1].banned:
                        end_block()
                    pop_to(i)
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
            continue
        if tag not in _INLINE:
            end_block()
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in _BARRIER:
                    break
        for like in _CLOSED_BY_LIKE.get(tag, ()):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == like:
                    pop_to(i)
                    break
                if stack[i].tag in _BARRIER:
                    break
        parent = stack[-1]
        attributes = _attributes(rest) if rest else {}
        style = tag + "".join(f".{c}" for c in sorted(attributes["class"].lower().split())) if "class" in attributes else tag
        if not parent.children or parent.children[-1] != style:
            parent.children.append(style)  # runs of like children are one
        if tag in _VOID or rest.endswith("/"):
            continue
        banned = parent.banned or _declared(tag, attributes, parent.in_main)
        if banned and not parent.banned:
            end_block()
        path = f"{parent.path}>{style}" if parent.depth < DEPTH else parent.path
        in_main = parent.in_main or (not banned and tag in ("article", "main"))
        stack.append(Element(tag, path, banned, in_main, parent.depth + 1))
    parts.append(page[at:])
    end_block()
    pop_to(1)
    return blocks, shown


def main_blocks(blocks: list[Block]) -> list[int]:
    """Numbers of the blocks that may be content."""
    in_main = any(b.in_main and not b.banned for b in blocks)
    return [i for i, b in enumerate(blocks) if not b.banned and (b.in_main or not in_main)]


def contexts(blocks: list[Block], digest: int) -> list[int]:
    """What each block stands with: in an article its longest other block (of equal ones the first), elsewhere the page."""
    article = sorted((i for i, b in enumerate(blocks) if b.in_main and not b.banned), key=lambda i: -len(blocks[i].text))
    found = [digest] * len(blocks)
    for i in article:
        other = next((j for j in article if blocks[j].text != blocks[i].text), None)
        found[i] = digest if other is None else _hash(blocks[other].text)
    return found


def _open(block: Block) -> tuple[str, int | None]:
    """Path and feature that a block is looked up by; headings of an article have the path of what they stand in."""
    if block.heading and block.in_main:
        return block.path.rpartition(">")[0], None
    return block.path, _hash(block.text)


def _hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31) | (zlib.adler32(data) & 0x7FFFFFFF)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][-+.A-Za-z0-9]*:)?//([^/?#]*)", 1)), F.lit(""))


def read_pages(pages: DataFrame) -> DataFrame:
    """What each page shows: ``_key, host, digest`` (tells copies apart), ``nodes`` (a path, feature and context once), and ``open``.

    ``open``: the blocks that no declaration decides on.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = pa.list_(pa.struct([("path", pa.string()), ("feature", pa.int64()), ("content", pa.bool_()), ("context", pa.int64())]))
        block = pa.list_(pa.struct([("number", pa.int32()), ("path", pa.string()), ("feature", pa.int64())]))
        for batch in batches:
            digests, nodes, undecided = [], [], []
            for page in batch.column("html").to_pylist():
                blocks, shown = blocks_of(page or "")
                own = main_blocks(blocks)
                digest = _hash("\n".join(blocks[i].text for i in own))
                seen = {(path, _hash(children), False, digest): None for path, children in reversed(dict(reversed(shown)).items())}
                seen |= {(b.path, _hash(b.text), True, c): None for b, c in zip(blocks, contexts(blocks, digest), strict=True) if not b.banned}
                digests.append(digest)
                nodes.append([{"path": p, "feature": f, "content": c, "context": x} for p, f, c, x in seen])
                undecided.append([{"number": i, "path": p, "feature": f} for i in own for p, f in [_open(blocks[i])]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("host"), pa.array(digests, pa.int64()), pa.array(nodes, node), pa.array(undecided, block)], names=["_key", "host", "digest", "nodes", "open"]
            )

    schema = "_key long, host string, digest long, nodes array<struct<path:string,feature:bigint,content:boolean,context:bigint>>, open array<struct<number:int,path:string,feature:bigint>>"
    return pages.select("_key", "host", "html").mapInArrow(read, schema)


def unimportant(read: DataFrame) -> DataFrame:
    """Of pages as ``read_pages`` gives them: ``host, path, feature`` of what a host repeats: a block, or with feature null a branch."""
    once = read.groupBy("host", "digest").agg(F.min_by("nodes", "_key").alias("nodes"))
    counts = once.select("host", F.inline("nodes")).distinct().groupBy("host", "path", "feature", "content").agg(F.count("*").alias("n"))
    counts = checkpointed(counts)
    shown = counts.where("NOT content").groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("_nlogn"))
    # entropy of the child lists to the base of the number of pages
    diverse = (F.log("pages") - F.col("_nlogn") / F.col("pages")) / F.log("pages")
    shown = shown.where(F.col("pages") >= MIN_PAGES).withColumn("presentation", diverse).select("host", "path", "pages", "presentation")
    # a path of a large host may hold a third of all blocks
    node = F.xxhash64("host", "path")
    rated = skew_join(counts.where("content").withColumn("_node", node), shown.select(node.alias("_node"), "pages"), "_node")
    rated = rated.withColumn("importance", F.greatest(F.lit(0.0), 1 - F.log("n") / F.log("pages")))
    blocks = rated.where(F.col("importance") < LOW).select("host", "path", "feature")
    steps = F.transform(F.sequence(F.lit(2), F.size(F.split("path", ">"))), lambda i: F.array_join(F.slice(F.split("path", ">"), 1, i), ">"))
    below = rated.groupBy("host", "path").agg(F.sum("importance").alias("total"), F.count("*").alias("many"))
    below = below.select("host", F.explode(steps).alias("path"), "total", "many").groupBy("host", "path").agg((F.sum("total") / F.sum("many")).alias("content"))
    branches = shown.join(below, ["host", "path"]).where((1 - GAMMA) * F.col("presentation") + GAMMA * F.col("content") < LOW)
    return blocks.union(branches.select("host", "path", F.lit(None).cast("long").alias("feature")))


def _texts(pages: DataFrame) -> DataFrame:
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, dropped in zip(batch.column("html").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
                blocks, _ = blocks_of(page or "")
                gone = set(dropped or ())
                texts.append("\n".join(blocks[i].text for i in main_blocks(blocks) if i not in gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html", "dropped").mapInArrow(read, f"page_id {kind}, url string, text string")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).withColumn("_key", F.xxhash64("page_id", "url", "html"))
    read = checkpointed(read_pages(keyed))
    low = checkpointed(unimportant(read))
    low = low.withColumn("_place", F.xxhash64("host", "path", F.coalesce("feature", F.lit(0)), F.col("feature").isNull()))
    # every block looks for itself and for each branch above it
    steps = F.transform(F.sequence(F.lit(2), F.size(F.split("path", ">"))), lambda i: F.array_join(F.slice(F.split("path", ">"), 1, i), ">"))
    places = F.concat(
        F.array(F.xxhash64("host", "path", F.col("feature"), F.lit(False))),
        F.transform(steps, lambda p: F.xxhash64("host", p, F.lit(0).cast("long"), F.lit(True))),
    )
    looked = read.select("_key", "host", F.inline("open")).select("_key", "number", F.explode(places).alias("_place"))
    found = skew_join(looked, low.select("_place").distinct(), "_place")
    dropped = checkpointed(found.groupBy("_key").agg(F.collect_set("number").alias("dropped")))
    # only pages that may lose a block are shuffled
    marks = dropped.select(F.col("_key").alias("_mark"))
    changed = maybe_in(keyed, marks, "_key", "_mark").join(dropped, "_key", "left")
    same = maybe_in(keyed, marks, "_key", "_mark", keep=False).withColumn("dropped", F.lit(None).cast("array<int>"))
    both = same.select("page_id", "url", "html", "dropped").union(changed.select("page_id", "url", "html", "dropped"))
    return _texts(both).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
