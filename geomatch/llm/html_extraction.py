"""Main text of web pages by template deduction over equivalence classes.

Every page of a host is read as tokens: its elements, told apart by their path, and its blocks of
text, told apart by text and path. A token's occurrence vector says how often each page of the host
holds it. Tokens with equal vectors form a class; a class that is on most of the host's pages and
whose paths nest under one another is valid, and the valid classes, nested by path, are the host's
template. A block of text that is on the very pages of a class of template elements, at least
``TEXT_PAGES`` different ones (a few alike may be copies), is template text of that class. What lies
between template tokens are slots. Where the template has one article or main on each of its pages,
that is the slot of the text, and the other slots of the elements around it, which are boxes
(``BOXES``) of a steady count on their pages, go whatever their names and words: menus, adverts and
comments in any language. A box stays where it holds a title, an article or a main. Extracted are, in the order of the page,
all other blocks outside side matter that are no template text, and headings of template text right
before one of them. A page of template text alone keeps it. The main element of the template serves
pages that have no text outside elements named as side matter: an article or main is then read
whatever its name.

Side matter is known by tags and roles, and by classes and ids of which one word, parted by white
space, is made of ``SIDE_WORDS`` and ``PLACES`` alone; inside an article or main only ``ASIDE_WORDS``
count, as a share-price or a menu may be what the article is about.

Vectors are never collected: a token's vector is two sums of hashes of (page, count), so that the
pages of a host, however many, only meet in sums. Elements of any depth and number take part, in
time that grows with the length of the page; pages on a host without a valid class, or without the
main element of its template, are read by the same rules.

Defined cases: a null or empty html gives the empty text; a null url is a host of its own; ids may
be null or repeat; markup may be unclosed or cut anywhere; very long pages are read whole; other
columns are ignored; an empty table gives an empty result. White space is what Unicode and HTML call
so, the no-break space included.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator, Set
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import bounded_batches, written

PATH_CHARS = 400
BROADCAST_BYTES = 32 << 20
SUPPORT = 0.5
TEXT_PAGES = 5

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMES = re.compile(r"[a-z]+")
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES = {k: frozenset(v.split()) for k, v in {"li": "li p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "option": "option"}.items()}
FENCE = frozenset("table ul ol dl article section div body html main aside nav header footer form blockquote".split())
SIDE_TAGS = frozenset("head script style noscript template iframe object svg canvas nav aside footer form button select textarea dialog menu audio video map".split())
SIDE_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar form".split())
#: Words that name side matter in a class or an id; of these, those that do so inside an article too;
#: and words that say where or how large it is.
ASIDE_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter subscribe signup sidebar sidebars related recommended breadcrumb breadcrumbs navbar comment comments commentlist disqus respond masthead".split())
SIDE_WORDS = ASIDE_WORDS | frozenset("promotion banner notice notices notification popup modal overlay subscription login recommendations share sharing social menu menus navigation nav footer reply replies toolbar widget widgets".split())
PLACES = frozenset("area bar block bottom box btn button buttons container form global group inner item items left link links list main outer page panel post posts primary right row secondary section site slot thread top wrap wrapper".split())
WITHIN_PAGE = frozenset(["header"])
ARTICLES = frozenset(["article", "main"])
BOXES = frozenset("div section ul ol dl table details center".split())


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip("/ \t\r\n") else {}


def events(page: str) -> Iterator[tuple[str, str, dict[str, str] | str]]:
    """('open', tag, attributes), ('close', tag, ''), ('text', '', raw text)."""
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                yield "text", "", m[0][9:].removesuffix("]]>")
            continue
        if m[1] or m[4]:
            yield "close", tag, ""
            continue
        yield "open", tag, attributes(m[3] or m[6] or "")
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else n
        if tag in VOID:
            yield "close", tag, ""


def is_side(tag: str, attrs: dict[str, str], inside: bool = False) -> bool:
    """Whether an element is side matter; ``inside`` an article or main its names count for less."""
    if tag in SIDE_TAGS or "hidden" in attrs or attrs.get("role", "").lower() in SIDE_ROLES or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "style" in attrs and re.search(r"display\s*:\s*none", attrs["style"], re.I):
        return True
    telling = ASIDE_WORDS if inside else SIDE_WORDS
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = _NAMES.findall(name)
        if any(w in telling for w in words) and all(w in telling or w in PLACES for w in words):
            return True
    return False


class Node:
    """An element: what it inherits from the one above is settled when it opens."""

    __slots__ = ("tag", "path", "depth", "side", "length", "up", "block", "article", "linked", "within", "slot")

    def __init__(self, tag: str, path: str, up: Node | None, side: bool = False, within: bool = False, slots: Set[str] = frozenset()):
        self.tag, self.path, self.side, self.length, self.up, self.within = tag, path, side, 0, up, within
        self.depth = up.depth + 1 if up else 0
        self.block = path if tag in BLOCK or not up else up.block
        self.article = (up.article if up else None) or (self if tag in ARTICLES else None)
        self.linked = tag == "a" or bool(up and up.linked)
        self.slot = (up.slot if up else None) or (path if path in slots else None)


class Block(NamedTuple):
    """A block of text, the path of its block element, and that of the slot beside the main one that it stands in."""

    text: str
    path: str
    slot: str | None = None

    def is_heading(self) -> bool:
        return re.match(r"h[1-6]\b", self.path.rpartition("/")[2]) is not None


def short(path: str) -> str:
    """A long path by its digest, so that elements of any depth are told apart in bounded space."""
    return path if len(path) <= PATH_CHARS else "#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Stack:
    """The open elements, with the places of each tag and of fences, so that closing looks at no others."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.fences = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in FENCE:
            self.fences.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, tags: Iterable[str], through: bool = False) -> None:
        """Closes the innermost element of one of the tags; one beyond a fence only if ``through``."""
        k = max((at[-1] for t in tags if (at := self.places.get(t))), default=0)
        if not k or not through and self.fences and k < self.fences[-1]:
            return
        while len(self.nodes) > k:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in FENCE:
                self.fences.pop()


def walk(page: str, main_path: str | None = None, slots: Set[str] = frozenset()) -> tuple[list[Node], list[Block]]:
    """All elements of a page, and its blocks of text outside side matter; an element whose path is
    ``main_path`` is not side matter, whatever its name, and then only blocks inside it are given."""
    root = Node("", "", None)
    stack, nodes, blocks, words = Stack(root), [], [], []
    at, blank = root, True

    def flush() -> None:
        text = " ".join(entities.unescape("".join(words)).split()) if words else ""
        if text:
            blocks.append(Block(text, at.block, at.slot))
        words.clear()

    for kind, tag, what in events(page):
        top = stack.nodes[-1]
        if kind == "text":
            if not top.side:
                space = what.isspace()
                if main_path is None or top.within:
                    if not words or blank and not space:
                        at, blank = top, True
                    blank = blank and space
                    words.append(what)
                if not space and not top.linked:
                    top.length += len(what)
            continue
        if tag in BLOCK:
            flush()
        elif tag in ("br", "td", "th") and kind == "open" and words:
            words.append(" ")
        if kind == "open":
            closes = CLOSES.get(tag) or (("p",) if tag in BLOCK else ())
            if closes:
                stack.close(closes)
            up = stack.nodes[-1]
            first = _NAMES.findall(what.get("class", "").lower())[:1] if what else []
            path = f"{short(up.path)}/{tag}{'.' + first[0] if first else ''}"
            main = path == main_path and not up.within
            side = not main and (up.side or (tag not in ("html", "body") and is_side(tag, what, up.article is not None)) or (tag in WITHIN_PAGE and not up.article))
            node = Node(tag, path, up, side, up.within or main, slots)
            nodes.append(node)
            stack.push(node)
        else:
            stack.close((tag,), tag in FENCE)
    flush()
    for node in reversed(nodes):  # what is inside comes later
        node.up.length += node.length
    if not any(x.path.startswith(("/html", "/body")) for x in nodes):
        nodes.append(root)  # a fragment is its own body
    return nodes, blocks


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def tokens(pages: DataFrame) -> DataFrame:
    """host, path or key (of an element or a block of text), n (how often on the page), chars (text
    in an element outside links), side, depth, tag, page (the hash of its html)."""
    bounded_batches(pages.sparkSession)
    p = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"), F.xxhash64("html").alias("page"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for host, page, key in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("page").to_pylist(), strict=True):
                seen: dict[str, list] = {}
                nodes, blocks = walk(page or "")
                for node in nodes:
                    x = seen.setdefault(node.path, [0, 0, node.side, node.depth, node.tag])
                    x[0] += 1
                    x[1] += node.length
                out += [(host, path, None, n, chars, side, depth, tag, key) for path, (n, chars, side, depth, tag) in seen.items()]
                out += [(host, None, text, 1, 0, False, 0, None, key) for text in set(map(text_key, blocks))]
            cols = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["host", "path", "key", "n", "chars", "side", "depth", "tag", "page"])

    return p.mapInArrow(run, "host string, path string, key long, n long, chars long, side boolean, depth long, tag string, page long")


def deduced(pages: DataFrame, support: float = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Tokens of elements that are frequent on their host, and of each host main, the path of the
    main slot, texts, the text tokens of the template, anchor, the article or main that every page has
    once, and slots, the paths of the slots beside it."""
    h, on = F.xxhash64("page", "n"), F.xxhash64("page", F.lit(1).cast("long"))
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    # sums of 32 bits each stay in a long; partial sums are made before the shuffle. v is the vector of
    # counts, p that of presence; bits set by pages never say more pages than there are different ones
    bit = lambda k: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(on, k).bitwiseAND(F.lit(63)).cast("int")))
    sums = [F.sum(F.shiftrightunsigned(h, 32)).alias("v1"), F.sum(low(h)).alias("v2"), F.sum(F.shiftrightunsigned(on, 32)).alias("p1"), F.sum(low(on)).alias("p2")]
    t = tokens(pages).groupBy("host", "path", "key").agg(F.count("*").alias("pages"), *sums, F.sum("chars").alias("chars"), F.max("side").alias("side"), F.max("depth").alias("depth"), F.max("tag").alias("tag"), F.min("n").alias("fewest"), F.max("n").alias("most"), *[bit(k).alias(f"b{k}") for k in (0, 6, 12)])
    different = F.greatest(*[F.bit_count(f"b{k}") for k in (0, 6, 12)])
    # what is on one page only is no template; the rest is written, so that pages are read once
    t = written(t.where("pages >= 2").withColumn("different", different).drop("b0", "b6", "b12"), "tokens", compact=True)
    vectors = t.where("path is not null")
    # the number of pages of a host is that of its most frequent token
    sizes = vectors.groupBy("host").agg(F.max("pages").alias("of"))
    frequent = vectors.join(sizes, "host").where(F.col("pages") >= support * F.col("of"))
    # text on just the pages of a class of elements, TEXT_PAGES different ones at least, is of that class
    fixed = t.where(F.col("key").isNotNull() & (F.col("different") >= TEXT_PAGES)).join(frequent.select("host", "p1", "p2").distinct(), ["host", "p1", "p2"], "left_semi")
    texts = fixed.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("texts"))
    # an article or main, else the innermost element that holds all text outside links
    rank = F.struct(F.col("tag") == "article", F.col("tag") == "main", "chars", "depth", "path")
    mains = frequent.groupBy("host").agg(F.max_by("path", F.when(~F.col("side") & (F.col("chars") > 0), rank)).alias("main"))
    found = mains.join(texts, "host", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<long>")))
    # the outermost one that is once on each of its pages, as its vector of counts is that of presence
    once = F.col("tag").isin(*ARTICLES) & (F.col("v1") == F.col("p1")) & (F.col("v2") == F.col("p2")) & ~F.col("side") & (F.col("chars") > 0)
    anchors = frequent.where(once).groupBy("host").agg(F.min_by("path", F.struct("depth", -F.col("chars"), "path")).alias("anchor"))
    boxes = frequent.where(F.col("tag").isin(*BOXES) & (F.col("fewest") == F.col("most"))).join(anchors, "host")
    # beside it: inside an element around the anchor, but not around it
    beside = F.startswith("anchor", F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"))) & ~F.startswith("anchor", F.concat("path", F.lit("/")))
    slots = boxes.where(beside).groupBy("host").agg(F.max("anchor").alias("anchor"), F.sort_array(F.collect_list("path")).alias("slots"))
    return frequent, found.join(slots, "host", "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<string>")))


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """host, classes array<struct<tokens, pages>> from the outermost in, main and texts; the ancestors of an
    element are on all of its pages, so that all frequent classes nest."""
    frequent, hosts = deduced(pages, support)
    classes = frequent.groupBy("host", "v1", "v2", "pages").agg(F.sort_array(F.collect_list(F.struct("depth", "path", "chars", "side"))).alias("tokens"))
    outer = F.element_at("tokens", 1)["depth"]
    return classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(outer.alias("depth"), "pages", "tokens"))).alias("classes")).join(hosts, "host")


def text_key(block: Block) -> int:
    """A text token: the text of a block with its path, as 64 bits."""
    return int.from_bytes(hashlib.blake2b(f"{block.path}\0{block.text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def text_of(page: str | None, main: str | None, texts: Set[int] = frozenset(), anchor: str | None = None, slots: Set[str] = frozenset()) -> str:
    """The blocks of a page but for template text (``texts``, as text_key), and on a page with the
    ``anchor`` but for those of ``slots``."""
    page = page or ""
    nodes, blocks = walk(page, slots=slots)
    if slots and any(x.path == anchor and x.length for x in nodes):
        stay = {x.slot for x in nodes if x.tag == "h1" or x.tag in ARTICLES}
        blocks = [x for x in blocks if x.slot is None or x.slot in stay]
    if not blocks:  # an article or main may itself have the name of side matter
        own = [x.path for x in nodes if x.tag in ARTICLES]
        if own:
            blocks = walk(page, main if main in own else own[0])[1]
    if texts:
        kept: list[Block] = []
        last = False
        for x in reversed(blocks):
            last = text_key(x) not in texts or (last and x.is_heading())
            if last:
                kept.append(x)
        blocks = kept[::-1] or blocks
    return "\n\n".join(x.text for x in blocks)


def extract(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    # one row a host: broadcast if its size, taken first, allows; else pages are shuffled, and Spark splits hot hosts
    hosts = written(deduced(pages, support)[1], "templates", compact=True)
    size = hosts.agg(F.coalesce(F.sum(F.length("host") + F.coalesce(F.length("main"), F.lit(0)) + 8 * F.size("texts") + F.length(F.concat_ws(" ", "slots")) + F.length(F.coalesce("anchor", F.lit(""))) + 64), F.lit(0))).first()[0]
    joined = own.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "host", "left").select("page_id", "url", "html", "host", "main", "texts", "anchor", "slots")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, tuple] = {}
            out: list[str] = []
            for i, (host, page) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)):
                if host not in known:
                    main, texts, anchor, slots = (b.column(c)[i].as_py() for c in ("main", "texts", "anchor", "slots"))
                    known[host] = main, frozenset(texts or ()), anchor, frozenset(slots or ())
                out.append(text_of(page, *known[host]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(np.fromiter(map(len, out), np.int64, len(out)))], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
