"""HTML extraction: what pages of a host share is template, the rest is text."""

from __future__ import annotations

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.llm.urls import host_of
from speechcurate.session import materialise, ship_package, small_table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
# What an element's name, role or class says about it.
DROPPED = frozenset("script style noscript template iframe svg math canvas object embed audio video head title nav header footer aside form "
                    "button select option textarea input dialog menu xmp noembed noframes map".split())
MARKS = re.compile(
    r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bno[_-])(ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side|aside|rail|"
    r"cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|"
    r"comments?|commentlist|disqus|respond|replies|widget|toolbar|pagination|pager|skip|copyright|legal|alert)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
MAIN = frozenset(["article", "main"])
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th br".split()) | INLINE
# An open element of the first kind ends where one of the second begins.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre section table ul li dd dt".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACE = re.compile(r"\s+")
# Kinds of units: subtrees and blocks outside the main region, blocks inside it, blocks around the main region of their page.
OUTSIDE, INSIDE, AROUND = range(3)


class Node:
    __slots__ = ("tag", "attrs", "items", "parent", "around")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.items, self.parent, self.around = tag, attrs, [], parent, False


def parse(html: str) -> Node:
    """A tree of elements and texts (decoded). Missing end tags are added, stray ones ignored, a cut tag at the end is dropped."""
    root = here = Node("", "", None)
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            here.items.append(unescape(html[at:]))
            break
        if m.start() > at:
            here.items.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            elif tag == "p":
                here.items.append(Node("p", "", here))
            continue
        while here.parent is not None and tag in CLOSED_BY.get(here.tag, ()):
            here = here.parent
        if here.tag in INLINE and tag in CLOSED_BY["p"]:
            # <p><b>text<p>: the paragraph ends, and the open inline elements with it.
            node = here
            while node.tag in INLINE:
                node = node.parent
            if node.tag in CLOSED_BY and tag in CLOSED_BY[node.tag] and node.parent is not None:
                here = node.parent
        node = Node(tag, m[3], here)
        here.items.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
    mark_around(root)
    return root


def _below(node: Node) -> list[Node]:
    """All elements in ``node``, parents first."""
    order = [c for c in node.items if isinstance(c, Node)]
    for n in order:
        order.extend(c for c in n.items if isinstance(c, Node))
    return order


def _free_text(root: Node) -> int:
    """Characters of the page outside boilerplate."""
    total, stack = 0, [root]
    while stack:
        for c in stack.pop().items:
            if isinstance(c, str):
                total += len(c.strip())
            elif not is_boilerplate(c, False):
                stack.append(c)
    return total


def mark_around(root: Node) -> None:
    """Mark what is around the main region, if marks or a form would hide it: the ``article`` or ``main`` of the most text, as long as
    all other text outside boilerplate isn't more than three times as long; and in it the next one, of at least half its text."""
    order, sizes = [root, *_below(root)], {}
    regions = [n for n in order if n.tag in MAIN]
    if not regions:
        return
    for node in reversed(order):
        sizes[id(node)] = sum(sizes[id(c)] if isinstance(c, Node) else len(c.strip()) for c in node.items)
    outer = None
    for _ in range(2):
        region = max(regions, key=lambda n: sizes[id(n)], default=None)
        if region is None or outer is not None and 2 * sizes[id(region)] < sizes[id(outer)]:
            return
        above, up = [], region.parent
        while up is not None and up is not outer:
            if up.parent is not None and (up.tag not in DROPPED or up.tag == "form") and is_boilerplate(up, outer is not None):
                above.append(up)
            up = up.parent
        if outer is None and above and 3 * sizes[id(region)] < _free_text(root):
            return
        for node in above:
            node.around = True
        outer, regions = region, [n for n in _below(region) if n.tag in MAIN]


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(node.attrs)}


def is_boilerplate(node: Node, inside_main: bool) -> bool:
    """Does the element's name, role, class or id say that it isn't the page's text? What is around the main region is never that."""
    if node.around:
        return False
    if node.tag in DROPPED:
        return not (node.tag == "header" and inside_main)
    if not node.attrs.strip() or node.tag in MAIN or node.tag in ("html", "body"):
        return False
    found = attributes(node)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True
    style = found.get("style", "").replace(" ", "").lower()
    if "display:none" in style:
        return True
    marks = {m[1].lower() for m in MARKS.finditer(f"{found.get('class', '')} {found.get('id', '')}")}
    return bool(marks - {"header"} if inside_main else marks)


def _digest(node: Node, out: dict[int, int]) -> bytes:
    """Hash of the subtree: tag, and its texts with white space levelled and subtrees in order. Fills ``out``."""
    stack: list[tuple[Node, bool]] = [(node, False)]
    done: dict[int, bytes] = {}
    while stack:
        n, ready = stack.pop()
        if not ready:
            stack.append((n, True))
            stack.extend((c, False) for c in n.items if isinstance(c, Node))
            continue
        h = hashlib.blake2b(n.tag.encode(), digest_size=8)
        for c in n.items:
            if isinstance(c, Node):
                h.update(b"\x01" + done[id(c)])
            elif words := _SPACE.sub(" ", c).strip():
                h.update(b"\x02" + words.encode("utf-8", "replace"))
        done[id(n)] = h.digest()
        out[id(n)] = int.from_bytes(done[id(n)], "little", signed=True)
    return done[id(node)]


def candidates(root: Node) -> list[tuple[Node, int]]:
    """Elements that template removal may delete: outside the main region any with text, inside it containers only.

    Inside the main region paragraphs, headings, list items and cells are judged as blocks, see ``units``. Elements
    around a main region stay.
    """
    hashes: dict[int, int] = {}
    _digest(root, hashes)
    out: list[tuple[Node, int]] = []
    around: set[int] = set()
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.tag in MAIN and not inside:
            inside, up = True, node.parent
            while up is not None and id(up) not in around:
                around.add(id(up))
                up = up.parent
        for c in node.items:
            if isinstance(c, Node) and not is_boilerplate(c, inside):
                stack.append((c, inside))
                if c.tag not in MAIN and c.tag not in ("html", "body") and c.tag not in VOID and not (inside and c.tag in TEXTUAL):
                    out.append((c, hashes[id(c)]))
    return [(n, h) for n, h in out if id(n) not in around]


def blocks_of(root: Node, gone: set[int] | frozenset[int] = frozenset()) -> tuple[list[tuple[str, str, bool]], bool]:
    """(text, text without what is in ``gone``, inside the main region?) of each block in page order; has the page a main region?"""
    blocks: list[tuple[str, str, bool]] = []
    full: list[str] = []
    left: list[str] = []
    has_main = False

    def close(inside: bool) -> None:
        if text := _SPACE.sub(" ", "".join(full)).strip():
            blocks.append((text, text if len(left) == len(full) else _SPACE.sub(" ", "".join(left)).strip(), inside))
        full.clear()
        left.clear()

    work: list[tuple[object, bool, bool, bool]] = [(root, False, False, False)]
    while work:
        item, inside, removed, leaving = work.pop()
        if isinstance(item, str):
            full.append(item)
            if not removed:
                left.append(item)
            continue
        if leaving:
            close(inside)
            continue
        if item.parent is not None and item.tag not in MAIN and is_boilerplate(item, inside):
            continue
        removed = removed or id(item) in gone
        if item.tag not in INLINE:
            close(inside)
            inside = inside or item.tag in MAIN
            has_main = has_main or inside
            work.append((item, inside, removed, True))
        work.extend((c, inside, removed, False) for c in reversed(item.items))
    return blocks, has_main


def block_hash(text: str, kind: int) -> int:
    """Hash of a block's text, another one for each kind."""
    return int.from_bytes(hashlib.blake2b(bytes([3 + kind]) + text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def units(root: Node) -> dict[int, int]:
    """What is counted of a page: hash and kind. A block outside the main region of a page that has one is counted as both."""
    out = {h: OUTSIDE for _, h in candidates(root)}
    blocks, has_main = blocks_of(root)
    for text, _, inside in blocks:
        kind = INSIDE if inside else OUTSIDE
        out[block_hash(text, kind)] = kind
        if has_main and not inside:
            out[block_hash(text, AROUND)] = AROUND
    return out


def text_of(root: Node, template: frozenset[int] | set[int], everywhere: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of the page without what is in ``template``, the units of its host, and the blocks around its main region
    that are in ``everywhere``: blocks in page order, joined by a space."""
    gone: set[int] = {id(n) for n, h in candidates(root) if h in template} if template else set()
    blocks, has_main = blocks_of(root, gone)
    if has_main and everywhere:
        blocks = [b for b in blocks if b[2] or block_hash(b[0], AROUND) not in everywhere]
    if template:
        blocks = [b for b in blocks if block_hash(b[0], INSIDE if b[2] else OUTSIDE) not in template]
    return " ".join(left for _, left, _ in blocks if left)


def template_hashes(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = 5, min_share: float = 0.3,
                    main_share: float = 0.5, own_share: float = 0.9, min_hosts: int = 5) -> DataFrame:
    """(host, hash, pages) of ``units`` that recur on at least ``min_pages`` pages and ``min_share`` of all pages of their host.

    On a host of n pages sqrt(n) pages are enough, so that the templates of a large host's sections are found: 100 of
    10,000 pages. That is less than ``min_share`` beyond 1 / min_share^2 pages.

    A block inside the main region must recur on ``main_share`` of its host's pages, and ``own_share`` (over a half) of
    all pages that have it must be this host's: a passage that several hosts share is text.

    Hosts of few pages have no counts to speak of. For them, and for all others alike, counts are backed off to all hosts:
    a block that stands around the main regions of pages of ``min_hosts`` hosts is template on every host; its row has a null host
    and counts hosts.

    A page counts a unit once, and pages that differ in attributes only are one, so that copies of a page make no template.
    Counts are summed before the shuffle, so a host with a third of all pages is no hot key. Null html has no unit, and
    pages without a host share the empty one.
    """
    ship_package(pages.sparkSession)

    def subtrees(batches):
        for batch in batches:
            hosts, hashes, kinds, copies = [], [], [], []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = parse(text or "")
                own = units(root)
                page = int.from_bytes(_digest(root, {}), "little", signed=True)
                hosts += [host] * (len(own) + 1)
                hashes += [*own, None]  # null counts the page itself
                kinds += [*own.values(), OUTSIDE]
                copies += [page] * (len(own) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(kinds, pa.int32()), pa.array(copies, pa.int64())], ["host", "hash", "kind", "page"])

    rows = pages.select(host_of(F.col(f"`{url}`").cast("string")).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    counts = rows.mapInArrow(subtrees, "host string, hash long, kind int, page long").groupBy("host", "hash", "kind").agg(F.count_distinct("page").alias("pages"))
    # One row per host and unit; of a block inside or around the main region one for all hosts, with the one that has it most.
    counts = counts.filter((F.col("pages") >= min_pages) | F.col("hash").isNull() | (F.col("kind") != OUTSIDE))
    counts = counts.groupBy("hash", "kind", F.when(F.col("kind") == OUTSIDE, F.col("host")).alias("of")).agg(
        F.sum("pages").alias("everywhere"), F.count("*").alias("hosts"), F.max(F.struct("pages", "host")).alias("most"))
    shared = (F.col("kind") == AROUND) & (F.col("hosts") >= min_hosts)
    counts = counts.select("hash", "kind", "everywhere", "hosts", "most.*").filter(
        F.when(F.col("kind") == AROUND, shared).otherwise((F.col("pages") >= min_pages) | F.col("hash").isNull()))
    counts = materialise(counts, "units")
    whole = counts.filter("hash IS NULL").select("host", F.col("pages").alias("all_pages"))
    recurring = counts.filter(F.col("hash").isNotNull() & (F.col("kind") != AROUND)).join(whole, "host")
    enough = F.when(F.col("kind") == INSIDE, (F.col("pages") >= main_share * F.col("all_pages")) & (F.col("pages") >= own_share * F.col("everywhere")))
    template = recurring.filter(enough.otherwise(F.col("pages") >= F.least(min_share * F.col("all_pages"), F.sqrt("all_pages")))).select("host", "hash", "pages")
    return template.unionByName(counts.filter(shared).select(F.lit(None).cast("string").alias("host"), "hash", F.col("hosts").alias("pages")))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id", min_pages: int = 5,
                 min_share: float = 0.3, max_broadcast: int = 100_000) -> DataFrame:
    """``pages`` with ``text``, the main text of the whole page; null or empty html gives an empty text.

    Subtrees and blocks that recur over a host's pages are deleted, besides those whose name, role or class says that
    they aren't text; see ``template_hashes``. Up to ``max_broadcast`` recurring ones (16 bytes each) go to every task; if there are
    more, each host's are joined to the pages of that host in bounded shares instead, with the same result.
    """
    spark = pages.sparkSession
    ship_package(spark)
    found, rows = small_table(template_hashes(pages, url, html, min_pages, min_share), "template", max_broadcast)
    keep = [F.col(f"`{c}`") for c in pages.columns if c != "text"]

    host, page = host_of(F.col(f"`{url}`").cast("string")), F.col(f"`{html}`").cast("string")
    if rows is not None:
        by_host: dict[str | None, set[int]] = {}
        for h, x in zip(rows["host"].to_pylist(), rows["hash"].to_pylist()):
            by_host.setdefault(h, set()).add(x)
        everywhere = by_host.pop(None, frozenset())

        def known(hosts, texts):
            out = [text_of(parse(t), by_host.get(h, frozenset()), everywhere) if t else "" for h, t in zip(hosts.to_pylist(), texts.to_pylist())]
            return pa.array(out, pa.string())

        known.__annotations__ = {"hosts": pa.Array, "texts": pa.Array, "return": pa.Array}
        return pages.select(*keep, F.arrow_udf(known, "string")(host, page).alias("text"))

    # Each page asks for its own subtrees: a join of (host, hash) pairs, then one list per page.
    def own_hashes(batches):
        for batch in batches:
            ids, hosts, hashes = [], [], []
            for i, h, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = units(parse(text)) if text else ()
                ids += [i] * len(own)
                hosts += [h] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], ["id", "host", "hash"])

    digest = F.sha2(F.to_json(F.struct(F.col(f"`{page_id}`").alias("p"), host.alias("h"), F.coalesce(page, F.lit("")).alias("t"))), 256)
    own = pages.select(digest.alias("id"), host.alias("host"), page.alias("html")).mapInArrow(own_hashes, "id string, host string, hash long")
    of_host, of_all = found.filter("host IS NOT NULL"), found.filter("host IS NULL").select("hash")
    hits = own.join(of_host, ["host", "hash"]).select("id", "hash").unionByName(own.join(of_all, "hash").select("id", "hash"))
    lists = hits.groupBy("id").agg(F.collect_set("hash").alias("__own"))

    def listed(texts, owns):
        # Hashes differ by kind, so one set serves as both.
        out = [text_of(parse(t), own, own) if t else "" for t, own in zip(texts.to_pylist(), (frozenset(x or ()) for x in owns.to_pylist()))]
        return pa.array(out, pa.string())

    listed.__annotations__ = {"texts": pa.Array, "owns": pa.Array, "return": pa.Array}
    joined = pages.withColumn("__id", digest).join(lists, F.col("__id") == F.col("id"), "left")
    return joined.select(*keep, F.arrow_udf(listed, "string")(page, F.col("__own")).alias("text"))
