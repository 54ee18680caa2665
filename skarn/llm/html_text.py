"""Main text of HTML pages: site template removal, then element rules.

Method: every page is parsed into a tree; each element outside the main content (``article``, ``main``) and each box in it gives a hash of
its whole subtree (tags, classes, links, text).  Spark counts each hash once a page for each host, and subtrees that recur on at least ``LEAST_PAGES``
pages of a host, however many it has, are that site's template; a second parse deletes them.

Boxes are elements of ``BOXES`` with text that have a class, id or role, or hold a block or two elements, and paragraphs with a class, id or
role.  Plain paragraphs, headings, list items, table cells and inline elements of main content are never deleted by themselves.  Boxes are counted apart
from elements outside, once for each different text of a page, so an article that is printed on many pages stays.

Recurrence alone can't find menus, adverts and footers whose words differ from page to page, so elements that say what they are
(``nav``, ``aside``, ``footer``, ``form`` ..., or a class, id or role of the lists below) are deleted too.  A class or id counts as a whole: it is a
name of the list, or a compound of names and words that go with them (``ad-slot``, but not ``has-sidebar``).  Names never delete ``html``, ``body`` or
``main``, nor what is around ``main``, nor what is around articles if the page has no other main content.  The text of the main content
is returned, or of the whole body where a page has none or only such articles.

Templates are broadcast while there are ``BROADCAST_ROWS`` or fewer; more of them reach their pages by joins on (host, hash).

Defined cases: null html gives an empty text; a null URL or one without host belongs to no site, so no template applies; repeated rows
count as pages and give equal rows; unclosed elements end where HTML says or at the end; extra columns are not returned.  Nothing is
capped: memory is one page's tree.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .url_filter import host

LEAST_PAGES = 10
BROADCAST_ROWS = 200_000

# Element names of HTML, and names that mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea xmp iframe noembed noframes title".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr caption ul".split())
GONE = frozenset("head nav aside footer form script style noscript template iframe object embed svg canvas audio video button select textarea input label fieldset dialog menu search".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Words that leave a compound with a name what the name says.
PARTS = frozenset("area article bar block bottom box btn button buttons container entry footer form global group header heading icons inner item items left link links list main outer page panel post posts primary right secondary section site slot title top unit wrap wrapper".split())
#: Elements of main content that may be a site's box.
BOXES = frozenset("address article blockquote center details dir div dl figure header hgroup main ol p section table ul".split())
#: Start tags that end an open element of the same group.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements such an end never reaches across.
WALLS = frozenset("ul ol dl table select body html article main".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACES = re.compile(r"[\x20\x09-\x0D]+")


@lru_cache(1 << 16)
def named(marks: str) -> bool:
    """Whether a class or id of an attribute's value names what is not main text."""
    for mark in marks.lower().split():
        words = [w for w in re.split(r"[_-]+", mark) if w]
        if not NAMES.isdisjoint(words) and all(w in NAMES or w in PARTS or w.isdigit() for w in words):
            return True
    return False


class Node:
    __slots__ = ("tag", "role", "named", "spared", "key", "children", "digest")

    def __init__(self, tag: str, rest: str = ""):
        self.tag, self.children, self.digest, self.spared = tag, [], 0, False
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest else {}
        self.key = "|".join([tag, *[f"{k}={v}" for k, v in sorted(found.items())]])
        self.role = found.get("role", "").lower()
        self.named = bool(found) and tag not in ("html", "body", "main") and (named(found.get("class", "")) or named(found.get("id", "")))

    def gone(self, inside: bool) -> bool:
        """Whether the element says that it is not main text; ``inside``: within main content, where a header is the article's own."""
        if self.named and not self.spared:
            return True
        if self.tag in MAIN:
            return False
        return self.tag in GONE or (self.tag == "header" and not inside) or self.role in ROLES


def spare(root: Node) -> None:
    """Marks named elements around ``main``, and those around articles if no main content is outside of them; then the root is marked too."""
    live, around = False, {"main": [], "article": []}
    todo: list[tuple[Node, tuple | None]] = [(root, None)]
    while todo:
        node, names = todo.pop()
        if node.tag in MAIN and not node.named:
            if names is None:
                live = True
            else:
                around[node.tag].append(names)
            continue
        if node.named:
            names = (node, names)
            if node.tag in GONE or node.role in ROLES or node.tag in ("header", "article"):
                continue
        elif node.gone(False):
            continue
        todo += [(c, names) for c in node.children if isinstance(c, Node)]
    root.spared = not live and not around["main"] and bool(around["article"])
    for names in around["main"] + (around["article"] if root.spared else []):
        while names and not names[0].spared:
            names[0].spared, names = True, names[1]


def parse(page: str) -> Node:
    root = tree(page)
    spare(root)
    return root


def tree(page: str) -> Node:
    root = Node("html")
    stack, at = [root], 0

    def close(names: set[str] | frozenset[str], walls: frozenset[str] = WALLS) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        if m["end"]:
            name = m["end"].lower()
            close({name}, frozenset())
        elif m["tag"]:
            name = m["tag"].lower()
            if name == "html":
                continue
            if stack[-1].tag == "head" and name not in HEAD:
                stack.pop()
            if name in BLOCK:
                close({"p"})
            if name in ENDS:
                close(ENDS[name])
            node = Node(name, m["rest"])
            stack[-1].children.append(node)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = end.start() if end else len(page)
                if not end:
                    return root
                stack.append(node)
            elif name not in VOID:
                stack.append(node)


def boxed(node: Node) -> bool:
    """Whether an element of main content may be a box of the site."""
    if node.tag not in BOXES and "-" not in node.tag:
        return False
    if node.key != node.tag:
        return True
    held = [c.tag for c in node.children if isinstance(c, Node) and c.tag not in VOID]
    return node.tag != "p" and (len(held) > 1 or not BLOCK.isdisjoint(held))


def subtrees(root: Node) -> Iterator[tuple[Node, bool]]:
    """Elements outside main content and boxes in it, children first, with their ``digest``, and whether they are in it; main content itself gets none."""
    texts: set[int] = set()  # elements of main content with text
    todo: list[tuple[Node, bool, bool, bool]] = [(root, False, False, False)]
    while todo:
        node, ready, inside, lost = todo.pop()
        if not ready:
            top = not inside and node.tag in MAIN and not node.gone(False)
            if (top and lost) or (inside and node.gone(True)):
                continue
            if not top:
                todo.append((node, True, inside, lost))
            lost = lost or (not inside and node.gone(False))
            todo += [(c, False, inside or top, lost) for c in node.children if isinstance(c, Node)]
            continue
        h = hashlib.blake2b(node.key.encode("utf-8", "replace"), digest_size=8, person=b"main" if inside else b"")
        whole = True
        for c in node.children:
            if isinstance(c, Node):
                h.update(b"<%d" % c.digest)
                whole &= inside or c.digest != 0
                if inside and id(c) in texts:
                    texts.add(id(node))
            else:
                h.update(b"=" + SPACES.sub(" ", c).strip().encode("utf-8", "replace"))
                if inside and not c.isspace():
                    texts.add(id(node))
        if whole and node.tag not in ("html", "body", "head"):
            node.digest = int.from_bytes(h.digest(), "little", signed=True) or 1
            if not inside or (id(node) in texts and boxed(node)):
                yield node, inside


def text_of(root: Node, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the main text, in page order, joined by two line ends."""
    if templates:
        drop = {id(n) for n, _ in subtrees(root) if n.digest in templates}
    else:
        drop = set()
    has_main = False
    todo = [root]
    while todo and not has_main:
        node = todo.pop()
        if id(node) in drop or node.gone(False):
            continue
        has_main = node.tag in MAIN and not root.spared
        todo += [c for c in node.children if isinstance(c, Node)]
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", "".join(line)).strip(" ")
        line.clear()
        if text:
            blocks.append(text)

    work: list[tuple[Node | str | None, bool, bool]] = [(root, not has_main, False)]
    while work:
        item, inside, main = work.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside:
                line.append(entities.unescape(item))
        elif id(item) in drop or item.gone(main):
            if inside and item.tag in BLOCK:
                flush()
        else:
            main = main or item.tag in MAIN
            inside = inside or main
            if item.tag in ("br", "td", "th", "img", "wbr") and item.tag != "wbr":
                line.append(" ")
            if item.tag in BLOCK:
                flush()
                work.append((None, inside, main))
            work += [(c, inside, main) for c in reversed(item.children)]
    flush()
    return "\n\n".join(blocks)


HASHES = "key binary, host string, hash long, story long"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host and hash of every distinct subtree of each page, with the page's key; ``story`` is a hash of the page's text for boxes, else null."""
    for batch in batches:
        keys, hosts, pages = (batch.column(c) for c in ("key", "host", "html"))
        for key, site, page in zip(keys.to_pylist(), hosts.to_pylist(), pages, strict=True):
            root = parse(page.as_py() or "") if site else None
            found = {n.digest: inside for n, inside in subtrees(root)} if root else {}
            if found:
                story = hashlib.blake2b(text_of(root).encode("utf-8", "replace"), digest_size=8).digest() if any(found.values()) else b""
                stories = [int.from_bytes(story, "little", signed=True) if inside else None for inside in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.binary()), pa.array([site] * len(found)), pa.array(list(found), pa.int64()), pa.array(stories, pa.int64())], ["key", "host", "hash", "story"])


def batched(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 20_000):
    """Joins small batches of ``work`` to larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in work(batches):
            held.append(b)
            size += len(b)
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _texts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites = sent.value if sent else None
        for batch in batches:
            own = batch.column("templates").to_pylist() if sites is None else None
            hosts = batch.column("host").to_pylist()
            texts = []
            for i, page in enumerate(batch.column("html")):
                templates = (sites.get(hosts[i], ()) if hosts[i] else ()) if sites is not None else (own[i] or ())
                texts.append(text_of(parse(page.as_py() or ""), frozenset(templates)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def site_templates(pages: DataFrame, scratch: Scratch, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host`` and ``hash`` of template subtrees; ``pages`` has ``key``, ``host`` and ``html``."""
    hashes = pages.where("host <> ''").mapInArrow(batched(_hashes), HASHES).groupBy("host", "hash", "story").agg(F.count("*").alias("n"))
    times = F.sum(F.when(F.col("story").isNull(), F.col("n")).otherwise(1))
    return scratch.write(hashes.groupBy("host", "hash").agg(times.alias("n")).where(F.col("n") >= least_pages).select("host", "hash"), "templates")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    digest = F.md5(F.concat_ws("|", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).cast("binary"))
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    with_key = keyed.withColumn("key", F.unhex(digest))
    templates = site_templates(with_key.select("key", "host", "html"), scratch, least_pages)
    if templates.count() <= broadcast_rows:
        sites: dict[str, set[int]] = {}
        for row in templates.collect():
            sites.setdefault(row.host, set()).add(row.hash)
        out = keyed.mapInArrow(_texts(spark.sparkContext.broadcast(sites)), "page_id long, url string, text string")
    else:
        hashes = with_key.select("key", "host", "html").mapInArrow(batched(_hashes), HASHES).select("key", "host", "hash").distinct()
        hits = hashes.join(templates, ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("templates"))
        out = with_key.join(scratch.write(hits, "hits"), "key", "left").mapInArrow(_texts(None), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
