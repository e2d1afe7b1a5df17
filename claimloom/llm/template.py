"""Main text of web pages after removal of what recurs over the pages of a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch, pieces

LEAST_PAGES = 3  # a subtree of a template is on so many different pages of its host,
SHARE = 0.5  # and on this share of them

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea title iframe xmp".split())
_DROP = set("head script style noscript template textarea title iframe xmp nav aside form button select svg canvas dialog menu object audio video".split())
_BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
_ENDS_P = _BLOCK - set("td th tr tbody thead tfoot caption option legend".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar ad ads advert adverts advertisement adsense sponsor sponsored promo "
    "banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup social share sharing related recommended comment comments "
    "disqus respond reply replies login search pagination pager copyright toolbar widget".split()
)
_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_CONTENT = set("content article post entry body main text story".split())


class Node:
    __slots__ = ("tag", "attributes", "children", "digest", "size", "linked")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.digest, self.size, self.linked = 0, 0, 0

    def values(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attributes)}


def parse(page: str) -> Node:
    """A tree of elements; texts are strings among the children, references decoded."""
    root = Node("#")
    stack, at, n = [root], 0, len(page)

    def close(tags: set[str], fence: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in fence:
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body", "td", "th") and tag not in ("article", "main", "body", "html", "table", "div", "section", "tr"):
                    break
            continue
        if tag in _ENDS_P:
            close({"p"}, _BLOCK - {"p"})
        if tag in _SIBLINGS:
            close(_SIBLINGS[tag], _FENCE[tag])
        node = Node(tag, m[3] or m[6] or "")
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            close_at = page.find(">", end.start()) if end else -1
            at = close_at + 1 if close_at >= 0 else n
        elif tag not in _VOID and not node.attributes.rstrip().endswith("/"):
            stack.append(node)
        elif tag not in _VOID and tag in ("p", "div", "article", "section", "span", "a", "li", "b", "i"):
            stack.append(node)  # a slash does not close these
    return root


def _walk(root: Node) -> list[Node]:
    """All elements, children before parents, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    return out[::-1]


def _measure(root: Node) -> list[Node]:
    """Sets the hash, the text size and the linked text size of every subtree."""
    nodes = _walk(root)
    for node in nodes:
        parts, size, linked = [node.tag], 0, 0
        for c in node.children:
            if isinstance(c, Node):
                parts.append(f"{c.digest:x}")
                size, linked = size + c.size, linked + c.linked
            elif text := _SPACE.sub(" ", c).strip():
                parts.append("=" + text)
                size += len(text)
        node.size, node.linked = size, size if node.tag == "a" else linked
        node.digest = xxhash.xxh64_intdigest("\n".join(parts))
    return nodes


def _is_furniture(node: Node, inside: bool) -> bool:
    """Whether an element is by its name, class, id or role no part of an article."""
    tag = node.tag
    if tag in _DROP or tag == "footer" or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "article", "main") and not inside or not node.attributes:
        return False
    own = node.values()
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        return True
    if own.get("role", "").lower() in _ROLES:
        return True
    words = {w.lower() for w in _PART.findall(own.get("class", "") + " " + own.get("id", ""))}
    return bool(words & _WORDS) and not words & _CONTENT - {"text"} or bool(words & {"comments", "comment", "disqus"})


def _main(root: Node) -> tuple[Node | None, list[Node]]:
    """The longest element a page declares as its article, and all parts of it in page order.

    The other articles beside it are parts too, but for furniture and teasers: those
    of mostly links, and those whose heading is a link.  These are the article only
    where a page has no other.
    """
    best: dict[int, Node] = {}
    articles = []
    todo = [(root, root)]
    while todo:
        node, parent = todo.pop()
        if node is not root and _is_furniture(node, False):
            continue
        own = node.values() if node.attributes else {}
        rank = 3 if node.tag == "article" else 2 if node.tag == "main" or own.get("role") == "main" or own.get("itemprop") == "articleBody" else 0
        if rank and (rank not in best or node.size > best[rank].size):
            best[rank] = node
        if rank == 3:
            articles.append((node, parent))
        else:
            todo += [(c, node) for c in node.children if isinstance(c, Node)]
    full = [a for a, _ in articles[::-1] if not _is_teaser(a)]
    main = max(full, key=lambda a: a.size) if full else best.get(3) or best.get(2)
    beside = {id(p) for a, p in articles if a is main}
    parts = [a for a, p in articles[::-1] if a is main or id(p) in beside and not _is_teaser(a)]
    return main, parts or ([main] if main is not None else [])


def _is_teaser(article: Node) -> bool:
    headed = any(n.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and n.size and n.linked == n.size for n in _walk(article))
    return 2 * article.linked >= article.size or headed or _is_furniture(article, True)


def subtrees(page: str) -> list[int]:
    """Hashes of the subtrees with text that a template may hold.

    Only block elements count: an inline one, or a link in running text, is a part
    of its sentence.  Inside a declared article only those that are mostly links count, since
    articles may share passages; elsewhere all.
    """
    root = parse(page)
    nodes = _measure(root)
    main, parts = _main(root)
    own = {id(n) for part in parts for n in _walk(part)} - {id(part) for part in parts if part is not main}
    units = _BLOCK - {"html", "body"}
    return sorted({n.digest - 2**63 for n in nodes if n.size and n.tag in units and (id(n) not in own or n is not main and 2 * n.linked >= n.size)})


def main_text(page: str, template: set[int]) -> str:
    """Blocks of the article, one per line, without furniture and the template's subtrees."""
    root = parse(page)
    _measure(root)
    main, parts = _main(root)
    parts = [p for p in parts if p is main or p.digest - 2**63 not in template]
    whole = {id(p) for p in parts}
    blocks, line = [], []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    inside = main is not None
    todo: list = parts[::-1] or [root]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif id(item) in whole or not (_is_furniture(item, inside) or item.size and item.digest - 2**63 in template and (not inside or 2 * item.linked >= item.size)):
            block = item.tag in _BLOCK
            if block:
                flush()
                todo.append(None)
            todo += item.children[::-1]
    flush()
    return "\n".join(blocks)


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html", 1 << 21):
        found = [subtrees(p or "") for p in batch.column("html").to_pylist()]
        at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
        columns = [batch.column(c).take(at) for c in ("page", "host", "content")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([d for f in found for d in f], pa.int64())], ["page", "host", "content", "digest"])


def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html", 1 << 21):
        texts = [main_text(p or "", set(t or ())) for p, t in zip(batch.column("html").to_pylist(), batch.column("digests").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    Takes `page_id`, `url`, `html`.  Subtrees of block elements are hashed and counted
    over the different pages of each host; one on at least `least` of them and on
    `share` of them belongs to the site's template and is deleted.  A page's
    declared article keeps its recurring passages, since articles may quote each
    other; only subtrees of it that are mostly links can belong to the template.
    Elements that are no article by name, class, id or role go as well.

    Null or empty html: empty text.  A null url is a host of its own.  Rows that
    repeat a page count as one page and give a row each.  An empty table gives an
    empty one; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("page"), F.coalesce(host, F.lit("")).alias("host"), F.xxhash64("html").alias("content"))
    found = pages.select("page", "host", "content", "html").mapInArrow(_hasher, "page long, host string, content long, digest long")
    found = scratch.store(found)
    hosts = pages.groupBy("host").agg(F.count_distinct("content").alias("pages"))
    counts = found.groupBy("host", "digest").agg(F.count_distinct("content").alias("n")).where(F.col("n") >= least)
    often = F.col("n") >= F.col("pages") * share
    template = scratch.store(scratch.store(counts).join(scratch.store(hosts), "host").where(often).select("host", "digest"))
    own = found.join(template, ["host", "digest"]).groupBy("page").agg(F.collect_set("digest").alias("digests"))
    own = scratch.store(own)
    scratch.keep(own)
    both = pages.select("page", "page_id", "url", "html").join(own, "page", "left").select("page_id", "url", "html", "digests")
    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return both.mapInArrow(_writer, f"page_id {kind['page_id']}, url {kind['url']}, text string").withColumn("n_chars", F.length("text").cast("long"))
