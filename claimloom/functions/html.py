"""Reading titles, dates, bodies and links out of web pages.

Nested elements are beyond regular expressions, so pages go through Arrow
batches to the standard library's tolerant parser.  The helper knows just the
selector forms that the page profiles use.  Of a batch, one page at a time is a
text and a tree; the others stay in Arrow.
"""

from __future__ import annotations

import re
import weakref
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.settings import fixed, selectors

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style"))
_CLOSES_P = frozenset(
    "address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)


_STRING = pa.string()
_PIECE = 64  # pages whose results are held as Python objects


class _Node:
    """An element.  It does not hold its parent, so a tree goes as soon as its root does."""

    __slots__ = ("tag", "attrs", "_up", "parts", "__weakref__")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self._up = tag, attrs, None if parent is None else weakref.ref(parent)
        self.parts: list = []

    @property
    def parent(self) -> _Node | None:
        return None if self._up is None else self._up()

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(p for p in reversed(node.parts) if isinstance(p, _Node))

    def strings(self) -> Iterator[str]:
        stack = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in _SILENT:
                stack.extend(reversed(item.parts))


class _Tree(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self._open = _Node("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close("p")
        node = _Node(tag, {k: v or "" for k, v in attrs}, self._open)
        self._open.parts.append(node)
        if tag not in _VOID:
            self._open = node

    def handle_startendtag(self, tag, attrs):
        self._open.parts.append(_Node(tag, {k: v or "" for k, v in attrs}, self._open))

    def handle_endtag(self, tag):
        self._close(tag)

    def _close(self, tag: str) -> None:
        node = self._open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self._open = node.parent

    def handle_data(self, data):
        self._open.parts.append(data)


def _struct(**fields: pa.DataType) -> pa.StructType:
    return pa.struct(list(fields.items()))


def _each(kind: str, arrow: pa.DataType, read: Callable, *columns: Column) -> Column:
    """What ``read`` makes of each row, whose first column is a page (null: empty)."""

    @F.arrow_udf(kind)
    def parse(pages: pa.Array, *others: pa.Array) -> pa.Array:
        made = [pa.array([], arrow)]
        for a in range(0, len(pages), _PIECE):
            rows = zip(*(c.slice(a, _PIECE) for c in (pages, *others)), strict=True)
            made.append(pa.array([read(page.as_py() or "", *(v.as_py() for v in more)) for page, *more in rows], arrow))
        return pa.concat_arrays(made)

    return parse(*columns)


_PARSED: dict[str, tuple] = {}


def _steps(selector: str) -> tuple:
    """Steps of a selector from outside in: tag, id, classes, attribute tests."""
    if selector not in _PARSED:
        steps = []
        for step in re.findall(r"[^\s\[]*(?:\[[^\]]*\])?", selector):
            if step:
                tag = re.match(r"[a-z0-9]*", step).group()
                ident = re.findall(r"#([\w-]+)", step)
                classes = re.findall(r"\.([\w-]+)", step.split("[")[0])
                attrs = re.findall(r"\[([\w:-]+)(?:(\*?=)['\"]?([^'\"\]]*)['\"]?)?\]", step)
                steps.append((tag, ident, classes, attrs))
        _PARSED[selector] = tuple(steps)
    return _PARSED[selector]


def _fits(node: _Node, step: tuple) -> bool:
    tag, ident, classes, attrs = step
    if tag and node.tag != tag:
        return False
    if ident and node.attrs.get("id") != ident[0]:
        return False
    if classes and not set(classes) <= set(node.attrs.get("class", "").split()):
        return False
    for name, op, value in attrs:
        have = node.attrs.get(name)
        if have is None or (op == "=" and have != value) or (op == "*=" and value not in have):
            return False
    return True


def _select(root: _Node, selector: str) -> Iterator[_Node]:
    *outer, last = _steps(selector)
    for node in root.walk():
        if not _fits(node, last):
            continue
        ancestor, missing = node.parent, list(outer)
        while missing and ancestor is not None:
            if _fits(ancestor, missing[-1]):
                missing.pop()
            ancestor = ancestor.parent
        if not missing:
            yield node


def _first(root: _Node, choices) -> _Node | None:
    return next((n for s in choices for n in _select(root, s)), None)


def _text(node: _Node | None, joiner: str) -> str:
    if node is None:
        return ""
    return joiner.join(s for s in (part.strip() for part in node.strings()) if s)


def _date_text(node: _Node | None) -> str:
    return "" if node is None else node.attrs.get("datetime") or _text(node, "")


_ARTICLE = _struct(title=_STRING, date_text=_STRING, body_text=_STRING)


def _article(page: str, profile: dict) -> dict[str, str]:
    root = _Tree(page).root
    body = _text(_first(root, profile["body"]), "\n")
    if not body:
        body = _text(_first(root, profile["fallback"]), "\n")
    return {
        "title": _text(_first(root, profile["title"]), ""),
        "date_text": _date_text(_first(root, profile["date"])),
        "body_text": body,
    }


def parse_article(page: Column, profile: str = "office") -> Column:
    """``struct(title, date_text, body_text)`` of a page, by ordered selectors."""
    chosen = selectors.ARTICLE_PROFILES[profile]
    return _each("title string, date_text string, body_text string", _ARTICLE, lambda p: _article(p, chosen), page)


def parse_by_source(page: Column, source: Column) -> Column:
    """As ``parse_article``, with the profile of each row's source."""

    def article(page_text: str, name: str | None) -> dict[str, str]:
        profiles = selectors.ARTICLE_PROFILES
        return _article(page_text, profiles.get(name, profiles["generic"]))

    return _each("title string, date_text string, body_text string", _ARTICLE, article, page, source)


def record_text(page: Column) -> Column:
    """Text of a session record: its first known container, else the page."""

    def text(page_text: str) -> str:
        root = _Tree(page_text).root
        return _text(_first(root, selectors.SESSION_RECORD) or root, "\n")

    return _each("string", _STRING, text, page)


def statement_body(page: Column) -> Column:
    """Body of a statement page: the paragraphs of the first container with some
    text, else that text, else all paragraphs of the page."""

    def paragraphs(node: _Node, longer_than: int) -> str:
        texts = ("".join(p.strings()).strip() for p in _select(node, "p"))
        return "\n\n".join(t for t in texts if len(t) > longer_than)

    def body(page_text: str) -> str:
        root = _Tree(page_text).root
        found = ""
        for selector in selectors.STATEMENT_BODY:
            node = _first(root, [selector])
            whole = "" if node is None else "".join(node.strings()).strip()
            if len(whole) > 100:
                joined = paragraphs(node, 10)
                found = joined if len(joined) > 80 else whole
                break
        return found if len(found) >= 80 else paragraphs(root, 15)

    return _each("string", _STRING, body, page)


def parse_session(page: Column, min_chars: int = 500) -> Column:
    """``struct(title, body_text)`` of a session record: the first body element
    with more than ``min_chars`` characters, else the whole page."""

    def session(page_text: str) -> dict[str, str]:
        root = _Tree(page_text).root
        bodies = (_text(_first(root, [s]), "\n") for s in selectors.SESSION_BODY)
        body = next((b for b in bodies if len(b) > min_chars), "") or _text(root, "\n")
        titles = (_text(_first(root, [s]), " ") for s in selectors.SESSION_TITLE)
        title = next(
            (t for t in titles if 3 < len(t) < 200 and not re.search(fixed.SESSION_TITLE_EXCLUDED, t)), ""
        )
        if not title:
            found = re.search(fixed.SESSION_HEADING, body)
            title = found.group().strip() if found else ""
        return {"title": title, "body_text": body}

    return _each("title string, body_text string", _struct(title=_STRING, body_text=_STRING), session, page)


def _classed(root: _Node, pattern: str, tag: str = "") -> _Node | None:
    """First element below in page order that has a class with the pattern in it."""
    for node in root.walk():
        if node is not root and (not tag or node.tag == tag):
            if any(re.search(pattern, c) for c in node.attrs.get("class", "").split()):
                return node
    return None


def _following(root: _Node, node: _Node, tag: str) -> _Node | None:
    """First element of the tag after this one; its own content is the page shown, not the next."""
    own = {id(n) for n in node.walk()}
    after = False
    for other in root.walk():
        if id(other) in own:
            after = True
        elif after and other.tag == tag:
            return other
    return None


def listing_links(page: Column, base: str, fallback_marker: str = "/news/") -> Column:
    """Items of a listing page: ``array<struct(title, url, date_text)>``.

    The first selector with any element gives the items; without one, every
    link that looks like an article is taken.  Each address is kept once.
    """

    def absolute(href: str) -> str:
        return href if href.startswith("http") else base + href

    def items(page_text: str) -> list[dict]:
        root = _Tree(page_text).root
        found: dict[str, dict] = {}
        blocks = next(
            (nodes for s in selectors.LISTING_ITEMS if (nodes := list(_select(root, s)))), None
        )
        if blocks is None:
            links = [(n, "") for n in _select(root, "a[href]")]
            links = [
                (n, d)
                for n, d in links
                if fallback_marker in n.attrs["href"]
                and n.attrs["href"] != fallback_marker
                and "page" not in n.attrs["href"]
                and len(_text(n, "")) > 10
            ]
        else:
            pairs = [
                (_first(b, ["a[href]"]), _first(b, ["time"]) or _classed(b, fixed.LISTING_DATE_CLASS))
                for b in blocks
            ]
            links = [(n, _date_text(d)) for n, d in pairs if n is not None and len(_text(n, "")) >= 5]
        for node, date in links:
            url = absolute(node.attrs["href"])
            found.setdefault(url, {"title": _text(node, ""), "url": url, "date_text": date})
        return list(found.values())

    kind = pa.list_(_struct(title=_STRING, url=_STRING, date_text=_STRING))
    return _each("array<struct<title:string,url:string,date_text:string>>", kind, items, page)


def linked_items(page: Column, base: str, pattern: str, min_chars: int = 0) -> Column:
    """Links whose address fits a pattern, each once, with the text around them:
    ``array<struct(title, url, around, date_text)>``."""
    wanted = re.compile(pattern, re.I)

    def items(page_text: str) -> list[dict]:
        found: dict[str, dict] = {}
        for node in _select(_Tree(page_text).root, "a[href]"):
            href, title = node.attrs["href"], _text(node, " ")
            if wanted.search(href) and len(title) >= min_chars:
                url = href if href.startswith("http") else base + href
                date = _first(node.parent, ["time", "[class*='date']"])
                found.setdefault(
                    url,
                    {
                        "title": title,
                        "url": url,
                        "around": _text(node.parent, " "),
                        "date_text": _date_text(date),
                    },
                )
        return list(found.values())

    kind = pa.list_(_struct(title=_STRING, url=_STRING, around=_STRING, date_text=_STRING))
    return _each("array<struct<title:string,url:string,around:string,date_text:string>>", kind, items, page)


def next_page(page: Column, base: str) -> Column:
    """Address of the next listing page: a link marked as next, else the first link
    beside the active entry of the pager, else the next link of the page."""

    def address(page_text: str) -> str | None:
        root = _Tree(page_text).root
        link = _classed(root, fixed.NEXT_LINK_CLASS, "a") or _first(root, ["li.next a"])
        if link is None:
            pager = _classed(root, fixed.PAGER_CLASS)
            current = None if pager is None else _classed(pager, fixed.ACTIVE_PAGE_CLASS)
            if current is not None:
                siblings = [p for p in current.parent.parts if isinstance(p, _Node)]
                beside = siblings[siblings.index(current) + 1 :]
                link = next((n for n in beside if n.tag == "a"), None) or _following(root, current, "a")
        href = "" if link is None else link.attrs.get("href", "")
        return None if not href else href if href.startswith("http") else base + href

    return _each("string", _STRING, address, page)


_META = ("article:published_time", "article:modified_time", "og:title", "og:updated_time")


def _time(root: _Node) -> str | None:
    time = _first(root, ["time[datetime]"])
    return None if time is None else time.attrs["datetime"]


def _item_date(root: _Node) -> str | None:
    item = _first(root, ["[itemprop='datePublished']"])
    return None if item is None else item.attrs.get("content") or _date_text(item)


def _meta(root: _Node) -> list[tuple[str, str]]:
    some = (n.attrs for n in reversed(list(_select(root, "meta[property]"))))
    return list({a["property"]: a.get("content", "") for a in some if a["property"] in _META}.items())


# Name, type and reader of each part of a page.
_PARTS = {
    "links": ("array<string>", pa.list_(_STRING), lambda root: [n.attrs["href"] for n in _select(root, "a[href]")]),
    "paragraphs": ("array<string>", pa.list_(_STRING), lambda root: ["".join(n.strings()).strip() for n in _select(root, "p")]),
    "meta": ("map<string,string>", pa.map_(_STRING, _STRING), _meta),
    "dates": ("array<string>", pa.list_(_STRING), lambda root: ["".join(n.strings()).strip() for n in _select(root, "p.date")]),
    "time": ("string", _STRING, _time),
    "item_date": ("string", _STRING, _item_date),
    "info": ("string", _STRING, lambda root: _text(_first(root, [".elementor-post-info"]), " ")),
    "text": ("string", _STRING, lambda root: _text(_first(root, ["body"]), " ")),
}


def page_parts(page: Column, *names: str) -> Column:
    """What the collectors' own cascades need of a page: its links, paragraphs,
    meta fields and dated elements, or only the parts named."""
    chosen = {name: _PARTS[name] for name in names or _PARTS}

    def parts(page_text: str) -> dict:
        root = _Tree(page_text).root
        return {name: read(root) for name, (_, _, read) in chosen.items()}

    kind = ", ".join(f"{name} {sql}" for name, (sql, _, _) in chosen.items())
    return _each(kind, _struct(**{name: arrow for name, (_, arrow, _) in chosen.items()}), parts, page)
