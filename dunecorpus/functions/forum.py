"""Forum index, listing and thread pages: categories, forums, threads and posts.

Markup nests, so pages are parsed with the standard library's HTML parser in
Arrow-batched Pandas UDFs; every function gives arrays of structs, in order.
Unparsable rests are skipped as browsers do; a null page counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What marks links, dates and refused pages.
FORUM = re.compile(r"forumdisplay\.php\?f=(\d+)")
DATE = re.compile(r"\d{4}-\d{2}-\d{2},\s*\d{2}:\d{2}")
THREAD, POST, MESSAGE, SCOPE = "thread_title_", "post", "post_message_", "collapseobj_forumbit_"
REFUSED = ("ليس لديك الصلاحية", "you do not have permission", "غير مصرح لك", "access denied")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style"))
#: A tag that opens ends an open one of these, up to the bound.
ENDED_BY = {"td": (("td", "th"), "tr"), "th": (("td", "th"), "tr"), "tr": (("tr",), "table"), "li": (("li",), "ul"), "p": (("p",), "div"), "option": (("option",), "select")}


class Element:
    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.inner = tag, attributes, []

    def __getitem__(self, name: str) -> str:
        return self.attributes.get(name) or ""

    def all(self) -> Iterator[Element]:
        waiting = [x for x in reversed(self.inner) if isinstance(x, Element)]
        while waiting:
            now = waiting.pop()
            yield now
            waiting += [x for x in reversed(now.inner) if isinstance(x, Element)]

    def texts(self) -> Iterator[str]:
        waiting = list(reversed(self.inner))
        while waiting:
            now = waiting.pop()
            if isinstance(now, str):
                yield now
            elif now.tag not in SILENT:
                waiting += reversed(now.inner)

    def text(self, between: str = "") -> str:
        return between.join(filter(None, map(str.strip, self.texts())))

    def has_class(self, name: str) -> bool:
        return name in self["class"].split()

    def first(self, test) -> Element | None:
        return next(filter(test, self.all()), None)


class Page(HTMLParser):
    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        ends, bound = ENDED_BY.get(tag, ((), None))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == bound or not ends:
                break
            if self.open[i].tag in ends:
                del self.open[i:]
                break
        new = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].inner.append(new)
        if tag not in VOID:
            self.open.append(new)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].inner.append(data)


def _forum_id(a: Element) -> str | None:
    m = FORUM.search(a["href"]) if a.tag == "a" else None
    return m and m[1]


def _titled(links: Iterator[tuple[str | None, Element]]) -> list[tuple[str, str]]:
    """(id, title) with the first title of each id; links without text are skipped."""
    out: dict[str, str] = {}
    for key, a in links:
        if key and key not in out and a.text():
            out[key] = a.text()
    return list(out.items())


def category_list(html: str | None) -> list[tuple[str, str]]:
    heads = (td.first(_forum_id) for td in Page(html).root.all() if td.tag == "td" and td.has_class("tcat"))
    return [(_forum_id(a), a.text()) for a in heads if a and a.text()]


def forum_list(html: str | None, scope: str | None = None) -> list[tuple[str, str]]:
    root = Page(html).root
    if scope is not None:
        root = root.first(lambda e: e.tag == "tbody" and e["id"] == SCOPE + scope) or Element("", {})
    return _titled((_forum_id(a), a) for a in root.all())


def thread_list(html: str | None) -> list[tuple[str, str]]:
    return _titled((a["id"][len(THREAD) :], a) for a in Page(html).root.all() if a.tag == "a" and a["id"].startswith(THREAD))


def post_list(html: str | None) -> list[tuple[str, str | None, str | None, str]]:
    out = []
    for table in Page(html).root.all():
        number = table["id"][len(POST) :]
        if table.tag != "table" or not table["id"].startswith(POST) or not number.isdigit():
            continue
        body = table.first(lambda e, want=MESSAGE + number: e.tag == "div" and e["id"] == want)
        if body is None or not body.text("\n"):
            continue
        author = table.first(lambda e: e.tag == "a" and e.has_class("bigusername"))
        head = table.first(lambda e: e.tag == "td" and e.has_class("thead"))
        date = head and DATE.search("".join(head.texts()))
        out.append((number, author.text() if author else None, date[0] if date else None, body.text("\n")))
    return out


def leads_on(html: str | None) -> bool:
    bar = Page(html).root.first(lambda e: e.tag == "div" and e.has_class("pagenav"))
    return bar is not None and bar.first(lambda e: e.tag == "a" and e["rel"] == "next") is not None


def _listing(names: tuple[str, ...], read):
    fields = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))

    @F.pandas_udf(fields)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [dict(zip(names, row, strict=True)) for row in read(h)])

    return run


TITLED = ("id", "title")


def categories(html: Column) -> Column:
    """struct(id, title) of the genuine category headers."""
    return _listing(TITLED, category_list)(html)


def forums(html: Column, scope: str | None = None) -> Column:
    """struct(id, title) of the forums linked, once each; with ``scope``, in that category's block only."""
    return _listing(TITLED, lambda h: forum_list(h, scope))(html)


def threads(html: Column) -> Column:
    """struct(id, title) of a listing's threads, once each."""
    return _listing(TITLED, thread_list)(html)


def posts(html: Column) -> Column:
    """struct(id, author, written, body) of a thread page's posts; author and date may be null."""
    return _listing(("id", "author", "written", "body"), post_list)(html)


def has_next(html: Column) -> Column:
    """Whether the page's navigation leads to a next one."""

    @F.pandas_udf(T.BooleanType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(leads_on)

    return run(html)


def refused(html: Column) -> Column:
    """Whether the page says that it may not be read."""
    low = F.lower(html)
    test = F.lit(False)
    for marker in REFUSED:
        test = test | low.contains(marker)
    return F.coalesce(test, F.lit(False))
