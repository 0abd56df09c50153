"""HTML: cleaning in Catalyst expressions, and selector-based extraction where structure is needed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import bounded_batches

# Elements whose content is not text, in the order they are removed.
DROPPED = ("script", "style", "header", "footer", "nav")
#: Character references that are decoded, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _decoded(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def clean_html(html: Column | str = "html") -> Column:
    """All text outside script, style, header, footer and nav, joined by single spaces."""
    text = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    for tag in DROPPED:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(_decoded(text), r"[ \t\n\r\f]+", " "))


def page_article(html: Column | str = "html") -> Column:
    """Blocks of the first article element, one per line; empty without an article."""
    text = F.regexp_extract(F.col(html) if isinstance(html, str) else html, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    text = F.regexp_replace(text, r"[ \t\n\r\f]+", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|h1|h2|li|ul|br|div)\b[^>]*>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r" *\n[ \n]*", "\n")
    return F.regexp_replace(_decoded(text), r"^[ \n]+|[ \n]+$", "")


@dataclass
class Node:
    """Element of a parsed page; children are nodes and strings."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    def below(self):
        """Nodes and strings below, in page order; pages may be nested deeper than Python's stack."""
        left = self.children[::-1]
        while left:
            child = left.pop()
            yield child
            if isinstance(child, Node):
                left += child.children[::-1]

    def walk(self):
        return (child for child in self.below() if isinstance(child, Node))

    def text(self) -> str:
        """Text below the node, the pieces stripped and joined without gaps."""
        return "".join(c.strip() for c in self.below() if isinstance(c, str))

    def matches(self, simple: str) -> bool:
        """Whether a simple selector (tag, .class, #id, [attr=value], combined) holds."""
        parts = re.findall(r"^[\w-]+|\.[\w-]+|#[\w-]+|\[[\w-]+(?:=[^\]]*)?\]", simple)
        for part in parts:
            if part[0] == ".":
                ok = part[1:] in self.attrs.get("class", "").split()
            elif part[0] == "#":
                ok = self.attrs.get("id") == part[1:]
            elif part[0] == "[":
                name, _, value = part[1:-1].partition("=")
                ok = name in self.attrs and (not value or self.attrs[name] == value.strip("\"'"))
            else:
                ok = self.tag == part
            if not ok:
                return False
        return True

    def select(self, selector: str) -> list[Node]:
        """Descendants that match a descendant selector, in page order."""
        *outer, last = selector.split()
        found = []
        for node in self.walk():
            if node.matches(last):
                want, up = list(outer), node.parent
                while want and up is not None:
                    if up.matches(want[-1]):
                        want.pop()
                    up = up.parent
                if not want:
                    found.append(node)
        return found


class _Tree(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, [], self.at)
        self.at.children.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_html(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


@dataclass(frozen=True)
class ArticleRules:
    """Where an article is: container, title, and which blocks count.

    ``direct``: only children of the container count (headings and paragraphs that are not empty, every
    list item under a list); else all descendant paragraphs that are not empty and not below ``excluded``.
    """

    container: str
    title: str
    direct: bool = True
    excluded: str = ""


# The two known sources.
ARTICLE_RULES = {
    "consultant": ArticleRules("div.news-page__text", "h1.news-page__title"),
    "business_ru": ArticleRules("div.contentSchema[itemprop=articleBody]", "h1.page__title", False, "noindex"),
}


def extract_article(html: str | None, rules: ArticleRules | None) -> str | None:
    """Title and blocks, one per line; None without rules, html or container."""
    if html is None or rules is None:
        return None
    root = parse_html(html)
    containers = root.select(rules.container)
    if not containers:
        return None
    titles = root.select(rules.title)
    lines = [titles[0].text() if titles else ""]
    if rules.direct:
        for child in containers[0].children:
            if isinstance(child, Node) and child.tag in ("h2", "p") and child.text():
                lines.append(child.text())
            elif isinstance(child, Node) and child.tag == "ul":
                lines += [item.text() for item in child.select("li")]
    else:
        for p in containers[0].select("p"):
            up = p.parent
            while up is not None and up.tag != rules.excluded:
                up = up.parent
            if up is None and p.text():
                lines.append(p.text())
    return "\n".join(lines)


def article_text(source: Column | str, html: Column | str) -> Column:
    """Article of a page by the rules of its source; null where there are none. Batches of pages are bounded by bytes."""
    if session := SparkSession.getActiveSession():
        bounded_batches(session)

    @F.pandas_udf("string")
    def extracted(sources: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([extract_article(h, ARTICLE_RULES.get(s)) for s, h in zip(sources, pages)], dtype=object)

    return extracted(source, html)


def parse_listing(html: Column | str, page_url: Column | str, link: str, next_page: str) -> Column:
    """struct(urls, next_url) of a listing page, by CSS selectors of its links; nothing on broken input."""
    from urllib.parse import urljoin

    def one(page: str | None, base: str) -> dict:
        try:
            root = parse_html(page or "")
            urls = [urljoin(base, n.attrs["href"]) for n in root.select(link) if n.attrs.get("href")]
            after = [n.attrs["href"] for n in root.select(next_page) if n.attrs.get("href")]
        except (ValueError, AssertionError):
            return {"urls": [], "next_url": None}
        return {"urls": urls, "next_url": urljoin(base, after[0]) if after else None}

    @F.pandas_udf("struct<urls:array<string>,next_url:string>")
    def parsed(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p, b) for p, b in zip(pages, bases)], columns=["urls", "next_url"])

    return parsed(html, page_url)
