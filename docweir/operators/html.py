"""HTML pages to Markdown, links and asset records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fields as tree
from .tables import batched

#: What is no text of a page, where its text is looked for, signs that only decorate, files that are assets,
#: and the words of a line of metadata.
DROPPED = "script, style, noscript, template, svg, nav, footer, [hidden], [aria-hidden=true], .cookie, .cookies, .cookie-banner, .social-share, .share"
ROOTS = ("main", "article", "body")
ICONS = frozenset("icon fa fas far fab fal fad bi glyphicon".split())
ICON_BEGINNINGS = ("icon-", "fa-", "bi-", "glyphicon-", "material-icons", "material-symbols")
ASSETS = {
    ".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".csv": "text/csv",
}
STATED = ("Added by", "Added on", "Updated by", "Updated on")

EMPTY_BOLD = re.compile(r"^\s*\*\*\s*-\s*$", re.M)
STATED_BOLD = re.compile(rf"^\s*\*\*\s*({'|'.join(STATED)}):\s*(?!\*\*)(.*)$", re.M)
GAPS = [(re.compile(r"[ \t]+\n"), "\n"), (re.compile(r"\n[ \t]+"), "\n"), (re.compile(r"\n{3,}"), "\n\n")]


def normalise(markdown: str) -> str:
    """One kind of line end, links apart, broken bold lines mended, no spaces at line ends, two line feeds at most."""
    text = markdown.replace("\r\n", "\n").replace("\r", "\n").replace(")[", ") [")
    text = STATED_BOLD.sub(r"**\1:** \2", EMPTY_BOLD.sub("", text))
    for gap, sign in GAPS:
        text = gap.sub(sign, text)
    return text.strip()


def _line(text: str) -> str:
    return " ".join(text.split())


def _marked(sign: str):
    return lambda e, inside, base: f"{sign}{_line(inside)}{sign}" if inside.strip() else ""


def _block(before: str, after: str = "\n\n"):
    return lambda e, inside, base: f"\n\n{before}{_line(inside)}{after}"


def _link(e: tree.Element, inside: str, base: str) -> str:
    label = _line(inside)
    return f"[{label}]({urljoin(base, e.attributes['href'])})" if label and "href" in e.attributes else label


def _quote(e: tree.Element, inside: str, base: str) -> str:
    return "\n\n" + "\n".join(f"> {line}" for line in normalise(inside).splitlines()) + "\n\n"


def _item(e: tree.Element, inside: str, base: str) -> str:
    return f"\n{'1.' if e.above is not None and e.above.tag == 'ol' else '-'} {_line(inside)}"


def _table(e: tree.Element, inside: str, base: str) -> str:
    rows = [line for line in inside.splitlines() if line.strip()]
    if not rows:
        return ""
    rule = "| " + " | ".join(["---"] * max(1, rows[0].count("|") - 1)) + " |"
    return "\n\n" + "\n".join([rows[0], rule, *rows[1:]]) + "\n\n"


#: What an element makes of its rendered inside; others leave it as it is. Rows of tables are made of their cells.
RENDER = {
    **{f"h{n}": _block("#" * n + " ") for n in range(1, 7)}, "p": _block(""), "br": lambda e, inside, base: "\n", "a": _link,
    "strong": _marked("**"), "b": _marked("**"), "em": _marked("*"), "i": _marked("*"),
    "code": lambda e, inside, base: inside if e.above is not None and e.above.tag == "pre" else f"`{_line(inside)}`",
    "pre": lambda e, inside, base: "\n\n```\n" + "\n".join(e.strings()).strip() + "\n```\n\n",
    "blockquote": _quote, "li": _item, "table": _table,
    **dict.fromkeys(("ul", "ol"), lambda e, inside, base: f"\n{inside.strip()}\n"),
    **dict.fromkeys(("div", "section", "article", "main", "header"), lambda e, inside, base: f"\n{inside}\n"),
}


def _decorates(e: tree.Element) -> bool:
    names = e.attributes.get("class", "").lower().split() if e.tag in ("i", "span") else ()
    return any(n in ICONS or n.startswith(ICON_BEGINNINGS) or n.endswith("-icon") for n in names)


def render(root: tree.Element, base: str) -> str:
    """Markdown of an element, its inside first; the open elements are a list, so pages may be as deep as they like."""
    open_: list[tuple[tree.Element, Iterator, list[tuple[str, str]]]] = [(root, iter(root.inside), [])]
    while True:
        e, rest, made = open_[-1]
        x = next(rest, None)
        if isinstance(x, str):
            made.append(("", x))
        elif x is not None:
            if not _decorates(x):
                open_.append((x, iter(x.inside), []))
        else:
            open_.pop()
            if e.tag == "tr":
                cells = [_line(text) for tag, text in made if tag in ("td", "th")]
                text = f"\n| {' | '.join(cells)} |" if cells else ""
            else:
                inside = "".join(text for _, text in made)
                text = RENDER[e.tag](e, inside, base) if e.tag in RENDER else inside
            if not open_:
                return text
            open_[-1][2].append((e.tag, text))


def _without(root: tree.Element, selector: str) -> None:
    """Take what fits the selector out of the tree below root."""
    gone = {id(e) for e in tree.select(root, selector)}
    if gone:
        for e in [root, *root.walk()]:
            e.inside = [x for x in e.inside if id(x) not in gone]


def _assets(root: tree.Element, base: str, selector: str) -> list[dict[str, str | None]]:
    """(url, kind, title, mime_type) of links to files of a known kind, or that are to be downloaded, each url once."""
    found: dict[str, dict[str, str | None]] = {}
    for e in tree.select(root, selector):
        if "href" in e.attributes:
            url = urljoin(base, e.attributes["href"])
            path = urlsplit(url).path.lower()
            mime = next((m for end, m in ASSETS.items() if path.endswith(end)), None)
            if mime or "download" in e.attributes:
                found.setdefault(url, {"url": url, "kind": "pdf" if mime == ASSETS[".pdf"] else "attachment", "title": e.text() or None, "mime_type": mime})
    return [*found.values()]


def clean_page(html: str | None, base: str, selector: str | None = None, excluded: str | None = None, asset_selector: str = "a[href]") -> tuple[str | None, str, list[str], list[dict]]:
    """(title, markdown, links, assets) of a page. Its text is what selector finds first (nothing, if it finds nothing), else that of
    the first of ROOTS; DROPPED and what excluded fits is left out."""
    page = tree.read(html)
    title = next((_line(e.text()) or None for e in tree.select(page, "title")), None)
    if selector:
        root = next(iter(tree.select(page, selector)), None)
    else:
        root = next((found[0] for tag in ROOTS if (found := tree.select(page, tag))), page)
    if root is None:
        return title, "", [], []
    _without(root, f"{DROPPED}, {excluded}" if excluded else DROPPED)
    for e in tree.select(root, "title, head"):  # of pages without a body
        e.inside = []
    links = dict.fromkeys(urljoin(base, e.attributes["href"]) for e in tree.select(root, "a[href]") if e.attributes["href"])
    return title, normalise(render(root, base)), [*links], _assets(root, base, asset_selector)


def clean_pages(pages: DataFrame, selector: str | None = None, excluded: str | None = None, asset_selector: str = "a[href]") -> DataFrame:
    """(page_id, title, markdown, links, assets) of each page (page_id, url, html); see clean_page()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page, *clean_page(html, url or "", selector, excluded, asset_selector)) for page, url, html in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["page_id", "title", "markdown", "links", "assets"])

    kind = dict(pages.dtypes)["page_id"]
    asset = "struct<url:string,kind:string,title:string,mime_type:string>"
    return batched(pages.select("page_id", "url", "html")).mapInPandas(run, f"page_id {kind}, title string, markdown string, links array<string>, assets array<{asset}>")


def fields(html: Column) -> dict[str, Column]:
    """Title, first heading, language and number of paragraphs of simple HTML, by expressions alone."""
    flat = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    return {
        "title": flat(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)),
        "heading": flat(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)),
        "lang": F.regexp_extract(html, r'<html[^>]*\blang="([^"]*)"', 1),
        "n_paragraphs": F.size(F.regexp_extract_all(html, F.lit(r"<p[ >]"), 0)),
    }


def hrefs(html: Column) -> Column:
    """Distinct href values in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\b[^>]*\bhref="([^"]*)"'), 1))
