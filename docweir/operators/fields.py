"""Fields and links of HTML pages by configured rules: a page's elements, simple CSS selectors, and what rules make of their values.

Pages are independent, so they are read in Arrow batches by a small tree of elements; everything after a page's values is
DataFrame work. A selector is a list of alternatives with commas; each is tag, #id, .class and [attribute], [attribute=value],
~=, ^=, $= or *= parts, joined by a space (below) or > (directly below).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from .tables import batched

#: Elements without an end, and those that a new one of the same kind ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
CORE = ("title", "summary", "country", "policy_status", "start_year", "end_year")
PART = re.compile(r"""(?P<tag>^[\w*-]+)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>[~^$*]?)=["']?(?P<value>[^"'\]]*)["']?)?\]""")


@dataclass(eq=False, repr=False)
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    above: Element | None = None
    inside: list = field(default_factory=list)

    def nodes(self) -> Iterator[Element | str]:
        """All elements and strings below, in the order of their starts; the open ones are a list, so pages may be as deep as they like."""
        open_ = [iter(self.inside)]
        while open_:
            for x in open_[-1]:
                yield x
                if isinstance(x, Element):
                    open_.append(iter(x.inside))
                    break
            else:
                open_.pop()

    def walk(self) -> Iterator[Element]:
        """All elements below, in the order of their starts."""
        return (x for x in self.nodes() if isinstance(x, Element))

    def text(self, separator: str = " ") -> str:
        """Strings below, each trimmed, blank ones left out."""
        return separator.join(s for x in self.strings() if (s := x.strip()))

    def strings(self) -> Iterator[str]:
        return (x for x in self.nodes() if isinstance(x, str))


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SELF_ENDING and self.at.tag == tag:
            self.at = self.at.above
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(made)
        if tag not in VOID:
            self.at = made

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.above is not None and node.tag != tag:
            node = node.above
        if node.above is not None:
            self.at = node.above

    def handle_data(self, data: str) -> None:
        if self.at.tag not in ("script", "style"):
            self.at.inside.append(data)


def read(html: str | None, as_written: bool = False) -> Element:
    """A page's elements; as_written leaves all character references but &amp; as they stand, also those cut off."""
    reader = Reader()
    reader.feed(re.sub("&(?!amp;)", "&amp;", html or "") if as_written else html or "")
    reader.close()
    return reader.root


def _fits(e: Element, compound: str) -> bool:
    for m in PART.finditer(compound):
        have = e.attributes
        if m["tag"]:
            ok = m["tag"] in ("*", e.tag)
        elif m["id"]:
            ok = have.get("id") == m["id"]
        elif m["cls"]:
            ok = m["cls"] in have.get("class", "").split()
        elif m["value"] is None:
            ok = m["name"] in have
        else:
            own, want = have.get(m["name"]), m["value"]
            tests = {"": lambda: own == want, "~": lambda: want in own.split(), "^": lambda: own.startswith(want), "$": lambda: own.endswith(want), "*": lambda: want in own}
            ok = own is not None and tests[m["op"]]()
        if not ok:
            return False
    return True


def _climbs(e: Element, steps: list[str]) -> bool:
    """Whether the elements above e fit the steps before its own, nearest last; a > step must fit the next one above."""
    if not steps:
        return True
    direct = steps[-1] == ">"
    rest = steps[:-1] if direct else steps
    up = e.above
    while up is not None and up.tag:
        if _fits(up, rest[-1]) and _climbs(up, rest[:-1]):
            return True
        if direct:
            return False
        up = up.above
    return False


def select(root: Element, selector: str) -> list[Element]:
    """Elements that fit any of the alternatives, in the order of the page, each once."""
    ways = [re.sub(r"\s*>\s*", " > ", way).split() for way in re.split(r",(?![^\[]*\])", selector) if way.strip()]
    return [e for e in root.walk() if any(_fits(e, w[-1]) and _climbs(e, w[:-1]) for w in ways)]


def value_of(e: Element, url: str, rule: dict) -> str | int | None:
    """One element's value by a rule: its text or an attribute, what a pattern finds in it, and the transformed whole."""
    name = rule.get("attribute", "text")
    if name == "text":
        found = e.text(rule.get("separator", " "))
    elif name not in e.attributes:
        return None
    else:
        found = urljoin(url, e.attributes[name]) if name in ("href", "src") else e.attributes[name].strip()
    if pattern := rule.get("regex"):
        m = re.search(pattern, found)
        if not m:
            return None
        found = m[rule.get("group", 1 if m.re.groups and m.lastindex else 0)]
    kind = rule.get("transform")
    if kind in ("integer", "year"):
        number = re.search(r"-?\d+", found.replace(",", ""))
        return int(number[0]) if number else None
    return {"lower": str.lower, "upper": str.upper}.get(kind, lambda x: " ".join(x.split()))(found)


def apply_rule(root: Element, url: str, rule: str | dict) -> object:
    """What a rule (a selector, or a dictionary with one) finds in a page, or its default."""
    rule = {"selector": rule} if isinstance(rule, str) else rule
    if not rule.get("selector"):
        return rule.get("default")
    values = [v for e in select(root, rule["selector"]) if (v := value_of(e, url, rule)) is not None]
    if rule.get("multiple"):
        return list(dict.fromkeys(values)) or rule.get("default")
    return values[0] if values else rule.get("default")


def extract_fields(pages: DataFrame, rules: dict[str, str | dict], as_written: bool = False) -> DataFrame:
    """(page_id, fields, metadata) of pages (page_id, url, html): maps of names to JSON values.

    Of the rules the six core fields count, and those of the dictionary called metadata. Fields without a value are left
    out; a null page has none but defaults. as_written is read()'s.
    """

    def found(root: Element, url: str, own: dict) -> dict[str, str]:
        values = {name: apply_rule(root, url, rule) for name, rule in own.items()}
        return {name: json.dumps(v, ensure_ascii=False) for name, v in values.items() if v is not None and v != []}

    core, more = {k: rules[k] for k in CORE if k in rules}, rules.get("metadata", {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            roots = [(page, url or "", read(html, as_written)) for page, url, html in batch.itertuples(index=False)]
            rows = [(page, found(root, url, core), found(root, url, more)) for page, url, root in roots]
            yield pd.DataFrame(rows, columns=["page_id", "fields", "metadata"])

    kind = dict(pages.dtypes)["page_id"]
    return batched(pages.select("page_id", "url", "html")).mapInPandas(run, f"page_id {kind}, fields map<string,string>, metadata map<string,string>")


def labelled_values(pages: DataFrame, label: str = "dt", value: str = "dd", shortest: int = 80) -> DataFrame:
    """(page_id, values, summary, year): a page's label lists as a map, its first paragraph of at least so many characters, and
    the first year of that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in batch.itertuples(index=False):
                root, held, name = read(html), {}, None
                for e in select(root, f"{label}, {value}"):
                    if e.tag == label:
                        name = e.text().rstrip(":").strip().lower()
                    elif name:
                        held.setdefault(name, e.text())
                summary = next((t for e in select(root, "p") if len(t := " ".join(e.text().split())) >= shortest), None)
                year = re.search(r"\b(?:19|20)\d\d\b", summary or "")
                rows.append((page, held, summary, int(year[0]) if year else None))
            yield pd.DataFrame(rows, columns=["page_id", "values", "summary", "year"]).astype({"year": "Int32"})

    kind = dict(pages.dtypes)["page_id"]
    return batched(pages.select("page_id", "html")).mapInPandas(run, f"page_id {kind}, values map<string,string>, summary string, year int")


def page_links(pages: DataFrame, start_url: str, domains: list[str], details: list[str] | None = None, pages_like: list[str] | None = None, selector: str = "a[href]") -> DataFrame:
    """(page_id, details, pagination): a page's links to detail pages and to further result pages, absolute, each once, in order.

    Links leave out fragments and other hosts. Without patterns a detail page lies below the start's path, and a result
    page has its path and a numbered page, p or offset.
    """
    start = urlsplit(start_url).path.rstrip("/")

    def allowed(target: str) -> bool:
        parts = urlsplit(target)
        host = (parts.hostname or "").lower()
        return parts.scheme in ("http", "https") and any(host == d or host.endswith(f".{d}") for d in domains)

    def is_detail(target: str) -> bool:
        return any(re.search(p, target) for p in details) if details else urlsplit(target).path.rstrip("/").startswith(f"{start}/")

    def is_page(target: str) -> bool:
        parts = urlsplit(target)
        return any(re.search(p, target) for p in pages_like) if pages_like else parts.path.rstrip("/") == start and bool(re.search(r"(?:^|&)(?:page|p|offset)=\d+", parts.query))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, url, html in batch.itertuples(index=False):
                targets = [urljoin(url or "", e.attributes["href"].strip()).split("#")[0] for e in select(read(html), selector) if e.attributes.get("href", "").strip()]
                kept = [t for t in dict.fromkeys(targets) if t and allowed(t)]
                rows.append((page, [t for t in kept if is_detail(t)], [t for t in kept if is_page(t)]))
            yield pd.DataFrame(rows, columns=["page_id", "details", "pagination"])

    kind = dict(pages.dtypes)["page_id"]
    return batched(pages.select("page_id", "url", "html")).mapInPandas(run, f"page_id {kind}, details array<string>, pagination array<string>")
