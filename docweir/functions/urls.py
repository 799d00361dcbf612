"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by file suffix; anything else is a stream of bytes.
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
    "csv": "text/csv",
}


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    """Percent encoding of a query's parts: letters, digits and _.-~ stay, a space is +."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no fragment and no parameters of the last segment, no slash at the path's end (an empty
    path is /), query pairs decoded, sorted and encoded again; a name without a value has an empty one."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), ";[^/]*$", "")
    path = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    joined = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def allowed(url: Column, domains: list[str]) -> Column:
    """An http(s) url whose host is one of the domains or below one."""
    h = host(url)
    fits = F.exists(F.array(*map(F.lit, domains)), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))
    return F.coalesce(F.regexp_like(url, F.lit("^(?i)https?://")) & fits, F.lit(False))


def asset_path(document_url: Column, asset_url: Column) -> Column:
    """Where an attachment is kept: digests of both urls and the attachment's suffix."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace(asset_url, "[?#].*$", ""), r"(\.[A-Za-z0-9]{1,5})$", 1))
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    return F.concat(short(document_url), F.lit("/"), short(asset_url), suffix)


def mime_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    found = F.lit("application/octet-stream")
    for ext, kind in MIME_TYPES.items():
        found = F.when(suffix == ext, kind).otherwise(found)
    return found


def page_numbers(total: Column, size: int, first: int = 1) -> Column:
    """Numbers of the result pages after the first: up to first + ceil(total / size) - 1."""
    last = F.lit(first) + F.ceil(total / size).cast("int") - 1
    return F.when(last > first, F.sequence(F.lit(first + 1), last)).otherwise(F.array().cast("array<int>"))


def last_page(expected: Column, size: int, first: int = 1) -> Column:
    """The number of the last result page."""
    return F.lit(first) + F.greatest(F.ceil(expected / size).cast("int"), F.lit(1)) - 1


def numbered_pages(url: Column, last: Column, parameter: str = "page", first: int = 1) -> Column:
    """Urls of the result pages from first to last: the parameter set to each number, the other pairs as they are."""
    base, query = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    others = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit(f"{parameter}=")))
    of = lambda n: F.concat(base, F.lit("?"), F.array_join(F.concat(others, F.array(F.concat(F.lit(f"{parameter}="), n.cast("string")))), "&"))
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), of)).otherwise(F.array().cast("array<string>"))


def template_pages(template: str, last: Column, first: int = 1, sign: str = "{page}") -> Column:
    """Urls of the result pages from first to last by a template with a sign for the number."""
    of = lambda n: F.replace(F.lit(template), F.lit(sign), n.cast("string"))
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), of)).otherwise(F.array().cast("array<string>"))


def stated_total(text: Column, label: str = "") -> Column:
    """The first number of a text, after a label if one is given, with commas between its thousands; null if there is none."""
    found = F.regexp_extract(text, label + r"(?s).*?(\d[\d,]*)" if label else r"(\d[\d,]*)", 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit("")).try_cast("bigint")


def next_page(current: Column, total: Column, size: int = 20) -> Column:
    """The number of the next result page, or null where the current one is the last."""
    return F.when(current < F.ceil(total / size), current + 1)


def _as_regex(pattern: str) -> str:
    """A pattern that is no regular expression is a glob."""
    import fnmatch
    import re

    try:
        re.compile(pattern)
        return pattern
    except re.error:
        return fnmatch.translate(pattern).replace("\\Z", "$").replace("(?s:", "(?s)(?:")


def matches(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Some include pattern is found in the url (any url, if there are none), and no exclude pattern is."""
    found = lambda patterns: [F.regexp_like(url, F.lit(_as_regex(p))) for p in patterns]
    wanted, barred = F.lit(not include), F.lit(False)
    for c in found(include):
        wanted = wanted | c
    for c in found(exclude):
        barred = barred | c
    return F.coalesce(wanted & ~barred, F.lit(False))
