"""Text expressions. Every function takes and returns Columns and stays inside Catalyst."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapse(text: Column) -> Column:
    """Runs of white space, Unicode's included, become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized_hash(text: Column) -> Column:
    """Digest by which texts that differ in case and spacing are equal."""
    return F.sha2(F.lower(collapse(text)), 256)


def content_hash(title: Column, content: Column) -> Column:
    """Digest of the compact JSON of content and title; missing values count as empty."""
    body = F.to_json(F.struct(F.coalesce(content, F.lit("")).alias("content"), F.coalesce(title, F.lit("")).alias("title")))
    return F.sha2(body, 256)


def preview(text: Column, size: int = 500) -> Column:
    """The collapsed text, cut to size characters with an ellipsis."""
    flat = collapse(text)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size - 3)), F.lit("...")))


def excerpt(text: Column, head: int = 9000, middle: int = 5000, tail: int = 2000) -> Column:
    """Head, middle and tail of a long text, with marks between them; a short text as it is."""
    n = F.length(text)
    mark = "\n\n[...]\n\n"
    start = F.floor((n - middle) / 2).cast("int") + 1
    cut = F.concat(F.substring(text, 1, head), F.lit(mark), F.substr(text, start, F.lit(middle)), F.lit(mark), F.right(text, F.lit(tail)))
    return F.when(n <= head + middle + tail, text).otherwise(cut)


def string_list(text: Column) -> Column:
    """Items of a list in a text: split at the first of newline, semicolon or comma that it holds, trimmed, none empty."""
    parts = (
        F.when(F.contains(text, F.lit("\n")), F.split(text, "\n"))
        .when(F.contains(text, F.lit(";")), F.split(text, ";"))
        .otherwise(F.split(text, ","))
    )
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def like_pattern(query: Column) -> Column:
    """A pattern that finds query as a substring, with ! as its escape."""
    escaped = query
    for sign in "!%_":
        escaped = F.replace(escaped, F.lit(sign), F.lit("!" + sign))
    return F.concat(F.lit("%"), escaped, F.lit("%"))


def match_fields(query: Column, **fields: Column) -> Column:
    """Names of the fields that hold query, whatever the case, in the order given."""
    found = [F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(query)), name) for name, c in fields.items()]
    return F.array_compact(F.array(*found))


def slug(title: Column, url: Column, size: int = 80) -> Column:
    """A file name from a title; from the url's digest where the title has no letters or digits."""
    name = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.substring(F.sha2(url, 256), 1, 16))


def mask_secret(secret: Column) -> Column:
    """Four characters at each end of a long secret; a short one is hidden whole."""
    return F.when(F.length(secret) <= 8, "****").otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4))))


def loose_key(text: Column) -> Column:
    """Lower-case letters, digits and CJK signs alone, by which questions are compared."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", "")


def sentences(text: Column) -> Column:
    """Sentences and lines, trimmed, in order; blank ones stay as empty strings so that positions hold."""
    return F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x))


def units(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def citation_numbers(text: Column) -> Column:
    """Numbers of [n] markers in order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))


def words(text: Column) -> Column:
    """Lower-case ASCII words and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def numbered_lines(text: Column) -> Column:
    """Digits become #, so that numbered margin lines are alike."""
    return F.regexp_replace(F.lower(collapse(text)), r"\d+", "#")


def is_contents_page(text: Column) -> Column:
    """A page with the word contents and four dot leaders or six numbered entries."""
    leaders = F.size(F.regexp_extract_all(text, F.lit(r"\.{4,}"), 0))
    entries = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d+(?:\.\d+)*\s+\S.*\s\d+\s*$"), 0))
    return F.contains(F.lower(text), F.lit("contents")) & ((leaders >= 4) | (entries >= 6))


def guess_language(text: Column) -> Column:
    """A first guess over the first 20,000 characters; null for a blank text, English if nothing speaks against it."""
    start = F.lower(F.substring(text, 1, 20_000))
    held = lambda *xs: F.regexp_like(start, F.lit("|".join(xs)))
    return (
        F.when(text.isNull() | (F.trim(collapse(start)) == ""), None)
        .when(held("[Ѐ-ӿ]"), "Bulgarian")
        .when(held(*SPANISH), "Spanish")
        .when(held(*FRENCH), "French")
        .otherwise("English")
    )


#: Beginnings of words that speak for a language.
SPANISH = ("transformaci", "polit", "digitalizaci")
FRENCH = ("strat", "numer", "gouvernance")


def unfenced(text: Column) -> Column:
    """A model's reply without the fence of a code block around it."""
    bare = collapse_ends(text)
    opened = F.regexp_replace(bare, r"^```(?:json)?", "")
    return F.when(F.startswith(bare, F.lit("```")), collapse_ends(F.regexp_replace(collapse_ends(opened), "```$", ""))).otherwise(bare)


def collapse_ends(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def json_object(text: Column) -> Column:
    """The JSON object of a reply: the whole without its fence, else what stands from the first { to the last }; null if there is none."""
    bare = unfenced(text)
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    is_object = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object(bare), bare).when(F.try_parse_json(bare).isNotNull(), "{}").when(is_object(body), body)


def clean_list(values: Column) -> Column:
    """Items of a JSON array in a text, trimmed, none blank; no items for anything else."""
    items = F.from_json(values, "array<string>")
    return F.coalesce(F.filter(F.transform(items, lambda x: collapse_ends(x)), lambda x: x != ""), F.array().cast("array<string>"))


def clean_date(value: Column) -> Column:
    """A date as YYYY-MM-DD, or null."""
    bare = collapse_ends(value)
    return F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")).isNotNull(), bare)


def suggestions(text: Column) -> Column:
    """Strings of a JSON array in a reply: of the whole, else of what stands between the first [ and the last ]; of an array
    that was cut off all strings that are complete."""
    bare = unfenced(text)
    block = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    listed = lambda c: F.when(F.startswith(collapse_ends(c), F.lit("[")) & F.try_parse_json(c).isNotNull(), F.from_json(c, "array<string>"))
    literals = F.regexp_extract_all(bare, F.lit(r'"(?:[^"\\]|\\.)*"'), 0)
    single = F.transform(literals, lambda x: F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0)))
    found = F.coalesce(listed(bare), listed(block), single)
    return F.filter(F.transform(found, lambda x: collapse_ends(x)), lambda x: x.isNotNull() & (x != ""))


def cut_question(text: Column, size: int) -> Column:
    """A suggested question, trimmed and cut to size characters."""
    bare = collapse_ends(text)
    return F.when(F.length(bare) > size, F.regexp_replace(F.left(bare, F.lit(size)), r"(?U)\s+$", "")).otherwise(bare)


def header(text: Column, size: int = 240) -> Column:
    """A chunk's header as it is stored: one line, no quotation marks around it, size characters at most."""
    bare = F.regexp_replace(collapse(text), '^"+|"+$', "")
    return F.left(F.trim(bare), F.lit(size))


def vector_literal(vector: Column) -> Column:
    """A vector as text, eight decimals a number, rounded by its exact value and ties to even as in C.

    Spark's format rounds what is halfway up. A number's first 24 bits and the rest are each multiplied without an error, so
    the sign of their sum over an odd number of halves tells on which side of halfway it is; below it, or on it with an
    even number under it, that number is written. From 45,000,000 on Spark's format stands. Nulls are left out; a vector
    of nothing else is null.
    """
    halves = 2e8

    def literal(v: Column) -> Column:
        size = F.abs(v)
        odd, high = F.rint(size * halves), size.cast("float").cast("double")
        over, under = (high * halves - odd) + (size - high) * halves, (odd - 1) / 2
        down = (odd % 2 == 1) & ((over < 0) | ((over == 0) & (under % 2 == 0))) & (size < 4.5e7)
        finite = F.format_string("%.8f", F.when(down, F.signum(v) * (under / 1e8)).otherwise(v))
        return F.when(size < float("inf"), finite).when(F.isnan(v), "nan").when(v > 0, "inf").when(v < 0, "-inf")

    joined = F.array_join(F.transform(vector, lambda v: literal(v.cast("double"))), ",")
    return F.when((F.size(vector) == 0) | F.exists(vector, lambda v: v.isNotNull()), F.concat(F.lit("["), joined, F.lit("]")))


def humanized(name: Column) -> Column:
    """An identifier as a title."""
    return F.initcap(F.trim(F.translate(name, "_-", "  ")))


def english_display(value: Column, fallback: Column, translations: dict[str, str] | None = None) -> Column:
    """A name as it is, unless it has Han signs and no ASCII letter or digit: then its translation or the fallback."""
    only_han = value.rlike("[一-鿿]") & ~value.rlike("[A-Za-z0-9]")
    known = fallback
    for name, meaning in (translations or {}).items():
        known = F.when(value == name, meaning).otherwise(known)
    return F.when(F.coalesce(only_han, F.lit(False)), known).otherwise(value)


def holds(json: Column, query: Column) -> Column:
    """Whether a key or a value of a JSON text, however deep, contains a lower-case query; keys and values are looked at one by one."""
    tokens = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false'), 0)
    plain = F.transform(tokens, lambda x: F.when(F.startswith(x, F.lit('"')), F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0))).otherwise(x))
    return F.coalesce(F.exists(plain, lambda x: F.contains(F.lower(x), query)), F.lit(False))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("span_id", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])))
def _question_spans(questions: pa.Array) -> pa.Array:
    made = [_spans(questions.slice(k, 16)) for k in range(0, max(1, len(questions)), 16)]  # few texts are objects at once
    return pa.concat_arrays(made)


def _spans(questions: pa.Array) -> pa.Array:
    ids, starts, ends, texts, at = [], [], [], [], [0]
    for question in questions.to_pylist():
        for k, m in enumerate(_WORD.finditer(question or "")):
            ids.append(f"q{k}")
            starts.append(m.start())
            ends.append(m.end())
            texts.append(m[0])
        at.append(len(ids))
    spans = pa.StructArray.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], names=["span_id", "start", "end", "text"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)


_WORD = re.compile(r"\S+")


def question_spans(question: Column) -> Column:
    """Words of a question with their places: array of {span_id, start, end, text}, in characters, end exclusive.

    One pass over texts of any length, in Arrow batches, since an expression would copy what it has at each word.
    """
    return _question_spans(question)


def paragraphs(text: Column, most: int = 8) -> Column:
    """The first paragraphs that aren't blank, trimmed; a blank line ends one."""
    return F.slice(F.filter(F.transform(F.split(text, "\n\n"), lambda x: collapse_ends(x)), lambda x: x != ""), 1, most)


def query_words(text: Column) -> Column:
    """Distinct words of letters and digits of any script, in lower case, in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(text: Column) -> Column:
    """The text in Unicode's compatible form with single spaces, by an Arrow-batched function, as Spark has none for it."""
    return collapse(_nfkc(text))
