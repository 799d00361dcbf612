import re

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docweir import plans
from docweir.functions import text, urls, vectors


def one(spark, column, **values):
    kinds = {str: "string", int: "long", list: "array<double>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_vector_literals_round_as_c_does(spark):
    """Halfway values go to even, and those a little under or over halfway to their side."""
    dice = random.Random(3)
    values = [k / 512 for k in range(-700, 700)] + [k * 1e-8 + 5e-9 for k in range(200)] + [-1.5e-8, 0.0, 2.5e-9, 40_000_000.001953125]
    values += [dice.uniform(-2, 2) for _ in range(300)] + [dice.uniform(-1e4, 1e4) for _ in range(300)]
    assert one(spark, text.vector_literal(F.col("v")), v=values) == "[" + ",".join(f"{v:.8f}" for v in values) + "]"


def test_vectors_are_written_whole(spark, tmp_path):
    """Every component is in the text, whatever stands before it, and odd ones are written as the SQL writes them."""
    odd = [None, [], [None], [0.5, None, None, 0.25, -1e-9], [1.0, 2.0, 3.0, float("nan"), float("inf"), -float("inf"), 4.0], [0.0, -0.0]]
    rows = list(enumerate([[k / 512 for k in range(-32, 32)], *odd]))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = plans.all_queries()["vector_texts"](spark, str(tmp_path)).orderBy("vec_id").collect()
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.sql(f"select vec_id, literal from ({plans.ORACLE_SQL['vector_texts']}) order by 1").fetchall()
    assert got[0].literal == "[" + ",".join(f"{v:.8f}" for v in rows[0][1]) + "]"


@pytest.mark.parametrize("raw", ["  A b\n\tC ", "", "x" * 600, "é É"])
def test_normalised_hash_and_preview(spark, raw):
    flat = " ".join(raw.split())
    assert one(spark, text.normalized_hash(F.col("t")), t=raw) == hashlib.sha256(flat.lower().encode()).hexdigest()
    want = flat if len(flat) <= 500 else flat[:497].rstrip() + "..."
    assert one(spark, text.preview(F.col("t")), t=raw) == want


@pytest.mark.parametrize("title,content", [("T", 'a "q" \\ /   é'), (None, "x"), ("", None)])
def test_content_hash(spark, title, content):
    body = json.dumps({"content": content or "", "title": title or ""}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert one(spark, text.content_hash(F.col("a"), F.col("b")), a=title, b=content) == hashlib.sha256(body.encode()).hexdigest()


def test_lists_and_patterns(spark):
    assert one(spark, text.string_list(F.col("t")), t="a; b;;c, d") == ["a", "b", "c, d"]
    assert one(spark, text.string_list(F.col("t")), t="a, b\n c;d ") == ["a, b", "c;d"]
    assert one(spark, text.like_pattern(F.col("t")), t="50%_!") == "%50!%!_!!%"
    assert one(spark, text.citation_numbers(F.col("t")), t="x [1], [12][3] [a]") == [1, 12, 3]
    assert one(spark, text.sentences(F.col("t")), t="A b. C!\n\nd") == ["A b.", "C!", "d"]
    assert one(spark, text.loose_key(F.col("t")), t="What's 2+2, 中文?") == "whats22中文"
    assert one(spark, text.mask_secret(F.col("t")), t="sk-1234567890") == "sk-1...7890"
    assert one(spark, text.json_object(F.col("t")), t='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert one(spark, text.json_object(F.col("t")), t="none") is None
    for t, want in [("la politica digital", "Spanish"), ("une stratégie", "French"), ("abc Щ", "Bulgarian"), ("the cat", "English"), (" \n", None)]:
        assert one(spark, text.guess_language(F.col("t")), t=t) == want
    assert one(spark, text.slug(F.col("t"), F.lit("u")), t="Ünder the Hill!") == "nder-the-hill"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTP://Ex.COM/a/b/?b=2&a=1#top", "http://ex.com/a/b?a=1&b=2"),
        ("https://ex.com", "https://ex.com/"),
        ("https://ex.com///?", "https://ex.com/"),
        ("https://ex.com/A?x", "https://ex.com/A?x="),
        ("http://ex.com/a;p=1?q=%7Eb*%20c&q=", "http://ex.com/a?q=&q=~b%2A+c"),
    ],
)
def test_canonical_urls(spark, raw, want):
    assert one(spark, urls.canonical(F.col("t")), t=raw) == want


def test_url_rules(spark):
    fits = lambda u: one(spark, urls.allowed(F.col("t"), ["ex.com"]), t=u)
    assert fits("https://ex.com/a") and fits("http://www.EX.com:80") and not fits("https://notex.com") and not fits("ftp://ex.com") and not fits(None)
    assert one(spark, urls.mime_type(F.col("t")), t="a/b.PDF") == "application/pdf"
    assert one(spark, urls.page_numbers(F.col("n"), 20), n=45) == [2, 3]
    assert one(spark, urls.page_numbers(F.col("n"), 20), n=20) == []


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.distance(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 1
    assert not one(spark, vectors.valid(F.col("a"), 2), a=[1.0, float("nan")])


def test_model_replies(spark):
    got = lambda t: one(spark, text.suggestions(F.col("t")), t=t)
    assert got('```json\n["a", " b ", "", 3]\n```') == ["a", "b", "3"]
    assert got('Sure: ["a?", "b\\"c"] ok') == ["a?", 'b"c']
    assert got('["whole", "two", "cut o') == ["whole", "two"]
    assert got("nothing") == []
    assert one(spark, text.json_object(F.col("t")), t='Reply {"a": 1} end') == '{"a": 1}' and one(spark, text.json_object(F.col("t")), t="[1]") == "{}"
    assert one(spark, text.clean_list(F.col("t")), t='[" a ", "", 2]') == ["a", "2"] and one(spark, text.clean_list(F.col("t")), t="no") == []
    assert one(spark, text.clean_date(F.col("t")), t=" 2020-02-29 ") == "2020-02-29" and one(spark, text.clean_date(F.col("t")), t="2021-02-29") is None
    assert one(spark, text.header(F.col("t")), t='  "A  short\nheader" ') == "A short header"
    assert one(spark, text.cut_question(F.col("t"), 6), t=" abcde fgh ") == "abcde"


def test_spans_of_questions(spark):
    for q in ("What  is it?", " a\tb ", "", "one", "é\u3000ü x"):
        want = [(f"q{i}", m.start(), m.end(), m[0]) for i, m in enumerate(re.finditer(r"\S+", q))]
        assert [tuple(x) for x in one(spark, text.question_spans(F.col("t")), t=q)] == want


def test_nested_containment(spark):
    holds = lambda j, q: one(spark, text.holds(F.col("t"), F.lit(q)), t=j)
    nested = '{"Key": [1.50, {"inner": "A \\"Word\\""}, true, null]}'
    assert holds(nested, "key") and holds(nested, 'a "word"') and holds(nested, "1.5") and holds(nested, "true")
    assert not holds(nested, "null") and not holds(nested, '":') and not holds(None, "x")


def test_display_names(spark):
    assert one(spark, text.humanized(F.col("t")), t=" chat_model-x ") == "Chat Model X"
    show = lambda t: one(spark, text.english_display(F.col("t"), F.lit("Endpoint"), {"\u6a21\u578b": "Model"}), t=t)
    assert [show(t) for t in ("plain", "\u6a21\u578b", "\u5411\u91cf", "\u6a21\u578b v2", None)] == ["plain", "Model", "Endpoint", "\u6a21\u578b v2", None]


def test_result_pages(spark):
    pages = lambda u, n: one(spark, urls.numbered_pages(F.col("t"), F.lit(n)), t=u)
    assert pages("http://x/l?page=4&q=a#f", 2) == ["http://x/l?q=a&page=1", "http://x/l?q=a&page=2"] and pages("http://x/l", 1) == ["http://x/l?page=1"]
    assert one(spark, urls.template_pages("http://x/{page}/", F.lit(4), 3), t="") == ["http://x/3/", "http://x/4/"]
    total = lambda t: one(spark, urls.stated_total(F.col("t")), t=t)
    assert total("Found 1,234 items of 9") == 1234 and total("none") is None
    assert one(spark, urls.next_page(F.lit(2), F.lit(41)), t="") == 3 and one(spark, urls.next_page(F.lit(3), F.lit(41)), t="") is None
    assert one(spark, urls.last_page(F.lit(101), 50), t="") == 3


def test_compatible_forms(spark):
    assert one(spark, text.compatible(F.col("t")), t=" \ufb01ne\u00a0 \u2460 \uff21 ") == "fine 1 A" and one(spark, text.compatible(F.col("t")), t=None) is None
