"""Contexts, claims, fields and structure against plain ways to the same results."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docweir import plans
from docweir.operators import chunking, claims, contexts, fields, structure

PAGE = """<html><body><main id="top"><h1 class="big head"> Plan  for
 AI</h1><dl><dt>Country:</dt><dd>Chile</dd><dt>Start year</dt><dd>since 2,019</dd></dl>
<ul class="tags"><li><a href="/t/a">Alpha</a><li><a href="/t/b">Beta</a><li><a href="/t/a">Alpha</a></ul><p>short</p>
<p>This paragraph of the page is long enough to stand as its summary, as it was begun in 2017 and again in 2021.</p>
<div><p><b>deep</b></p></div><a href="/list/one#x">1</a><a href="/list/two">2</a><a href="/list?page=2">next</a><a href="http://other.net/list/x">no</a></main></body></html>"""


def test_page_titles_with_references_as_sql_reads_them(spark, tmp_path):
    """Of the references in a title the SQL reads &amp; alone; others, and those that are cut off, stand as written."""
    titles = ["a &amp;&amp;&amp", "b &quot;x&quot;", "c &a", "d &amp;quot; &lt;i&gt;", "e & f &#38;", "plain &am"]
    rows = [(k, "http://example.com/", f'<html lang="en"><head><title> {t} </title></head><body><p>x</p></body></html>') for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = plans.all_queries()["page_values"](spark, str(tmp_path)).orderBy("page_id").collect()
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"select page_id, title, lang, has_text from ({plans.ORACLE_SQL['page_values']}) order by 1").fetchall()
    assert [(r.page_id, r.title, r.lang, r.has_text) for r in got] == want and want[0][1] == "a &&&amp"


def test_selectors():
    root = fields.read(PAGE)
    texts = lambda s: [" ".join(e.text().split()) for e in fields.select(root, s)]
    assert texts("h1") == texts("#top > .big.head") == texts("main h1[class~=head]") == ["Plan for AI"]
    assert texts("ul.tags a") == ["Alpha", "Beta", "Alpha"] and texts("div > b") == [] and texts("div b") == ["deep"]
    assert texts("dd, h1") == ["Plan for AI", "Chile", "since 2,019"]
    assert len(fields.select(root, 'a[href^="/t/"]')) == 3 and len(fields.select(root, "a[href$=two]")) == 1 and len(fields.select(root, "a[href*=page]")) == 1


def test_rules_and_links(spark):
    rules = {
        "title": "h1", "country": {"selector": "dd", "transform": "upper"}, "start_year": {"selector": "dd", "regex": r"since ([\d,]+)", "transform": "year"}, "other": "h1",
        "summary": {"selector": "p.none", "default": "nothing"},
        "metadata": {"tags": {"selector": "ul a", "multiple": True}, "links": {"selector": "ul a", "attribute": "href", "multiple": True}, "empty": ".none"},
    }
    pages = spark.createDataFrame([(1, "http://h.org/list", PAGE), (2, None, None)], "page_id int, url string, html string")
    one, two = sorted(fields.extract_fields(pages, rules).collect())
    assert one.fields == {"title": '"Plan for AI"', "country": '"CHILE"', "start_year": "2019", "summary": '"nothing"'}
    assert one.metadata == {"tags": '["Alpha", "Beta"]', "links": '["http://h.org/t/a", "http://h.org/t/b"]'}
    assert two.fields == {"summary": '"nothing"'} and two.metadata == {}
    links = {r.page_id: r for r in fields.page_links(pages, "http://h.org/list/", ["h.org"]).collect()}
    assert links[1].details == ["http://h.org/list/one", "http://h.org/list/two"] and links[1].pagination == ["http://h.org/list?page=2"]
    found = {r.page_id: r for r in fields.labelled_values(pages).collect()}
    assert found[1]["values"] == {"country": "Chile", "start year": "since 2,019"} and found[1].year == 2017 and found[2].summary is None


def test_packing_by_hand():
    block = lambda i, text="", chunk="proof", doc="d": contexts.Block(i, doc, f"{doc}.pdf", "T", text, 1.0, [(f"c{i}", 1, 2, chunk)])
    count = lambda t: len(t.split())
    blocks = [block("a", "wide proof text"), block("b", "x " * 500), block("a"), block("c", "", "long " * 300), block("d", doc="e")]
    size = count(contexts.BREAK.join(b.render({f"c{i}": 1 for i in "abcd"}) for b in [block("a"), block("b"), block("d", doc="e")]))
    context, reasons, numbers, expanded = contexts.build_context(blocks, size + 20, count)
    assert reasons == [("a", "packed"), ("b", "packed"), ("a", "duplicate"), ("c", "over the budget"), ("d", "packed")]
    assert numbers == {"ca": 1, "cb": 2, "cd": 3} and expanded == {"a"} and count(context) <= size + 20
    assert "wide \n[Supporting Child text shown below.]\n text" in context and context.count(contexts.NO_EXPANSION) == 2
    _, reasons, numbers, _ = contexts.build_context([block(i) for i in "abcd"], 10_000, count, most=3, per_document=1, backfill=True, known={"x": 4})
    assert [r for _, r in reasons] == ["packed", *["over the document's cap"] * 3, "packed late", "packed late", "over the cap"] and numbers == {"x": 4, "ca": 5, "cb": 6, "cc": 7}


def test_packed_questions(spark):
    parents = spark.createDataFrame([(1, "p", "d", "f", "t", "whole text", 0.5, 1), (1, "q", "d", "f", None, None, 0.9, 2), (2, "p", "d", "f", "t", "", 0.1, 1)], "query_id int, context_id string, document_id string, file string, section_title string, text string, score double, position int")
    kids = spark.createDataFrame([(1, "p", 7, 1, None, "seven", 2), (1, "p", 6, 1, 2, "six", 1), (1, "q", 5, None, None, "five", 1)], "query_id int, context_id string, id int, page_start int, page_end int, text string, position int")
    got = {r.query_id: r for r in contexts.pack_evidence(kids, parents).collect()}
    assert got[1].context_ids == ["q", "p"] and got[1].chunk_ids == ["5", "6", "7"] and got[1].numbers == [1, 2, 3] and got[1].expanded == ["p"] and not got[1].truncated
    assert got[2].chunk_ids == [] and got[2].context_ids == ["p"]


@pytest.mark.parametrize("budget", [0, 40, 75, 10_000])
def test_flat_contexts(spark, budget):
    rows = [(1, 1, "f", 3, "short"), (1, 2, "f", None, "long " * 12), (1, 3, "f", 4, None), (1, 4, "f", 5, "é end"), (2, 1, "g", 1, "")]
    held, cut = [], False
    for _, k, f, p, t in rows[:4]:
        if t:
            made = f"[{k}] {f}, page {p or '?'}\n{t}"
            if len(contexts.BREAK.join([*held, made]).encode()) > budget:
                cut = True
            else:
                held.append(made)
    got = {r.query_id: r for r in contexts.flat_context(spark.createDataFrame(rows, "query_id int, position int, file string, page int, text string"), budget).collect()}
    assert (got[1].context, got[1].truncated) == (contexts.BREAK.join(held), cut) and (got[2].context, got[2].truncated) == ("", False)


def test_budgets(spark):
    row = spark.range(1).select(contexts.context_budget(), contexts.context_budget(F.lit(30_000)), contexts.context_budget(F.lit(27_000)), contexts.candidate_limit(5, 12), contexts.candidate_limit(F.lit(9), 40)).first()
    assert [*row] == [6000, 208, 3208, 20, 40]


UNITS = [("u1", "# Head"), ("u2", "Fact [1]."), ("u3", "**Label:**"), ("u4", "Other [2][1]"), ("u5", "Nothing is said of it."), ("u6", "Loose prose.")]
SOURCES = {1: "the first source says so", 2: "the second"}


def test_reviewed_answers():
    review = {"u1": ("non_factual", []), "u2": ("supported", [(1, "first source")]), "u3": ("non_factual", []), "u4": ("supported", [(2, "second"), (2, "the")]), "u5": ("gap", []), "u6": ("non_factual", [])}
    got = claims.review_answer(UNITS, review, SOURCES)
    assert got["answer"] == "# Head\n\nFact [1].\n\n**Label:**\n\nOther [2]\n\nNothing is said of it." and got["removed"] == ["u6"] and got["rebound"] == ["u4"] and got["error"] is None
    bad = review | {"u2": ("supported", [(1, "not there")]), "u4": ("supported", []), "u5": ("unsupported", [])}
    got = claims.review_answer(UNITS, bad, SOURCES)
    assert got["error"] and got["answer"] is None and got["faults"] == {"u2": "quote is not in its source", "u4": "no binding"}
    assert claims.review_answer(UNITS, {"u1": ("gap", [])}, SOURCES)["error"] and claims.review_answer(UNITS[:1], {"u1": ("odd", [])}, SOURCES)["error"] == "unknown state"
    assert claims.unit_fault("gap", "see [1]", [], SOURCES) and claims.unit_fault("supported", "x", [(3, "x")], SOURCES) == "invalid binding"


def test_reviews_of_many_answers(spark):
    units = spark.createDataFrame([(a, k, u, t) for a in (1, 2, 3) for k, (u, t) in enumerate(UNITS[:2])], "answer_id int, position int, unit string, text string")
    ok = [(1, "u1", "non_factual", []), (1, "u2", "supported", [(1, "so")]), (2, "u1", "non_factual", []), (2, "u1", "gap", []), (2, "u2", "gap", []), (3, "u2", "supported", [(1, "so")]), (3, "u1", "non_factual", []), (3, "u9", "gap", [])]
    reviews = spark.createDataFrame(ok, "answer_id int, unit string, state string, bindings array<struct<number:int,quote:string>>")
    sources = spark.createDataFrame([(a, 1, "it is so") for a in (1, 2, 3)], "answer_id int, number int, quote string")
    got = {r.answer_id: r for r in claims.apply_reviews(units, reviews, sources).collect()}
    assert got[1].answer == "# Head\n\nFact [1]." and got[1].error is None
    assert got[2].answer is None and got[2].error and got[3].error


def test_restored_anchors():
    assert claims.restored("Plan", "The Plan of plan") == "Plan" and claims.restored("the plan", "The Plan of it") == "The Plan"
    assert claims.restored("PLAN", "plan and Plan") is None and claims.restored(" ", "x y") is None


def brute_tree(levels, numbered, marked):
    """Levels and parents by following a stack of sections, a heading at a time."""
    stack, out = [], []
    for k, level in enumerate(levels):
        if level == 0:
            out.append((0, -1))
            continue
        if not numbered[k] and not marked[k]:
            above = [own for own, j in stack if numbered[j]]
            level = max(level, above[-1] + 1) if above else level
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append((level, stack[-1][1] if stack else -1))
        stack.append((level, k))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_trees(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 40)
    levels = [0 if rng.random() < 0.5 else 1, *(rng.randrange(1, 7) for _ in range(n - 1))]
    numbered, marked = [x > 0 and rng.random() < 0.5 for x in levels], [rng.random() < 0.3 for _ in levels]
    tokens = [rng.randrange(1, 9) for _ in levels]
    own, parents, sizes = structure.tree_of(levels, numbered, marked, tokens)
    assert [*zip(own, parents, strict=True)] == brute_tree(levels, numbered, marked)
    for k in range(n):
        below = {k}
        for j in range(k + 1, n):
            if parents[j] in below:
                below.add(j)
        assert sizes[k] == sum(tokens[j] for j in below)


LAYOUT = {"bold": True, "large": False, "block_heading": True, "margin": False, "footnote": False}


@pytest.mark.parametrize(("text", "layout", "isolated", "want"), [
    ("## Scope", {}, False, (2, None)), ("Part II Rules", {}, False, (1, "II")), ("Article 5 must apply", {}, False, None), ("2.1 Scope of work", {}, False, (4, "2.1")),
    ("1. Item", {}, False, None), ("1. Item", LAYOUT, False, (3, "1")), ("3 Scope", {"font_size": 9.0}, False, None), ("2 Members may vote", {}, False, None), ("Ends here.", LAYOUT, True, None),
    ("Plain bold words", LAYOUT | {"heading_level": 5}, False, (5, None)), ("Plain bold words", LAYOUT | {"footnote": True}, False, None), ("ALL CAPS LINE", {}, True, (4, None)),
    ("ALL CAPS LINE", {}, False, None), ("Contents ...... 12", LAYOUT, False, None), ("x " * 80, {}, True, None), ("Annex B", {}, False, (1, "B")), ("see https://a.org", LAYOUT, False, None),
])
def test_headings(spark, text, layout, isolated, want):
    names = [x.split(":")[0] for x in structure.LAYOUT.removeprefix("struct<").removesuffix(">").split(",")]
    df = spark.createDataFrame([(text.strip(), isolated, tuple(layout.get(n) for n in names))], f"text string, isolated boolean, layout {structure.LAYOUT}")
    got = df.select(structure.heading(F.col("text"), F.col("isolated"), F.col("layout")).alias("h")).first().h
    assert (got and tuple(got)) == want


def test_lines_of_one_heading(spark):
    names = [x.split(":")[0] for x in structure.LAYOUT.removeprefix("struct<").removesuffix(">").split(",")]
    style = lambda k, **more: tuple((LAYOUT | {"block_id": 1, "line_index": k, "font_size": 14.0} | more).get(n) for n in names)
    body = "The long title\nof a  chapter\nthat goes on\nArticle 3 Next\nplain text\nfar line"
    layout = {"The long title": style(0), "of a chapter": style(1), "that goes on": style(2), "Article 3 Next": style(3), "far line": style(9)}
    docs = spark.createDataFrame([(1, body, layout)], f"doc_id int, text string, layout map<string,{structure.LAYOUT}>")
    rows = sorted((r.line, r.text) for r in structure.logical_lines(structure.lines(docs)).collect())
    assert rows == [(0, "The long title of a  chapter that goes on"), (3, "Article 3 Next"), (4, "plain text"), (5, "far line")]


def test_parents_and_children(spark):
    long_ = " ".join(f"word{k}." for k in range(900))
    body = f"before all\n# One\nintro words\n## Two\n{' '.join(f'two{k}' for k in range(200))}\n## Three\nthree\n# Four\n{long_}\n## Five\nlast"
    docs = spark.createDataFrame([(1, "Title", body), (2, None, None), (3, "T", "")], "doc_id int, title string, text string")
    rows = structure.parent_children(docs, 300, 80, 10, 6).collect()
    assert {r.doc_id for r in rows} == {1}
    kinds = {(r.section, r.kind, tuple(r.path)) for r in rows}
    assert (0, "section", ("Document introduction",)) in kinds and (1, "section", ("# One",)) in kinds and (5, "section", ("# Four", "## Five")) in kinds
    assert (4, "passage", ("# Four", "Passage 1")) in kinds and not any(r.section in (2, 3) for r in rows)
    assert all(chunking.count_words(r.child_text) <= 80 and chunking.count_words(r.prefix) <= 6 for r in rows)
    assert any(tuple(r.child_path) == ("# One", "## Two") for r in rows if r.section == 1)
    assert len({r.parent_id for r in rows}) == len({(r.section, *r.path) for r in rows})
    again = structure.parent_children(docs, 300, 80, 10, 6).collect()
    assert {r.parent_id for r in again} == {r.parent_id for r in rows}
    words = lambda t: {w for w in t.split()}
    assert words(body) <= {w for r in rows for w in words(r.child_text)}
    with pytest.raises(ValueError):
        structure.child_budget(100, 100, 120, 64)
    assert structure.child_budget(400, 300, 512, 64, 60) == 300


def test_long_unbroken_texts():
    text = "x" * 200_000
    made = chunking.chunks_of(text, 64, 10, lambda t: -(-len(t) // 10))
    assert "".join(t for t, _ in chunking.chunks_of(text, 64, 0, lambda t: -(-len(t) // 10))).count("x") == 200_000
    assert all(n <= 66 for _, n in made)
