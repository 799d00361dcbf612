"""Bookkeeping that no query over the test tables covers."""

from pyspark.sql import functions as F

from docweir.operators import records, search


def test_sources_that_changed(spark):
    sources = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "document string, sha256 string")
    files = spark.createDataFrame([("a", "1"), ("b", "x")], "document string, sha256 string")
    pages = spark.createDataFrame([("a", 1, "one  two"), ("a", 2, "three four"), ("a", 3, "five")], "document string, page int, text string")
    anchors = spark.createDataFrame([("a", 1, 2, "two three"), ("a", 2, 3, "two"), ("a", 3, 4, "five"), ("b", 1, 1, "x")], "document string, page_start int, page_end int, quote string")
    got = {tuple(r) for r in records.source_problems(sources, files, pages, anchors).collect()}
    assert got == {("b", "changed file"), ("c", "missing file"), ("a", "quote not found"), ("a", "page out of range"), ("b", "page out of range")}


def test_newest_first(spark):
    docs = spark.createDataFrame([(1, "s", 5), (2, "t", 9), (3, "s", 7)], "id int, source string, last_seen_at int")
    assert [r.id for r in records.newest_seen(docs).collect()] == [2, 3, 1] and [r.id for r in records.newest_seen(docs, "s").collect()] == [3, 1]


def test_blank_and_odd_searches(spark):
    docs = spark.createDataFrame([(1, "100%", ["a_b"], 2019), (2, "100 x", ["ab"], None)], "id int, title string, keywords array<string>, year int")
    found = lambda q: {r.id: r.match_fields for r in records.library_search(docs, q).collect()}
    assert found("  ") == {1: [], 2: []} and found("100%") == {1: ["title"]} and found("A_B") == {1: ["keywords"]} and found("201") == {1: ["year"]} and found("!") == {}


def test_labels_by_vector(spark):
    leaves = spark.createDataFrame([("Health", [1.0, 0.0]), ("Work", [0.0, 1.0])], "label string, embedding array<double>")
    values = spark.createDataFrame([(1, 0, "x", [0.0, 3.0]), (1, 1, "y", [5.0, 0.1]), (1, 2, "z", [0.1, 9.0]), (2, 0, " health ", None), (3, 0, "none", [-1.0, -1.0])], "owner int, position int, value string, embedding array<double>")
    assert {r.owner: r.labels for r in search.nearest_labels(values, leaves).collect()} == {1: ["Work", "Health"], 2: ["Health"], 3: ["Other"]}
    assert {r.owner: r.labels for r in search.nearest_labels(values, leaves, most=1).collect()}[1] == ["Work"]


def test_results_without_content(spark):
    rows = [(1, 1, "T", "u", " m ", "c", None), (1, 2, "", "v", None, " ", "d"), (1, 3, "T", None, "m", None, None), (1, 4, "T", "w", None, None, " ")]
    raw = spark.createDataFrame(rows, "query_id int, position int, title string, url string, markdown string, content string, description string")
    assert [tuple(r) for r in records.web_results(raw).collect()] == [(1, 1, "T", "u", "m"), (1, 2, "v", "v", "d")]


def test_states_and_limits(spark):
    row = spark.range(1).select(records.answerability(F.lit(None).cast("string"), F.lit(False)), records.answerability(F.lit("partial"), F.lit(True)), records.input_limit(F.lit(8000), F.lit(True), 2, 8), records.input_limit(F.lit(400), F.lit(False), 2, 8)).first()
    assert [*row] == ["unresolved_candidate", "partial", 502, 390]
