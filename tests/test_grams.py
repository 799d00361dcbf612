"""Substring search by trigrams held against a look at every text."""

import random

from pyspark.sql import functions as F

from docweir.operators import grams, records


def test_same_rows_as_a_scan(spark):
    dice = random.Random(7)
    texts = ["".join(dice.choice("abcd eÉé%_") for _ in range(dice.randrange(40))) for _ in range(400)] + ["", "a", "É", None, "ab", "ABAB" * 500]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").repartition(3)
    index = grams.build(df, F.col("text"))
    asked = [(q, s) for q, s in enumerate(["a", "É", "ab", "b ", "abc", "%_", "d e", "ABABAB", "zzz", "", "e", "abcd e", "cdcd", "éé", "_%a"])]
    got = {(r.query_id, r.id) for r in grams.search(index, spark.createDataFrame(asked, "query_id int, query string")).collect()}
    assert got == {(q, k) for q, s in asked for k, t in enumerate(texts) if s and s.lower() in (t or "").lower()}
    empty = grams.build(df.limit(0), F.col("text"))
    assert grams.search(empty, spark.createDataFrame(asked, "query_id int, query string")).collect() == []


def test_a_library_search_looks_at_few_rows(spark):
    rows = [(k, f"file{k}.pdf", f"title of {k * 7}", ["water", f"k{k % 50}"]) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, filename string, title string, keywords array<string>")
    index = grams.build(df, F.concat_ws("\x1f", "filename", "title", F.array_join("keywords", " ")))
    for query in ("E2999.P", " k17 ", "er k4", "nothing of it"):
        few = grams.narrowed(index, df, query)
        whole = {(r.id, tuple(r.match_fields)) for r in records.library_search(df, query).collect()}
        assert {(r.id, tuple(r.match_fields)) for r in records.library_search(few, query).collect()} == whole
        assert few.count() <= max(2 * len(whole), 30)
    assert records.library_search(grams.narrowed(index, df, " "), " ").count() == 3000
