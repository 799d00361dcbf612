import random
from itertools import combinations, product

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docweir.operators import chunking, evidence, html, lexical, merge, metric, metrics, search, selection, stemming, structure


def test_fuse_counts_first_ranks(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, id string, rank int")
    got = {r.id: r for r in search.fuse({"a": a, "b": b}).collect()}
    assert got["x"].rrf_score == pytest.approx(1 / 61) and got["y"].rrf_score == pytest.approx(1 / 62 + 1 / 61)
    assert (got["y"].n_sources, got["x"].b_rank) == (2, None)


def test_knn_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric, "PART", 2)
    monkeypatch.setattr(metric, "VISITORS", 2)
    v = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(9)], "id long, embedding array<double>")
    q = v.filter("id < 5").select(F.col("id").alias("query_id"), "embedding")
    rows = search.batch_knn(v, q, 2, exclude_self=True).collect()
    assert len(rows) == 10
    assert {r.id for r in rows if r.query_id == 0} == {3, 6}
    few = v.filter("id < 3")
    assert {r.query_id: r.id for r in search.nearest_of(v.select(F.col("id").alias("query_id"), "embedding"), few).collect()} == {k: k % 3 for k in range(9)}


def test_sync_rules(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    first = spark.createDataFrame([("http://a/x/", 2, "t", "two"), ("http://a/x", 1, "t", "one"), ("http://a/y", 3, None, "y")], "url string, ordinal int, title string, markdown string")
    state = merge.sync(spark.createDataFrame([], merge.STATE), first, now)
    assert {(r.canonical_url, r.change, r.current_version) for r in state.collect()} == {("http://a/x", "added", 1), ("http://a/y", "added", 1)}
    second = spark.createDataFrame([("http://A/x", 1, "t", "changed"), ("http://a/z", 2, "t", "z")], first.schema)
    rows = {r.canonical_url: r for r in merge.sync(state.drop("change"), second, now, mark_missing=True).collect()}
    assert (rows["http://a/x"].change, rows["http://a/x"].current_version) == ("updated", 2)
    assert rows["http://a/y"].status == "MISSING" and rows["http://a/y"].missing_since
    again = merge.sync(merge.sync(state.drop("change"), second, now, mark_missing=True).drop("change"), first, now)
    back = {r.canonical_url: r for r in again.collect()}
    assert back["http://a/y"].status == "ACTIVE" and back["http://a/y"].missing_since is None and back["http://a/z"].change == "kept"


def test_packing_skips_and_backfills():
    blocks = [("a", "d", 50), ("b", "d", 60), ("c", "e", 30), ("a", "d", 1), ("f", "d", 5), ("g", "h", 20)]
    found = selection.pack(blocks, 100, 4, 1, backfill=True)
    assert found == [("a", "packed"), ("b", "over the document's cap"), ("c", "packed"), ("a", "duplicate"), ("f", "packed late"), ("g", "packed")] or dict(found)["f"] != "packed late"
    assert sum(t for c, _, t in blocks[:3] + blocks[4:] if dict(found)[c].startswith("packed")) <= 100
    plain = dict(selection.pack(blocks, 100, 4, 9))
    assert plain["b"] == "over the budget" and plain["c"] == "packed"


def test_backfill_prefers_new_sections(spark):
    rows = [(1, i, p, float(9 - p), u) for p, (i, u) in enumerate(zip("abcdef", "ssstut", strict=True))]
    one = spark.createDataFrame(rows, "query_id int, id string, position int, rrf_score double, unit string")
    got = selection.protected_backfill(one, 4, protected=2).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b", "d", "e"] and [r.reason for r in got][2:] == ["new section"] * 2


def test_backfill_is_the_greedy_choice(spark):
    """Windows choose what taking the best of a new unit again and again does."""
    dice = random.Random(2)
    rows, want = [], []
    for q in range(25):
        own = [(q, f"i{k}", k, dice.choice([1.0, 2.0, 3.0]) + k / 1000, dice.choice(["a", "b", "c", "d", None])) for k in range(dice.randrange(1, 15))]
        rows += own
        kept, rest = own[:3], sorted(own[3:], key=lambda r: (-r[3], r[2]))
        units, chosen = {r[4] for r in kept}, [(r, "protected") for r in kept]
        while len(chosen) < 8 and rest:
            fresh = [r for r in rest if r[4] not in units]
            row = (fresh or rest)[0]
            chosen.append((row, "new section" if fresh else "same section"))
            units.add(row[4])
            rest.remove(row)
        want += [(q, r[1], n + 1, why) for n, (r, why) in enumerate(chosen)]
    rows += rows[:5]
    frame = spark.createDataFrame(rows, "query_id int, id string, position int, rrf_score double, unit string")
    assert sorted(tuple(r) for r in selection.protected_backfill(frame, 8, 3).collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(20))
def test_best_cover_is_best(seed):
    rng = random.Random(seed)
    ids = "abcdef"
    options = {f"r{k}": [frozenset(rng.sample(ids, rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))] for k in range(4)}
    tokens = {i: rng.randrange(1, 9) for i in ids}
    got, covered = evidence.best_cover(options, tokens, 4)
    met = lambda s: sum(any(b <= set(s) for b in bs) for bs in options.values())
    best = max(((met(c), -n) for n in range(5) for c in combinations(ids, n)))
    assert (met(got), -len(got)) == best and len(covered) == best[0]


def test_evidence_sets_of_queries(spark):
    rows = [("q", "r1", "b1", i, 1) for i in "ab"] + [("q", "r1", "b2", i, 1) for i in "ab"] + [("q", "r1", "b3", "c", 9), ("q", "r2", "b1", "a", 1), ("q", "r3", "b1", "z", 2)]
    rows += [("q", "r4", "big", f"x{k}", 1) for k in range(9)] + [("p", "r1", "big", f"x{k}", 1) for k in range(9)]
    got = {r.query_id: r for r in evidence.evidence_sets(spark.createDataFrame(rows, "query_id string, requirement string, bundle string, id string, tokens int"), 4).collect()}
    assert (got["q"].ids, got["q"].covered, got["q"].uncovered, got["q"].dropped) == (["a", "b", "z"], ["r1", "r2", "r3"], ["r4"], False)
    assert (got["p"].ids, got["p"].covered, got["p"].uncovered) == ([], [], ["r1"])


def test_evidence_sets_are_best_and_few(spark):
    """What comes to a query's search is one set for what its requirements share, and covers are those of all bundles."""
    dice, rows, want = random.Random(5), [], {}
    for q in range(12):
        ids = list(range(30))
        cost = {i: dice.randrange(1, 4) for i in ids}
        bundles = {r: [frozenset(dice.sample(ids[8 * k : 8 * k + 10], dice.randrange(1, 4))) for _ in range(5)] for k, r in enumerate("abc")}
        rows += [(q, r, f"b{n}", i, cost[i]) for r, own in bundles.items() for n, b in enumerate(own) for i in b]
        every = [frozenset().union(*(b for b in pick if b)) for pick in product(*([None, *own] for own in bundles.values()))]
        met = lambda s: sum(any(b <= s for b in own) for own in bundles.values())  # noqa: B023, E731
        want[q] = sorted(min((s for s in every if len(s) <= 5), key=lambda s: (-met(s), len(s), sum(cost[i] for i in s), sorted(s))))  # noqa: B023
    rows += [(99, r, str(n), n * 10 + k, 1) for k, r in enumerate("abcde") for n in range(200)]
    frame = spark.createDataFrame(rows, "query_id int, requirement string, bundle string, id long, tokens int")
    got = {r.query_id: r for r in evidence.evidence_sets(frame, 5).collect()}
    assert {q: got[q].ids for q in want} == want
    assert got[99].ids == [0, 1, 2, 3, 4] and not got[99].dropped


def test_dropped_states_are_told(monkeypatch):
    options = {f"r{k}": [frozenset({f"a{k}"}), frozenset({f"b{k}"})] for k in range(5)}
    assert not evidence._cover(options, {}, 8)[2]
    monkeypatch.setattr(evidence, "STATES", 4)
    assert evidence._cover(options, {}, 8)[2]


def test_audits(spark):
    answers = spark.createDataFrame([("a", "see [1] and [4]"), ("b", "none")], "answer_id string, text string")
    cites = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "answer_id string, number int")
    rows = {r.answer_id: (r.n_markers, r.unresolved, r.unused) for r in evidence.audit_citations(answers, cites).collect()}
    assert rows == {"a": (2, [4], [2]), "b": (0, [], [1])}
    units = spark.createDataFrame([("a", 1, 1, "fox"), ("a", 1, 2, "dog"), ("a", 2, 9, "x")], "answer_id string, unit int, number int, quote string")
    sources = spark.createDataFrame([("a", 1, "a fox"), ("a", 2, "a cat")], "answer_id string, number int, text string")
    assert {r.unit: r.supported for r in evidence.supported_units(units, sources).collect()} == {1: False, 2: False}


def test_minimum_cover():
    assert metrics.minimum_cover([0b001, 0b011, 0b010, 0b100], 0b111) == 2
    assert metrics.minimum_cover([], 0) == 0 and metrics.minimum_cover([], 1) == -1


@pytest.mark.parametrize("seed", range(15))
def test_chunks_hold_all_and_fit(seed):
    rng = random.Random(seed)
    paragraphs = [" ".join(f"w{seed}x{k}x{i}{rng.choice(['', '', '.'])}" for i in range(rng.randrange(1, 200))) for k in range(8)]
    chunks = chunking.chunks_of("\n\n".join(paragraphs), 64, rng.choice([0, 10, 30]))
    assert all(n <= 64 and n == chunking.count_words(t) for t, n in chunks)
    held = {w for t, _ in chunks for w in t.split()}
    assert held == {w for p in paragraphs for w in p.split()}


def test_sections(spark):
    body = "intro line\n# One\ntext a\n## Two\ntext b c\n## Three\nx\n# Four\nPart 2 Rules\nArticle 5 Scope of work\n3.1 Details\nyes"
    docs = spark.createDataFrame([(1, body)], "doc_id int, text string")
    found = {r.section: r for r in structure.generation_parents(structure.sections(docs), 9).collect()}
    assert [found[k].path for k in range(4)] == [[], ["# One"], ["# One", "## Two"], ["# One", "## Three"]]
    assert found[6].path == ["Part 2 Rules", "Article 5 Scope of work"] and found[7].path[-1] == "3.1 Details"
    assert found[1].subtree_tokens == 2 + 2 + 2 + 3 + 2 + 1 and not found[1].generation_parent and found[2].generation_parent
    assert found[0].generation_parent


def test_margins_and_references(spark):
    pages = spark.createDataFrame([(1, p, f"Journal  {p}\nbody {p * 7} alpha\nmore{p}\n x{p} y\n z{p} \nend {p}") for p in range(1, 9)], "doc int, page int, text string")
    keys = {r.line_key for r in structure.repeated_margins(pages).collect()}
    assert "journal #" in keys and all("#" in k for k in keys)
    refs = spark.createDataFrame([(1, p, "a\nReferences\nb" if p in (2, 9) else "text") for p in range(1, 11)], "doc int, page int, text string")
    got = {r.page: r.text for r in structure.cut_references(refs).collect()}
    assert got[2] == "a\nReferences\nb" and got[9] == "a" and got[10] == "" and got[8] == "text"


def test_html_to_markdown(spark):
    page = """<html><head><title> A  T </title><style>x</style></head><body><nav>no</nav><main><h2>Head</h2><p>one <b>two</b> <a href="/x?a=1">link</a><br>three
    <span hidden>gone</span></p><ul><li>i</li><li>j</li></ul><ol><li>k</li></ol><table><tr><td>1</td><td>2</td></tr></table><script>z</script></main><footer>no</footer></body></html>"""
    row = html.clean_pages(spark.createDataFrame([(1, "http://h/p/", page), (2, None, None)], "page_id int, url string, html string")).orderBy("page_id").collect()
    assert row[0].title == "A T" and row[0].links == ["http://h/x?a=1"]
    assert row[0].markdown == "## Head\n\none **two** [link](http://h/x?a=1) three\n\n- i\n- j\n\n1. k\n\n| 1 | 2 |\n| --- | --- |"
    assert (row[1].title, row[1].markdown, row[1].links) == (None, "", [])


def test_pages_by_selectors_and_their_assets(spark):
    page = """<body><div class="side">side</div><div id="text"><p><i class="fa fa-home"></i>go <em> far </em><code>x  y</code></p><blockquote>a<br>b</blockquote>
    <pre>one
      two</pre><p>** Added by: someone</p><p>** -</p><a href="/f.PDF?x=1#p"> the <b>file</b></a><a href="n.html" download>N</a><a href="n.html" download>again</a><a href="plain.html">p</a>
    <div class="ad">buy</div><div class="share"><a href="s.pdf">s</a></div></div></body>"""
    df = spark.createDataFrame([(1, "http://h/d/", page)], "page_id int, url string, html string")
    row = html.clean_pages(df, "#text", ".ad, .none").first()
    assert row.markdown == "go *far*`x y`\n\n> a\n> b\n\n```\none\n two\n```\n**Added by:** someone\n\n[the **file**](http://h/f.PDF?x=1#p) [N](http://h/d/n.html) [again](http://h/d/n.html) [p](http://h/d/plain.html)".replace("\n two", "\ntwo")
    assert [tuple(a) for a in row.assets] == [("http://h/f.PDF?x=1#p", "pdf", "the file", "application/pdf"), ("http://h/d/n.html", "attachment", "N", None)]
    assert html.clean_pages(df, "#nothing").first().markdown == "" and "side" in html.clean_pages(df).first().markdown
    assert html.normalise("a \r\n\r b\rc\n ** -\n\n\nd") == "a\n\nb\nc\n\nd"
    deep = "<div>" * 20_000 + "end"
    assert html.clean_page(deep, "")[1] == "end"


WORDS = """caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing failing filing happy sky relational
conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness
callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic
adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll
roll yes by flies dying generalizations oscillators policy policies university universe running runner""".split()


def test_stems_are_those_of_the_full_text_index():
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.execute("insert into t values (?)", (" ".join(WORDS),))
    want = [r[0] for r in db.execute("select term from v order by offset")]
    assert [stemming.stem(w) for w in WORDS] == want


def test_stemmed_scores_are_those_of_the_full_text_index(spark):
    import sqlite3

    rng = random.Random(5)
    texts = {k: " ".join(rng.choices([*WORDS, "Café", "naïve", "Ärger", "résumés", "cafe\u0301"], k=rng.randrange(3, 60))) for k in range(60)}
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", texts.items())
    asked = ["the running policies of universities", "Hopping and happy", "cafés or a naive resume"]
    docs = spark.createDataFrame([*texts.items()], "id long, text string")
    got = stemming.stemmed_bm25(docs, spark.createDataFrame([*enumerate(asked)], "query_id long, text string"))
    found = {(r.query_id, r.id): r.score for r in got.collect()}
    for k, q in enumerate(["running OR policies OR universities", "hopping OR happy", "cafés OR naive OR resume"]):
        want = {i: -s for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (q,))}
        assert {i for a, i in found if a == k} == want.keys()
        assert all(found[k, i] == pytest.approx(s, rel=1e-6) for i, s in want.items())


def test_compatible_forms_and_terms_in_blocks(spark, monkeypatch):
    """Full-width and other compatible forms are the plain words; any number of terms takes as many passes as it needs."""
    docs = spark.createDataFrame([(1, "ﬁne Ｗｏｒｄｓ x²"), (2, "fine"), (3, None), (4, "words words")], "id long, text string")
    terms = spark.createDataFrame([(9, "fine"), (9, "words"), (9, "x2"), (8, "words")], "query_id long, term string")
    whole = {(r.query_id, r.id): r.score for r in search.bm25(docs, terms).collect()}
    assert whole.keys() == {(9, 1), (9, 2), (9, 4), (8, 1), (8, 4)}
    monkeypatch.setattr(lexical, "TERM_BYTES", 1)
    again = {(r.query_id, r.id): r.score for r in search.bm25(docs, terms).collect()}
    assert whole == pytest.approx(again)
    assert {(r.query_id, r.id): r.overlap for r in search.overlap(docs, terms).collect()} == {(9, 1): 3, (9, 2): 1, (9, 4): 1, (8, 1): 1, (8, 4): 1}
    assert lexical.plain("ﬁne Ｗｏｒｄｓ x²") == ["fine", "words", "x2"]
    assert search.bm25(docs.limit(0), terms).collect() == []


def test_aspects_and_merges(spark):
    c = spark.createDataFrame([(1, x, k, 0.1 * k, None) for k, x in enumerate("abcdef")], "query_id int, id string, position int, distance double, score double")
    a = spark.createDataFrame([(1, "p", "f", 0), (1, "p", "e", 1), (1, "p", "d", 2), (1, "q", "e", 0), (1, "q", "c", 1)], "query_id int, aspect string, id string, position int")
    rows = selection.allocate_aspects(c, a, 4, 0.45, 0.0).orderBy("rank").collect()
    assert [(r.id, r.reserved) for r in rows] == [("e", True), ("d", True), ("c", True), ("a", False)]
    calls = spark.createDataFrame([(1, 1, "s", 0.5, ["x", "y"]), (2, 1, "s", 0.9, ["z", "x"])], "call int, query_id int, context_id string, score double, children array<string>")
    assert [tuple(r) for r in selection.merge_parents(calls).collect()] == [(1, "s", 0.9, ["x", "y", "z"])]
    facets = spark.createDataFrame([(1, "f", [["a", "b"], ["c"]]), (1, "g", [["a", "z"]]), (2, "h", [["a"]])], "query_id int, facet string, bundles array<array<string>>")
    packed = spark.createDataFrame([(1, "a"), (1, "c")], "query_id int, id string")
    assert sorted((r.query_id, r.facet) for r in selection.uncovered(facets, packed).collect()) == [(1, "g"), (2, "h")]


def test_crawls(spark):
    from docweir.functions import urls
    from docweir.operators import crawl

    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert sorted((r.url, r.depth) for r in crawl.reachable(seeds, links, 2).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    u = spark.createDataFrame([("http://h/docs/a.pdf",), ("http://h/x",), (None,)], "u string")
    got = [r[0] for r in u.select(urls.matches(F.col("u"), ["/docs/", "*.pdf"], ["secret"])).collect()]
    assert got == [True, False, False]
    chunks = spark.createDataFrame([("o", "p", 0.5, 0), ("o", "q", 0.3, 1), ("o", "r", 0.3, 2)], "owner string, id string, distance double, position int")
    assert [tuple(r) for r in crawl.best_per_owner(chunks).collect()] == [("o", "q", 0.3)]


def test_layout_hints(spark):
    from docweir.operators import crawl

    rows = []
    for page in range(1, 5):
        rows += [(1, page, 0, f"Journal {page}", 8.0, False, 50.0, 1000.0), (1, page, 1, "A Heading", 14.0, True, 100.0, 1000.0), (1, page, 2, "body text " * 9, 10.0, False, 300.0, 1000.0), (1, page, 3, "a note", 8.0, False, 800.0, 1000.0)]
    spans = spark.createDataFrame(rows, "doc int, page int, line int, text string, size double, bold boolean, y double, page_height double")
    got = {r.line: r for r in crawl.layout_hints(spans).filter("page = 2").collect()}
    assert got[1].bold and got[1].large and got[1].heading_level == 1 and not got[2].large and got[2].heading_level == 2
    assert got[0].margin and not got[0].footnote and got[3].footnote and not got[3].margin


def test_quotes_of_any_length(spark, monkeypatch):
    docs = {k: t for k, t in enumerate(["the cat sat on the mat", "a cat. sat", "THE CAT", "ünï the cat sat", "", None, "x" * 500 + "needle" + "y" * 500, "aaaa"])}
    chunks = spark.createDataFrame([(k, "d" if k % 2 == 0 else "e", k, k + 1, t) for k, t in docs.items()], "id long, document string, page_start int, page_end int, text string")
    asked = [(q, d, 0, 9, t) for q, (d, t) in enumerate([("d", "cat"), ("e", "cat"), ("e", "the cat sat"), ("d", "needle"), ("e", "a"), ("e", "aa"), ("d", ""), ("d", None), (None, "cat"), ("d", "the cat sat on the mat")])]
    asked += [(20, "e", 3, 3, "cat"), (21, "e", 50, 60, "cat"), (0, "d", 0, 9, "cat")]
    quotes = spark.createDataFrame(asked, "quote_id long, document string, page_start int, page_end int, quote string")
    want = sorted((q, k) for q, d, a, b, t in asked for k, x in docs.items() if t and x and d == ("d" if k % 2 == 0 else "e") and k <= b and k + 1 >= a and t in x)
    assert sorted((r.quote_id, r.id) for r in metrics.resolve_anchors(quotes, chunks).collect()) == want
    monkeypatch.setattr(metrics, "QUOTE_BYTES", 1)
    assert sorted((r.quote_id, r.id) for r in metrics.resolve_anchors(quotes, chunks).collect()) == want
    assert metrics.resolve_anchors(quotes.limit(0), chunks).collect() == []


def test_covers_of_many_groups(spark):
    import itertools
    import time

    dice = random.Random(6)
    for _ in range(60):
        n = dice.randrange(1, 9)
        masks = [dice.randrange(1, 1 << n) for _ in range(dice.randrange(1, 8))]
        full = (1 << n) - 1
        want = next((k for k in range(1, len(masks) + 1) for c in itertools.combinations(masks, k) if sum({b for m in c for b in [1 << i for i in range(n) if m >> i & 1]}) == full), -1)
        assert metrics.minimum_cover(masks, full) == want
    began = time.time()
    assert metrics.minimum_cover([1 << k for k in range(40)], (1 << 40) - 1) == 40 and time.time() - began < 1
    rows = [(n, g, f"{g // 2}") for n in (63, 64, 70, 200) for g in range(n)] + [(2, g, i) for g in range(70) for i in (("a",) if g < 66 else ("b",))]
    got = {r.query_id: r.n_cover for r in metrics.minimum_covers(spark.createDataFrame(rows, "query_id int, group_id int, id string")).collect()}
    assert got == {63: 32, 64: 32, 70: 35, 200: 100, 2: 2}


def test_language_model_on_held_out_texts(spark):
    from docweir.operators import language

    said = {"en": "the quick brown fox jumps over the lazy dog while the wind is blowing", "de": "der schnelle braune Fuchs springt über den faulen Hund während der Wind weht", "fr": "le renard brun rapide saute par dessus le chien paresseux pendant que le vent souffle", "bg": "бързата кафява лисица прескача мързеливото куче докато вятърът духа"}
    dice = random.Random(1)
    rows = [(k, lang, " ".join(dice.choices(text.split(), k=12))) for k in range(400) for lang, text in said.items()]
    rows += [(9000, None, "nobody knows what language this is"), (9001, "en", None), (9002, "en", "short")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.train(df.filter("doc_id % 4 <> 2").select(F.col("lang").alias("language"), "text"))
    out = language.detect(df, model).collect()
    held = [r for r in out if r.doc_id % 4 == 2 and r.doc_id < 9000]
    assert sum(r.detected == r.lang for r in held) >= 0.99 * len(held)
    odd = {r.doc_id: r.detected for r in out if r.doc_id >= 9000}
    assert odd[9000] == "en" and odd[9001] is None and odd[9002] is None
    assert model.detect("12345 67890 !!! ??? 111 222") is None and model.detect("  " + "a" * 19 + "  ") is None
    empty = language.train(df.limit(0).select(F.col("lang").alias("language"), "text"))
    assert {r.detected for r in language.detect(df, empty).collect()} == {None}


def test_deep_pages_and_folded_anchors(spark):
    from docweir.operators import claims, fields

    deep = "<div>" * 100_000 + "<p>at the bottom</p>" + "</div>" * 100_000
    root = fields.read(deep)
    assert [e.text() for e in fields.select(root, "p")] == ["at the bottom"] and root.text() == "at the bottom"
    assert claims.restored("ABC", "straße ßß abc def") == "abc"
    assert claims.restored("STRASSE", "die Straße hier") == "Straße" and claims.restored("s", "ß") is None
    assert claims.restored("x", "X and x") == "x" and claims.restored("Q", "q q") is None and claims.restored(" ", "a") is None
    assert claims.restored("aa", "A" * 100_000) is None


def test_flat_contexts_take_what_fits(spark):
    from docweir.operators import contexts

    pages = [("q", 1, "f", 1, "a" * 30), ("q", 2, "f", None, "b" * 500), ("q", 3, "f", 3, ""), ("q", 4, "f", 4, "d" * 20), ("q", 4, "f", 4, "d" * 20), ("r", 1, "f", 1, None), (None, 1, "g", 1, "null's")]
    got = {r.query_id: r for r in contexts.flat_context(spark.createDataFrame(pages, "query_id string, position int, file string, page int, text string"), 150).collect()}
    assert got["q"].context == contexts.BREAK.join(["[1] f, page 1\n" + "a" * 30, "[4] f, page 4\n" + "d" * 20]) and got["q"].truncated
    assert got["r"].context == "" and not got["r"].truncated and got[None].context == "[1] g, page 1\nnull's"
