"""The stored index held against scores of all documents."""

import random

import pytest
from pyspark.sql import functions as F

from docweir.operators import lexical, postings, search


def corpus(spark, n=3000, seed=3):
    dice = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    texts = [(k, " ".join(dice.choices(words, weights, k=dice.randrange(2, 80)))) for k in range(n)] + [(n, None), (n + 1, "")]
    return spark.createDataFrame(texts, "id long, text string").repartition(3), dice, words


def ranked(docs, terms, k):
    scored = search.bm25(docs, terms).withColumn("score", F.round("score", 6))
    return search.top_k(scored, ["query_id"], [F.desc("score"), "id"], k)


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize("block", [4, 128])
def test_same_rows_with_fewer_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    docs, dice, words = corpus(spark)
    asked = [(q, w) for q in range(12) for w in {*dice.sample(words[:12], 4), *dice.sample(words[100:800], 2)}]
    asked += [(50, "w0"), (51, "nowhere"), (52, "w2999"), (53, "w0"), (53, "w1"), (53, "w0")]
    terms = spark.createDataFrame(asked, "query_id long, term string").distinct()
    index = postings.build(docs)
    for k in (1, 7):
        assert rows(postings.search(index, terms, k)) == rows(ranked(docs, terms, k))
    if block == 4:
        read = postings.wanted_blocks(index, postings.asked_of(index, terms), 7)[0].count()
        held = index.blocks.join(terms, "term").count()
        assert read < 0.5 * held
        sizes = [len(r.ids) for r in index.blocks.collect()]
        assert max(sizes) <= 4 and sum(sizes) == lexical.term_counts(docs, index.terms.select("term")).filter("term is not null").count()


def shuffled(spark):
    """Records that all stages so far have shuffled."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_postings_are_brought_together_before_they_are_shuffled(spark):
    docs, _, _ = corpus(spark)
    docs = spark.createDataFrame(docs.collect(), "id long, text string").coalesce(3)
    before = shuffled(spark)
    index = postings.build(docs)
    assert shuffled(spark) - before < 0.4 * index.terms.agg(F.sum("df")).first()[0]


@pytest.mark.parametrize("named", ["long", "string"])
@pytest.mark.parametrize("analyse", [lexical.plain, lexical.folded])
def test_common_terms_are_dealt_by_steps(spark, monkeypatch, named, analyse):
    """Chunks, steps and groups, however small, keep every posting once and give the same rows; so do small blocks of queries and pairs."""
    for name, n in (("BLOCK", 8), ("CHUNK", 900), ("COMMON", 5), ("SPREAD", 1), ("TERM_BYTES", 400), ("PAIRS", 50)):
        monkeypatch.setattr(postings, name, n)
    docs, dice, words = corpus(spark, 600, 5)
    docs = docs.withColumn("id", F.col("id").cast(named)).withColumn("text", F.when(F.rand(1) < 0.3, F.concat("text", F.lit(" \u00e9t\u00e9 W1"))).otherwise(F.col("text")))
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(3)
    terms = spark.createDataFrame([(q, w) for q in range(9) for w in {*dice.sample(words[:12], 4), *dice.sample(words[100:800], 2)}], "query_id long, term string")
    index = postings.build(docs, analyse)
    counts = lexical.term_counts(docs, index.terms.select("term"), analyse)
    held = sorted((r.term, r.id, r.tf, r.length) for r in counts.filter("term is not null").collect())
    blocks = index.blocks.collect()
    mean = counts.filter("term is null").agg(F.avg("length")).first()[0]
    found = []
    for r in blocks:
        own = [(int.from_bytes(r.weights[k : k + 4], "little"), int.from_bytes(r.weights[k + 4 : k + 8], "little")) for k in range(0, len(r.weights), 8)]
        impacts = [tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) for tf, length in own]
        assert impacts == sorted(impacts, reverse=True) and abs(impacts[0] - r.top) < 1e-12 and 0 < len(r.ids) <= 8
        found += [(r.term, k, *w) for k, w in zip(r.ids, own, strict=True)]
    assert sorted(found) == held
    scored = lexical.bm25(lexical.term_counts(docs, terms, analyse), terms).withColumn("score", F.round("score", 6))
    assert rows(postings.search(index, terms, 7)) == rows(search.top_k(scored, ["query_id"], [F.desc("score"), "id"], 7))


def test_words_of_many_texts_at_once():
    import pyarrow as pa

    dice = random.Random(1)
    signs = ["a", "Z", "9", " ", "\u00e9", "\ufb01", "\u212a", "\u0130", "\uff21", "\x00", "\u00df", "_", "-", "\n", "\U0001d400"]
    for _ in range(500):
        texts = [None if dice.random() < 0.1 else "".join(dice.choices(signs[: dice.choice([4, 15])], k=dice.randrange(6))) for _ in range(dice.randrange(7))]
        words, row = lexical.split(pa.array(["x", *texts, "y"], pa.string()).slice(1, len(texts)), lexical.plain)
        assert list(zip(words.to_pylist(), row.tolist(), strict=True)) == [(w, k) for k, text in enumerate(texts) for w in lexical.plain(text or "")]


def test_empty_index_and_queries(spark):
    docs, _, _ = corpus(spark, 20)
    none = spark.createDataFrame([], "query_id long, term string")
    assert postings.search(postings.build(docs), none, 3).collect() == []
    assert postings.search(postings.build(docs.limit(0)), spark.createDataFrame([(1, "w0")], "query_id long, term string"), 3).collect() == []


def test_workers_hold_few_texts_at_once(spark, monkeypatch):
    """Batches are bounded by bytes and read in slices, however many rows a task has; results stay."""
    import pyarrow as pa

    from docweir.functions.text import question_spans
    from docweir.operators import chunking, grams, metrics, structure, tables

    spark.conf.unset(tables.BYTES)
    docs = spark.range(900).repartition(1).select("id", F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 1000).alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    most = lambda df: max(r.n for r in df.mapInArrow(size, "n long").collect())
    assert most(docs) > 2 * tables.BATCH_BYTES and most(tables.batched(docs)) < 1.1 * tables.BATCH_BYTES
    held = pa.RecordBatch.from_arrays([pa.array(["x" * 10_000] * 900)], names=["text"])
    pieces = list(tables.slices([held, held.slice(0, 0)]))
    assert sum(b.num_rows for b in pieces) == 900 and max(b.num_rows for b in pieces) <= 50
    named = docs.select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), "text")
    for use in (lambda: chunking.chunk(named), lambda: structure.parent_children(named), lambda: structure.sections(named), lambda: lexical.term_counts(docs, spark.createDataFrame([("word",)], "term string")), lambda: grams.build(docs.limit(5), F.col("text")), lambda: metrics.minimum_covers(spark.createDataFrame([(1, 1, 1)], "query_id int, group_id int, id int"))):
        spark.conf.unset(tables.BYTES)
        use()
        assert int(spark.conf.get(tables.BYTES)) == tables.BATCH_BYTES
    spans = spark.createDataFrame([("a  b c",), (None,), ("",)] * 20, "t string").select(F.size(question_spans(F.col("t"))).alias("n"))
    assert [r.n for r in spans.collect()] == [3, 0, 0] * 20


@pytest.mark.parametrize("named", ["long", "string"])
def test_ranked_holds_k_rows_of_a_query(spark, monkeypatch, named):
    """Rankings equal those of scoring every pair, whatever the blocks, and no pairs of queries and rows are written."""
    docs, dice, words = corpus(spark, 1500, 4)
    docs = docs.withColumn("id", F.col("id").cast(named))
    asked = [(q, w) for q in range(15) for w in {*dice.sample(words[:12], 4), *dice.sample(words[100:800], 2)}] + [(50, "nowhere"), (51, "w2999")]
    terms = spark.createDataFrame(asked, "query_id long, term string")
    counts = lexical.term_counts(docs, terms)
    scored = {"bm25": lexical.bm25(counts, terms).withColumn("score", F.round("score", 6)), "overlap": lexical.overlap(counts, terms).withColumnRenamed("overlap", "score")}
    wanted = {name: rows(search.top_k(df, ["query_id"], [F.desc("score"), "id"], 7)) for name, df in scored.items()}
    measures = {"bm25": lexical.bm25_rate, "overlap": None}
    sizes = []
    monkeypatch.setattr(lexical, "written", lambda df, to=lexical.written: (out := to(df), sizes.append(out.count()))[0])
    assert {name: rows(df) for name, df in lexical.ranked(docs, terms, 7, measures).items()} == wanted
    assert len(sizes) == 2 and sizes[0] == docs.count() and sizes[1] <= 3 * 2 * 7 * 17
    monkeypatch.setattr(lexical, "TERM_BYTES", 1500)
    assert {name: rows(df) for name, df in lexical.ranked(docs, terms, 7, measures).items()} == wanted
    assert [df.collect() for df in lexical.ranked(docs, terms.limit(0), 7, measures).values()] == [[], []]
    assert lexical.ranked(docs.limit(0), terms, 7, measures)["bm25"].collect() == []


def test_pairs_are_weighed_some_rows_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    dice = random.Random(1)
    held = [sorted(dice.sample(range(9), dice.randrange(6))) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([9] * 40), pa.array(held, pa.list_(pa.int32())), pa.array([[1] * len(h) for h in held], pa.list_(pa.int32()))], names=["id", "length", "held", "tfs"])
    starts, asked_by = np.arange(10) * 3, np.array([q for _ in range(9) for q in (0, 1, 2)])
    for size in (1, 7, 10_000):
        monkeypatch.setattr(lexical, "PAIRS", size)
        parts = list(lexical._weighed(batch.slice(3), starts, asked_by, {}, 9.0, 1.2, 0.75))
        assert sorted((k, q, n) for _, row, query, part in parts for k, q, n in zip(row.tolist(), query.tolist(), part[None].tolist(), strict=True)) == [(k, q, len(h)) for k, h in enumerate(held[3:]) for q in range(3) if h]
