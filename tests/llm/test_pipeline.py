"""The pipeline against its stages' own brute force on a small corpus."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from docweir.llm import common, decontaminate, pieces, sanitise, simhash, toxicity

PLAIN = [f"{a}{b}" for a in "ka lo mi ne pu ra so ti vu we".split() for b in "dan fel gor hix jun".split()]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    bench = [(k, " ".join(rng.choices(PLAIN, k=30))) for k in range(4)]
    rows = []
    for k in range(240):
        words = rng.choices(PLAIN, k=80)
        if k % 4 == 0:
            words[rng.randrange(80)] = "villain"
        if k % 31 == 5:
            words[10:10] = bench[k % 4][1].split()
        if k % 17 == 3:
            words[20:20] = ["write", f"x{k}@mail.example.org", "or", "+1 (255) 555-8013"]
        rows.append(" ".join(words))
    rows += [rows[1], rows[2].upper(), rows[5], "", "", None, "villain"]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(rows)]
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    labels = [(k, 1, int(k % 4 == 0)) for k in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, {d[0]: d[1] for d in docs}, bench


def test_stages_and_run(spark, corpus):
    root, texts, bench = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "pieces"]
    columns = docs.columns
    kept = p.toxicity(spark, docs, root)
    assert kept.columns == columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert left == {k: t for k, t in texts.items() if "villain" not in (t or "").split()}
    classes = simhash.brute_force(left)
    unique = {k: t for k, t in left.items() if classes[k][1] == k}
    found = p.near_dedup(spark, kept, root)
    assert found.columns == columns and {r.doc_id: r.text for r in found.collect()} == unique
    clean = {k: t for k, t in unique.items() if not decontaminate.brute_force(t, [(str(i), b) for i, b in bench])[4]}
    assert len(clean) < len(unique)
    found = p.decontamination(spark, found, root)
    assert found.columns == columns and {r.doc_id: r.text for r in found.collect()} == clean
    safe = p.pii(spark, found, root)
    assert safe.columns == columns
    redacted = {r.doc_id: r.text for r in safe.collect()}
    assert redacted.keys() == clean.keys()
    for k, t in clean.items():
        assert sanitise.base_spans(redacted[k]) == [] and (redacted[k] == t or sanitise.base_spans(t))
    model = pieces.PieceModel(pieces.read_model())
    rows = p.run(spark, root).collect()
    assert len(rows) == len(clean)
    for r in rows:
        assert r.ids == model.library.encode(redacted[r.doc_id] or "", add_eos=True)
        assert r.text == model.library.decode(r.ids) and r.n_tokens == len(r.ids)


def test_repeated_rows_and_nulls(spark, corpus):
    root, *_ = corpus
    docs = spark.createDataFrame([(7, "a b c d", "x"), (7, "a b c d", "x"), (None, "e f g h", "x"), (None, "e f g h", "x"), (9, "A b c d", "x")], "doc_id long, text string, _dw_kept string")
    rows = sorted(((r.doc_id, r.text, r._dw_kept) for r in p.near_dedup(spark, docs, root).collect()), key=str)
    assert rows == [(7, "a b c d", "x"), (None, "e f g h", "x")]
    empty = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, root).count() == 0
    assert toxicity.THRESHOLD == 0.3


def test_verdicts_belong_to_rows(spark, corpus):
    a, b, c = "one two three four five six", "other words stand in this text", "third text of seven words in all"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (None, b), (8, c), (8, c), (None, c), (None, None), (9, "")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.text) for r in p.near_dedup(spark, docs, corpus[0]).collect()), key=str)
    assert rows == [(3, a), (5, b), (8, c), (9, "")]


CLASHING = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "decoded", "score", "fp", "row", "component_id", "digest", "size", "set", "bands", "label", "places", "terms", "spans", "_dw_n"]


def test_own_columns_with_the_stages_names(spark, corpus):
    root, texts, bench = corpus
    own = ", ".join(f"{c} string" for c in CLASHING)
    rows = [(k, t, *(f"{c} {k}" for c in CLASHING)) for k, t in [(2, "plain words here stand"), (3, bench[0][1]), (4, None), (5, "write to x@mail.example.org now please")]]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {own}")
    for name, stage in p.STAGES:
        made = stage(spark, docs, root)
        assert made.columns[: len(docs.columns)] == docs.columns, name
        found = {r.doc_id: r for r in made.collect()}
        assert found.keys() == ({2, 4, 5} if name == "decontamination" else {2, 3, 4, 5}), name
        for k, r in found.items():
            assert [r[c] for c in CLASHING] == [f"{c} {k}" for c in CLASHING], name
    ids = docs.select("doc_id", "text", F.lit("own").alias("ids"), F.lit("own").alias("n_tokens"), "decoded")
    made = p.pieces(spark, ids, root)
    assert made.columns == ["doc_id", "text", "decoded", "ids", "n_tokens"] and all(r.n_tokens == len(r.ids) for r in made.collect())


def test_stages_leave_nothing_but_the_last_table(spark, corpus, monkeypatch):
    written = []
    monkeypatch.setattr(p, "write_table", lambda df, f=p.write_table: written.append(f(df)) or written[-1])
    monkeypatch.setattr(common, "write_table", lambda df, f=common.write_table: written.append(f(df)) or written[-1])
    rows = p.run(spark, corpus[0]).count()
    there = [os.path.exists(path.removeprefix("file://").removeprefix("file:")) for _, path in written]
    assert rows and len(there) > 10 and sum(there) == 1 and written[there.index(True)][0].count() == rows


def test_a_cluster_without_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return Context._jsc

            @staticmethod
            def getCheckpointDir():
                return Context._jsc

            @staticmethod
            def isDefined():
                return False

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
    assert common.is_local("local[4]") and not common.is_local("local-cluster[2,1,1024]")
