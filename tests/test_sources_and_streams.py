import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docweir.sources import files, library
from docweir.streaming import crawl, threads


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}<w:tbl>{t}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_library_files(spark, tmp_path):
    sub = tmp_path / "deep" / "er"
    sub.mkdir(parents=True)
    (tmp_path / "a.txt").write_text(" héllo \n")
    (sub / "b.PDF").write_bytes(b"%PDF-1.4 x")
    (sub / "c.md").write_bytes(b"bad \xff byte")
    (sub / "d.docx").write_bytes(docx(["one", " ", "two"], [["x", "y"]]))
    (sub / "e.docx").write_bytes(b"PK\x03\x04 broken")
    (sub / "f.exe").write_bytes(b"MZ")
    (sub / "g.txt").write_bytes(b"nul \x00 byte")
    found = files.discover(spark, str(tmp_path))
    ok = {r.name: r.ok for r in found.select("name", files.is_valid(F.col("suffix"), F.col("content")).alias("ok")).collect()}
    assert ok == {"a.txt": True, "b.PDF": True, "c.md": False, "d.docx": True, "e.docx": True, "g.txt": False}
    names = {r.sha256: r.name for r in found.collect()}
    texts = {names[r.sha256]: r.text for r in files.text_pages(found).unionByName(files.docx_pages(found)).collect()}
    assert texts["a.txt"].strip() == "héllo" and texts["c.md"] == "bad � byte"
    assert texts["d.docx"] == "one\n\ntwo\n\nx | y" and texts["e.docx"] is None


def test_gold_and_catalogue(spark, tmp_path):
    cases = [
        {"question_id": "q1", "split": "dev", "question": "?", "answerability": "answerable", "leakage_group": "g", "evidence_groups": [{"id": "e", "answer_point": "p", "alternatives": [{"document_sha256": "d", "page_start": 1, "page_end": 2, "quote": "x"}]}]},
        {"question_id": "q2", "split": "dev", "question": "?", "answerability": "answerable", "leakage_group": "g"},
        {"question_id": "q1", "split": "test", "question": "?", "answerability": "perhaps", "leakage_group": "g"},
    ]
    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, cases)))
    gold = files.gold_cases(spark, str(tmp_path / "gold.jsonl"))
    assert sorted((r.question_id, r.problem) for r in files.gold_problems(gold).collect()) == [("q1", "repeated id"), ("q1", "unknown answerability"), ("q2", "no evidence")]
    assert [tuple(r) for r in files.gold_groups(gold).collect()] == [("q1", "e", "d", 1, 2, "x")]
    (tmp_path / "cat.jsonl").write_text('{"provider":"p","model":"m","capability":"chat","dimensions":3}\n{"provider":"p","model":"m","capability":"embedding","dimensions":3}')
    assert [r.problem for r in files.catalogue_problems(files.catalogue(spark, str(tmp_path / "cat.jsonl"))).collect()] == ["dimensions without embedding"]


def test_replacing_groups(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_groups(spark.createDataFrame([(k, f"a{k}") for k in range(500)], "k int, v string"), path, "k", buckets=8)
    files.write_groups(spark.createDataFrame([(2, "c"), (2, "d")], "k int, v string"), path, "k")
    got = files.read_groups(spark, path, "k int, v string")
    assert sorted((r.k, r.v) for r in got.filter("k < 4").collect()) == [(0, "a0"), (1, "a1"), (2, "c"), (2, "d"), (3, "a3")] and got.count() == 501
    assert len(list((tmp_path / "out").glob("data/*/bucket=*"))) == 9  # of the bucket that was replaced the old one is still there for readers
    files.write_groups(spark.createDataFrame([], "k int, v string"), path, "k")
    assert files.read_groups(spark, path, "k int, v string").count() == 501


def _library(tmp_path):
    folder = tmp_path / "lib"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.txt").write_text(" plain \n")
    (folder / "deep" / "b.docx").write_bytes(docx(["one"], [["x", "y"]]))
    (folder / "deep" / "c.docx").write_bytes(b"PK broken")
    (folder / "d.exe").write_bytes(b"MZ")
    (folder / "e").write_bytes(b"none")
    (folder / "f.txt").write_bytes(b"nul \x00")
    (folder / "gold.jsonl").write_text('{"question_id": "q1"}\n\n{"question_id": "q2"}\n')
    (folder / "bad.jsonl").write_text('{"question_id": "q1"}\nnot json\n')
    (folder / "store.json").write_text('{"documents": [{"id": "x"}, {"id": "y"}]}')
    (folder / "_hidden.txt").write_text("no")
    return folder


def test_a_library_is_a_data_source(spark, tmp_path, monkeypatch):
    folder = _library(tmp_path)
    library.register(spark, {"rot": lambda content: [content.decode()[::-1]]})
    (folder / "own.rot").write_text("olleh")
    rows = spark.read.format(library.FORMAT).load(str(folder)).collect()
    name = lambda r: r.path.rpartition("/")[2]
    good = {(name(r), r.page): r.text for r in rows if r.error is None}
    assert good[("a.txt", 1)] == "plain" and good[("b.docx", 1)] == "one\n\nx | y" and good[("own.rot", 1)] == "hello"
    assert json.loads(good[("gold.jsonl", 2)]) == {"question_id": "q2"} and json.loads(good[("store.json", 1)]) == {"id": "x"} and len(good) == 7
    bad = {name(r): r.error for r in rows if r.error}
    assert bad.keys() == {"c.docx", "d.exe", "e", "f.txt", "bad.jsonl"} and bad["d.exe"] == "no extractor for exe" and "JSON" in bad["bad.jsonl"]


def test_filters_choose_files_and_partitions_are_planned(spark, tmp_path, monkeypatch):
    folder = _library(tmp_path)
    reader = library.Reader(str(folder), library.EXTRACTORS)
    left = list(reader.pushFilters([library.EqualTo(("suffix",), "txt"), library.EqualTo(("page",), 1)]))
    assert [f.attribute for f in left] == [("page",)]
    assert sorted(p.rpartition("/")[2] for part in reader.partitions() for p, _, _ in part.files) == ["a.txt", "f.txt"]
    monkeypatch.setattr(library, "PARTITION_BYTES", 1)
    assert len(library.Reader(str(folder), library.EXTRACTORS).partitions()) == 9
    library.register(spark)
    held = spark.read.format(library.FORMAT).load(str(folder)).filter("suffix in ('txt', 'exe') and error is null")
    assert [r.text for r in held.collect()] == ["plain"]
    assert spark.read.format(library.FORMAT).load(str(folder / "deep")).filter("suffix = 'none'").count() == 0


def test_a_library_is_followed(spark, tmp_path):
    folder = _library(tmp_path)
    library.register(spark)
    seen = []
    stream = lambda: spark.readStream.format(library.FORMAT).load(str(folder)).filter("error is null")
    for k in range(2):
        query = stream().writeStream.foreachBatch(lambda df, n: seen.extend((r.path.rpartition("/")[2], r.page) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        if not k:
            assert sorted(seen) == [("a.txt", 1), ("b.docx", 1), ("gold.jsonl", 1), ("gold.jsonl", 2), ("store.json", 1), ("store.json", 2)]
            seen.clear()
            (folder / "deep" / "new.md").write_text("# new")
    assert seen == [("new.md", 1)]


def test_streamed_merges(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    batches = [[("http://a/1", "x"), ("http://a/2", "y")], [("http://a/1", "x2"), ("http://a/3", "z")], [("http://a/1", "x2")]]
    for k, rows in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"url": u, "ordinal": i, "title": "t", "markdown": m}) for i, (u, m) in enumerate(rows)))
        crawl.start_merging(crawl.crawl_stream(spark, str(source), 1), root).awaitTermination()
    state = {r.canonical_url: r.current_version for r in crawl.state(spark, root).collect()}
    assert state == {"http://a/1": 2, "http://a/2": 1, "http://a/3": 1}
    assert sorted((r.canonical_url, r.version) for r in crawl.history(spark, root).collect()) == [("http://a/1", 1), ("http://a/1", 2), ("http://a/2", 1), ("http://a/3", 1)]
    crawl.start_merging(crawl.crawl_stream(spark, str(source), 1), root).awaitTermination()
    assert crawl.history(spark, root).count() == 4


def test_streamed_counts(spark, tmp_path):
    rows = [(1, 0, "user", "a", "2024-01-01 00:00:00"), (1, 0, "user", "a", "2024-01-01 00:00:01"), (1, 1, "assistant", "b", "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string").withColumn("at", F.to_timestamp("at")).write.json(str(tmp_path / "m"))
    stream = spark.readStream.schema(crawl.MESSAGES).json(str(tmp_path / "m"))
    q = crawl.conversation_counts(stream).writeStream.outputMode("update").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.role, r.n) for r in spark.sql("select * from counted").collect()) == [("assistant", 1), ("user", 1)]


def test_kinds_without_an_extractor(spark, tmp_path):
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1")
    found = files.discover(spark, str(tmp_path))
    assert [r.text for r in files.extracted_pages(found.filter("suffix = 'txt'")).collect()] == ["text"]
    with pytest.raises(Exception, match="no extractor"):
        files.extracted_pages(found).collect()
    assert files.unknown_kinds(found).count() == 0 and files.unknown_kinds(found.withColumn("suffix", F.lit("exe"))).count() == 2


def test_document_stores(spark, tmp_path):
    store = {"documents": [{"id": "a", "url": "http://old"}, {"id": "b", "canonical_url": "http://new"}], "versions": [{"policy_id": "a", "version": 1}], "assets": [{"document_id": "b", "original_url": "u"}]}
    (tmp_path / "store.json").write_text(json.dumps(store, indent=1))
    got = files.document_store(spark, str(tmp_path / "store.json"))
    assert {(r.id, r.canonical_url) for r in got["documents"].collect()} == {("a", "http://old"), ("b", "http://new")}
    assert got["versions"].first().document_id == "a" and got["assets"].first().document_id == "b"


def _batch(spark, rows):
    return spark.createDataFrame([(u, i, "t", m) for i, (u, m) in enumerate(rows)], crawl.CRAWLED)


def _bytes(folder):
    return {str(p): p.stat().st_size for p in folder.rglob("*.parquet")}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """Bytes follow the batch, old buckets go, and a batch that runs again changes nothing."""
    root = str(tmp_path / "out")
    merge_ = crawl.merge_batches(root, buckets=32)
    merge_(_batch(spark, [(f"http://a/{k}", f"text {k}") for k in range(3000)]), 0)
    first = _bytes(tmp_path / "out" / "data")
    for number in range(1, 5):
        before = _bytes(tmp_path / "out" / "data")
        merge_(_batch(spark, [("http://a/7", f"new {number}")]), number)
        written = {p: n for p, n in _bytes(tmp_path / "out" / "data").items() if p not in before}
        assert len({p.split("bucket=")[1].split("/")[0] for p in written}) == 1
        assert sum(written.values()) < sum(first.values()) / 10
    assert len(list((tmp_path / "out" / "manifests").glob("*.json"))) == 2
    assert sum(_bytes(tmp_path / "out" / "data").values()) < 1.2 * sum(first.values())
    merge_(_batch(spark, [("http://a/7", "another")]), 4)  # the batch was committed
    got = {r.canonical_url: r.current_version for r in crawl.state(spark, root).collect()}
    assert len(got) == 3000 and got["http://a/7"] == 5 and got["http://a/8"] == 1
    assert crawl.history(spark, root).count() == 3004


def test_a_killed_commit_leaves_the_state_as_it_was(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    merge_ = crawl.merge_batches(root, buckets=4)
    merge_(_batch(spark, [("http://a/1", "x"), ("http://a/2", "y")]), 0)
    kill = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    with monkeypatch.context() as m:
        m.setattr(crawl.manifest, "commit", kill)
        with pytest.raises(RuntimeError):
            merge_(_batch(spark, [("http://a/1", "z"), ("http://a/3", "w")]), 1)
    assert {r.canonical_url: r.current_version for r in crawl.state(spark, root).collect()} == {"http://a/1": 1, "http://a/2": 1}
    merge_(_batch(spark, [("http://a/1", "z"), ("http://a/3", "w")]), 1)
    assert {r.canonical_url: r.current_version for r in crawl.state(spark, root).collect()} == {"http://a/1": 2, "http://a/2": 1, "http://a/3": 1}
    assert sorted((r.canonical_url, r.version) for r in crawl.history(spark, root).collect()) == [("http://a/1", 1), ("http://a/1", 2), ("http://a/2", 1), ("http://a/3", 1)]
    attempts = {p.name.split("-")[0] for p in (tmp_path / "out" / "data").iterdir()}
    assert len(list((tmp_path / "out" / "data").iterdir())) == len(attempts)  # the killed attempt's directory is gone
    merge_(_batch(spark, []), 2)
    assert crawl.state(spark, root).count() == 3


def _events(spark, folder, rows):
    spark.createDataFrame(rows, "thread_id string, step long, at string, kind string, document_id string, chunk_id string, source_url string").write.json(str(folder))


def test_threads_go_on_after_restarts(spark, tmp_path):
    """Each batch is a query of its own, stopped and started again; the threads are those of a recount."""
    at = lambda m, s=0: f"2024-01-01 00:{m:02d}:{s:02d}"
    none = (None, None, None)
    batches = [
        [("t", 1, at(0), "message", *none), ("t", 2, at(0, 1), "tool", *none), ("t", 3, at(0, 2), "citation", "d", "c", None), ("u", 1, at(0), "message", *none)],
        [("t", 3, at(0, 2), "citation", "d", "c", None), ("t", 4, at(1), "citation", "d", "c", None), ("t", 5, at(1, 1), "citation", None, None, "http://w"), ("w", 1, at(20), "message", *none)],
        [("w", 2, at(21), "tool", *none)],
        [("u", 2, at(22), "message", *none), ("t", 6, at(22, 5), "done", *none)],
    ]
    root, source = str(tmp_path / "out"), tmp_path / "in"
    status = []
    for k, rows in enumerate(batches):
        _events(spark, source / str(k), rows)
        stream = spark.readStream.schema(threads.EVENTS).option("recursiveFileLookup", True).json(str(source))
        query = threads.start(stream, root)
        query.awaitTermination(180)
        assert query.exception() is None
        status.append({r.thread_id: r.status for r in threads.latest(spark, root).collect()})
    assert status[0] == {"t": "running", "u": "running"}
    assert status[2]["u"] == "interrupted" and status[3] == {"t": "done", "u": "running", "w": "running"}
    got = {r.thread_id: r for r in threads.latest(spark, root).collect()}
    assert got["u"].n_resumed == 1 and got["t"].citations == [("d", "c", None), (None, None, "http://w")]
    columns = ["thread_id", "status", "last_step", "n_messages", "n_tools", "citations"]
    whole = spark.read.schema(threads.EVENTS).option("recursiveFileLookup", True).json(str(source))
    assert sorted(map(str, threads.latest(spark, root).select(columns).collect())) == sorted(map(str, threads.recount(whole).select(columns).collect()))
    said = spark.createDataFrame([("t", 6, "old"), ("t", 7, "new"), ("v", 1, "first")], "thread_id string, step long, text string")
    assert {r.text for r in threads.resumed(threads.latest(spark, root), said).collect()} == {"new", "first"}
