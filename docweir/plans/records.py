"""Bookkeeping queries over the test tables: statuses, libraries, jobs, sessions, crawls, manifests and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import grams, metadata
from ..operators import records as r
from . import query, table


@query("SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN o_orderstatus WHEN n > 4 THEN 'ready' ELSE 'failed' END AS status, CASE WHEN n > 4 THEN '2024-01-01' WHEN o_orderstatus = 'F' THEN 'before' END AS processed_at, CASE WHEN n <= 4 THEN n || ' lines' WHEN n IS NULL THEN o_orderpriority END AS error_message FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' statuses after the changes that their lines bring."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "F", "before").alias("processed_at"), F.col("o_orderpriority").alias("error_message"))
    n = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    changes = n.select("id", F.when(F.col("n") > 4, "ready").otherwise("failed").alias("status"), F.when(F.col("n") <= 4, F.concat(F.col("n").cast("string"), F.lit(" lines"))).alias("error_message"))
    return r.set_status(docs, changes, F.lit("2024-01-01"))


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, c_name) AS name, o_orderkey AS page_number, o_orderpriority AS text FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document by its display name; a document without pages has one row for that."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("title"), F.col("c_name").alias("filename"))
    return r.pages_of(docs, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("page_number"), F.col("o_orderpriority").alias("text")))


@query("SELECT d.doc_id AS id, d.source AS document_id, d.n_chars AS chunk_index, 'm' || label AS model, left(text, 500) AS preview FROM documents d LEFT JOIN embeddings ON doc_id = vec_id")
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the model that embedded them and a preview."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), F.col("n_chars").alias("chunk_index"), "text")
    return r.chunk_list(chunks, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("model")))


@query("SELECT doc_id AS id, source AS document_id, CASE WHEN trim(lang) <> '' THEN lang || chr(10) || chr(10) || text ELSE text END AS input FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING sum(toxic) = 0)")
def reembedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded anew, but for the documents that failed."""
    d = table(spark, sf_dir, "documents")
    failed = d.select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("document_id")).agg(F.sum("toxic").alias("n")).filter("n = 0")
    return r.reembedding_inputs(d.select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), F.col("lang").alias("header"), "text"), failed)


@query("SELECT p.p_partkey AS path, p.p_name AS checksum, CASE WHEN a.path IS NOT NULL THEN 'known path' WHEN b.checksum IS NOT NULL THEN 'known content' ELSE 'new' END AS state FROM part p LEFT JOIN (SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_quantity > 49) a ON p.p_partkey = a.path LEFT JOIN (SELECT DISTINCT p_name AS checksum FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 49 AND l_tax > 0.07) b ON p.p_name = b.checksum")
def library_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a library doesn't know by path or by content."""
    p, li = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("checksum")), table(spark, sf_dir, "lineitem").filter("l_quantity > 49")
    known = li.select(F.col("l_partkey").alias("path"), F.when(F.col("l_tax") > 0.07, 1).alias("s")).join(p, "path").select("path", F.when(F.col("s") == 1, F.col("checksum")).alias("checksum"))
    return r.library_changes(p, known)


@query("SELECT s_suppkey AS wanted, count(n_nationkey) > 0 AS found, min(n_name) AS base_url FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND (s_suppkey % 2 = 0 OR n_regionkey = s_suppkey % 5) GROUP BY 1")
def catalogue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by provider and model, of one capability or any."""
    entries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("provider"), F.lit("m").alias("model"), F.col("n_regionkey").cast("long").alias("capability"), F.col("n_name").alias("base_url"), F.lit(1).alias("sort_order"))
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("provider"), F.lit("m").alias("model"), F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey") % 5).alias("capability"), F.col("s_suppkey").alias("wanted"))
    return r.catalogue_entry(entries, wanted).select("wanted", "found", "base_url")


@query("SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_nationkey >= 20 THEN 'unknown provider' END, CASE WHEN c_acctbal <= 0 THEN 'dimensions must be positive' END, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'dimensions are for embedding alone' END], lambda x: x IS NOT NULL), ', ') AS problems FROM customer")
def endpoint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with catalogue entries."""
    capability = F.when(F.col("c_mktsegment") == "MACHINERY", "embedding").otherwise("chat")
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("provider"), F.col("c_acctbal").alias("dimensions"), capability.alias("capability"))
    found = r.endpoint_problems(entries, table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("id")))
    return found.select("id", F.array_join("problems", ", ").alias("problems"))


@query("SELECT r_name AS parent, n_name AS child, r_regionkey AS parent_order, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS child_order FROM region JOIN nation ON n_regionkey = r_regionkey")
def taxonomy_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy's rows from its groups, with blanks and repetitions among the names."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("position")).agg(F.array_sort(F.collect_list("n_name")).alias("own"))
    groups = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("position"))
    spaced = F.concat(F.array(F.lit(" ")), F.transform("own", lambda c: F.concat(F.lit("  "), c)), F.array(F.get("own", F.lit(0))))
    return r.taxonomy_rows(groups.select("position", F.concat("r_name", F.lit(" ")).alias("parent"), spaced.alias("children")))


@query("SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN o_orderstatus ELSE 'done' END AS status, o_orderpriority AS kind, CAST(n AS VARCHAR) AS lines, CASE WHEN n IS NULL THEN 'before' ELSE 'after' END AS finished_at FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def jobs_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after their results, whose details join those that they had."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.to_json(F.create_map(F.lit("kind"), F.col("o_orderpriority"))).alias("details"), F.lit("before").alias("finished_at"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.create_map(F.lit("lines"), F.count(F.lit(1)).cast("string"))).alias("details"))
    out = r.close_jobs(jobs, n.withColumn("status", F.lit("done")), F.lit("after"))
    return out.select("id", "status", F.get_json_object("details", "$.kind").alias("kind"), F.get_json_object("details", "$.lines").alias("lines"), "finished_at")


@query("SELECT event_id AS id, user_id AS session_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def owned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the sessions that belong to one owner."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), "event_type", F.col("ts").alias("created_at"))
    return r.session_messages(e, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("owner_id")), F.lit(3)).select("id", "session_id", "event_type")


@query("SELECT conv_id AS session_id, left(arg_min(text, turn) FILTER (WHERE role = 'user'), 200) AS title, max(turn) AS updated_at, count(*) AS n_messages FROM conversations GROUP BY 1")
def session_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of sessions, made of the first question."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "role", "text")
    return r.session_titles(said)


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 'answer ' || turn ELSE text END AS text, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 'more?' END AS suggestions, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 'complete' WHEN turn % 2 = 1 THEN 'pending' ELSE 'old' END AS status FROM conversations")
def answers_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending answers finished; nothing else takes an answer's text or suggestions."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("id"), "role", "text", F.when(F.col("turn") % 2 == 1, "pending").otherwise("old").alias("status"), F.lit(None).cast("string").alias("suggestions"))
    new = said.select("id", F.concat(F.lit("answer "), F.col("turn").cast("string")).alias("text"), F.lit("more?").alias("suggestions"))
    return r.finish_messages(said, new).select("conv_id", "turn", "text", "suggestions", "status")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'file' || doc_id ELSE 'Title ' || doc_id END AS title, CASE WHEN doc_id % 4 = 0 THEN CAST(1990 + doc_id % 30 AS INTEGER) END AS year, CASE WHEN doc_id % 5 = 0 THEN '2020-01-1' || doc_id % 10 END AS publication_date, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'detected' END AS language, lang || ',' || source AS keywords FROM documents")
def metadata_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's metadata made fit to store."""
    k = F.col("doc_id")
    fields = F.struct(
        F.when(k % 3 > 0, F.concat(F.lit("Title "), k.cast("string"))).otherwise("").alias("title"), F.when(k % 4 == 0, (1990 + k % 30).cast("string")).when(k % 4 == 1, "in 1990").alias("year"),
        F.when(k % 5 == 0, F.concat(F.lit(" 2020-01-1"), (k % 10).cast("string"))).otherwise("2020-13-40").alias("publication_date"), F.when(k % 2 == 0, F.col("lang")).alias("language"),
        F.array(F.concat(F.lit(" "), F.col("lang")), F.lit("  "), F.col("source")).alias("keywords"),
    )
    raw = table(spark, sf_dir, "documents").select(k.alias("id"), F.concat(F.lit("file"), k.cast("string")).alias("filename"), F.to_json(fields).alias("json"), F.lit("detected").alias("detected"))
    return r.normalised_metadata(raw).withColumn("keywords", F.array_join("keywords", ","))


@query("SELECT event_id AS id, list_filter([CASE WHEN contains(event_type, '7') THEN 'title' END, CASE WHEN contains(props, '7') THEN 'metadata' END], lambda x: x IS NOT NULL)[1] AS first_field FROM events WHERE contains(event_type, '7') OR contains(props, '7') ORDER BY ts DESC, event_id LIMIT 100")
def crawl_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred documents with a query in their fields or anywhere in their metadata."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("ts").alias("last_seen_at"), F.col("props").alias("metadata"))
    return r.crawl_search(e, "7", 100).select("id", F.get("match_fields", F.lit(0)).alias("first_field"))


@query("SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) AS version, o_orderkey AS body FROM orders")
def versions_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories with new versions behind the old ones."""
    o = table(spark, sf_dir, "orders")
    number = F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    old = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), number.cast("long").alias("version"), F.col("o_orderkey").alias("body"))
    return r.save_versions(old, o.filter("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("body")))


@query("WITH a AS (SELECT l_orderkey AS id, l_linenumber AS url, min(l_tax) AS size FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), b AS (SELECT l_orderkey AS id, l_linenumber AS url, max(l_discount) + 1 AS size FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) SELECT id, url, coalesce(b.size, a.size) AS size FROM a FULL JOIN b USING (id, url)")
def assets_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets by document and url, of which the new ones win."""
    li = table(spark, sf_dir, "lineitem")
    of = lambda df, size: df.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("url")).agg(size.alias("size"))
    return r.save_assets(of(li.filter("l_linestatus = 'O'"), F.min("l_tax")), of(li.filter("l_returnflag = 'A'"), F.max("l_discount") + 1))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def rows_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which some fields are set, one of them to null."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    fields = F.create_map(F.lit("c_name"), F.lit("renamed"), F.lit("c_acctbal"), F.lit(None).cast("string"))
    return r.patch_rows(c, c.filter("c_nationkey < 5").select("c_custkey", fields.alias("fields")), "c_custkey")


@query("SELECT user_id AS crawl_id, count(*) AS n_documents, arg_max(last, day) AS counters FROM (SELECT user_id, CAST(ts AS DATE) AS day, max(event_id) AS last, count(*) AS n FROM events GROUP BY ALL) JOIN events e USING (user_id) WHERE CAST(e.ts AS DATE) = day GROUP BY 1")
def crawls_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a crawl's batches, and the last batch's counters."""
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("crawl_id"), F.to_date("ts").alias("batch"))
    return r.joined_crawl(days.agg(F.collect_list("event_id").alias("documents"), F.max("event_id").alias("counters"))).select("crawl_id", "n_documents", "counters")


@query("SELECT l_orderkey AS batch, count(*) FILTER (WHERE l_quantity > CASE WHEN l_orderkey % 2 = 0 THEN 30 ELSE 46 END) AS n_over, count(*) FILTER (WHERE l_quantity > CASE WHEN l_orderkey % 2 = 0 THEN 30 ELSE 46 END) = 0 AS accepted FROM lineitem GROUP BY 1")
def inputs_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that hold an input over the model's limit."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_quantity").alias("tokens"))
    return r.rejected_inputs(li, r.input_limit(F.lit(50), F.col("batch") % 2 == 0, 2, 2, 34))


@query("SELECT page_id AS query_id, url AS title, coalesce(CASE WHEN page_id % 3 = 0 THEN trim(url) END, CASE WHEN page_id % 3 = 1 THEN 'text' END) AS content FROM pages WHERE page_id % 3 < 2")
def web_results_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results with the best content that they have."""
    k = F.col("page_id")
    raw = table(spark, sf_dir, "pages").select(k.alias("query_id"), F.lit(1).alias("position"), F.lit(" ").alias("title"), "url", F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("url"))).otherwise(" ").alias("markdown"), F.lit(None).cast("string").alias("content"), F.when(k % 3 == 1, "text").alias("description"))
    return r.web_results(raw).select("query_id", "title", "content")


@query("SELECT doc_id, left(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), 500) AS text FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''")
def clicks_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as they are logged."""
    return r.clicks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 'withdrawn' END, CASE WHEN quality = 1 THEN 'answerable' ELSE 'unresolved_candidate' END) AS answerability FROM labels")
def answerability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether questions can be answered, in three states or as stated."""
    return table(spark, sf_dir, "labels").select("doc_id", r.answerability(F.when(F.col("toxic") == 1, "withdrawn"), F.col("quality") == 1).alias("answerability"))


@query("SELECT o_custkey AS folder, count(*) AS n_files, sha256(string_agg(printf('%010d', o_orderkey) || chr(9) || sha256(o_orderpriority) || chr(10), '' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for the files of each folder."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), F.format_string("%010d", "o_orderkey").alias("path"), F.sha2("o_orderpriority", 256).alias("sha256"))
    return r.manifest_digest(o)


@query("SELECT DISTINCT p_name AS name, unnest(list_filter([CASE WHEN contains(p_name, '/') THEN 'no plain name' END, CASE WHEN n > 1 THEN 'repeated name' END, CASE WHEN p_size < 25 THEN 'no PDF' END, CASE WHEN p_size > 40 THEN 'other digest' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS n FROM (SELECT p_size, CASE WHEN p_size = 7 THEN 'in/' ELSE '' END || p_name || p_partkey // 2 AS p_name FROM part))")
def batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the files of a batch."""
    size = F.col("p_size")
    name = F.concat(F.when(size == 7, "in/").otherwise(""), F.col("p_name"), F.expr("p_partkey div 2").cast("string"))
    return r.batch_problems(table(spark, sf_dir, "part").select(name.alias("name"), F.when(size < 25, "PK..").otherwise("%PDF-1.7").alias("head"), F.when(size > 40, "a").otherwise("b").alias("sha256"), F.lit("b").alias("stated")))


@query("SELECT document_id, coalesce(n_sections, 0) AS n_sections, coalesce(n_children, 0) AS n_children, coalesce(n_headers, 0) AS n_headers, coalesce(input_tokens, 0) AS input_tokens, coalesce(n_single, 0) AS n_single, coalesce(n_tiny, 0) AS n_tiny FROM (SELECT o_custkey AS document_id, count(*) AS n_sections, count(*) FILTER (WHERE o_totalprice < 50000) AS n_tiny FROM orders GROUP BY 1) FULL JOIN (SELECT o_custkey AS document_id, sum(n)::BIGINT AS n_children, sum(h)::BIGINT AS n_headers, sum(t) AS input_tokens, count(*) FILTER (WHERE n = 1) AS n_single FROM (SELECT o_custkey, l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'N') AS h, sum(l_quantity) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY 1) USING (document_id)")
def rebuilt_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, chunks and headers by document."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("section_id"), (F.col("o_totalprice") / 500).alias("tokens"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.when(F.col("l_returnflag") != "N", "h").otherwise(" ").alias("header"), F.col("l_quantity").alias("tokens"))
    return r.rebuild_statistics(o, li.join(o.select("section_id", "document_id"), "section_id"))


@query("SELECT lang, count(*) AS n, CAST(sum(('0x' || left(md5('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}'), 12))::BIGINT) AS DECIMAL(38,0)) AS digest FROM documents GROUP BY 1")
def section_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for the rows of each group, whatever their order."""
    return r.group_digest(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").withColumn("digest", F.col("digest").cast("decimal(38,0)"))


@query("WITH a AS (SELECT o_custkey, o_orderpriority AS k, CAST(count(*) AS VARCHAR) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL), b AS (SELECT o_custkey, o_orderpriority AS k, CAST(count(*) AS VARCHAR) AS v FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL) SELECT o_custkey, k, a.v AS before, b.v AS after FROM a FULL JOIN b USING (o_custkey, k) WHERE a.v IS DISTINCT FROM b.v")
def run_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings in which two runs differ."""
    of = lambda state: table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != state).groupBy("o_custkey", F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).cast("string").alias("v"))
    return r.differences(of("F"), of("O"), ["o_custkey", "k"], "v")


@query("SELECT user_id AS query_id, event_type AS branch, event_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 10")
def branches_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each branch's candidates ranked anew from saved ranks that have gaps."""
    return r.rerank_saved(table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("branch"), F.col("event_id").alias("id"), (-F.col("value")).alias("saved_rank")), 10)


@query("SELECT user_id AS query_id, event_id AS id, rank, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a generation sees of its five best candidates, without the gold."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "value", "props", F.col("event_type").alias("gold"))
    ranked = e.select("query_id", "id", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY value DESC, id)").alias("rank"))
    return r.generation_packets(ranked, e, ["gold", "value"])


@query("SELECT doc_id AS case_id FROM labels WHERE quality = 1 AND toxic = 1")
def false_completes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that were certified complete and aren't."""
    return r.falsely_complete(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "complete").otherwise("partial").alias("coverage_status"), (F.col("toxic") == 0).alias("gold_complete")))


@query("SELECT doc_id AS case_id FROM labels WHERE quality = 0 AND toxic = 0")
def replayable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that can be generated again, without their gold."""
    return r.replay_inputs(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 0).alias("generation_failed"), (F.col("toxic") == 0).alias("context_approved"), "quality"), ["quality", "generation_failed", "context_approved"])


@query("SELECT doc_id AS case_id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 30")
def selected_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of cases by id."""
    return r.case_slice(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "lang"), 30, 50)


@query("SELECT ord AS \"order\", id FROM (SELECT 'uploaded_desc' AS ord, c_custkey AS id, row_number() OVER (ORDER BY c_nationkey DESC NULLS LAST, c_mktsegment, c_custkey) AS n FROM customer UNION ALL SELECT 'name_asc', c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_nationkey DESC NULLS LAST, c_custkey) FROM customer UNION ALL SELECT 'year_desc', c_custkey, row_number() OVER (ORDER BY CASE WHEN c_nationkey > 5 THEN c_custkey % 7 END DESC NULLS LAST, c_nationkey DESC NULLS LAST, c_custkey) FROM customer UNION ALL SELECT 'chunks_desc', c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_nationkey DESC NULLS LAST, c_custkey) FROM customer) WHERE n <= 20")
def library_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a library in each of its orders."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("uploaded_at"), F.col("c_mktsegment").alias("filename"), F.when(F.col("c_nationkey") > 5, F.col("c_custkey") % 7).alias("year"), F.col("c_acctbal").alias("chunk_count"))
    out = None
    for order in ("uploaded_desc", "name_asc", "year_desc", "chunks_desc"):
        page = r.library_order(c, order).limit(20).select(F.lit(order).alias("order"), "id")
        out = page if out is None else out.unionByName(page)
    return out


@query("SELECT page_id, (SELECT count(*) FROM range(1, page_id % 7 + 1)) AS n_pages, 'http://x.org/list?q=' || page_id || '&page=' || (page_id % 7) AS last_url, CASE WHEN page_id % 7 > 0 THEN 'http://x.org/p/' || (page_id % 7) END AS by_template, page_id * 1000 AS total, CASE WHEN 3 < ceil(page_id * 1000 / 20) THEN 4 END AS next FROM pages")
def result_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of result pages by number and by template, totals as a page states them, and the page after the third."""
    k = F.col("page_id")
    last = (k % 7).cast("int")
    total = urls.stated_total(F.concat(F.lit("Showing "), F.format_number(k * 1000, 0), F.lit(" results")))
    numbered = urls.numbered_pages(F.concat(F.lit("http://x.org/list?page=9&q="), k.cast("string")), F.greatest(last, F.lit(1)))
    of_template = urls.template_pages("http://x.org/p/{page}", last)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.size(of_template).cast("long").alias("n_pages"), F.when(last > 0, F.element_at(numbered, -1)).otherwise(F.concat(F.lit("http://x.org/list?q="), k.cast("string"), F.lit("&page=0"))).alias("last_url"),
        F.get(of_template, last - 1).alias("by_template"), total.alias("total"), urls.next_page(F.lit(3), total).alias("next"),
    )


@query("SELECT doc_id, len(w) AS n_spans, w[1] AS first, CASE WHEN len(w) > 0 THEN strpos(text, w[1]) - 1 END AS start, w[len(w)] AS last FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+') AS w FROM documents)")
def question_span_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, as of questions, with their places."""
    d = table(spark, sf_dir, "documents").withColumn("s", tx.question_spans(F.col("text")))
    first, last = F.get("s", F.lit(0)), F.get("s", F.size("s") - 1)
    return d.select("doc_id", F.size("s").cast("long").alias("n_spans"), first["text"].alias("first"), first["start"].cast("long").alias("start"), last["text"].alias("last"))


@query("SELECT event_id, props LIKE '%7%' OR event_type = 'click' AS holds FROM events")
def nested_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query stands in any key or value of nested metadata."""
    deep = F.to_json(F.struct(F.array(F.struct(F.col("props").alias("kept"), F.when(F.col("event_type") == "click", "7").alias("own"))).alias("list")))
    return table(spark, sf_dir, "events").select("event_id", tx.holds(deep, F.lit("7")).alias("holds"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda v: printf('%.8f', v::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def vector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a database reads them."""
    return table(spark, sf_dir, "embeddings").select("vec_id", tx.vector_literal(F.col("embedding")).alias("literal"))


@query("SELECT DISTINCT event_type, upper(left(event_type, 1)) || substr(event_type, 2) AS label, left(regexp_replace(event_type, '[_-]', ' ', 'g'), 240) AS header FROM events")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers as titles and headers."""
    quoted = F.concat(F.lit('" '), F.translate("event_type", "_-", "  "), F.lit(' "'))
    return table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", tx.humanized(F.col("event_type")).alias("label"), tx.header(quoted).alias("header"))


@query("SELECT conv_id, turn, ['one', CAST(turn AS VARCHAR)] AS found FROM conversations")
def recovered_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions out of replies: fenced, with words around them, or cut off."""
    n = F.col("turn").cast("string")
    kind = F.col("conv_id") % 4
    reply = F.when(kind == 0, F.concat(F.lit('```json\n["one", '), n, F.lit("]\n```"))).when(kind == 1, F.concat(F.lit('Here: [" one ", "", "'), n, F.lit('"] more'))).when(kind == 2, F.concat(F.lit('["one", "'), n, F.lit('", "cut'))).otherwise(F.concat(F.lit('["one","'), n, F.lit('"]')))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.suggestions(reply).alias("found"))


@query("SELECT doc_id, len(p) AS n, p[1] AS first FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '')[1:8] AS p FROM documents)")
def paragraph_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraphs of texts."""
    p = tx.paragraphs(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(p).cast("long").alias("n"), F.get(p, F.lit(0)).alias("first"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower('file_' || doc_id), '1_') THEN 'filename' END, CASE WHEN contains(lower(left(text, 60)), '1_') THEN 'title' END, CASE WHEN contains(lang || ' 1_' || source, '1_') THEN 'keywords' END], lambda x: x IS NOT NULL), ',') AS fields FROM documents")
def library_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a query, which has a sign of LIKE, in any of a library's fields."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("File_"), F.col("doc_id").cast("string")).alias("filename"), F.left("text", F.lit(60)).alias("title"), F.array("lang", F.concat(F.lit("1_"), F.col("source"))).alias("keywords"), (F.col("doc_id") % 30 + 1990).alias("year"))
    return r.library_search(d, " 1_ ").select("doc_id", F.array_join("match_fields", ",").alias("fields"))


@query("SELECT l_orderkey AS id, l_partkey % 50 AS document_id, CASE WHEN o_orderkey IS NULL THEN 'missing section' WHEN o_custkey % 50 <> l_partkey % 50 THEN 'section of another document' END AS problem, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey GROUP BY ALL")
def parent_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose section isn't their document's."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 50).alias("document_id"), F.col("l_orderkey").alias("section_id"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("document_id"), F.lit("t").alias("text"))
    return r.parents_of(li, o).groupBy("id", "document_id", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS crawl_id, CAST(n // 5 AS INTEGER) AS batch, count(*) AS n_pages, least(5 * (n // 5 + 1), max(total)) AS so_far FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events) GROUP BY user_id, n // 5")
def crawl_detail_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages of crawls in batches of five, and what each crawl has by then."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("crawl_id"), F.col("event_id").alias("position"), F.col("event_id").cast("string").alias("url"))
    return r.crawled_totals(r.crawl_batches(e))


@query("SELECT count(*) AS n_sections, round(count(*) FILTER (WHERE n = 1) / count(*), 9) AS single_share, round(count(*) FILTER (WHERE o_totalprice < 100000) / count(*), 9) AS tiny_share, round(avg(n), 9) AS mean_children FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def section_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of sections that tell of a bad split."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("tokens"))
    found = r.section_audit(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id")))
    return found.select("n_sections", *(F.round(c, 9).alias(c) for c in ("single_share", "tiny_share", "mean_children")))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, source || '.txt' AS name, strlen(text) AS size, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END AS uploaded_at, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS publication_date, [lang, source] AS keywords, [] AS policy_areas, coalesce(CASE WHEN n_chars > 1000 THEN n_chars // 1000 END, 0) AS page_count, true AS approved
 FROM documents LEFT JOIN events ON event_id = doc_id""")
def metadata_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as their metadata is shown, with the time of the event of their number."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    d = table(spark, sf_dir, "documents").join(e, F.col("doc_id") == F.col("event_id"), "left")
    rows = d.select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit(".txt")).alias("original_filename"), F.octet_length("text").cast("long").alias("file_size"), F.col("ts").alias("uploaded_at"),
        F.when(F.col("event_type") != "error", F.to_date("ts")).alias("publication_date"), F.concat_ws("; ", "lang", "source").alias("keywords"), F.when(F.col("n_chars") > 1000, F.floor(F.col("n_chars") / 1000)).alias("page_count"),
    )
    return metadata.projection(rows).select("id", "name", "size", "uploaded_at", "publication_date", "keywords", "policy_areas", "page_count", "approved")


@query("SELECT event_id FROM events WHERE contains(event_type, 'i') OR contains(json_extract_string(props, '$.k'), '7')")
def metadata_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose nested metadata has a query in a key or a value at any depth: their kind is a key, their properties below it."""
    e = table(spark, sf_dir, "events")
    nested = F.concat(F.lit('{"'), F.col("event_type"), F.lit('":[{"'), F.lit('in":'), F.col("props"), F.lit("}]}"))
    held = metadata.parsed(e.select("event_id", nested.alias("json")), "json")
    both = metadata.leaves(held, "event_id", "metadata").filter("name is null or name <> 'in'")
    return both.filter("contains(name, 'i') or contains(value, '7')").select("event_id").distinct()


@query("SELECT item_id AS query_id, doc_id AS id FROM (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN substr(text, 2, 2) ELSE substr(text, 4, 3 + item_id % 9) END AS q FROM benchmark) JOIN documents ON contains(lower(text), lower(q)) WHERE q <> ''")
def substring_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold pieces of benchmark items, long and short, by a trigram index."""
    b, k = table(spark, sf_dir, "benchmark"), F.col("item_id")
    piece = F.when(k % 5 == 0, F.substr("text", F.lit(2), F.lit(2))).otherwise(F.substr("text", F.lit(4), (3 + k % 9).cast("int")))
    index = grams.build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), F.col("text"))
    return grams.search(index, b.select(k.alias("query_id"), piece.alias("query")))
