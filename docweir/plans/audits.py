"""Audits and bookkeeping over the test tables: citations, evidence tiers, traces, inventories, governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import norm, valid
from ..operators import evidence, search, selection
from . import query, table

_TERMS = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_CITED = "SELECT conv_id, turn, event_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY event_id) AS pos, event_type AS source FROM conversations JOIN events ON user_id = conv_id WHERE event_id % 40 = turn"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of answers: events of a conversation's user that its turn picks out."""
    said, e = table(spark, sf_dir, "conversations").select("conv_id", "turn"), table(spark, sf_dir, "events")
    met = said.join(e, (F.col("user_id") == F.col("conv_id")) & (F.col("event_id") % 40 == F.col("turn")))
    order = W.partitionBy("conv_id", "turn").orderBy("event_id")
    return met.select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.row_number().over(order).alias("position"), F.col("event_type").alias("source"), "event_id", "value")


@query(f"WITH c AS (SELECT conv_id || '-' || turn AS answer_id, pos, source FROM ({_CITED})), f AS (SELECT answer_id, source, row_number() OVER (PARTITION BY answer_id ORDER BY p, source) AS number FROM (SELECT answer_id, source, min(pos) AS p FROM c GROUP BY ALL)) SELECT answer_id, pos AS position, source, number FROM c JOIN f USING (answer_id, source)")
def citation_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of sources in the order of their first mention."""
    return selection.number_citations(_cited(spark, sf_dir).select("answer_id", "position", "source"))


@query(f"SELECT conv_id || '-' || turn AS answer_id, min(pos) AS position, source FROM ({_CITED}) GROUP BY ALL")
def citation_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of citations of one source in an answer the first."""
    return evidence.first_identities(_cited(spark, sf_dir).select("answer_id", "position", "source"), ["answer_id", "source"])


@query(f"SELECT item_id AS query_id, string_agg(term, ' ' ORDER BY term) AS terms FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) WHERE term NOT IN ({_TERMS}) GROUP BY 1")
def lexical_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct terms of any script that each item asks for."""
    terms = search.lexical_terms(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return terms.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("terms"))


@query("SELECT source, count(*) AS n_documents, count(l.doc_id) AS n_labelled, count(*) FILTER (WHERE n_chars < 100) AS n_tiny, round(count(*) FILTER (WHERE n_chars < 100) / count(*), 6) AS tiny_share, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def corpus_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source holds, and ratios that tell of trouble."""
    d = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    n, tiny = F.count(F.lit(1)), F.count_if(F.col("n_chars") < 100)
    return d.groupBy("source").agg(n.alias("n_documents"), F.count("l").alias("n_labelled"), tiny.alias("n_tiny"), F.round(tiny / n, 6).alias("tiny_share"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 5) AS norm, len(embedding) = 64 AS valid FROM embeddings")
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of all vectors, and whether each is fit for the index."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(norm(e), 5).alias("norm"), valid(e, 64).alias("valid"))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'partial' WHEN quality = 1 THEN 'complete' ELSE 'not_assessed' END AS coverage_status FROM labels")
def status_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictory states of coverage made one."""
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf_dir, "labels").select("doc_id", F.when(good & bad, "partial").when(good, "complete").otherwise("not_assessed").alias("coverage_status"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE lower(o_orderstatus) END AS status, o_orderstatus = 'P' AS changed FROM orders")
def interrupted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that were running are failed; the others stay as they are."""
    running = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(running, "failed").otherwise(F.lower("o_orderstatus")).alias("status"), running.alias("changed"))


@query("SELECT user_id, event_id, event_type, done FROM (SELECT *, max(event_id) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id, CAST(ts AS DATE)) = event_id AS done FROM events) WHERE event_type = 'click'")
def trace_last_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result goes to the last step of its tool: each user's last click of a day."""
    clicks = table(spark, sf_dir, "events").filter("event_type = 'click'").select("user_id", "event_id", "event_type", F.to_date("ts").alias("day"))
    last = F.max("event_id").over(W.partitionBy("user_id", "day"))
    return clicks.select("user_id", "event_id", "event_type", (F.col("event_id") == last).alias("done"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS tiers FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY 1")
def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of evidence in the order in which each user first brought one."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    order = F.array_sort(F.collect_list(F.struct("first", "event_type")))  # as many as there are kinds
    return first.groupBy("user_id").agg(F.array_join(F.transform(order, lambda x: x["event_type"]), ",").alias("tiers"))


@query("SELECT conv_id, turn, role FROM (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS u FROM conversations) WHERE role <> 'system' AND (turn >= u OR role = 'user')")
def current_turn_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of a conversation, and whatever came since the latest."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    asked = said.filter("role = 'user'").groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("u"))
    met = said.filter("role <> 'system'").join(asked, said["conv_id"] == asked["c"])
    return met.filter("turn >= u or role = 'user'").select("conv_id", "turn", "role")


@query("SELECT lower(regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g')) AS slug, count(*) AS n, left(min(source), 4) || '...' AS hint FROM documents GROUP BY 1")
def provider_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers made of names."""
    d = table(spark, sf_dir, "documents").select("source")
    slug = F.lower(F.regexp_replace("source", "[^A-Za-z0-9]+", "_"))
    return d.groupBy(slug.alias("slug")).agg(F.count(F.lit(1)).alias("n"), F.concat(F.left(F.min("source"), F.lit(4)), F.lit("...")).alias("hint"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, json_keys(props)[1] AS k FROM events)")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field of each event's JSON, read tolerantly."""
    e = table(spark, sf_dir, "events").select("event_id", "props", F.get(F.json_object_keys("props"), F.lit(0)).alias("k"))
    return e.select("event_id", F.expr("get_json_object(props, concat('$.', k))").alias("value"))


@query("SELECT l_orderkey, sum(l_quantity) AS tokens, sum(l_quantity) + 16 * count(*) + 40 <= 200 AS fits FROM lineitem GROUP BY 1")
def prompt_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether messages with their overheads fit a window."""
    total = F.sum("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(total.alias("tokens"), (total + 16 * F.count(F.lit(1)) + 40 <= 200).alias("fits"))


@query("SELECT doc_id, len(items) AS n_items, items[1] AS first_item FROM (SELECT doc_id, list_filter(list_transform(string_split(text, CASE WHEN contains(text, chr(10)) THEN chr(10) WHEN contains(text, ';') THEN ';' ELSE ',' END), lambda x: trim(x)), lambda x: x <> '') AS items FROM documents)")
def list_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text read as a list: its number of items and the first."""
    items = tx.string_list(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(items).cast("long").alias("n_items"), F.get(items, F.lit(0)).alias("first_item"))


@query("SELECT o_custkey AS query_id, o_orderkey AS id, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 10")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ten jobs of each owner."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return search.top_k(jobs, ["query_id"], [F.desc("o_orderdate"), "id"], 10).select("query_id", "id", "rank")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, means and counts by two states, from a scan that reads seven columns and filters first."""
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count(F.lit(1)).alias("n"),
    )
