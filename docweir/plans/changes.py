"""Duplicates, fingerprints, merges and upserts over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import dedup, merge
from . import query, table

_NORM = r"sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"


@query(f"SELECT {_NORM} AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that differ in case and spacing at most."""
    return dedup.duplicate_groups(table(spark, sf_dir, "documents"), tx.normalized_hash(F.col("text")), "doc_id")


@query("SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) = 1 AS keep FROM documents")
def exact_dup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the first is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("hash"))
    return dedup.keep_best(docs, F.col("hash"), [-F.col("n_chars"), F.col("doc_id")]).select("doc_id", "keep")


@query("SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5('{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}'), 1, 12) AS BIGINT)) AS DECIMAL(38,0)) AS digest FROM orders")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free digest of a table."""
    return dedup.fingerprint(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


_CANON = """lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1))
 || CASE WHEN regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') END
 || CASE WHEN contains(u, '?') AND length(regexp_extract(u, '\\?(.*)$', 1)) > 0 THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '')), '&') ELSE '' END"""
_PAGES = "(SELECT page_id, url, html, regexp_replace(url, '#.*$', '') AS u FROM pages)"


@query(f"SELECT page_id, {_CANON} AS canonical_url, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM {_PAGES}")
def url_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form and host of every crawled url."""
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"), urls.host(F.col("url")).alias("host"))


@query("SELECT page_id, regexp_matches(lower(url), '^https?://([a-z0-9.-]*\\.)?(example\\.org|thering\\.example\\.net)([/?#:]|$)') AS allowed FROM pages")
def url_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each url is on an allowed domain or below one."""
    return table(spark, sf_dir, "pages").select("page_id", urls.allowed(F.col("url"), ["example.org", "thering.example.net"]).alias("allowed"))


def _crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A state of the pages with https, those of mobile hosts with an older hash, and a batch of the pages that aren't Spanish."""
    pages = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("ordinal"), F.lit(None).cast("string").alias("title"), F.col("html").alias("markdown"))
    first = merge.first_of_batch(pages.filter(F.startswith("url", F.lit("https:"))))
    mobile = F.contains("canonical_url", F.lit("://m."))
    state = first.select(
        "canonical_url", "title", F.when(mobile, F.lit("older")).otherwise(F.col("content_hash")).alias("content_hash"), F.lit(1).alias("current_version"),
        F.lit("ACTIVE").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("last_seen"), F.lit(None).cast("timestamp").alias("missing_since"),
    )
    return state, pages.filter(~F.contains("url", F.lit("/es/")))


_STATE = f"""f AS (SELECT c, arg_min(html, page_id) AS h FROM (SELECT {_CANON} AS c, page_id, html FROM {_PAGES} WHERE starts_with(url, 'https:')) GROUP BY 1),
 b AS (SELECT c, arg_min(html, page_id) AS h FROM (SELECT {_CANON} AS c, page_id, html FROM {_PAGES} WHERE NOT contains(url, '/es/')) GROUP BY 1),
 s AS (SELECT c, CASE WHEN contains(c, '://m.') THEN 'older' ELSE h END AS h FROM f),
 m AS (SELECT coalesce(s.c, b.c) AS canonical_url, CASE WHEN s.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'missing' WHEN s.h <> b.h THEN 'updated' ELSE 'unchanged' END AS change FROM s FULL JOIN b ON s.c = b.c)"""


@query(f"WITH {_STATE} SELECT canonical_url, change, CASE change WHEN 'updated' THEN 2 ELSE 1 END AS current_version, CASE change WHEN 'missing' THEN 'MISSING' ELSE 'ACTIVE' END AS status FROM m")
def cdc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a crawl batch was merged, missing pages marked."""
    state, batch = _crawled(spark, sf_dir)
    merged = merge.sync(state, batch, F.lit("2024-06-01").cast("timestamp"), mark_missing=True)
    return merged.select("canonical_url", "change", "current_version", "status")


@query(f"WITH {_STATE} SELECT change, count(*) AS n FROM m GROUP BY 1")
def cdc_merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages a batch added, updated, left unchanged and missed."""
    return cdc_merge(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STATE} SELECT canonical_url, CASE change WHEN 'updated' THEN 2 ELSE 1 END AS version FROM m WHERE change IN ('added', 'updated')")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version rows that a batch adds to the history."""
    state, batch = _crawled(spark, sf_dir)
    return merge.new_versions(merge.sync(state, batch, F.lit("2024-06-01").cast("timestamp"))).select("canonical_url", "version")


_NEW = "(SELECT doc_id, CASE WHEN toxic = 1 THEN 'xx' END AS lang, quality AS n FROM labels)"


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").alias("n"))
    return docs, table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "xx").alias("lang"), F.col("quality").cast("long").alias("n"))


@query(f"SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.lang, o.lang) AS lang, coalesce(n.n, o.n_chars) AS n FROM documents o FULL JOIN {_NEW} n ON o.doc_id = n.doc_id")
def upsert_keep_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert of the labels into the documents in which null changes nothing."""
    docs, new = _labelled(spark, sf_dir)
    return merge.upsert(docs, new, ["doc_id"], keep_empty=True)


@query(f"SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.lang ELSE o.lang END AS lang, CASE WHEN n.doc_id IS NOT NULL THEN n.n ELSE o.n_chars END AS n FROM documents o FULL JOIN {_NEW} n ON o.doc_id = n.doc_id")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert in which every new value wins, nulls too."""
    docs, new = _labelled(spark, sf_dir)
    return merge.upsert(docs, new, ["doc_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT DISTINCT -o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def replace_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the groups that the new rows mention give way to them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = orders.filter("o_orderstatus = 'P'").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey")
    return merge.replace_groups(orders.drop("o_orderstatus"), new, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the current table doesn't have are added; the others stay."""
    return merge.insert_unseen(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows that are left when their parents are deleted."""
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    left = merge.delete_cascade(gone, "l_orderkey", {"lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey")})["lineitem"]
    return left.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n.doc_id AS id, coalesce(u.id, h.id) AS existing_id, CASE WHEN u.id IS NOT NULL THEN 'url' WHEN h.id IS NOT NULL THEN 'hash' ELSE 'none' END AS matched_by FROM documents n LEFT JOIN (SELECT lang || n_chars AS s, min(doc_id) AS id FROM documents WHERE source = 'src0' GROUP BY 1) u ON n.lang || n.n_chars = u.s LEFT JOIN (SELECT sha256(text) AS s, min(doc_id) AS id FROM documents WHERE source = 'src0' GROUP BY 1) h ON sha256(n.text) = h.s WHERE n.source <> 'src0'")
def import_dedup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rows of other sources repeat of the first one's: by address (language and length) first, then by content."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("lang", F.col("n_chars").cast("string")).alias("url"), F.sha2("text", 256).alias("hash"), "source")
    return dedup.import_matches(docs.filter("source <> 'src0'"), docs.filter("source = 'src0'")).select("id", "existing_id", "matched_by")
