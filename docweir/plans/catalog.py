"""Relational queries of a document catalogue: documents, chat sessions, jobs and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.search import top_k
from . import query, table

_REPLY = "SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'"


@query("SELECT s.src AS source, coalesce(n, 0) AS n_documents, coalesce(l, 0) AS n_labelled FROM (SELECT DISTINCT source AS src FROM documents) s LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY 1) d ON s.src = d.source LEFT JOIN (SELECT source, count(*) AS l FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) t ON s.src = t.source")
def catalog_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from two pre-aggregated sides, zero where a side has none."""
    docs, labels = table(spark, sf_dir, "documents").drop("text"), table(spark, sf_dir, "labels")
    french = docs.filter("lang = 'fr'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("l"))
    every = docs.select("source").distinct()
    joined = every.join(french, "source", "left").join(toxic, "source", "left")
    return joined.select("source", F.coalesce("n", F.lit(0)).alias("n_documents"), F.coalesce("l", F.lit(0)).alias("n_labelled"))


@query("SELECT doc_id, lang, source, array_to_string(list_filter([CASE WHEN contains(lower(text), 'the') THEN 'text' END, CASE WHEN contains(lower(source), 'the') THEN 'source' END, CASE WHEN contains(lower(lang), 'the') THEN 'lang' END], lambda x: x IS NOT NULL), ',') AS fields FROM documents WHERE (text ILIKE '%the%' OR source ILIKE '%the%' OR lang ILIKE '%the%') AND lang = 'de'")
def catalog_search_match_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language that hold a string in any field, with the fields that do."""
    docs, asked = table(spark, sf_dir, "documents").filter("lang = 'de'"), F.lit("the")
    pattern = tx.like_pattern(asked)
    hit = F.expr("false")
    for c in ("text", "source", "lang"):
        hit = hit | F.ilike(F.col(c), pattern, F.lit("!"))
    fields = tx.match_fields(asked, text=F.col("text"), source=F.col("source"), lang=F.col("lang"))
    return docs.filter(hit).select("doc_id", "lang", "source", F.array_join(fields, ",").alias("fields"))


@query("SELECT d.doc_id, d.source, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0 AND d.lang = 'en' AND d.source = 'src1'")
def visibility_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved documents of one language and source; both filters reach the scan."""
    docs = table(spark, sf_dir, "documents").filter("lang = 'en' and source = 'src1'").select("doc_id", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id"), "doc_id")


@query("SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r > 40 AND r <= 60")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty, longest documents first: a page is the feature, so it has a limit."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM documents WHERE lang <> 'en'")
def catalog_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a filter, and how many pages of twenty they fill."""
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "documents").filter("lang <> 'en'").agg(n.alias("total"), F.ceil(n / 20).alias("pages"))


@query("SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest documents of each source: lateral top-k."""
    return top_k(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 3).select("doc_id", "source", "rank")


@query(f"SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS role, left(arg_max(text, turn), 80) AS preview FROM ({_REPLY}) GROUP BY 1")
def last_message_per_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last message: a maximum, which tasks combine before the shuffle."""
    said = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    last = said.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("t"))
    return last.select("conv_id", "last_turn", "role", F.left("t", F.lit(80)).alias("preview"))


@query(f"SELECT conv_id, turn, role, place FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM ({_REPLY})) WHERE place > n - 4")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two exchanges of each conversation, oldest first."""
    said = table(spark, sf_dir, "conversations").filter("role <> 'system'").select("conv_id", "turn", "role")
    last = top_k(said, ["conv_id"], [F.desc("turn")], 4, "back")
    sizes = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return last.join(sizes, "conv_id").select("conv_id", "turn", "role", (F.col("n") - F.col("back") + 1).cast("long").alias("place"))


@query(f"SELECT conv_id, count(*) AS n_messages, count(*) FILTER (WHERE role = 'user') AS n_user, sum(length(text)) FILTER (WHERE turn >= u) AS chars_since_user FROM (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS u FROM ({_REPLY})) GROUP BY 1")
def turn_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each conversation, and how much was said since its latest question."""
    said = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    asked = said.filter("role = 'user'").groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("u"))
    both = said.join(asked, said["conv_id"] == asked["c"], "left")
    since = F.sum(F.when(F.col("turn") >= F.col("u"), F.length("text"))).cast("long")
    return both.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), since.alias("chars_since_user"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, conditional counts and means by status."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct("user_id").alias("n_users")
    )


@query("SELECT user_id, string_agg(event_type || ':' || event_id, '; ' ORDER BY event_id DESC) AS hint, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY 1")
def recent_clicks_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's five latest events as one hint."""
    recent = top_k(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], [F.desc("event_id")], 5, "r")
    one = F.struct("r", F.concat_ws(":", "event_type", "event_id").alias("t"))
    hint = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "; ")  # five at most
    return recent.groupBy("user_id").agg(hint.alias("hint"), F.count(F.lit(1)).alias("n"))


@query("SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")
def running_crawl_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters over batches: days are aggregated first, so the running sum sees a row a day."""
    from pyspark.sql import Window as W

    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("total", F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)))


@query("SELECT r_name AS parent, string_agg(n_name, ',' ORDER BY n_name) AS children, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def taxonomy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-level tree from its edges, children in order."""
    edges = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return edges.groupBy(F.col("r_name").alias("parent")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("children"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS leaf, r_name AS parent, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def leaf_to_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts carried from leaves to parents; aggregated by leaf before the tree is joined."""
    by = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("b"))
    tree = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return by.join(tree, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("leaf"), F.col("r_name").alias("parent"), "n", F.round("b", 2).alias("balance"))


@query("SELECT count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND d.lang IN ('en', 'fr')")
def has_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existence probe as a semi-join."""
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "fr")).select("doc_id")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL AND d.lang = 'es'")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the other table misses."""
    docs = table(spark, sf_dir, "documents").filter("lang = 'es'").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey, c_name, n_orders, last_order FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_orderkey) AS last_order FROM orders GROUP BY 1 HAVING count(*) > 15) ON c_custkey = o_custkey")
def grouped_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose group passes a condition."""
    big = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderkey").alias("last_order")).filter("n_orders > 15")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "n_orders", "last_order")


@query("SELECT source, round(median(n_chars), 6) AS median_chars, round(avg(n_chars), 6) AS mean_chars, round(avg(n_chars) FILTER (WHERE lang = 'en'), 6) AS mean_en FROM documents GROUP BY 1")
def stage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians, means and conditional means by group."""
    d = table(spark, sf_dir, "documents")
    mean_en = F.avg(F.when(F.col("lang") == "en", F.col("n_chars")))
    return d.groupBy("source").agg(F.round(F.median("n_chars"), 6).alias("median_chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(mean_en, 6).alias("mean_en"))


@query("SELECT lpad(CAST(max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) + 1 AS VARCHAR), 9, '0') AS next_uid FROM customer")
def next_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number after the largest, padded."""
    largest = F.max(F.regexp_extract("c_name", r"([0-9]+)$", 1).cast("long")) + 1
    return table(spark, sf_dir, "customer").agg(F.lpad(largest.cast("string"), 9, "0").alias("next_uid"))


@query("SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - prev > INTERVAL 30 MINUTE OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, s")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond parity: each user's events in sessions with gaps of at most thirty minutes."""
    from pyspark.sql import Window as W

    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("prev", F.lag("ts").over(by))
    new = F.when(F.col("prev").isNull() | (seconds("ts") - seconds("prev") > 1_800_000_000), 1).otherwise(0)
    e = e.withColumn("s", F.sum(new).over(by))
    return e.groupBy("user_id", "s").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")).drop("s")
