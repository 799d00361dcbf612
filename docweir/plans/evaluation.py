"""Retrieval metrics and audits over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, metrics, search
from . import query, table
from .retrieval import _COS, _vectors

_N = f"n AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS ql, v.label, {_COS} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k nearest others of every twentieth vector with both labels."""
    v = _vectors(spark, sf_dir)
    asking = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = search.batch_knn(v, asking, k, exclude_self=True)
    return found.join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")


@query(f"WITH {_N}, g AS (SELECT query_id, CAST(id % 3 AS INT) AS group_id, min(rank) FILTER (WHERE rank <= 20) AS rank FROM n WHERE label = ql GROUP BY ALL) SELECT query_id, max(coalesce((rank <= 5)::DOUBLE, 0)) AS hit_5, round(avg(coalesce((rank <= 5)::DOUBLE, 0)), 9) AS coverage_5, min(coalesce((rank <= 5)::DOUBLE, 0)) AS complete_5, max(coalesce((rank <= 20)::DOUBLE, 0)) AS hit_20, round(avg(coalesce((rank <= 20)::DOUBLE, 0)), 9) AS coverage_20, round(CASE WHEN min(rank) <= 10 THEN 1 / min(rank) ELSE 0 END, 9) AS rr_10 FROM g GROUP BY 1")
def retrieval_metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of evidence groups: vectors of a query's label, in three groups, any of which proves its group."""
    v = _vectors(spark, sf_dir).select("id", "label")
    asking = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "label")
    groups = asking.join(v, "label").filter("id <> query_id").select("query_id", (F.col("id") % 3).cast("int").alias("group_id"), "id")
    scored = metrics.group_scores(_ranked(spark, sf_dir, 20).select("query_id", "id", "rank"), groups)
    return scored.select("query_id", "hit_5", F.round("coverage_5", 9).alias("coverage_5"), "complete_5", "hit_20", F.round("coverage_20", 9).alias("coverage_20"), F.round("rr_10", 9).alias("rr_10"))


@query(f"WITH {_N}, f AS (SELECT query_id, ql, min(rank) FILTER (WHERE rank <= 20 AND label = ql) AS first FROM n GROUP BY ALL) SELECT ql AS label, count(*) AS n, round(avg(coalesce((first <= 5)::INT, 0)), 9) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1 / first ELSE 0 END), 9) AS mrr FROM f GROUP BY 1")
def label_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and mean reciprocal rank of finding a vector of the same label, by label."""
    ranked = _ranked(spark, sf_dir, 20)
    gold = ranked.select("query_id", "ql", "id", F.col("label") == F.col("ql"))
    first = metrics.label_scores(ranked.select("query_id", "id", "rank"), ranked.filter("label = ql").select("query_id", "id"))
    every = gold.select("query_id", "ql").distinct().join(first, "query_id", "left")
    return every.groupBy(F.col("ql").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("hit_5", F.lit(0))), 9).alias("recall_5"), F.round(F.avg(F.coalesce("rr_10", F.lit(0.0))), 9).alias("mrr"))


@query("SELECT b.item_id AS quote_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def anchor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item word for word."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("corpus").alias("document"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "text")
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.lit("corpus").alias("document"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.col("text").alias("quote"))
    return metrics.resolve_anchors(quotes, docs)


@query("SELECT CAST(min(n_chars) FILTER (WHERE quality = 1) AS DOUBLE) AS least_yes, round(avg(n_chars) FILTER (WHERE quality = 1), 6) AS mean_yes, CAST(max(n_chars) FILTER (WHERE quality = 0) AS DOUBLE) AS most_no, round(avg(n_chars) FILTER (WHERE quality = 0), 6) AS mean_no, min(n_chars) FILTER (WHERE quality = 1) <= max(n_chars) FILTER (WHERE quality = 0) AS overlap, (min(n_chars) FILTER (WHERE quality = 1) + max(n_chars) FILTER (WHERE quality = 0)) / 2 AS threshold FROM documents JOIN labels USING (doc_id)")
def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where scores of two classes part."""
    cases = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")).join(table(spark, sf_dir, "labels"), "doc_id")
    out = metrics.calibrate(cases.select((F.col("quality") == 1).alias("sufficient"), "score"))
    return out.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("least_yes", "mean_yes", "most_no", "mean_no")), "overlap", "threshold")


@query(f"WITH {_N} SELECT query_id, (max(-distance) FILTER (WHERE label = ql) > max(-distance) FILTER (WHERE label <> ql))::INT AS top1, round(max(-distance) FILTER (WHERE label = ql) - max(-distance) FILTER (WHERE label <> ql), 5) AS margin FROM n WHERE rank <= 30 GROUP BY 1")
def label_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the nearest vector of the same label leads the nearest of another."""
    ranked = _ranked(spark, sf_dir, 30).select("query_id", (-F.col("distance")).alias("score"), (F.col("label") == F.col("ql")).alias("relevant"))
    # as the SQL rounds: the product is, not the decimal
    return metrics.margins(ranked).select("query_id", "top1", (F.round(F.col("margin") * 100_000, 0) / 100_000).alias("margin"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM documents a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def membership_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that one of two tables lacks."""
    return metrics.mismatches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT sha256(text) AS leakage_group, count(DISTINCT source) AS n_splits FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts that stand in more than one source."""
    return metrics.split_leaks(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("leakage_group"), F.col("source").alias("split")))


@query("SELECT query_id, label, distance FROM (SELECT v.vec_id AS query_id, c.label, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], c.centre), 6) AS distance, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(1 - list_cosine_similarity(v.embedding::DOUBLE[], c.centre), 6), c.label) AS r FROM embeddings v, (SELECT label, embedding::DOUBLE[] AS centre FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) c) WHERE r = 1")
def nearest_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest label, a label being its first vector; labels are a fixed few."""
    v = _vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min_by("embedding", "id").alias("embedding")).select(F.col("label").alias("id"), "embedding")
    found = search.nearest_of(v.select(F.col("id").alias("query_id"), "embedding"), first)
    return found.select("query_id", F.col("id").alias("label"), "distance")


@query()
def evidence_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest sets of events that prove each user's needs, a need being an event type and a bundle an hour of it."""
    e = table(spark, sf_dir, "events")
    bundles = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("requirement"), F.date_trunc("hour", "ts").cast("string").alias("bundle"), F.col("event_id").alias("id"), F.length("props").alias("tokens"))
    return evidence.evidence_sets(bundles)


@query("WITH RECURSIVE g AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS b FROM (SELECT DISTINCT event_type FROM events)), m AS (SELECT user_id, bit_or(1::BIGINT << b) AS mask FROM events JOIN g USING (event_type) GROUP BY user_id, CAST(ts AS DATE)), d AS (SELECT DISTINCT * FROM m), f AS (SELECT user_id, bit_or(mask) AS whole FROM m GROUP BY 1), r AS (SELECT user_id, 0::BIGINT AS mask, 0 AS n FROM f UNION SELECT r.user_id, r.mask | d.mask, r.n + 1 FROM r JOIN d ON r.user_id = d.user_id JOIN f ON f.user_id = r.user_id WHERE r.mask <> f.whole AND r.n < 6) SELECT user_id AS query_id, min(n) AS n_cover FROM r JOIN f USING (user_id) WHERE mask = whole GROUP BY 1")
def minimum_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest days that hold an event of each type for each user."""
    e = table(spark, sf_dir, "events")
    return metrics.minimum_covers(e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("group_id"), F.to_date("ts").cast("string").alias("id")).distinct())


@query("WITH a AS (SELECT user_id, bool_or(value > 40) AS c FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, bool_or(value > 40) AS c FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id AS query_id, CASE WHEN a.c IS NULL THEN 'new' WHEN b.c IS NULL THEN 'gone' WHEN NOT a.c AND b.c THEN 'recovered' WHEN a.c AND NOT b.c THEN 'regressed' WHEN b.c THEN 'kept' ELSE 'open' END AS state FROM a FULL JOIN b USING (user_id)")
def replay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each case from one run to the next."""
    e = table(spark, sf_dir, "events")
    run = lambda odd: e.filter(F.col("event_id") % 2 == odd).groupBy(F.col("user_id").alias("query_id")).agg(F.bool_or(F.col("value") > 40).alias("complete"))
    return metrics.replay_states(run(0), run(1))


@query("SELECT item_id AS quote_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def anchors_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that no document holds word for word."""
    return metrics.unresolved_anchors(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id")), anchor_resolution(spark, sf_dir))
