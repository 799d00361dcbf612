"""Search and selection over the test tables: benchmark items ask, documents and vectors answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import dedup, lexical, metric, postings, search, selection, stemming
from . import query, table

STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)


def _bm25_sql() -> str:
    return f"""
    SELECT query_id, id, round(sum(part), 6) AS score FROM (
      SELECT q.query_id, tf.id, ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.length / s.mean)) AS part
      FROM (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(words) AS length, unnest(words) AS term FROM w) GROUP BY ALL) tf
      JOIN (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(words) AS term FROM w) GROUP BY term) d USING (term)
      JOIN q USING (term), (SELECT count(*) AS n, avg(len(words)) AS mean FROM w) s
    ) GROUP BY ALL"""


_TERMS = f"q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) WHERE term NOT IN ({STOP}))"
_WORDS = "w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query_terms(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def _by_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_docs(spark, sf_dir), _terms(spark, sf_dir), 20, {"bm25": lexical.bm25_rate})["bm25"]


@query(f"WITH {_TERMS}, {_WORDS}, s AS ({_bm25_sql()}) SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item by BM25."""
    return _by_bm25(spark, sf_dir).select("query_id", "id", "score", "rank")


@query(f"WITH {_TERMS}, {_WORDS}, s AS ({_bm25_sql()}) SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for each benchmark item, from a stored index whose blocks are skipped where they can't matter."""
    return postings.search(postings.build(_docs(spark, sf_dir)), _terms(spark, sf_dir), 5).select("query_id", "id", "score", "rank")


_FUSED = f"""WITH {_TERMS}, {_WORDS},
 a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_bm25_sql()})),
 o AS (SELECT query_id, id, count(*) AS overlap FROM (SELECT DISTINCT id, unnest(words) AS term FROM w) JOIN q USING (term) GROUP BY ALL),
 b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, id) AS rank FROM o),
 f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, count(*) AS n_sources, max(CASE WHEN src = 0 THEN rank END) AS bm25_rank, max(CASE WHEN src = 1 THEN rank END) AS overlap_rank
       FROM (SELECT 0 AS src, * FROM a WHERE rank <= 20 UNION ALL SELECT 1, * FROM b WHERE rank <= 20) GROUP BY ALL)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _terms(spark, sf_dir)
    # both rankings are made of one pass over the texts
    both = search.fuse(lexical.ranked(_docs(spark, sf_dir), terms, 20, {"bm25": lexical.bm25_rate, "overlap": None}))
    return both.withColumn("rrf_score", F.round("rrf_score", 9))


@query(f"{_FUSED} SELECT * FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexical rankings for each benchmark item, by BM25 and by distinct terms held, fused by reciprocal ranks."""
    return fused(spark, sf_dir)


@query(
    f"""{_FUSED}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(bm25_rank, 1000), id) AS position FROM f),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, position) AS rrf_rank FROM c WHERE position <= 15),
 s AS (SELECT *, round(0.25 / position + 0.75 / rrf_rank, 9) AS blend FROM p),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, position, id DESC) AS n FROM s)
 SELECT query_id, id, position AS rerank_rank, rrf_rank, blend, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank FROM t WHERE n <= 5"""
)
def rank_blend_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each item's first fifteen candidates by a blend of their ranks."""
    order = W.partitionBy("query_id").orderBy(F.coalesce("bm25_rank", F.lit(1000)), "id")
    candidates = fused(spark, sf_dir).withColumn("position", F.row_number().over(order))
    return selection.blend_ranks(candidates, 5, 15).select("query_id", "id", "rerank_rank", "rrf_rank", "blend", "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_COS = "round(1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"


@query(f"SELECT query_id, id, distance, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 10")
def batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth one, exactly."""
    v = _vectors(spark, sf_dir)
    asking = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return search.batch_knn(v, asking, 10).select("query_id", "id", "distance", "rank")


@query(f"SELECT v.vec_id AS id, v.label, {_COS} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY distance, id LIMIT 25")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 vectors nearest to one, by expressions alone: the sort keeps 25 rows a task."""
    from ..functions.vectors import distance

    v = _vectors(spark, sf_dir)
    one = v.filter("id = 7").select(F.col("embedding").alias("q"))
    near = v.join(F.broadcast(one)).select("id", "label", F.round(distance(F.col("q"), F.col("embedding")), 6).alias("distance"))
    return near.orderBy("distance", "id").limit(25)


@query(f"SELECT query_id, id, distance FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id <> v.vec_id AND q.vec_id % 20 = 0) WHERE rank <= 5 AND distance <= 0.6")
def near_vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every twentieth vector the five nearest others that are within a distance."""
    v = _vectors(spark, sf_dir)
    asking = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return dedup.near_pairs(v, asking, 5, 0.6).select("query_id", "id", "distance")


@query(
    f"""WITH RECURSIVE l AS MATERIALIZED (SELECT q.vec_id AS a, v.vec_id AS b FROM embeddings q, embeddings v WHERE q.vec_id <> v.vec_id AND {_COS} <= 0.05),
 r(node, root) AS (SELECT a, b FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.root)
 SELECT vec_id AS id, least(vec_id, coalesce((SELECT min(root) FROM r WHERE node = vec_id), vec_id)) AS class_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links FROM embeddings"""
)
def near_vector_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's class of near duplicates and its number of links, over all pairs within 0.05."""
    return metric.within(_vectors(spark, sf_dir).select("id", "embedding"), 0.05)


@query(
    f"""WITH n AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS} AS distance, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
 SELECT query_id, 'section:' || label AS context_id, max(-distance) AS score, count(*) AS n_children, min(rank) AS first_position FROM n WHERE rank <= 12 GROUP BY ALL"""
)
def parent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors joined by their label as the section that they stand in."""
    found = batch_knn_wide(spark, sf_dir)
    children = found.select("query_id", "id", F.col("label").cast("string").alias("section_id"), F.lit(100).alias("section_tokens"), F.lit(None).cast("double").alias("score"), "distance", F.col("rank").alias("position"))
    return selection.parents(children)


def batch_knn_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    asking = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return search.batch_knn(v, asking, 12).join(v.select("id", "label"), "id")


@query(
    f"""WITH n AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS} AS distance, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
 c AS (SELECT query_id, id, distance, CASE WHEN label = 3 THEN NULL ELSE label - 5.0 END AS score, repeat('x', 30) AS text FROM n WHERE rank <= 12 AND rank > 1),
 s AS (SELECT query_id, sum(length(text)) AS chars, min(distance) AS nearest, max(score) AS best FROM c GROUP BY 1)
 SELECT query_id, reason = 'sufficient' AS sufficient, reason FROM (SELECT query_id, CASE WHEN chars < 200 THEN 'context too short' WHEN nearest > 0.55 THEN 'too distant' WHEN best < 1 THEN 'scored too low' ELSE 'sufficient' END AS reason FROM s)"""
)
def gate_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was found for each query is enough to answer from."""
    found = batch_knn_wide(spark, sf_dir).filter("rank > 1")
    score = F.when(F.col("label") != 3, F.col("label") - 5.0)
    return selection.sufficiency(found.select("query_id", "distance", score.alias("score"), F.lit("x" * 30).alias("text")), 0.55, 1.0)


@query(
    f"""{_FUSED.replace("WITH ", "WITH RECURSIVE ", 1)},
 k AS MATERIALIZED (SELECT query_id, CAST(id AS VARCHAR) AS context_id, source AS document, CAST(floor(strlen(text) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, CAST(id AS VARCHAR)) AS n FROM f JOIN documents ON doc_id = id),
 g(query_id, n, used, cnt, docs, reason) AS (SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, 0, []::VARCHAR[], '' FROM k
  UNION ALL SELECT query_id, n, CASE WHEN why = 'packed' THEN used + tokens ELSE used END, CASE WHEN why = 'packed' THEN cnt + 1 ELSE cnt END, CASE WHEN why = 'packed' THEN list_append(docs, document) ELSE docs END, why
  FROM (SELECT k.query_id, k.n, used, cnt, docs, tokens, document, CASE WHEN cnt >= 8 THEN 'over the cap' WHEN len(list_filter(docs, lambda x: x = document)) >= 2 THEN 'over the document''s cap' WHEN used + tokens > 6000 THEN 'over the budget' ELSE 'packed' END AS why FROM g JOIN k ON k.query_id = g.query_id AND k.n = g.n + 1)),
 p AS MATERIALIZED (SELECT * FROM g WHERE n > 0),
 l AS MATERIALIZED (SELECT p.query_id, p.n, tokens, row_number() OVER (PARTITION BY p.query_id ORDER BY p.n) AS j FROM p JOIN k USING (query_id, n) WHERE reason = 'over the document''s cap'),
 h(query_id, j, used, cnt, fits) AS (SELECT query_id, 0::BIGINT, arg_max(used, n), arg_max(cnt, n), false FROM p GROUP BY query_id
  UNION ALL SELECT query_id, j, CASE WHEN ok THEN used + tokens ELSE used END, CASE WHEN ok THEN cnt + 1 ELSE cnt END, ok FROM (SELECT l.query_id, l.j, used, cnt, tokens, cnt < 8 AND used + tokens <= 6000 AS ok FROM h JOIN l ON l.query_id = h.query_id AND l.j = h.j + 1))
 SELECT p.query_id, context_id, n AS place, CASE WHEN fits THEN 'packed late' ELSE reason END AS reason FROM p JOIN k USING (query_id, n) LEFT JOIN l USING (query_id, n) LEFT JOIN h USING (query_id, j)"""
)
def pack_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused documents packed into each item's context under a token budget."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), F.floor(F.octet_length("text") / 4).cast("int").alias("tokens"))
    found = fused(spark, sf_dir).join(docs, "id")
    blocks = found.select("query_id", F.col("id").cast("string").alias("context_id"), "document_id", "tokens", F.col("rrf_score").alias("score"))
    return selection.pack_contexts(blocks, 6000, 8, 2, backfill=True)


@query(
    f"""{_FUSED}, c AS (SELECT query_id, id, source AS unit, rrf_score, coalesce(bm25_rank, 1000) * 100 + coalesce(overlap_rank, 99) AS position FROM f JOIN documents ON doc_id = id),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position, id) AS p FROM c),
 m AS (SELECT *, p <= 6 AS kept, bool_or(p <= 6) OVER (PARTITION BY query_id, unit) AS has, row_number() OVER (PARTITION BY query_id, unit, p <= 6 ORDER BY rrf_score DESC, position, id) = 1 AS first FROM p),
 r AS (SELECT *, NOT kept AND NOT has AND first AS fresh, row_number() OVER (PARTITION BY query_id ORDER BY kept DESC, CASE WHEN kept THEN p END, (NOT kept AND NOT has AND first) DESC, rrf_score DESC, position, id) AS rank FROM m)
 SELECT query_id, id, rank, CASE WHEN kept THEN 'protected' WHEN fresh THEN 'new section' ELSE 'same section' END AS reason FROM r WHERE rank <= 10"""
)
def backfilled_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused documents, the first few protected, then one of each source not seen yet."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("unit"))
    found = fused(spark, sf_dir).withColumn("position", F.coalesce("bm25_rank", F.lit(1000)) * 100 + F.coalesce("overlap_rank", F.lit(99)))
    return selection.protected_backfill(found.join(docs, "id"), 10)


_HYBRID = f"""WITH {_TERMS}, {_WORDS},
 l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_bm25_sql()})),
 d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT doc_id FROM documents)),
 f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, count(*) AS n_sources, max(CASE WHEN src = 0 THEN rank END) AS dense_rank, max(CASE WHEN src = 1 THEN rank END) AS lexical_rank
       FROM (SELECT 0 AS src, * FROM d WHERE rank <= 20 UNION ALL SELECT 1, * FROM l WHERE rank <= 20) GROUP BY ALL)
 SELECT f.*, {_COS} AS distance FROM f LEFT JOIN embeddings q ON q.vec_id = query_id LEFT JOIN embeddings v ON v.vec_id = id"""


@query(_HYBRID)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for each benchmark item by words and by vectors (an item's is that of its number), fused."""
    v, items = _vectors(spark, sf_dir).select("id", "embedding"), table(spark, sf_dir, "benchmark").select("item_id")
    asked = items.join(v, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), "embedding")
    return search.hybrid(_docs(spark, sf_dir), v, _terms(spark, sf_dir), asked, 20)


@query(
    f"""WITH n AS (SELECT * FROM documents WHERE doc_id % 10 = 3), k AS (SELECT * FROM documents WHERE doc_id % 10 <> 3),
 u AS (SELECT source || lang AS url, min(doc_id) AS m FROM k WHERE doc_id % 100 = 1 GROUP BY 1), h AS (SELECT sha256(text) AS hash, min(doc_id) AS m FROM k GROUP BY 1),
 v AS (SELECT q.vec_id AS query_id, min_by(v.vec_id, ({_COS}, v.vec_id)) AS m, min({_COS}) AS d FROM embeddings q, embeddings v WHERE q.vec_id % 10 = 3 AND v.vec_id IN (SELECT doc_id FROM k) GROUP BY 1)
 SELECT doc_id AS id, coalesce(u.m, h.m, CASE WHEN d <= 0.62 THEN v.m END) AS existing_id, CASE WHEN u.m IS NOT NULL THEN 'url' WHEN h.m IS NOT NULL THEN 'hash' WHEN d <= 0.62 THEN 'vector' ELSE 'none' END AS matched_by
 FROM n LEFT JOIN u ON u.url = source || lang LEFT JOIN h ON h.hash = sha256(text) LEFT JOIN v ON v.query_id = doc_id"""
)
def import_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents that a library has by url, by text, or nearly by vector."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", "lang").alias("url"), F.sha2("text", 256).alias("hash"))
    known = d.filter("id % 10 <> 3").withColumn("url", F.when(F.col("id") % 100 == 1, F.col("url")))
    return dedup.import_chain(d.filter("id % 10 = 3"), known, _vectors(spark, sf_dir).select("id", "embedding"), 0.62).select("id", "existing_id", "matched_by")


@query("SELECT user_id AS query_id, event_id AS id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value END AS score FROM events WHERE event_type <> 'view')) WHERE rank <= 8")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with text by a model's scores, of which some are missing."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "event_type", F.col("value").alias("score"))
    text = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    return search.rerank(e.select("query_id", "id", F.col("id").alias("position"), text.alias("text")), e.filter("id % 4 > 0").select("query_id", "id", "score"), 8)


@query("WITH l AS (SELECT c_custkey AS owner, n_name AS label, p FROM customer, (VALUES (0, 0), (1, 3), (2, 0)) v(p, step) JOIN nation ON n_nationkey = (c_custkey + step) % 40 WHERE n_nationkey < 25) SELECT c_custkey AS owner, coalesce((SELECT string_agg(label, ',' ORDER BY p) FROM (SELECT label, min(p) AS p FROM l WHERE l.owner = c_custkey GROUP BY label)), 'Other') AS labels FROM customer")
def labels_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that free names stand for, Other where there is none."""
    c, names = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    asked = c.select(F.col("c_custkey").alias("owner"), F.posexplode(F.array(F.lit(0), F.lit(3), F.lit(0))).alias("position", "step"))
    named = asked.withColumn("key", (F.col("owner") + F.col("step")) % 40).join(names, F.col("key") == F.col("n_nationkey"), "left")
    values = named.select("owner", "position", F.concat(F.lit(" "), F.lower(F.coalesce("n_name", F.lit("none")))).alias("value"))
    return search.exact_labels(values, names.select(F.col("n_name").alias("label"))).select("owner", F.array_join("labels", ",").alias("labels"))


@query()
def stemmed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item over stems; the stemmer has no SQL."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return stemming.stemmed_ranked(_docs(spark, sf_dir), items, 20)
