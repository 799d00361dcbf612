"""Texts of the test tables: excerpts, languages, structure, chunks, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import chunking, graph, html, language, structure
from . import query, table


@query("SELECT doc_id, CASE WHEN length(f) <= 120 THEN f ELSE rtrim(left(f, 117)) || '...' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed beginnings of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.preview(F.col("text"), 120).alias("preview"))


@query("SELECT doc_id, CASE WHEN length(text) <= 1600 THEN text ELSE left(text, 900) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || substr(text, CAST(floor((length(text) - 500) / 2.0) AS BIGINT) + 1, 500) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 200) END AS excerpt FROM documents")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, middle and tail of long documents."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.excerpt(F.col("text"), 900, 500, 200).alias("excerpt"))


@query("SELECT doc_id, idx AS span, trim(s) AS text FROM (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS idx FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS parts FROM documents)) WHERE trim(s) <> ''")
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and lines of all documents, numbered with gaps kept."""
    spans = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("span", "text"))
    return spans.filter("text <> ''")


@query("SELECT doc_id, lang, CASE WHEN regexp_replace(coalesce(t, ''), '\\s+', '', 'g') = '' THEN NULL WHEN regexp_matches(t, '[Ѐ-ӿ]') THEN 'Bulgarian' WHEN regexp_matches(t, 'transformaci|polit|digitalizaci') THEN 'Spanish' WHEN regexp_matches(t, 'strat|numer|gouvernance') THEN 'French' ELSE 'English' END AS guess FROM (SELECT doc_id, lang, lower(left(text, 20000)) AS t FROM documents)")
def language_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First guesses of all documents' languages, by the beginning of each, as the rule says."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", tx.guess_language(F.col("text")).alias("guess"))


@query()
def languages_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' languages by a model of the letters of those that aren't held out; held_out rows tell how good it is."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.train(d.filter(~out).select(F.col("lang").alias("language"), "text"))
    return language.detect(d, model).select("doc_id", "lang", "detected", out.alias("held_out"))


@query(
    """WITH RECURSIVE h AS MATERIALIZED (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS href FROM pages),
 e AS MATERIALIZED (SELECT url AS source, href AS target FROM h UNION SELECT href, url FROM h),
 r(url, depth) AS (SELECT DISTINCT url, 0 FROM pages WHERE contains(url, '/de/') UNION SELECT target, depth + 1 FROM r JOIN e ON source = url WHERE depth < 20)
 SELECT url, min(depth) AS depth FROM r GROUP BY url"""
)
def page_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and menu entries that lead to each other, by the fewest steps from the pages of one language, twenty at most."""
    page = table(spark, sf_dir, "pages")
    held = page.select("url", F.explode(html.hrefs(F.col("html"))).alias("href"))
    links = held.select(F.col("url").alias("source"), F.col("href").alias("target"))
    return graph.reachable(page.filter("contains(url, '/de/')").select("url"), links.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"))), 20)


@query("SELECT source AS doc, key AS line_key, count(DISTINCT doc_id) AS n_pages FROM (SELECT source, doc_id, lower(regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '\\d+', '#', 'g')) AS key, pos, n FROM (SELECT source, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos, len(ls) AS n FROM (SELECT source, doc_id, list_filter(string_split('Journal of Notes, page ' || doc_id || chr(10) || text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents))) JOIN (SELECT source, greatest(3, count(*) // 4) AS needed FROM documents GROUP BY 1) USING (source) WHERE (pos < 3 OR pos >= n - 3) AND length(key) BETWEEN 4 AND 120 GROUP BY source, key, needed HAVING count(DISTINCT doc_id) >= needed")
def repeated_line_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many documents of a source repeat at their edges."""
    text = F.concat(F.lit("Journal of Notes, page "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))  # a running title
    return structure.repeated_margins(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), text.alias("text")))


@query("SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and distinct words of each document, without a shuffle."""
    words = tx.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title, regexp_extract(html, '<html[^>]*\\blang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, len(list_distinct(regexp_extract_all(html, '<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1))) AS n_links FROM pages")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and links of all pages, by expressions alone."""
    page = table(spark, sf_dir, "pages")
    f = html.fields(F.col("html"))
    return page.select("page_id", f["title"].alias("title"), f["lang"].alias("lang"), f["n_paragraphs"].alias("n_paragraphs"), F.size(html.hrefs(F.col("html"))).alias("n_links"))


@query("SELECT page_id, substr(sha256(url), 1, 16) || '/' || substr(sha256('https://files.example/' || page_id || '.pdf?x=1'), 1, 16) || '.pdf' AS path, 'application/pdf' AS mime FROM pages")
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page's attachment is kept."""
    asset = F.concat(F.lit("https://files.example/"), "page_id", F.lit(".pdf?x=1"))
    return table(spark, sf_dir, "pages").select("page_id", urls.asset_path(F.col("url"), asset).alias("path"), urls.mime_type(F.lit("a.pdf")).alias("mime"))


@query("SELECT s.page AS page, count(*) AS n FROM (SELECT unnest(generate_series(2, CAST(ceil(n_chars / 1000.0) AS BIGINT))) AS page FROM documents) s GROUP BY 1")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered follow-up pages of results of each size."""
    pages = table(spark, sf_dir, "documents").select(F.explode(urls.page_numbers(F.col("n_chars"), 1000).cast("array<long>")).alias("page"))
    return pages.groupBy("page").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, string_agg(m, ',') AS numbers FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text || ' [1] and [' || turn || ']', '\\[(\\d+)\\]', 1)) AS m FROM conversations) GROUP BY ALL")
def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation numbers in texts that were given two of them."""
    said = F.concat("text", F.lit(" [1] and ["), F.col("turn").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.citation_numbers(said).cast("array<string>"), ",").alias("numbers"))


@query()
def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as Markdown with their links; parsing is stateful, so without SQL."""
    return html.clean_pages(table(spark, sf_dir, "pages"))


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents; filling a chunk depends on the one before, so without SQL."""
    return chunking.chunk(table(spark, sf_dir, "documents"), 120, 30)


_SOLID = "[^\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@query(f"SELECT doc_id, len(list_distinct(w)) AS n_distinct, true AS fits FROM (SELECT doc_id, regexp_extract_all(text, '{_SOLID}') AS w FROM documents) WHERE len(w) > 0")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunks must keep: all words of a document and no others, and the budget."""
    words = F.regexp_extract_all(F.col("text"), F.lit(_SOLID), 0)
    made = chunking.chunk(table(spark, sf_dir, "documents"), 120, 30).select("doc_id", words.alias("w"), "tokens")
    fits = F.bool_and((F.col("tokens") <= 120) & (F.size("w") == F.col("tokens")))
    return made.groupBy("doc_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("w"))))).cast("long").alias("n_distinct"), fits.alias("fits"))


@query()
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the pages' Markdown with their generation parents."""
    pages = html.clean_pages(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    return structure.generation_parents(structure.sections(pages), 200)
