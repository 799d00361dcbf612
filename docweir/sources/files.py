"""Files of a document library, gold sets and catalogue exports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import mime_type
from ..streaming import manifest

SUFFIXES = ("pdf", "docx", "txt", "md")
GOLD = """question_id string, split string, question string, answerability string, leakage_group string,
 evidence_groups array<struct<id:string, answer_point:string, alternatives:array<struct<document_sha256:string, page_start:int, page_end:int, quote:string>>>>"""
CATALOGUE = "provider string, model string, capability string, base_url string, dimensions int, sort_order int"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, name, suffix, mime, length, content, sha256) of a folder's files, at any depth, of the known kinds."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    named = found.withColumn("name", name).withColumn("suffix", F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))
    kept = named.filter(F.col("suffix").isin(*suffixes))
    return kept.select("path", "name", "suffix", mime_type(F.col("name")).alias("mime"), "length", "content", F.sha2("content", 256).alias("sha256"))


def is_valid(suffix: Column, content: Column) -> Column:
    """Whether the content looks like its suffix: magic bytes, or UTF-8 without NUL."""
    start = F.hex(F.substring(content, 1, 4))
    plain = F.is_valid_utf8(content.cast("string")) & (F.locate("\0", content.cast("string")) == 0)
    return F.when(suffix == "pdf", start == "25504446").when(suffix == "docx", start == "504B0304").when(suffix.isin("txt", "md"), plain).otherwise(False)


def text_pages(files: DataFrame) -> DataFrame:
    """(sha256, page, text) of plain text files: one page, broken bytes replaced."""
    plain = files.filter(F.col("suffix").isin("txt", "md"))
    return plain.select("sha256", F.lit(1).alias("page"), F.trim(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def _docx_text(content: bytes) -> str:
    """Paragraphs that aren't blank, then the rows of tables with cells between bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{WORD}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD}t")).strip()
    parts = [said(p) for p in body.findall(f"{WORD}p")]
    for row in body.iter(f"{WORD}tr"):
        parts.append(" | ".join(said(c) for c in row.findall(f"{WORD}tc")))
    return "\n\n".join(p for p in parts if p)


def docx_pages(files: DataFrame) -> DataFrame:
    """(sha256, page, text) of word-processor files: one page; a file that can't be read has a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append(_docx_text(bytes(content)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
                    texts.append(None)
            yield pd.DataFrame({"sha256": batch["sha256"], "page": 1, "text": texts})

    return files.filter("suffix = 'docx'").select("sha256", "content").mapInPandas(run, "sha256 string, page int, text string")


def gold_cases(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their evidence groups from JSON lines."""
    return spark.read.schema(GOLD).json(path)


def gold_problems(cases: DataFrame) -> DataFrame:
    """(question_id, problem): repeated ids, unknown answerability, answerable questions without evidence."""
    repeated = cases.groupBy("question_id").count().filter("count > 1").select("question_id", F.lit("repeated id").alias("problem"))
    states = ["answerable", "partial", "unanswerable"]
    wrong = F.when(~F.col("answerability").isin(states) | F.col("answerability").isNull(), "unknown answerability").when(
        (F.col("answerability") != "unanswerable") & (F.coalesce(F.size("evidence_groups"), F.lit(0)) < 1), "no evidence"
    )
    return repeated.unionByName(cases.select("question_id", wrong.alias("problem")).filter("problem is not null"))


def gold_groups(cases: DataFrame) -> DataFrame:
    """(question_id, group_id, document_sha256, page_start, page_end, quote): a row for each alternative."""
    groups = cases.select("question_id", F.explode("evidence_groups").alias("g"))
    each = groups.select("question_id", F.col("g.id").alias("group_id"), F.explode("g.alternatives").alias("a"))
    return each.select("question_id", "group_id", "a.*")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOGUE).json(path)


def catalogue_problems(entries: DataFrame) -> DataFrame:
    """Entries without a provider or a model, with dimensions that aren't positive, or with dimensions for no embedding."""
    wrong = (
        F.when(F.coalesce(F.trim("provider"), F.lit("")) == "", "no provider").when(F.coalesce(F.trim("model"), F.lit("")) == "", "no model")
        .when(F.col("dimensions") <= 0, "dimensions not positive").when(F.col("dimensions").isNotNull() & (F.col("capability") != "embedding"), "dimensions without embedding")
    )
    return entries.withColumn("problem", wrong).filter("problem is not null")


def write_groups(new: DataFrame, root: str, key: str, buckets: int = 64) -> None:
    """Replace whole groups of a dataset that lies in buckets by a hash of its key; all other groups stay as they are.

    The buckets that new's keys fall into are written anew beside the old ones and a manifest is committed, so a reader sees
    all of it or nothing, and there are as many directories as buckets, however many groups. See read_groups().
    """
    spark, number = new.sparkSession, (known := manifest.last(new.sparkSession, root))["batch"] + 1
    n = known.get("buckets_n", buckets)
    dealt = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).persist()
    try:
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # as many as buckets
        held = manifest.read(spark, known, new.schema, touched)
        stays = held.join(new.select(key).distinct(), key, "left_anti").select(*new.columns)
        both = dealt.unionByName(stays.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")))
        folder = manifest.fresh(root, number)
        both.repartition(max(1, min(len(touched), 64)), "bucket").write.partitionBy("bucket").parquet(folder)
    finally:
        dealt.unpersist()
    manifest.commit(spark, root, {"batch": number, "buckets_n": n, "dirs": dict(known["dirs"]) | {str(b): f"{folder}/bucket={b}" for b in touched}})
    manifest.sweep(spark, root)


def read_groups(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The groups as the last write_groups() left them."""
    return manifest.read(spark, manifest.last(spark, root), schema)


def unknown_kinds(files: DataFrame) -> DataFrame:
    """Files (path, suffix) that no extractor takes."""
    return files.filter(~F.coalesce(F.col("suffix"), F.lit("")).isin(*SUFFIXES)).select("path", F.lit("no extractor for this kind of file").alias("problem"))


def extracted_pages(files: DataFrame) -> DataFrame:
    """(sha256, page, text) of all files, by the extractor of their kind; a kind without one ends the job when it is met.

    PDF files need a library that reads them, so here they are such a kind; unknown_kinds() and this select tell beforehand.
    """
    known = F.col("suffix").isin("txt", "md", "docx")
    checked = files.withColumn("suffix", F.when(known, F.col("suffix")).otherwise(F.raise_error(F.concat(F.lit("no extractor for "), F.col("path")))))
    return text_pages(checked).unionByName(docx_pages(checked))


STORE = """documents array<struct<id:string, canonical_url:string, url:string, title:string, summary:string, country:string, metadata:string, last_seen_at:timestamp>>,
 versions array<struct<document_id:string, policy_id:string, version:int, clean_markdown:string>>, assets array<struct<document_id:string, policy_id:string, original_url:string, mime_type:string>>"""


def document_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, versions and assets of a JSON store in one file; a name that older stores used stands in for the newer one."""
    whole = spark.read.schema(STORE).option("multiLine", True).json(path)
    each = lambda name: whole.select(F.inline(name))
    documents = each("documents").withColumn("canonical_url", F.coalesce("canonical_url", "url")).drop("url")
    owned = lambda name: each(name).withColumn("document_id", F.coalesce("document_id", "policy_id")).drop("policy_id")
    return {"documents": documents, "versions": owned("versions"), "assets": owned("assets")}
