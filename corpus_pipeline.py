"""A corpus from raw documents: toxic ones out, one of each near-duplicate group, clean of benchmarks and personal data, encoded.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. All but the last return the
columns of documents, whatever they are called, as they were but for what the stage changes. run() writes each stage's
rows to the shared folder, reads them again for the next, and deletes what the stage before wrote on its way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.llm.common import drop_table, scratch, table, write_table
from docweir.llm.decontaminate import find_contamination, judged
from docweir.llm.pieces import encode_documents
from docweir.llm.sanitise import sanitise
from docweir.llm.simhash import one_of_each
from docweir.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay.

    Every row is judged by its own text, however long, so repeated rows go or stay together; null and empty texts stay; a
    score of exactly the threshold goes; an empty table gives an empty one.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).filter(F.col("_dw_score") < THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (three bits or similarity 0.8) stays: that with the smallest doc_id.

    Where a doc_id has several texts of the class, the text with the smallest digest stays; a repeated row stays once; rows
    without a doc_id stay only where no row of the class has one. Null and empty texts are one class; an empty table
    gives an empty one.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark stay.

    Every row is judged by its own whole text; null and empty texts have no words and stay; so do all rows if the
    benchmark is empty; an empty table gives an empty one.
    """
    held = docs.select(F.struct("*").alias("_dw_row"), "text")  # own columns may be called as the verdict's
    return judged(find_contamination(held, table(spark, sf_dir, "benchmark"))).filter("not contaminated").select("_dw_row.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data and the terms that disclose it are replaced in text, and n_chars is counted anew.

    Null and empty texts stay as they are; every row is rewritten by itself, repeated ones alike; an empty table gives an
    empty one.
    """
    return sanitise(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its ids, their number n_tokens, and as text what they decode to.

    A null text has the end id alone and becomes an empty one. An own column called ids or n_tokens gives way to the
    stage's; all others stay. Repeated rows stay; an empty table gives an empty one.
    """
    own = [c for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    held = docs.select(F.struct(*own).alias("_dw_row") if own else F.lit(None).alias("_dw_row"), "text")
    made = encode_documents(held, keep=["_dw_row"])
    columns = {"text": F.col("decoded")} | {c: F.col("_dw_row")[c] for c in own}
    order = [c for c in docs.columns if c in columns]
    return made.select(*(columns[c].alias(c) for c in order), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("pieces", pieces)]

#: Scores, reachable classes and merges are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = write_table(stage(spark, docs, sf_dir))
        if before:
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
