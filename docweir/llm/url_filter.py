"""URL verdicts from stated rules and, where none fits, from path templates with labelled purity.

Each host has a tree of path segments. Segments that vary by their look (numbers, long hexadecimal names) are wildcards
from the start, so pages shrink to counted templates at once. Level by level, rare segments of a crowded branch become
wildcards too. Then branches of one parent whose share of bad labelled pages is statistically that of the parent merge
into one. A template is rejected where its smoothed share of bad labelled pages reaches REJECT. All of it is DataFrame
operations: sums by branch are grouped, written down where they are joined back, and so a host or a branch with most of
the pages never has to be in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (host, path, verdict); the host and all its subdomains, where the path starts so.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Levels that are generalised one by one; what is deeper stands together as one segment.
DEPTH = 16
#: A branch with more than CROWDED segments keeps those with at least RARE of its pages.
CROWDED, RARE = 20, 0.02
SIMILAR_Z = 1.96
PRIOR_ROWS, REJECT = 10.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// with A-Z lower-cased, and the path up to ? or #; empty for a null or a url without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, else null. rules is a short list stated by the caller."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """All segments, each as it is or a wildcard by its look; those below DEPTH are joined to one."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    varying = r"^[0-9][0-9_.-]*(\.[A-Za-z]{2,5})?$|^[0-9a-fA-F-]{16,}$|[0-9]{4,}"
    seen = F.transform(parts, lambda s: F.when(s.rlike(varying), "*").otherwise(s))
    deep = F.array_join(F.slice(seen, DEPTH + 1, F.greatest(F.size(seen), F.lit(1))), "/")
    return F.when(F.size(seen) > DEPTH, F.concat(F.slice(seen, 1, DEPTH), F.array(deep))).otherwise(seen)


def _generalised(leaves: DataFrame) -> DataFrame:
    """leaves with template: the rare segments of crowded branches as wildcards, from the first level down."""
    deepest = leaves.agg(F.max(F.size("segments"))).first()[0] or 0
    tree = leaves.withColumn("template", F.array().cast("array<string>"))
    for level in range(1, deepest + 1):
        own = F.get("segments", F.lit(level - 1))
        counts = tree.filter(own.isNotNull()).groupBy("host", "template", own.alias("segment")).agg(F.sum("n").alias("n_segment"))
        crowded = counts.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k"), F.sum("n_segment").alias("n_branch"))
        crowded = cut(crowded.filter(F.col("k") > CROWDED))
        longer = F.when(own.isNotNull(), F.concat("template", F.array(own))).otherwise(F.col("template"))
        if crowded.isEmpty():
            tree = tree.withColumn("template", longer)
            continue
        rare = counts.join(crowded, ["host", "template"]).filter(F.col("n_segment") < RARE * F.col("n_branch"))
        rare = cut(rare.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("segment").alias("s")))
        met = (tree["host"] == rare["h"]) & (tree["template"] == rare["t"]) & (own == rare["s"])
        longer = F.when(F.col("s").isNotNull(), F.concat("template", F.array(F.lit("*")))).otherwise(longer)
        tree = cut(tree.join(rare, met, "left").select(*leaves.columns, longer.alias("template")))
    return tree


def template_verdicts(pages: DataFrame) -> DataFrame:
    """(host, segments, template, labelled, bad, purity, verdict) from rows of host, segments and bad (1, 0 or null)."""
    leaves = cut(
        pages.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    rate = leaves.agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("rate")).select(F.coalesce("rate", F.lit(0.0))).first()[0]
    tree = _generalised(leaves)
    # siblings: templates of one host that differ in their first segment that isn't a wildcard
    nodes = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    at = F.coalesce(F.array_position(F.transform("template", lambda s: s != "*"), True), F.lit(0)).cast("int")
    parent = F.when(at > 0, F.transform("template", lambda s, i: F.when(i == at - 1, F.lit("{*}")).otherwise(s))).otherwise(F.col("template"))
    nodes = cut(nodes.withColumn("parent", parent))
    summed = lambda df, by, *names: cut(df.groupBy("host", by).agg(F.sum("labelled").alias(names[0]), F.sum("bad").alias(names[1])))
    nodes = nodes.join(summed(nodes, "parent", "all_labelled", "all_bad"), ["host", "parent"])
    shared = F.coalesce(F.try_divide(F.col("all_bad"), F.col("all_labelled")), F.lit(0.0))
    spread = F.sqrt(F.col("labelled") * shared * (1 - shared))
    similar = (F.col("labelled") == 0) | (spread == 0) | (F.abs(F.col("bad") - F.col("labelled") * shared) < SIMILAR_Z * spread)
    nodes = cut(nodes.withColumn("merged", F.when(similar, F.col("parent")).otherwise(F.col("template"))))
    judged = nodes.join(summed(nodes, "merged", "n_labelled", "n_bad"), ["host", "merged"])
    purity = (F.col("n_bad") + F.lit(PRIOR_ROWS * rate)) / (F.col("n_labelled") + F.lit(PRIOR_ROWS))
    judged = cut(judged.select(
        F.col("host").alias("h"), F.col("template").alias("t"), F.concat(F.lit("/"), F.array_join("merged", "/")).alias("merged"),
        "n_labelled", "n_bad", purity.alias("purity"), F.when(purity >= REJECT, "block").otherwise("allow").alias("verdict"),
    ))
    met = (tree["host"] == judged["h"]) & (tree["template"] == judged["t"])
    return tree.join(judged, met).select("host", "segments", F.col("merged").alias("template"), F.col("n_labelled").alias("labelled"), F.col("n_bad").alias("bad"), "purity", "verdict")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of pages (page_id, url).

    labels has page_id and bad (1 or 0); of repeated labels of a page the largest counts, a null one doesn't. Pages
    without labels count in no purity; a template without labelled pages has the corpus's share. Repeated rows are
    judged alike; null urls have an empty host and path, which is a template like any other. A purity of exactly REJECT
    blocks. Urls count however long they are; an empty table gives no rows; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("segments", segments(F.col("path")))
    known = labels.filter("page_id is not null").groupBy(F.col("page_id").alias("_dw_page")).agg(F.max("bad").alias("bad"))
    marked = rows.join(known, rows["page_id"] == known["_dw_page"], "left").select("host", "segments", "bad")
    verdicts = cut(template_verdicts(marked)).select(
        F.col("host").alias("_dw_host"), F.col("segments").alias("_dw_segments"), "template", "purity", F.col("verdict").alias("_dw_verdict")
    )
    joined = rows.join(verdicts, (rows["host"] == verdicts["_dw_host"]) & (rows["segments"] == verdicts["_dw_segments"]), "left")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return joined.withColumn("_dw_rule", rule).select(
        "page_id", "host", "path", F.col("_dw_rule.rule").alias("rule"), F.coalesce("_dw_rule.verdict", "_dw_verdict").alias("verdict"), "template", "purity"
    )


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages. A page shows the document that its path numbers, so that document's labels are the page's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    _, path = host_and_path(F.col("url"))
    number = F.expr("try_cast(nullif(regexp_extract(_dw_path, '([0-9]+)[^0-9/]*/?$', 1), '') as bigint)")
    shown = pages.withColumn("_dw_path", path).select("page_id", number.alias("doc_id"))
    bad = (F.coalesce(1 - F.col("quality"), F.lit(0)) + F.coalesce("toxic", F.lit(0)) > 0).cast("int")
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    return judge_urls(pages, shown.join(labels, "doc_id").select("page_id", "bad"))
