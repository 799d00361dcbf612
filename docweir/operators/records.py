"""Bookkeeping over documents, jobs, sessions, crawls and evaluation runs, each a set-wise operation on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from .search import top_k


def set_status(documents: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """documents (id, status, processed_at, error_message, ...) after changes (id, status, error_message), one for each id.

    The message is overwritten, with null too; the time of processing is set by the status ready alone.
    """
    new = changes.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("error_message").alias("_error"))
    met = documents.join(new, documents["id"] == new["_id"], "left")
    hit = F.col("_id").isNotNull()
    own = {
        "status": F.when(hit, F.col("_status")).otherwise(F.col("status")),
        "error_message": F.when(hit, F.col("_error")).otherwise(F.col("error_message")),
        "processed_at": F.when(hit & (F.col("_status") == "ready"), now).otherwise(F.col("processed_at")),
    }
    return met.select(*(own[c].alias(c) if c in own else F.col(c) for c in documents.columns))


def pages_of(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, name, page_number, text) in page order for each document (id, title, filename), with a null page where it has none.

    A document without pages is to be extracted again.
    """
    held = pages.select(F.col("id").alias("_id"), "page_number", "text")
    met = documents.join(held, documents["id"] == held["_id"], "left")
    return met.select("id", F.coalesce("title", "filename").alias("name"), "page_number", "text").orderBy("id", "page_number")


def chunk_list(chunks: DataFrame, models: DataFrame) -> DataFrame:
    """(id, document_id, chunk_index, model, preview): chunks in order with the model that embedded them, if any."""
    of = models.select(F.col("id").alias("_id"), "model")
    met = chunks.join(of, chunks["id"] == of["_id"], "left")
    return met.select("id", "document_id", "chunk_index", "model", F.left("text", F.lit(500)).alias("preview")).orderBy("document_id", "chunk_index")


def reembedding_inputs(chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, document_id, input): each chunk's header and text, but for documents (document_id) that failed."""
    body = F.concat_ws("\n\n", F.when(F.trim("header") != "", F.col("header")), F.col("text"))
    return chunks.join(failed.select("document_id").distinct(), "document_id", "left_anti").select("id", "document_id", body.alias("input"))


def library_changes(files: DataFrame, documents: DataFrame) -> DataFrame:
    """files (path, checksum) with state: known by path, else known by checksum, else new."""
    paths = documents.select(F.col("path").alias("_path")).distinct()
    sums = documents.select(F.col("checksum").alias("_sum")).distinct()
    met = files.join(paths, files["path"] == F.col("_path"), "left").join(sums, files["checksum"] == F.col("_sum"), "left")
    state = F.when(F.col("_path").isNotNull(), "known path").when(F.col("_sum").isNotNull(), "known content").otherwise("new")
    return met.select(*(files[c] for c in files.columns), state.alias("state"))


def catalogue_entry(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (provider, model, capability or null for any) with found and base_url of the first entry by sort_order that fits."""
    e = entries.select(*(F.col(c).alias(f"_{c}") for c in ("provider", "model", "capability", "base_url", "sort_order")))
    fits = (F.col("provider") == F.col("_provider")) & (F.col("model") == F.col("_model")) & (F.col("capability").isNull() | (F.col("capability") == F.col("_capability")))
    met = wanted.join(e, fits, "left").groupBy(*wanted.columns).agg(F.min(F.struct("_sort_order", "_capability", "_base_url")).alias("m"), F.count("_provider").alias("n"))
    return met.select(*wanted.columns, (F.col("n") > 0).alias("found"), F.when(F.col("n") > 0, F.col("m._base_url")).alias("base_url"))


def endpoint_problems(entries: DataFrame, providers: DataFrame) -> DataFrame:
    """Entries with problems: a provider that isn't registered, dimensions that aren't positive, dimensions outside embedding."""
    known = providers.select(F.col("id").alias("_id")).distinct()
    met = entries.join(known, entries["provider"] == F.col("_id"), "left")
    found = F.array_compact(F.array(
        F.when(F.col("_id").isNull(), "unknown provider"), F.when(F.col("dimensions") <= 0, "dimensions must be positive"),
        F.when(F.col("dimensions").isNotNull() & (F.col("capability") != "embedding"), "dimensions are for embedding alone"),
    ))
    return met.select(*(entries[c] for c in entries.columns), found.alias("problems"))


def taxonomy_rows(groups: DataFrame) -> DataFrame:
    """(parent, child, parent_order, child_order) of groups (position, parent, children): names trimmed, blank ones left out,
    a child once for each parent; orders count from 0 within what is left."""
    parent = groups.select("position", tx.collapse_ends(F.col("parent")).alias("parent"), F.transform("children", lambda c: tx.collapse_ends(c)).alias("children"))
    clean = parent.filter("parent <> ''").select("position", "parent", F.array_distinct(F.filter("children", lambda c: c != "")).alias("children"))
    ordered = clean.withColumn("parent_order", F.row_number().over(W.orderBy("position")) - 1)  # a taxonomy is a page of names
    return ordered.select("parent", "parent_order", F.posexplode("children").alias("child_order", "child")).select("parent", "child", "parent_order", "child_order")


def close_jobs(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """jobs (id, status, details, finished_at, ...) after results (id, status, details): their details join the job's, key by key."""
    new = results.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("details").alias("_details"))
    met = jobs.join(new, jobs["id"] == new["_id"], "left")
    hit, kind = F.col("_id").isNotNull(), "map<string,string>"
    old = lambda c: F.coalesce(F.from_json(c, kind), F.create_map().cast(kind))
    joined = F.to_json(F.map_concat(F.map_filter(old("details"), lambda k, _: ~F.map_contains_key(old("_details"), k)), old("_details")))
    own = {"status": F.when(hit, F.col("_status")).otherwise(F.col("status")), "details": F.when(hit, joined).otherwise(F.col("details")), "finished_at": F.when(hit, now).otherwise(F.col("finished_at"))}
    return met.select(*(own[c].alias(c) if c in own else F.col(c) for c in jobs.columns))


def session_messages(messages: DataFrame, sessions: DataFrame, owner: Column) -> DataFrame:
    """Messages of the sessions (session_id, owner_id) that belong to owner, in their order."""
    own = sessions.filter(F.col("owner_id") == owner).select("session_id")
    return messages.join(own, "session_id", "left_semi").orderBy("session_id", "created_at", "id")


def session_titles(messages: DataFrame, size: int = 200) -> DataFrame:
    """(session_id, title, updated_at, n_messages): the first question, cut to size characters, and the latest message's time."""
    asked = F.min(F.when(F.col("role") == "user", F.struct("created_at", "id", "text")))
    return messages.groupBy("session_id").agg(F.left(asked["text"], F.lit(size)).alias("title"), F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("n_messages"))


def finish_messages(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pending assistant messages (id, role, status, text, suggestions) finished by answers (id, text, suggestions); no other role takes any."""
    new = answers.select(F.col("id").alias("_id"), F.col("text").alias("_text"), F.col("suggestions").alias("_suggestions"))
    met = messages.join(new, messages["id"] == new["_id"], "left")
    hit = F.col("_id").isNotNull() & (F.col("role") == "assistant") & (F.col("status") == "pending")
    own = {"text": F.when(hit, F.col("_text")).otherwise(F.col("text")), "suggestions": F.when(hit, F.col("_suggestions")).otherwise(F.col("suggestions")), "status": F.when(hit, "complete").otherwise(F.col("status"))}
    return met.select(*(own[c].alias(c) if c in own else F.col(c) for c in messages.columns))


def normalised_metadata(raw: DataFrame) -> DataFrame:
    """(id, title, year, publication_date, language, keywords) of raw (id, filename, json, detected): the file's name where there
    is no title, whole years alone, dates alone, lists without blanks; the model's language goes before the detected one."""
    field = lambda name: F.get_json_object("json", f"$.{name}")
    blank = lambda c: F.when(c != "", c)
    year = F.when(field("year").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(field("year")).try_cast("int")).otherwise(F.floor(F.when(field("year").rlike(r"^[+-]?\d+\.\d+$"), field("year").try_cast("double"))).cast("int"))
    return raw.select(
        "id", F.coalesce(blank(field("title")), "filename").alias("title"), year.alias("year"), tx.clean_date(field("publication_date")).alias("publication_date"),
        F.coalesce(blank(field("language")), "detected").alias("language"), tx.clean_list(field("keywords")).alias("keywords"),
    )


def newest_seen(documents: DataFrame, source: str | None = None) -> DataFrame:
    """Crawled documents, newest seen first, of one source or all."""
    held = documents if source is None else documents.filter(F.col("source") == source)
    return held.orderBy(F.desc("last_seen_at"), "id")


def crawl_search(documents: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, match_fields) of the newest limit documents with the lower-case query in url, title, summary, country or metadata (JSON)."""
    names = [c for c in ("canonical_url", "title", "summary", "country") if c in documents.columns]
    found = [F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query)), c) for c in names]
    found.append(F.when(tx.holds(F.col("metadata"), F.lit(query)), "metadata"))
    hits = documents.withColumn("match_fields", F.array_compact(F.array(*found))).filter(F.size("match_fields") > 0)
    return hits.orderBy(F.desc("last_seen_at"), "id").limit(limit).select("id", "match_fields")


def save_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """versions (id, version, ...) with one more for each row of new (id, ...), numbered on from the document's last."""
    last = versions.groupBy(F.col("id").alias("_id")).agg(F.max("version").alias("_last"))
    order = [c for c in new.columns if c != "id"]
    numbered = new.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*order)))
    met = numbered.join(last, numbered["id"] == last["_id"], "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast(dict(versions.dtypes)["version"]))
    return versions.unionByName(met.select(*versions.columns))


def save_assets(assets: DataFrame, new: DataFrame) -> DataFrame:
    """assets (id, url, ...) where new ones take the place of those with their document and url."""
    return assets.join(new.select("id", "url").distinct(), ["id", "url"], "left_anti").select(*assets.columns).unionByName(new.select(*assets.columns))


def patch_rows(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """rows changed by patches (key, fields: map of column names to texts): only the fields that a patch names, null included."""
    new = patches.select(F.col(key).alias("_key"), F.col("fields").alias("_fields"))
    met, kinds = rows.join(new, rows[key] == new["_key"], "left"), dict(rows.dtypes)
    named = lambda c: F.coalesce(F.map_contains_key("_fields", c), F.lit(False))
    return met.select(*(rows[c] if c == key else F.when(named(c), F.element_at("_fields", c).cast(kinds[c])).otherwise(rows[c]).alias(c) for c in rows.columns))


def joined_crawl(batches: DataFrame) -> DataFrame:
    """(crawl_id, documents, n_documents, counters): all documents of a crawl's batches (crawl_id, batch, documents, counters), the last one's counters."""
    last = batches.groupBy("crawl_id").agg(F.max_by("counters", "batch").alias("counters"), F.sum(F.size("documents")).alias("n_documents"))
    return last


def input_limit(maximum: Column, local: Column, special: int, margin: int, local_most: int = 512) -> Column:
    """Tokens that an embedding input may have: local models take no more than local_most."""
    return F.when(local, F.least(maximum, F.lit(local_most))).otherwise(maximum) - special - margin


def rejected_inputs(inputs: DataFrame, limit: Column) -> DataFrame:
    """(batch, n_over, accepted): a batch with any input (batch, tokens) over the limit is rejected whole."""
    over = F.count_if(F.col("tokens") > limit)
    return inputs.groupBy("batch").agg(over.alias("n_over"), (over == 0).alias("accepted"))


def web_results(raw: DataFrame) -> DataFrame:
    """(query_id, position, title, url, content) of raw results: markdown, else content, else description; else they are left out."""
    blank = lambda c: F.when(tx.collapse_ends(F.col(c)) != "", tx.collapse_ends(F.col(c)))
    content = F.coalesce(blank("markdown"), blank("content"), blank("description"))
    return raw.select("query_id", "position", F.coalesce(blank("title"), F.col("url")).alias("title"), "url", content.alias("content")).filter("url is not null and content is not null")


def clicks(raw: DataFrame, size: int = 500) -> DataFrame:
    """Clicks (user_id, ts, text): trimmed, cut to size characters, blank ones left out."""
    bare = F.left(tx.collapse_ends(F.col("text")), F.lit(size))
    return raw.withColumn("text", bare).filter("text <> ''")


def answerability(stated: Column, answerable: Column) -> Column:
    """Three states: what is stated, else answerable, else a candidate nobody resolved."""
    return F.coalesce(stated, F.when(answerable, "answerable").otherwise("unresolved_candidate"))


def source_problems(sources: DataFrame, files: DataFrame, pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """(document, problem): files whose digest isn't the stated one, anchors past the last page, quotes that their pages don't hold.

    sources has document, sha256; files document, sha256; pages document, page, text; anchors document, page_start,
    page_end, quote. Quotes and pages are compared without differences of spacing.
    """
    of = files.select(F.col("document").alias("_d"), F.col("sha256").alias("_sum"))
    digests = sources.join(of, sources["document"] == of["_d"], "left").filter(~F.col("sha256").eqNullSafe(F.col("_sum"))).select("document", F.when(F.col("_d").isNull(), "missing file").otherwise("changed file").alias("problem"))
    last = pages.groupBy("document").agg(F.max("page").alias("last"))
    past = anchors.join(last, "document", "left").filter(F.coalesce(F.col("page_end") > F.col("last"), F.lit(True))).select("document", F.lit("page out of range").alias("problem"))
    keyed = anchors.withColumn("_a", F.xxhash64("document", "page_start", "page_end", "quote"))
    held = keyed.join(pages, "document").filter("page between page_start and page_end")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ")  # an anchor's few pages
    spans = held.groupBy("document", "_a", "quote").agg(text.alias("text"))
    lost = spans.filter(~F.contains(tx.collapse(F.col("text")), tx.collapse(F.col("quote")))).select("document", F.lit("quote not found").alias("problem"))
    return digests.unionByName(past).unionByName(lost)


def manifest_digest(files: DataFrame) -> DataFrame:
    """(folder, n_files, digest) of files (folder, path, sha256): one sha256 over the lines of all files by path.

    A folder's lines, a hundred bytes each, come together in one row.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit("\t"), x["sha256"], F.lit("\n")))
    return files.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sha2(F.array_join(lines, ""), 256).alias("digest"))


def batch_problems(batch: DataFrame) -> DataFrame:
    """(name, problem) of a batch (name, head: first bytes, sha256, stated): names with folders, repeated names, no PDF, other digest."""
    n = batch.groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("_n"))
    met = batch.join(n, batch["name"] == n["_name"])
    found = F.array_compact(F.array(
        F.when(F.col("name").rlike(r"[/\\]") | F.col("name").isin("", ".", ".."), "no plain name"), F.when(F.col("_n") > 1, "repeated name"),
        F.when(~F.startswith(F.col("head").cast("string"), F.lit("%PDF-")), "no PDF"), F.when(~F.col("sha256").eqNullSafe(F.col("stated")), "other digest"),
    ))
    return met.select("name", F.explode(found).alias("problem")).distinct()


def rebuild_statistics(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, n_sections, n_children, n_headers, input_tokens, n_single, n_tiny) of a document's sections and chunks.

    sections has document_id, section_id, tokens; chunks document_id, section_id, header, tokens. A section with one
    child is single, one under 100 tokens tiny.
    """
    kids = chunks.groupBy("document_id", "section_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("header") != "").alias("h"), F.sum("tokens").alias("t"))
    of = kids.groupBy("document_id").agg(F.sum("n").alias("n_children"), F.sum("h").alias("n_headers"), F.sum("t").alias("input_tokens"), F.count_if((F.col("n") == 1) & F.col("section_id").isNotNull()).alias("n_single"))
    own = sections.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(F.col("tokens") < 100).alias("n_tiny"))
    return own.join(of, "document_id", "full").fillna(0)


def group_digest(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, digest): an order-free digest of each group's rows, added up in tasks."""
    one = F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("digest"))


def differences(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, before, after) of settings that two runs don't share; a missing one is null."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys, "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def rerank_saved(saved: DataFrame, limit: int) -> DataFrame:
    """(query_id, branch, id, rank): each branch's candidates (query_id, branch, id, saved_rank) ranked anew without gaps."""
    return top_k(saved, ["query_id", "branch"], ["saved_rank", "id"], limit).select("query_id", "branch", "id", "rank")


def generation_packets(ranked: DataFrame, pool: DataFrame, gold: list[str], most: int = 5) -> DataFrame:
    """The pool's rows (query_id, id, ...) of each query's first ids by rank, without the columns that give the gold away."""
    first = ranked.filter(F.col("rank") <= most).select("query_id", "id", "rank")
    return first.join(pool.drop(*gold), ["query_id", "id"])


def falsely_complete(cases: DataFrame) -> DataFrame:
    """case_id of cases whose coverage was certified complete though their gold evidence isn't."""
    return cases.filter("coverage_status = 'complete' and not gold_complete").select("case_id")


def replay_inputs(cases: DataFrame, gold: list[str]) -> DataFrame:
    """Cases whose generation failed although their context was approved, without the columns that give the gold away."""
    return cases.filter("generation_failed and context_approved").drop(*gold)


def case_slice(cases: DataFrame, offset: int, limit: int) -> DataFrame:
    """Cases by id, from offset on, limit of them."""
    return cases.orderBy("case_id").offset(offset).limit(limit)


def library_order(documents: DataFrame, order: str) -> DataFrame:
    """Documents by one of four orders; an unknown one is the default, newest upload first."""
    new = F.desc_nulls_last("uploaded_at")
    orders = {
        "uploaded_desc": [new, F.asc("filename")], "name_asc": [F.asc("filename"), new],
        "year_desc": [F.desc_nulls_last("year"), new], "chunks_desc": [F.desc_nulls_last("chunk_count"), new],
    }
    return documents.orderBy(*orders.get(order, orders["uploaded_desc"]), "id")


#: The fields of a library's search, in the order in which matches name them.
LIBRARY_FIELDS = ("filename", "title", "summary", "country_region", "source_type", "source_organisation", "policy_areas", "keywords", "year")


def library_search(documents: DataFrame, query: str) -> DataFrame:
    """Documents whose fields hold the query, whatever the case, with match_fields; a blank query finds all.

    Signs of LIKE in the query stand for themselves; lists are joined by spaces; a year is looked at as text.
    """
    kinds, bare = dict(documents.dtypes), query.strip()
    text = lambda c: F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c).cast("string")
    pattern = tx.like_pattern(F.lit(bare))
    found = F.array_compact(F.array(*(F.when(F.ilike(text(c), pattern, F.lit("!")), c) for c in LIBRARY_FIELDS if c in kinds)))
    out = documents.withColumn("match_fields", found)
    return out.filter(F.size("match_fields") > 0) if bare else out.withColumn("match_fields", F.array().cast("array<string>"))


def parents_of(children: DataFrame, sections: DataFrame) -> DataFrame:
    """children (id, document_id, section_id) with text of their section and problem: a section that isn't there, or another document's."""
    s = sections.select(F.col("id").alias("_s"), F.col("document_id").alias("_d"), F.col("text").alias("parent_text"))
    met = children.join(s, children["section_id"] == F.col("_s"), "left")
    foreign = F.col("_d") != F.col("document_id")
    problem = F.when(F.col("section_id").isNotNull() & F.col("_s").isNull(), "missing section").when(foreign, "section of another document")
    return met.select(*(children[c] for c in children.columns), F.when(problem.isNull(), F.col("parent_text")).alias("parent_text"), problem.alias("problem"))


def crawl_batches(details: DataFrame, size: int = 5) -> DataFrame:
    """details (crawl_id, position, url) with batch: so many pages in each, in the order of their finding."""
    n = F.row_number().over(W.partitionBy("crawl_id").orderBy("position", "url")) - 1
    return details.withColumn("batch", F.floor(n / size).cast("int"))


def crawled_totals(batches: DataFrame) -> DataFrame:
    """(crawl_id, batch, n_pages, so_far) by batch: what each brings, and what a crawl has by then."""
    each = batches.groupBy("crawl_id", "batch").agg(F.count(F.lit(1)).alias("n_pages"))
    return each.withColumn("so_far", F.sum("n_pages").over(W.partitionBy("crawl_id").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)))


def section_audit(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: shares of sections (id, tokens) with one child and under 100 tokens, and children for each section that has any."""
    n = chunks.groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    met = sections.join(n, sections["id"] == n["section_id"], "left")
    every = F.count(F.lit(1))
    return met.agg(every.alias("n_sections"), (F.count_if(F.col("n") == 1) / every).alias("single_share"), (F.count_if(F.col("tokens") < 100) / every).alias("tiny_share"), F.avg("n").alias("mean_children"))
