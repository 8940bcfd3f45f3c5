"""Queries of the core engine by name, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import chunking, filters, generations, identity, pages, queue, retrieval
from folioforge.operators.timestamps import all_source_values, found_moments, normalise_timestamps
from folioforge.plans.config import Queue
from folioforge.plans.oracle import ORACLE
from folioforge.plans.runtime import fan_out, table
from folioforge.sources import plugins, readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
#: The moment at which queue queries are asked, and what they ask.
NOW = datetime(2025, 1, 20, tzinfo=timezone.utc)
MODEL = "harbor-embed-64"
QUESTION = "router firewall packet"


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _long(*cols: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in cols]


# Pages and routing


@_query
def text_quality(spark, sf):
    q = pages.with_quality(fan_out(table(spark, sf, "documents").select("doc_id", "text")), "text")
    r = [F.round(c, 6).alias(c) for c in ("alpha_ratio", "replacement_char_ratio", "avg_word_length")]
    return q.select("doc_id", *_long("char_count", "word_count"), *r, *_long("line_count"), F.array_join("flags", ",").alias("flags"), "is_true_text")


@_query
def quality_flag_counts(spark, sf):
    q = pages.with_quality(fan_out(table(spark, sf, "documents").select("text")), "text")
    return pages.flag_counts(q)


def _routed(spark, sf):
    """Documents as pages of their site; image signals are derived from the id."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text", (F.col("doc_id") % 5 == 0).alias("has_images"))
    q = pages.with_quality(fan_out(docs), "text")
    return q.withColumn("has_visual", F.col("has_images") | F.col("is_true_text") | (F.col("doc_id") % 3 == 0))


@_query
def ocr_route(spark, sf):
    return pages.route_pages(_routed(spark, sf), "source").select("doc_id", "usable", "likely_true_text", "route")


def _scanned_pages(spark, sf):
    """Latest page attempts with the text of the chunks that begin there; what was kept as an image, or has no text layer, can be seen."""
    p = pages.latest_pages(table(spark, sf, "page_metadata"), "image_path", "text_layer_detected").where("source_id is not null and page_number is not null")
    live = _live(spark, sf, "source_id", "page_start", "chunk_index", "text").where("text is not null and page_start is not null")
    texts = pages.combine_pages(live, ["source_id", "page_start"], "chunk_index", "text").withColumnRenamed("page_start", "page_number").withColumnRenamed("markdown", "text")
    q = pages.with_quality(p.join(texts, ["source_id", "page_number"], "left"), "text")
    images = F.col("image_path").isNotNull()
    return q.withColumn("has_images", images).withColumn("has_visual", images | ~F.coalesce("text_layer_detected", F.lit(False)))


@_query
def page_routes(spark, sf):
    """Pages of the page table by their own signals, judged by source."""
    return pages.route_pages(_scanned_pages(spark, sf), "source_id").select("source_id", "page_number", "usable", "likely_true_text", "route")


@_query
def source_votes(spark, sf):
    return pages.source_votes(_routed(spark, sf), "source")


@_query
def extraction_summary(spark, sf):
    return pages.extraction_summary(table(spark, sf, "page_metadata"))


@_query
def normalized_pages(spark, sf):
    docs = fan_out(table(spark, sf, "documents").select("doc_id", "text")).withColumn("page_number", (F.col("doc_id") % 50 + 1).cast("int"))
    return pages.normalized_pages(docs, "page_number", "text").select("doc_id", "markdown", *_long("char_count", "word_count"))


@_query
def combined_chapters(spark, sf):
    live = retrieval.live_chunks(table(spark, sf, "chunks"), "source_id", "chapter", "chunk_index", "text")
    return pages.combine_pages(live, ["source_id", "chapter"], "chunk_index", "text")


@_query
def raster_signals(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_id") % 97 == 0, ((F.col("event_id") * 37) % 4000).alias("dark"), F.lit(1_000_000).alias("n"))
    e = e.toDF("event_id", "drawings", "dark", "n")
    return e.select("event_id", pages.blank_raster(F.col("dark"), F.col("n")).alias("blank"), pages.visual_raster(F.col("drawings"), F.col("dark"), F.col("n")).alias("visual"))


# Names, addresses, tags, front matter


@_query
def url_forms(spark, sf):
    r = table(spark, sf, "article_requests").select("request_id", "url", "canonical_url").distinct()
    return r.select("request_id", X.normalize_url(F.col("url")).alias("url_form"), X.normalize_url(F.col("canonical_url")).alias("canonical_form"))


@_query
def source_ids(spark, sf):
    m = table(spark, sf, "source_manifests").select("source_id", "title", "created_at").distinct()
    made = X.source_id(F.col("title"), F.col("created_at"))
    return m.select("source_id", X.slugify(F.col("title")).alias("slug"), made.alias("made_id"), X.valid_source_id(F.col("source_id")).alias("valid"))


@_query
def file_names(spark, sf):
    j = table(spark, sf, "jobs").select("job_id", F.concat(F.lit("/in box/"), F.col("filename"), F.lit(" (1)")).alias("f")).distinct()
    return j.select("job_id", X.safe_filename(F.col("f")).alias("file_name"), X.chapter_filename(F.regexp_extract("job_id", "([0-9]+)$", 1).substr(-3, 3)).alias("chapter_file"))


@_query
def tags_normalized(spark, sf):
    r = table(spark, sf, "article_requests").select("request_id", "tags").distinct()
    return r.select("request_id", F.array_join(X.normalize_tags(F.col("tags")), "|").alias("tags"))


@_query
def input_kinds(spark, sf):
    j = table(spark, sf, "jobs").groupBy(readers.input_kind(F.col("filename")).alias("kind")).agg(F.count("*").alias("jobs"))
    return j


@_query
def front_matter(spark, sf):
    """Manifests written as Markdown with front matter, read back and merged with defaults."""
    m = identity.latest_manifests(table(spark, sf, "source_manifests"), "title", "collection", "external_id", "tags")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit("'")), F.lit('"'))
    lines = [F.lit("---"), F.concat(F.lit("title: "), quoted("title")), F.concat(F.lit("collection: "), quoted("collection")), F.concat(F.lit("external_id: "), quoted("external_id")), F.concat(F.lit("tags: ["), F.array_join(F.transform(F.col("tags"), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]")), F.lit("ignored: 1"), F.lit("---"), F.lit("Body of it.")]
    written = m.select("source_id", F.concat_ws("\n", *lines).alias("markdown"))
    read = readers.resolve_metadata(readers.parse_front_matter(written, "source_id", "markdown"), {})
    return read.select("source_id", "title", "collection", "external_id", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|").alias("tags"), "source_type", "language", "body", "front_error", "has_title")


def _answers(events):
    e = events.select("event_id", "event_type")
    chat = F.concat(F.lit('{"choices":[{"message":{"content":" '), F.col("event_type"), F.lit('\\n"}}]}'))
    vectors = F.concat(F.lit('{"data":[{"index":1,"embedding":[3,4]},{"index":0,"embedding":['), (F.col("event_id") % 7).cast("string"), F.lit(",0]}]}"))
    unit = F.transform(readers.embedding_response(vectors), retrieval.normalize)
    return e.select("event_id", readers.ocr_response_markdown(chat).alias("markdown"), F.element_at(F.element_at(unit, 1), 1).alias("first_x"), F.element_at(F.element_at(unit, 2), 2).alias("second_y"))


@_query
def service_answers(spark, sf):
    """OCR and embedding answers built from every event, parsed."""
    return _answers(table(spark, sf, "events"))


# Identity and duplicates


@_query
def identity_keys(spark, sf):
    return identity.request_identities(table(spark, sf, "article_requests")).select("request_id", "identity_key")


@_query
def duplicate_decisions(spark, sf):
    d = identity.duplicate_decisions(identity.request_identities(table(spark, sf, "article_requests")))
    return d.select("request_id", "decision", "existing_id")


@_query
def identity_backfill(spark, sf):
    return identity.backfill_identities(table(spark, sf, "source_manifests")).select("source_id", "identity_key", "backfilled")


@_query
def identity_collisions(spark, sf):
    """Identities that several sources share if every fifth source were published again under another id."""
    made = identity.backfill_identities(table(spark, sf, "source_manifests")).select("source_id", "identity_key")
    again = made.where("length(source_id) % 5 = 0").select(F.concat("source_id", F.lit("_again")).alias("source_id"), "identity_key")
    return identity.identity_collisions(made.unionByName(again)).select("identity_key", "n_sources", F.array_join("source_ids", ",").alias("source_ids"))


@_query
def published_already(spark, sf):
    r = identity.request_identities(table(spark, sf, "article_requests"))
    s = identity.backfill_identities(table(spark, sf, "source_manifests")).select("source_id", "identity_key")
    return identity.find_by_identity(r, s).select("request_id", "source_id")


@_query
def reservation_reconcile(spark, sf):
    jobs = queue.latest_jobs(table(spark, sf, "jobs"))
    held = jobs.select("identity_key", F.col("job_id").alias("owner_id"), F.when(F.col("attempts") > 1, "direct").otherwise("job").alias("owner_type"), "source_id", "created_at")
    live = identity.latest_manifests(table(spark, sf, "source_manifests"))
    out = identity.reservation_state(held, jobs.where(queue.is_active()), live, F.lit(NOW))
    return out.select("owner_id", "release")


# Chunking


@_query
def split_long_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.split_documents(docs, "doc_id", "text").select("doc_id", *_long("char_from", "char_to"), "text")


@_query
def packed_chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    c = chunking.chunk_sources(docs, "doc_id", "text")
    return c.select("source", "chunk_index", "inferred_chapter", "section", F.array_join("pages", ",").alias("pages"), "text")


@_query
def described_chunks(spark, sf):
    """Sites' documents chunked and joined to manifest-like and page-like metadata."""
    docs = table(spark, sf, "documents").where("text is not null")
    sources = docs.select(F.col("doc_id").cast("string").alias("source_id"), F.lit(None).cast("string").alias("chapter"), F.col("title"), F.col("source_type"), F.col("lang").alias("language")).dropDuplicates(["source_id"])
    c = chunking.chunk_sources(docs.dropDuplicates(["doc_id"]), "doc_id", "text")
    meta = docs.select(F.col("doc_id").cast("string").alias("source_id"), F.lit(1).alias("page_number"), F.when(F.col("doc_id") % 4 == 0, "ocr").otherwise("markdown").alias("extraction_method"), F.when(F.col("doc_id") % 4 == 0, "m1").alias("ocr_model")).dropDuplicates(["source_id"])
    return chunking.describe_chunks(c, sources, meta).select("chunk_id", "source_id", "chapter", "section", "page_start", "page_end", "chunk_index", "extraction_method", "ocr_model", "title", "language")


@_query
def markdown_parts(spark, sf):
    """Parts between blank lines with their first page marker and heading."""
    docs = fan_out(table(spark, sf, "documents").select("doc_id", "text"))
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n[ \t\n]*\n")).alias("pos", "part")).where(F.regexp_replace("part", X.SPACE, "") != "")
    page = F.nullif(F.regexp_extract("part", X.PAGE_MARKER, 1), F.lit("")).cast("bigint")
    head = F.nullif(F.regexp_extract("part", r"(?md)^(#{1,6})[ \t]+([^\n]+)$", 2), F.lit(""))
    return p.select("doc_id", F.col("pos").cast("bigint").alias("pos"), page.alias("page"), X.clean_heading(head).alias("heading"))


# Filters


def _live(spark, sf, *cols):
    """Live chunks with the columns that a query uses."""
    return retrieval.live_chunks(table(spark, sf, "chunks"), *cols)


@_query
def filter_equal_pages(spark, sf):
    f = filters.Filters(equal={"language": "en", "source_type": "documentation"}, page_start=3, page_end=20)
    return retrieval.live_matching(table(spark, sf, "chunks"), filters.predicate(f))


@_query
def filter_tags(spark, sf):
    return retrieval.live_matching(table(spark, sf, "chunks"), filters.predicate(filters.Filters(tags=("law",))))


@_query
def filter_dates(spark, sf):
    """Requests whose normalised source time lies in a range: filters on converted timestamps."""
    v = normalise_timestamps(all_source_values(*(table(spark, sf, t) for t in ("article_requests", "source_manifests", "publishers"))))
    wide = v.where("field_name = 'created_at_source'").select("record_id", F.timestamp_micros("utc_micros").alias("created_at_source"))
    f = filters.Filters(after={"created_at_source": datetime(2021, 1, 1, tzinfo=timezone.utc)}, before={"created_at_source": datetime(2022, 12, 31, tzinfo=timezone.utc)})
    return filters.apply_filters(wide, f).select("record_id")


@_query
def page_overlaps(spark, sf):
    """Chunks of one source that share a page with a later chunk, counted by chunk."""
    live = _live(spark, sf, "source_id", "chapter", "page_start", "page_end").where("page_start is not null and page_end is not null").select(F.col("chunk_id").alias("id"), "source_id", "chapter", "page_start", "page_end")
    live = live.withColumn("key", F.concat_ws("|", "source_id", F.coalesce("chapter", F.lit("")))).drop("source_id", "chapter")
    pairs = filters.overlapping_pages(live, live, "key").where("left_id < right_id")
    return pairs.groupBy("left_id").agg(F.count("*").alias("n_overlaps"))


# Search


def _query_vector(spark, sf):
    first = table(spark, sf, "chunks").where(retrieval.usable_vector(MODEL)).orderBy("chunk_id", "created_at").select("embedding").limit(1).collect()
    return list(first[0][0]) if first else [0.0]


@_query
def bm25_topk(spark, sf):
    return retrieval.top(retrieval.bm25(fan_out(table(spark, sf, "chunks").select("chunk_id", "created_at", "text")), QUESTION), "lexical", 20)


@_query
def vector_topk(spark, sf):
    return retrieval.top(retrieval.cosine_to(table(spark, sf, "chunks"), _query_vector(spark, sf), MODEL), "cosine", 20)


def _hybrid(spark, sf, method):
    return retrieval.hybrid_search(fan_out(table(spark, sf, "chunks")), QUESTION, _query_vector(spark, sf), MODEL, filters.Filters(equal={"language": "en"}), method=method)


@_query
def hybrid_relative(spark, sf):
    return _hybrid(spark, sf, "relative")


@_query
def hybrid_rrf(spark, sf):
    return _hybrid(spark, sf, "rrf")


#: The model that needs no service, and what is asked of it from end to end.
OWN_MODEL = "hashed-words-64"
ASKED = "How do routers and firewalls pass packets?"


def _hits(spark, sf):
    """The whole search: chunks embedded by the engine's own embedder, the question after its instruction, filtered, both lists fused, models compared."""
    c = table(spark, sf, "chunks").select("chunk_id", "created_at", "title", "chapter", "section", "page_start", "page_end", "text", "language")
    rows = fan_out(c).withColumns({"embedding": plugins.embed_column(F.coalesce("text", F.lit("")), plugins.hashed_vectors), "embedding_model": F.lit(OWN_MODEL), "embedding_dimension": F.lit(64)})
    f = filters.Filters(equal={"language": "en"})
    return retrieval.search(rows, ASKED, plugins.hashed_vectors, OWN_MODEL, f, top_k=10, instruction=plugins.INSTRUCTION)


@_query
def search_hits(spark, sf):
    return _hits(spark, sf).select("rank", "chunk_id", F.round("score", 6).alias("score"), "lexical", F.round("cosine", 5).alias("cosine"), "title", "embedding_model")


@_query
def search_lines(spark, sf):
    return retrieval.result_lines(_hits(spark, sf))


@_query
def context_pack(spark, sf):
    return retrieval.context_pack(_hits(spark, sf), ASKED)


@_query
def chunk_shown(spark, sf):
    """One chunk looked up by its id, here the first."""
    chunks = table(spark, sf, "chunks")
    return retrieval.show_chunk(chunks, chunks.agg(F.min("chunk_id")).collect()[0][0]).select("chunk_id", "source_id", "title", "text")


@_query
def source_shown(spark, sf):
    """One source looked up by its id, here the first."""
    m = table(spark, sf, "source_manifests")
    return identity.show_source(m, m.agg(F.min("source_id")).collect()[0][0]).select("source_id", "title", "source_type", "collection")


@_query
def model_mismatch(spark, sf):
    return retrieval.mismatched_models(_live(spark, sf, "embedding_model"), MODEL)


@_query
def neighbours_by_label(spark, sf):
    """The three vectors of each label that are nearest to the first vector, by exact cosine."""
    e = table(spark, sf, "embeddings")
    q = e.orderBy("vec_id").limit(1).select("embedding").collect()
    rows = e.select(F.col("vec_id").cast("string").alias("chunk_id"), "label", "embedding", F.lit("m").alias("embedding_model"), F.size("embedding").alias("embedding_dimension"))
    near = rows.select("chunk_id", "label", retrieval.cosine_expression(list(q[0][0]), "m").alias("cosine")).where("cosine is not null")
    place = F.row_number().over(W.partitionBy("label").orderBy(F.desc("cosine"), "chunk_id"))  # cut to three per task before the shuffle
    return near.withColumn("rank", place).where("rank <= 3")


@_query
def hashed_embeddings(spark, sf):
    """Chunks embedded without a service: length of the vector and its product with the query's."""
    live = _live(spark, sf, "text")
    v = plugins.embed_with(live, "chunk_id", "text", plugins.hashed_vectors, batch=256)
    asked = F.array(*[F.lit(x) for x in plugins.hashed_vectors([QUESTION])[0]])
    own = F.col("embedding")
    return v.select("chunk_id", F.round(retrieval.dot(own, own), 4).alias("size"), F.round(retrieval.dot(own, asked), 4).alias("likeness"))


# Index generations


def _generations(spark, sf):
    live = retrieval.live_chunks(table(spark, sf, "chunks"), "source_id", "chunk_index", "text", "page_start")
    old = live.where("chunk_index % 7 <> 0")
    new = live.where("chunk_index % 5 <> 0").withColumn("text", F.when(F.col("chunk_index") % 3 == 0, F.upper("text")).otherwise(F.col("text")))
    return old, new


@_query
def stale_chunks(spark, sf):
    return generations.stale_ids(*_generations(spark, sf))


@_query
def generation_diff(spark, sf):
    return generations.difference(*_generations(spark, sf)).groupBy("change").agg(F.count("*").alias("chunks"))


@_query
def upsert_generation(spark, sf):
    return generations.upsert(*_generations(spark, sf)).select("chunk_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


@_query
def duplicate_chunk_ids(spark, sf):
    return generations.duplicate_ids(table(spark, sf, "chunks"))


@_query
def dimension_report(spark, sf):
    return generations.dimension_report(table(spark, sf, "chunks")).select("embedding_model", "vectors", *_long("least", "most"), "misstated", "uniform")


@_query
def source_models(spark, sf):
    return generations.source_models(table(spark, sf, "chunks"), MODEL)


@_query
def chunk_stats(spark, sf):
    return generations.chunk_stats(_live(spark, sf, "source_id", "text", "page_start", "page_end"))


@_query
def facet_rollup(spark, sf):
    f = generations.facet_counts(_live(spark, sf, "source_type", "language"), "source_type", "language")
    return f.select("source_type", "language", "chunks", F.col("level").cast("bigint").alias("level"))


@_query
def index_properties(spark, sf):
    live = _live(spark, sf, "source_id", "section", "page_start", "tags")
    return generations.index_properties(live)


@_query
def chunk_keys(spark, sf):
    """Keys of the chunks in the index."""
    return _live(spark, sf, "source_id").select("chunk_id", generations.object_key(F.col("chunk_id")).alias("object_key"))


@_query
def object_faults(spark, sf):
    """Live chunks that the index would not take, and why."""
    return generations.object_faults(_live(spark, sf, "text", "embedding", "embedding_dimension"))


@_query
def snapshot_faults(spark, sf):
    return generations.snapshot_faults(table(spark, sf, "chunks"), table(spark, sf, "source_manifests"))


@_query
def source_scan(spark, sf):
    """The second page of the largest source's chunks, in order of id, after the first page's last one."""
    live = _live(spark, sf, "source_id", "chunk_index", "text")
    largest = live.groupBy("source_id").count().orderBy(F.desc("count"), "source_id").limit(1).collect()[0][0]
    last = readers.scan_source(live, largest, page=20).agg(F.max("chunk_id")).collect()[0][0]
    return readers.scan_source(live, largest, after=last, page=20)


@_query
def input_refusals(spark, sf):
    """Uploads by why they are refused, their size taken from the job's number; none have no reason."""
    j = table(spark, sf, "jobs").select("job_id", "filename").distinct()
    size = F.pmod(F.regexp_extract("job_id", "([0-9]+)$", 1).cast("bigint") * 7919, F.lit(400))
    why = readers.refusal(F.when(size % 5 == 0, F.concat("filename", F.lit(".zip"))).otherwise(F.col("filename")), F.when(size % 7 == 0, 0).otherwise(size), 300)
    return j.groupBy(why.alias("reason")).agg(F.count("*").alias("jobs"))


@_query
def failure_kinds(spark, sf):
    """Whether failures may be tried again, by status code and kind of error, for all codes from 400 and all messages of the jobs."""
    codes = spark.range(400, 520).select(F.col("id").cast("int").alias("code"))
    m = table(spark, sf, "jobs").where("error is not null").select("error").distinct()
    kinds = F.explode(F.array(*[F.lit(x) for x in ("ReadTimeout", "ValueError")])).alias("kind")
    every = codes.select(F.lit(None).cast("string").alias("error"), "code", F.lit(None).cast("string").alias("kind")).unionByName(m.select("error", F.lit(None).cast("int").alias("code"), kinds))
    return every.select("error", "code", "kind", X.retryable(F.col("error"), F.col("code"), F.col("kind")).alias("again"))


@_query
def source_list(spark, sf):
    return identity.latest_manifests(table(spark, sf, "source_manifests"), "title", "source_type", "chapter").select("source_id", "title", "source_type", "chapter")


@_query
def chunk_list(spark, sf):
    return _live(spark, sf, "title", "page_start", "page_end").select("chunk_id", "title", X.page_label(F.col("page_start"), F.col("page_end")).alias("pages"))


@_query
def index_copy_check(spark, sf):
    """A copy that lacks every thirteenth chunk and holds another vector for every eleventh."""
    old = _live(spark, sf, "chunk_index", "embedding")
    cut = F.when(F.col("chunk_index") % 11 == 0, F.slice("embedding", 1, 2)).otherwise(F.col("embedding"))
    return generations.copied_completely(old, old.where("chunk_index % 13 <> 0").withColumn("embedding", cut))


@_query
def layout_fallback(spark, sf):
    """Pages whose layout failed or was empty, from page attempts; the layout is the text of the chunk that begins there, in capitals."""
    p = pages.latest_pages(table(spark, sf, "page_metadata"), "extraction_method").where("source_id is not null")
    first = _live(spark, sf, "source_id", "page_start", "text").where("text is not null").groupBy("source_id", F.col("page_start").alias("page_number")).agg(F.min("text").alias("plain"))
    error = F.when(F.col("extraction_method") == "failed", "RuntimeError")
    made = p.join(first, ["source_id", "page_number"], "left").select("source_id", "page_number", F.when(F.col("extraction_method") != "skipped", F.upper("plain")).alias("layout"), error.alias("layout_error"), "plain")
    return plugins.layout_fallback(made).select("source_id", "page_number", "extraction_method", F.array_join("quality_flags", ",").alias("flags"), "fatal", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


@_query
def publication_outcomes(spark, sf):
    """Half of the sources published again, some with other content."""
    live = identity.latest_manifests(table(spark, sf, "source_manifests")).select("source_id", "identity_key", "content_sha256")
    other = F.when(F.length("source_id") % 3 == 0, F.lit("changed")).otherwise(F.col("content_sha256"))
    return identity.publication_conflicts(live.withColumn("content_sha256", other), live.where(F.length("source_id") % 2 == 0))


# Queue


def _jobs(spark, sf):
    return queue.latest_jobs(table(spark, sf, "jobs"))


@_query
def job_ready(spark, sf):
    return queue.ready_jobs(_jobs(spark, sf), F.lit(NOW), 25).select("job_id")


@_query
def job_claim(spark, sf):
    return queue.claim(_jobs(spark, sf), F.lit(NOW), "worker-x").select("job_id", "status", "attempts", "worker_id")


@_query
def job_recovery(spark, sf):
    return queue.recover_interrupted(_jobs(spark, sf)).groupBy("status").agg(F.count("*").alias("jobs"), F.count("worker_id").alias("owned"))


@_query
def job_failures(spark, sf):
    return queue.after_failure(_jobs(spark, sf), F.lit(NOW))


@_query
def admission_control(spark, sf):
    """Article requests as uploads in order of arrival, against a queue that holds the active jobs already."""
    r = table(spark, sf, "article_requests")
    u = r.groupBy("request_id").agg(F.min("received_at").alias("received_at"), F.max(F.length("body")).cast("bigint").alias("bytes"))
    active = _jobs(spark, sf).where(queue.is_active()).count()
    s = Queue(max_active=active + 20, storage_bytes=60_000, upload_bytes=2_500)
    return queue.admit(u, active, 30_000, s, ("received_at", "request_id")).select("request_id", "bytes", "decision")


@_query
def blocked_jobs(spark, sf):
    """Ended jobs sent in again under another source id: which of them, and which others, a job blocks."""
    live = identity.latest_manifests(table(spark, sf, "source_manifests"), "title")
    jobs = _jobs(spark, sf).select("job_id", "status", "source_id", "identity_key")
    again = jobs.where("status in ('succeeded', 'failed')").select(F.concat("job_id", F.lit("-again")).alias("job_id"), F.lit("queued").alias("status"), F.concat("source_id", F.lit("_2")).alias("source_id"), "identity_key")
    return queue.blocking_jobs(jobs.unionByName(again), live)


@_query
def retry_jobs(spark, sf):
    """All jobs asked to run again; uploads of those with an even number of attempts are still there."""
    jobs = _jobs(spark, sf)
    there = jobs.where("attempts % 2 = 0").select("upload_path")
    asked = jobs.select("job_id").unionByName(jobs.select(F.lit("no-such-job").alias("job_id")).limit(1))
    s = Queue(max_active=jobs.where(queue.is_active()).count() + 7)
    return queue.retry(jobs, asked, there, s)


@_query
def terminal_cleanup(spark, sf):
    return queue.terminal_cleanup(_jobs(spark, sf))


@_query
def expired_uploads(spark, sf):
    return queue.expired_uploads(_jobs(spark, sf), F.lit(NOW))


@_query
def orphan_uploads(spark, sf):
    jobs = _jobs(spark, sf)
    uploads = jobs.select("upload_path", "job_id").unionByName(jobs.where("attempts = 1").select(F.concat("upload_path", F.lit(".tmp")).alias("upload_path"), "job_id"))
    return queue.orphan_uploads(uploads, jobs, jobs.where("status = 'running'"))


@_query
def worker_health(spark, sf):
    return queue.worker_health(_jobs(spark, sf), F.lit(NOW))


@_query
def queue_health(spark, sf):
    jobs = _jobs(spark, sf)
    return queue.queue_health(jobs, reservations=jobs.where("status = 'failed'"), sources=table(spark, sf, "source_manifests"))


@_query
def job_phases(spark, sf):
    """Jobs by phase, the phase that follows (also if a job is not to be indexed) and the one an interrupted job goes on from."""
    j = _jobs(spark, sf)
    follows = queue.transition(F.col("status"), F.col("phase"))
    short = queue.transition(F.col("status"), F.col("phase"), F.lit(True))
    return j.groupBy("status", "phase", follows.alias("next_phase"), short.alias("next_unindexed"), queue.resume_phase(F.col("phase")).alias("resumed")).agg(F.count("*").alias("jobs"))


@_query
def blank_sources(spark, sf):
    return pages.without_content(table(spark, sf, "page_metadata"))


@_query
def event_activity(spark, sf):
    """Hourly events by type, the batch form of the streaming window."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_timestamp("w.start").alias("hour_s"), "event_type", "events", "total")


# Timestamps


@_query
def p2_found(spark, sf):
    return found_moments(*(table(spark, sf, t) for t in ("article_requests", "source_manifests", "publishers")))


@_query
def p2_normalised(spark, sf):
    return normalise_timestamps(all_source_values(*(table(spark, sf, t) for t in ("article_requests", "source_manifests", "publishers"))))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in _QUERIES}


__all__ = ["oracle_sql", "queries"]
