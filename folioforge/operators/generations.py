"""Generations of the chunk index: set differences, upsert, deletion and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stale_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """chunk_ids that the new generation lacks."""
    return old.select("chunk_id").distinct().join(new.select("chunk_id").distinct(), "chunk_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows whose id is not in ``new``, and all of ``new``."""
    return old.join(new.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(new)


def delete_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def replace_source(index: DataFrame, source: str, new: DataFrame) -> DataFrame:
    """The index with one source's chunks replaced, stale ones gone."""
    return index.where(~F.col("source_id").eqNullSafe(F.lit(source))).unionByName(new)


def _same(cols: list[str]) -> Column:
    return F.struct(*[F.col(f"a.{c}") for c in cols]).eqNullSafe(F.struct(*[F.col(f"b.{c}") for c in cols]))


def difference(old: DataFrame, new: DataFrame, ignored: tuple[str, ...] = ("created_at", "chunker_version")) -> DataFrame:
    """(chunk_id, change): added, removed, changed or same, by all columns but the ignored ones."""
    cols = [c for c in old.columns if c in new.columns and c not in (*ignored, "chunk_id")]
    joined = old.alias("a").join(new.alias("b"), F.col("a.chunk_id") == F.col("b.chunk_id"), "full_outer")
    change = F.when(F.col("a.chunk_id").isNull(), "added").when(F.col("b.chunk_id").isNull(), "removed").when(_same(cols), "same").otherwise("changed")
    return joined.select(F.coalesce("a.chunk_id", "b.chunk_id").alias("chunk_id"), change.alias("change"))


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_id, n) of ids that occur more than once within a source."""
    return chunks.groupBy("source_id", "chunk_id").agg(F.count("*").alias("n")).where("n > 1")


def dimension_report(chunks: DataFrame) -> DataFrame:
    """Per model: vectors, least and greatest length, whether they are uniform and as stated."""
    rows = chunks.where("embedding is not null and embedding_model is not null")
    return rows.groupBy("embedding_model").agg(
        F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"),
        F.count_if(~F.col("embedding_dimension").eqNullSafe(F.size("embedding"))).alias("misstated"),
    ).withColumn("uniform", F.col("least") == F.col("most"))


def source_models(chunks: DataFrame, configured: str) -> DataFrame:
    """(source_id, models, mismatch): whether a source holds vectors of another model than the configured one."""
    other = (F.col("embedding_model").isNotNull()) & (F.col("embedding_model") != configured)
    return chunks.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("embedding_model")), ",").alias("models"), F.bool_or(F.coalesce(other, F.lit(False))).alias("mismatch"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per source: chunks, characters, page range and mean length."""
    return chunks.groupBy("source_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"),
        F.round(F.avg(F.length("text")), 6).alias("mean_chars"),
    )


#: The properties that an index entry can have.
PROPERTIES = (
    "chunk_id", "source_id", "source_type", "title", "course", "chapter", "section", "page_start", "page_end", "chunk_index", "text", "file_path", "extraction_method", "ocr_model", "language", "tags", "origin", "publisher",
    "author", "created_at_source", "updated_at_source", "retrieved_at", "url", "canonical_url", "external_id", "collection", "summary", "embedding_model", "embedding_dimension", "created_at",
)


def index_properties(chunks: DataFrame, now: Column | None = None) -> DataFrame:
    """(chunk_id, properties): a chunk as JSON of known properties without nulls and empty lists; a missing created_at becomes ``now`` if that is given."""
    if now is not None:
        chunks = chunks.withColumn("created_at", F.coalesce("created_at", now) if "created_at" in chunks.columns else now)
    cols = [c for c in chunks.columns if c in PROPERTIES]
    kept = [F.when(F.size(c) > 0, F.col(c)).alias(c) if dict(chunks.dtypes)[c].startswith("array") else F.col(c) for c in cols]
    return chunks.select("chunk_id", F.to_json(F.struct(*kept), {"ignoreNullFields": "true"}).alias("properties"))


def facet_counts(chunks: DataFrame, *facets: str) -> DataFrame:
    """Counts over all combinations of the facets' leading parts (rollup); an extension."""
    return chunks.rollup(*facets).agg(F.count("*").alias("chunks"), F.grouping_id().alias("level"))


def delete_source(index: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(the index without a source's chunks, one row with how many go)."""
    gone = F.col("source_id").eqNullSafe(F.lit(source))
    return index.where(~gone), index.agg(F.count_if(gone).alias("deleted"))


def copied_completely(old: DataFrame, new: DataFrame, compared: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """One row: rows of both generations, ids that the copy lacks, ids whose ``compared`` columns differ in it, and whether it is complete.

    Columns are compared by their 64-bit hashes, so no vectors are shuffled; an id that is repeated counts once, by its greatest hash.
    """
    cols = [c for c in compared if c in old.columns and c in new.columns]

    def slim(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("chunk_id").agg(F.max(F.xxhash64(F.lit(0), *[F.col(c) for c in cols])).alias(name))

    both = slim(old, "h_").join(slim(new, "g_"), "chunk_id", "left").agg(F.count_if(F.col("g_").isNull()).alias("missing"), F.count_if(F.col("g_") != F.col("h_")).alias("different"))
    counts = old.agg(F.count("*").alias("old_rows")).crossJoin(new.agg(F.count("*").alias("new_rows"))).crossJoin(both)  # one row each
    return counts.withColumn("complete", (F.col("missing") == 0) & (F.col("different") == 0))


#: Fixed value: the name space of index keys (that of domain names) as 32 hexadecimal digits.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def object_key(chunk_id: Column) -> Column:
    """Key of a chunk in the index: its name-based UUID (version 5), so the same id always replaces the same object."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(chunk_id, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def object_faults(rows: DataFrame) -> DataFrame:
    """(chunk_id, fault) of rows that cannot be written to the index: no_id, no_text, no_vector, bad_vector or wrong_length."""
    vector = F.col("embedding")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = F.when(F.col("chunk_id").isNull(), "no_id").when(F.col("text").isNull(), "no_text").when(vector.isNull() | (F.size(vector) == 0), "no_vector").when(bad, "bad_vector").when(~F.col("embedding_dimension").eqNullSafe(F.size(vector)), "wrong_length")
    return rows.select("chunk_id", fault.alias("fault")).where("fault is not null")


def snapshot_faults(chunks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(fault, rows): what would keep a snapshot from being restored: the faults of its objects, ids that two sources use, and (with ``sources``) sources that are not known."""
    parts = object_faults(chunks).select("fault")
    two = chunks.where("chunk_id is not null").groupBy("chunk_id").agg((F.min("source_id") != F.max("source_id")).alias("two_")).where("two_").select(F.lit("two_sources").alias("fault"))
    parts = parts.unionByName(two)
    if sources is not None:
        parts = parts.unionByName(chunks.join(sources.select("source_id").distinct(), "source_id", "left_anti").select(F.lit("unknown_source").alias("fault")))
    return parts.groupBy("fault").agg(F.count("*").alias("rows"))


def require_deleted(before: DataFrame, after: DataFrame, source: str) -> int:
    """How many of a source's chunks a deletion took; raises unless it took all of them and nothing else."""
    gone = F.col("source_id").eqNullSafe(F.lit(source))
    b, a = (df.agg(F.count_if(gone).alias("own"), F.count_if(~gone).alias("other")).collect()[0] for df in (before, after))
    if a["own"] or a["other"] != b["other"]:
        raise RuntimeError(f"deletion of {source!r} is not complete: {a['own']} of {b['own']} rows are left, {b['other'] - a['other']} of other sources are gone")
    return b["own"]


def publish_source(index, source: str, chunks: DataFrame, manifest: DataFrame | None = None) -> int:
    """Replaces one source in a versioned index, all or nothing: its chunks, and with them its manifest if one is given.

    Staged rows are checked first (faults, foreign rows, repeated ids); the version that was read is the snapshot: it stays current if anything fails, and a change by another writer
    in between is refused. Returns the version.
    """
    if (n := chunks.where(~F.col("source_id").eqNullSafe(F.lit(source))).limit(1).count()) or chunks.isEmpty():
        raise ValueError(f"staged rows of {source!r} " + ("hold another source's" if n else "are empty"))
    if faults := object_faults(chunks).limit(5).collect():
        raise ValueError(f"staged rows of {source!r} have faults: {[tuple(f) for f in faults]}")
    base = index.current()
    held = None if base is None else index.parts(base)
    parts = {"chunks": chunks if held is None else replace_source(index.read(base, "chunks"), source, chunks)}
    if held is not None and "sources" in held:
        rest = index.read(base, "sources").where(~F.col("source_id").eqNullSafe(F.lit(source)))
        parts["sources"] = rest if manifest is None else rest.unionByName(manifest)
    elif manifest is not None:
        parts["sources"] = manifest
    return index.publish_parts(parts, {"chunks": "chunk_id", "sources": "source_id"}, base=base)
