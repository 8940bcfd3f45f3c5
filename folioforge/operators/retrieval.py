"""Lexical, vector and hybrid top-k search; result lines and cited context packs."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions.text import page_label, strip, tokens
from folioforge.operators.filters import Filters, predicate
from folioforge.plans.config import Retrieval
from folioforge.plans.runtime import save_table


def live_chunks(chunks: DataFrame, *cols: str) -> DataFrame:
    """Each chunk once, by its latest row, with the named columns; name only those in use, as all of them are shuffled."""
    return chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct(F.col("created_at").alias("at_"), *cols)).alias("n_")).select("chunk_id", *[F.col(f"n_.{c}").alias(c) for c in cols])


def live_matching(chunks: DataFrame, where: Column, *cols: str) -> DataFrame:
    """``live_chunks`` of which the latest row fulfils ``where``.

    The condition reaches the scan: only rows that fulfil it carry ``cols`` into the shuffle; whether such a row is its chunk's latest is told by a second
    scan of id and time alone, on the same partitioning. Of equally late rows one that fulfils it is enough.
    """
    known = chunks.where("chunk_id is not null")
    hits = live_chunks(known.where(where), *dict.fromkeys((*cols, "created_at")))
    newest = known.groupBy(F.col("chunk_id").alias("i_")).agg(F.max("created_at").alias("t_"))
    return hits.join(newest, (F.col("chunk_id") == F.col("i_")) & F.col("created_at").eqNullSafe(F.col("t_"))).select("chunk_id", *cols)


def query_terms(query: str) -> list[str]:
    """Distinct lower-case words of a query."""
    import re

    words = re.findall(r"[^\W](?:[\w'-]*[^\W])?", query.lower())
    return list(dict.fromkeys(words))


def _delivered(chunks: DataFrame) -> Column:
    """When a row was delivered; null for all rows of a table that does not tell."""
    return (F.col("created_at") if "created_at" in chunks.columns else F.lit(None).cast("timestamp")).alias("created_at")


def _term_counts(words: Column, terms: Sequence[str]) -> list[Column]:
    """Length of a list of words, and the number of times it holds each term."""

    def times(word: str) -> Column:
        return F.size(F.filter(words, lambda x: x == F.lit(word)))

    return [F.size(words).alias("dl_"), *[times(w).alias(f"tf{i}_") for i, w in enumerate(terms)]]


def _features(chunks: DataFrame, query: str, where: Column | None, vector: Sequence[float] | None, model: str | None) -> DataFrame:
    """(chunk_id, keep_, dl_, tf0_.., cosine) once per chunk, by its latest row.

    Every row is reduced to these numbers before the latest is looked for, so neither texts nor vectors are shuffled.
    """
    terms = query_terms(query)
    keep = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    near = cosine_expression(vector, model) if vector is not None else F.lit(None).cast("double")
    words = tokens(F.lower(F.coalesce("text", F.lit("")))).alias("words_")  # a column of its own, so that it is made once
    slim = chunks.where("chunk_id is not null").select("chunk_id", _delivered(chunks), keep.alias("keep_"), near.alias("cosine"), words)
    slim = slim.select("chunk_id", "created_at", "keep_", "cosine", *_term_counts(F.col("words_"), terms))
    names = ("keep_", "cosine", "dl_", *(f"tf{i}_" for i in range(len(terms))))
    return live_chunks(slim, *names)


def _lexical(features: DataFrame, query: str, settings: Retrieval) -> DataFrame:
    """Adds ``lexical`` (null where no query word occurs); frequencies are taken over the whole index."""
    s, n = settings, len(query_terms(query))
    stats = features.agg(F.count("*").alias("n_"), F.avg("dl_").alias("avg_"), *[F.count_if(F.col(f"tf{i}_") > 0).alias(f"df{i}_") for i in range(n)])
    score = F.lit(0.0)
    for i in range(n):
        idf = F.log(1 + (F.col("n_") - F.col(f"df{i}_") + 0.5) / (F.col(f"df{i}_") + 0.5))
        tf = F.col(f"tf{i}_")
        score = score + idf * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * F.col("dl_") / F.col("avg_")))
    scored = features.where("keep_").crossJoin(F.broadcast(stats)).withColumn("s_", F.round(score, 6))  # one row
    return scored.select("chunk_id", F.when(F.col("s_") > 0, F.col("s_")).alias("lexical"), "cosine")


def bm25(chunks: DataFrame, query: str, where: Column | None = None, settings: Retrieval | None = None) -> DataFrame:
    """(chunk_id, lexical) of chunks, deliveries included, whose latest row holds a query word.

    Each text is tokenised in place and counted against the few query words, so neither postings nor vocabulary are shuffled; the
    statistics are one row.
    """
    return _lexical(_features(chunks, query, where, None, None), query, settings or Retrieval()).where("lexical is not null").select("chunk_id", "lexical")


def usable_vector(model: str) -> Column:
    """Chunks of a model whose vector is there and as long as stated."""
    return (F.col("embedding_model") == model) & (F.size("embedding") == F.col("embedding_dimension"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine_expression(vector: Sequence[float], model: str) -> Column:
    """Exact cosine of a chunk's vector to a query vector; null where the vector is not usable or of another length."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    size = sum(float(x) ** 2 for x in vector) ** 0.5 or 1.0
    own = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    good = usable_vector(model) & (F.size("embedding") == len(vector)) & (own > 0)
    return F.when(good, F.round(dot(F.col("embedding"), q) / (own * size), 6))


def cosine_to(chunks: DataFrame, vector: Sequence[float], model: str, where: Column | None = None) -> DataFrame:
    """(chunk_id, cosine) of chunks, deliveries included, by their latest row, to a query vector; exact."""
    keep = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    slim = chunks.where("chunk_id is not null").select("chunk_id", _delivered(chunks), keep.alias("keep_"), cosine_expression(vector, model).alias("cosine"))
    return live_chunks(slim, "keep_", "cosine").where("keep_ and cosine is not null").select("chunk_id", "cosine")


def top(df: DataFrame, score: str, k: int, *cols: str) -> DataFrame:
    """The k best, ties by chunk_id, with rank and ``cols``; planned as a bounded top-k per task."""
    best = df.select("chunk_id", score, *cols).orderBy(F.desc(score), "chunk_id").limit(k)
    listed = best.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("chunk_id").alias("c"), *cols))).alias("l"))
    return listed.select(F.posexplode("l").alias("p", "e")).select(F.col("e.c").alias("chunk_id"), (-F.col("e.s")).alias(score), (F.col("p") + 1).alias("rank"), *[F.col(f"e.{c}").alias(c) for c in cols])


def ranked(df: DataFrame, score: str) -> DataFrame:
    """(chunk_id, rank) of all rows by score, ties by chunk_id, without ordering them in one task.

    Rows are split into ranges of the order and kept so in the shared folder; a row's rank is its place in its range after the ranges before, of which one count each is
    collected.
    """
    order = [F.desc(score), F.asc("chunk_id")]
    parts = save_table(df.select("chunk_id", score).repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = sorted((r["range_"], r["count"]) for r in parts.groupBy("range_").count().collect())  # one number per partition
    starts = itertools.accumulate([0, *(n for _, n in sizes)])
    known = [F.lit(x) for (r, _), start in zip(sizes, starts) for x in (r, start)]
    offset = F.try_element_at(F.create_map(*known), F.col("range_")) if known else F.lit(0)
    place = F.row_number().over(W.partitionBy("range_").orderBy(*order))
    return parts.select("chunk_id", (place + offset).alias("rank"))


def hybrid_scores(scored: DataFrame, method: str = "relative", settings: Retrieval | None = None) -> DataFrame:
    """(chunk_id, score, lexical, cosine) of rows with either number: both whole lists fused.

    relative: min-max of each list, weighted by alpha, a missing side counting 0 and a constant list 1; rrf: weighted reciprocal ranks.
    """
    s = settings or Retrieval()
    either = scored.where("lexical is not null or cosine is not null")
    if method == "rrf":
        either = save_table(either, "scores")
        lists = [ranked(either.where(F.col(c).isNotNull()), c).select("chunk_id", F.col("rank").alias(f"{c}_rank_")) for c in ("lexical", "cosine")]
        both = either.join(lists[0], "chunk_id", "left").join(lists[1], "chunk_id", "left")
        part = lambda c: F.coalesce(1 / (s.rrf + F.col(c)), F.lit(0.0))
        score = s.alpha * part("cosine_rank_") + (1 - s.alpha) * part("lexical_rank_")
        return both.select("chunk_id", F.round(score, 9).alias("score"), "lexical", "cosine")
    ends = either.agg(*[f(c).alias(f"{n}_{c}") for c in ("lexical", "cosine") for n, f in (("lo", F.min), ("hi", F.max))])
    joined = either.crossJoin(F.broadcast(ends))  # one row

    def scaled(c: str) -> Column:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.coalesce(F.when(span > 0, (F.col(c) - F.col(f"lo_{c}")) / span).otherwise(F.when(F.col(c).isNotNull(), 1.0)), F.lit(0.0))

    score = s.alpha * scaled("cosine") + (1 - s.alpha) * scaled("lexical")
    return joined.select("chunk_id", F.round(score, 9).alias("score"), "lexical", "cosine")


def hybrid_search(chunks: DataFrame, query: str, vector: Sequence[float], model: str, filters: Filters | None = None, top_k: int | None = None, method: str = "relative", settings: Retrieval | None = None) -> DataFrame:
    """(rank, chunk_id, score, lexical, cosine): filtered before ranking, both whole lists fused, the best top_k.

    ``chunks`` may hold deliveries; a chunk counts by its latest row. One scan gives a few numbers per row, all else works on those.
    """
    s = settings or Retrieval()
    features = _features(chunks, query, predicate(filters) if filters else None, vector, model)
    return top(hybrid_scores(_lexical(features, query, s), method, s), "score", top_k or s.top_k, "lexical", "cosine").select("rank", "chunk_id", "score", "lexical", "cosine")


def search(chunks: DataFrame, query: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], model: str, filters: Filters | None = None, top_k: int | None = None, alpha: float | None = None, method: str = "relative", allow_mismatch: bool = False, instruction: str = "", settings: Retrieval | None = None) -> DataFrame:
    """The best chunks for a question with their columns, rank and score: the whole way from question to hits.

    The question is embedded after its ``instruction``; filters hold before ranking; both lists are fused; hits embedded by another model than the configured one
    are an error unless ``allow_mismatch`` (then only their words count). Hits are a bounded list, joined back to their rows.
    """
    check_request(query, top_k, alpha)
    s = replace(settings or Retrieval(), **({} if alpha is None else {"alpha": alpha}))
    best = hybrid_search(chunks, query, list(embed([instruction + query])[0]), model, filters, top_k, method, s)
    cols = [c for c in chunks.columns if c not in ("chunk_id", "created_at", "embedding", "rank", "score", "lexical", "cosine")]
    ids = save_table(best, "hits")
    rows = live_chunks(chunks.withColumn("created_at", _delivered(chunks)).join(F.broadcast(ids.select("chunk_id")), "chunk_id", "left_semi"), *cols)  # top_k rows
    return require_model(ids.join(rows, "chunk_id"), model, allow_mismatch) if "embedding_model" in cols else ids.join(rows, "chunk_id")


def show_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The latest row of one chunk; a lookup that reaches the scan. Raises if there is none."""
    found = chunks.where(F.col("chunk_id") == chunk_id).orderBy(F.desc("created_at")).limit(1)
    if found.isEmpty():
        raise LookupError(f"no chunk {chunk_id!r}")
    return found


def mismatched_models(results: DataFrame, model: str) -> DataFrame:
    """Embedding models other than the configured one among results, in order."""
    return results.where(F.col("embedding_model").isNotNull() & (F.col("embedding_model") != model)).select("embedding_model").distinct().orderBy("embedding_model")


def require_model(results: DataFrame, model: str, allow_mismatch: bool = False) -> DataFrame:
    """The results; raises if some were embedded by another model. Results are a bounded top-k."""
    if not allow_mismatch and (others := [r[0] for r in mismatched_models(results, model).collect()]):
        raise ValueError(f"embedding model mismatch: configured {model!r}, found {others}")
    return results


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def result_lines(results: DataFrame) -> DataFrame:
    """(rank, line): four lines a hit with a snippet of 300 characters."""
    pages = page_label(F.col("page_start"), F.col("page_end"), zero_is_missing=True)
    snippet = F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 300)
    head = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit(", chapter "), _or("chapter", "-"), F.lit(", section "), _or("section", "-"), F.lit(", pages "), pages)
    rest = [F.concat(F.lit("   score: "), F.coalesce(F.format_number("score", 6), F.lit("-"))), F.concat(F.lit("   chunk_id: "), F.col("chunk_id")), F.concat(F.lit("   snippet: "), snippet)]
    return results.select("rank", F.concat_ws("\n", head, *rest).alias("line"))


def context_pack(results: DataFrame, question: str, task: str = "answer") -> DataFrame:
    """One row with the cited context of a bounded result list, in rank order."""
    pages = page_label(F.col("page_start"), F.col("page_end"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("## Source "), F.col("rank").cast("string")), F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("Chapter: "), _or("chapter", "")),
        F.concat(F.lit("Section: "), _or("section", "")), F.concat(F.lit("Pages: "), pages), F.concat(F.lit("Chunk ID: "), F.col("chunk_id")), F.lit(""), strip(F.col("text")), F.lit(""),
    )
    # Fixed text of the pack.
    head = "\n".join(["# Context Pack", "", "User question:", question, "", "Instructions:", "Use only the provided context. Cite sources as [Title, p. 87]. If the answer is not in the context, say so.", "", f"Task: {task}", "", ""])
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    whole = F.concat(F.lit(head), F.array_join(F.transform(parts, lambda p: p["b"]), "\n"))
    return results.groupBy().agg(F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("context_pack"), F.count("*").alias("sources"))


def check_request(query: str, top_k: int | None = None, alpha: float | None = None) -> None:
    """Raises for an empty query, a top_k outside 1 to 100 or an alpha outside 0 to 1; None means the default."""
    if not query:
        raise ValueError("query must not be empty")
    if top_k is not None and not 1 <= top_k <= 100:
        raise ValueError("top_k must lie between 1 and 100")
    if alpha is not None and not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
