"""Text quality of pages, routing between text layer and OCR, extraction summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import LINE_END, SPACE, page_markdown, strip, tokens
from folioforge.plans.config import Detection


def with_quality(df: DataFrame, text: str, rules: Detection | None = None) -> DataFrame:
    """Adds the quality figures of a text column and the flags it fails, in fixed order. Null counts as empty."""
    r = rules or Detection()
    base = df.withColumn("t_", strip(F.coalesce(F.col(text), F.lit("")))).withColumn("w_", tokens(F.col("t_")))
    chars = F.length("t_")
    share = lambda part: F.when(chars > 0, part / chars).otherwise(F.lit(0.0))
    alnum = F.length(F.regexp_replace("t_", r"[^\p{L}\p{N}]", ""))
    replaced = chars - F.length(F.replace("t_", F.lit("�"), F.lit("")))
    lines = F.size(F.filter(F.split("t_", LINE_END), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0))
    out = base.select(
        "*", chars.alias("char_count"), F.size("w_").alias("word_count"), share(alnum).alias("alpha_ratio"), share(replaced).alias("replacement_char_ratio"),
        F.when(F.size("w_") > 0, F.length(F.array_join("w_", "")) / F.size("w_")).otherwise(F.lit(0.0)).alias("avg_word_length"), lines.alias("line_count"),
    ).drop("t_", "w_")
    rules_ = (
        (F.col("char_count") < r.min_chars, "too_few_chars"), (F.col("alpha_ratio") < r.min_alpha_ratio, "low_alpha_ratio"),
        (F.col("replacement_char_ratio") > r.max_replacement_ratio, "replacement_chars"),
        (F.col("avg_word_length") > r.max_word_length, "long_average_word"), (F.col("line_count") == 0, "no_lines"),
    )
    flags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules_]))
    return out.withColumn("flags", flags).withColumn("is_true_text", F.size("flags") == 0)


#: Flags of with_quality in their order.
FLAGS = ("too_few_chars", "low_alpha_ratio", "replacement_chars", "long_average_word", "no_lines")


def flag_counts(pages: DataFrame) -> DataFrame:
    """(flag, documents) of flags that occur, from pages with quality columns; counted in one pass without spreading the flags."""
    one = pages.agg(*[F.count_if(F.array_contains("flags", f)).alias(f) for f in FLAGS])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("documents")) for f in FLAGS])).alias("r")
    return one.select(rows).select("r.flag", "r.documents").where("documents > 0")


def usable_text_layer(rules: Detection | None = None) -> Column:
    """Whether a page with quality columns has a text layer worth keeping."""
    r = rules or Detection()
    return (
        (F.col("char_count") >= max(20, r.min_chars // 4)) & (F.col("alpha_ratio") >= r.min_alpha_ratio)
        & ~F.array_contains("flags", "replacement_chars") & ~F.array_contains("flags", "long_average_word")
    )


def source_votes(pages: DataFrame, source: str, rules: Detection | None = None) -> DataFrame:
    """(source, pages, usable_pages, true_text_pages, likely_true_text) by partial counts; no group is gathered."""
    counts = pages.groupBy(source).agg(F.count("*").alias("pages"), F.count_if(usable_text_layer(rules)).alias("usable_pages"), F.count_if("is_true_text").alias("true_text_pages"))
    likely = (F.col("true_text_pages") > 0) & ((F.col("usable_pages") / F.col("pages") >= 0.5) | (F.col("true_text_pages") >= 3))
    return counts.withColumn("likely_true_text", likely)


def wants_ocr(mode: str = "auto") -> Column:
    """Decision per page from is_true_text, likely_true_text, has_visual, has_images, char_count and flags."""
    if mode in ("always", "never"):
        return F.lit(mode == "always")
    if mode != "auto":
        return ~F.col("is_true_text")
    serious = F.size(F.array_remove("flags", "too_few_chars")) > 0
    some = F.col("char_count") > 0
    keep = F.col("is_true_text") | (F.col("likely_true_text") & ~F.col("has_visual")) | (some & ~F.col("has_images") & ~serious) | (some & ~F.col("has_visual"))
    return ~keep & F.col("has_visual")


def route_pages(pages: DataFrame, source: str, mode: str = "auto", rules: Detection | None = None) -> DataFrame:
    """Adds usable, likely_true_text and route (ocr or text) to pages with quality columns, has_images and has_visual."""
    votes = source_votes(pages, source, rules).select(F.col(source).alias("s_"), "likely_true_text")
    joined = pages.join(votes, F.col(source).eqNullSafe(F.col("s_")), "left").drop("s_")
    return joined.withColumn("usable", usable_text_layer(rules)).withColumn("route", F.when(wants_ocr(mode), "ocr").otherwise("text"))


def blank_raster(dark: Column, n: Column) -> Column:
    """A rendered page with next to no dark pixels."""
    return dark <= F.greatest(F.lit(8), (n * 0.0001).cast("bigint"))


def visual_raster(drawings: Column, dark: Column, n: Column) -> Column:
    """A page with drawings or enough ink."""
    return drawings | (dark / F.greatest(n, F.lit(1)) >= 0.002)


def latest_pages(pages: DataFrame, *cols: str) -> DataFrame:
    """The latest attempt of each page, with ``cols`` or all its columns; ties are settled by the other columns."""
    cols = cols or tuple(c for c in pages.columns if c not in ("source_id", "page_number", "extracted_at"))
    newest = F.max(F.struct("extracted_at", *cols)).alias("n_")
    return pages.groupBy("source_id", "page_number").agg(newest).select("source_id", "page_number", "n_.*")


def one_or_mixed(c: Column) -> Column:
    """Aggregate: the only value there is, ``mixed`` if there are several, null if none."""
    return F.when(F.min(c) == F.max(c), F.min(c)).when(F.min(c).isNotNull(), F.lit("mixed"))


def extraction_summary(pages: DataFrame) -> DataFrame:
    """Per source: pages by method, the OCR provider and model in use, whether nothing was read."""
    ocr = F.col("extraction_method") == "ocr"
    return latest_pages(pages, "extraction_method", "ocr_provider", "ocr_model").groupBy("source_id").agg(
        F.count("*").alias("pages_total"), F.count_if(F.col("extraction_method") == "pymupdf4llm").alias("pages_layout"), F.count_if(ocr).alias("pages_ocr"),
        one_or_mixed(F.when(ocr, F.col("ocr_provider"))).alias("ocr_provider"), one_or_mixed(F.when(ocr, F.col("ocr_model"))).alias("ocr_model"),
        F.bool_and(F.coalesce(F.col("extraction_method") == "skipped", F.lit(False))).alias("all_skipped"),
    )


def combine_pages(pages: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """One text per key: stripped parts in order with one line feed between. Keys must bound a group (a chapter, a page range)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda p: strip(p["t"])), "\n")
    return pages.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.concat(strip(joined), F.lit("\n")).alias("markdown"))


def normalized_pages(pages: DataFrame, number: str, text: str) -> DataFrame:
    """Adds ``markdown``, char_count and word_count (after normalisation, marker included). A page without content is blank and has 0 of both."""
    out = pages.withColumn("markdown", page_markdown(F.coalesce(F.col(text), F.lit("")), F.col(number)))
    bare = strip(F.col("markdown"))
    blank = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    words = F.size(F.filter(F.split(bare, f"{SPACE}+"), lambda w: w != ""))
    return out.withColumn("char_count", F.when(blank, 0).otherwise(F.length(bare))).withColumn("word_count", F.when(blank, 0).otherwise(words))


def require_content(summary: DataFrame) -> DataFrame:
    """The summary of ``extraction_summary``; raises when it is read if a source has pages and all of them were skipped."""
    said = F.concat(F.lit("no content: every page of "), F.coalesce("source_id", F.lit("a source")), F.lit(" was blank"))
    return summary.where(F.when(F.col("all_skipped"), F.raise_error(said).isNull()).otherwise(F.lit(True)))


def without_content(pages: DataFrame) -> DataFrame:
    """(source_id, pages_total) of sources of which every page was skipped; such are refused, not published."""
    return extraction_summary(pages).where("all_skipped").select("source_id", "pages_total")
