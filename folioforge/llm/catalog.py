"""Queries of the training-data problems; none but p2 lives outside this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.near_duplicates import near_duplicate_classes, near_duplicate_pairs
from folioforge.llm.neighbours import close_pairs, nearest_of_queries
from folioforge.llm.ocr_repair import noise_lines, repaired_texts
from folioforge.llm.oracle import ORACLE
from folioforge.llm.packing import document_sizes, fill_report, pack, pack_documents
from folioforge.llm.quality import not_prose, text_quality
from folioforge.llm.site_lines import clean_bodies, repeated_lines, site_patterns
from folioforge.llm.splitting import split_chunks, sufficient_boundaries
from folioforge.llm.subjects import document_subjects, subject_shares
from folioforge.llm.tokens import encode_corpus
from folioforge.plans.runtime import table


def _p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf, "article_requests"), table(spark, sf, "chunks"))


def _p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf, "article_requests"), table(spark, sf, "chunks"))


def _p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return close_pairs(table(spark, sf, "chunks"))


def _p3_queries(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_of_queries(table(spark, sf, "chunks"))


def _p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return sufficient_boundaries(table(spark, sf, "chunks"))


def _p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_chunks(table(spark, sf, "chunks"))


def _p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return not_prose(table(spark, sf, "documents"))


def _p5_quality(spark: SparkSession, sf: str) -> DataFrame:
    return text_quality(table(spark, sf, "documents"))


def _p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines(table(spark, sf, "article_requests"), table(spark, sf, "publishers"))


def _p6_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return site_patterns(table(spark, sf, "article_requests"), table(spark, sf, "publishers"))


def _p6_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return clean_bodies(table(spark, sf, "article_requests"), table(spark, sf, "publishers"))


def _p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return noise_lines(table(spark, sf, "chunks"), table(spark, sf, "page_metadata"))


def _p7_texts(spark: SparkSession, sf: str) -> DataFrame:
    return repaired_texts(table(spark, sf, "chunks"), table(spark, sf, "page_metadata"))


def _p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def _p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))


def _p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and fill of both ways of batching: topped up (p9_containers) and inside each bucket alone."""
    sizes = document_sizes(table(spark, sf, "documents"))
    topped, inside = (fill_report(pack(sizes, inside=x)).withColumn("batches", F.lit(n)) for x, n in ((False, "topped up"), (True, "inside buckets")))
    return topped.unionByName(inside)


_P10 = ("documents", "article_requests", "subject_labels", "subject_areas")


def _p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return document_subjects(*(table(spark, sf, t) for t in _P10))


def _p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    return subject_shares(*(table(spark, sf, t) for t in _P10))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _p1_found,
        "p1_classes": _p1_classes,
        "p3_found": _p3_found,
        "p3_queries": _p3_queries,
        "p4_found": _p4_found,
        "p4_pieces": _p4_pieces,
        "p5_found": _p5_found,
        "p5_quality": _p5_quality,
        "p6_found": _p6_found,
        "p6_patterns": _p6_patterns,
        "p6_bodies": _p6_bodies,
        "p7_found": _p7_found,
        "p7_texts": _p7_texts,
        "p8_ids": _p8_ids,
        "p9_containers": _p9_containers,
        "p9_fill": _p9_fill,
        "p10_found": _p10_found,
        "p10_shares": _p10_shares,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
