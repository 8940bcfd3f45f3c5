"""Search filters compiled into one pushed-down predicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUAL = ("source_id", "title", "source_type", "course", "chapter", "section", "language", "origin", "publisher", "author", "url", "canonical_url", "external_id", "collection")
DATES = ("created_at_source", "updated_at_source", "retrieved_at")


@dataclass(frozen=True)
class Filters:
    """Equal fields (an empty string is a value), tags of which all must be there, inclusive time ranges, a page range."""

    equal: Mapping[str, str] = field(default_factory=dict)
    tags: Sequence[str] = ()
    after: Mapping[str, datetime] = field(default_factory=dict)
    before: Mapping[str, datetime] = field(default_factory=dict)
    page_start: int | None = None
    page_end: int | None = None

    def __post_init__(self) -> None:
        if bad := set(self.equal) - set(EQUAL):
            raise ValueError(f"no filter fields: {sorted(bad)}")


def predicate(f: Filters) -> Column:
    """Conjunction of all clauses; true if there are none. Missing properties never match."""
    clauses = [F.col(c) == F.lit(v) for c, v in sorted(f.equal.items())]
    clauses += [F.array_contains("tags", t) for t in f.tags]
    clauses += [F.col(c) >= F.lit(v) for c, v in sorted(f.after.items())]
    clauses += [F.col(c) <= F.lit(v) for c, v in sorted(f.before.items())]
    if f.page_start is not None:
        clauses.append(F.col("page_end") >= f.page_start)
    if f.page_end is not None:
        clauses.append(F.col("page_start") <= f.page_end)
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def apply_filters(df: DataFrame, f: Filters) -> DataFrame:
    return df.where(predicate(f))


def overlapping_pages(left: DataFrame, right: DataFrame, key: str, bucket: int = 16) -> DataFrame:
    """Pairs of rows of one key whose page ranges overlap (left_id, right_id), joined on page buckets instead of ranges."""

    def spread(df: DataFrame, a: str) -> DataFrame:
        b = F.explode(F.sequence(F.floor(F.col("page_start") / bucket), F.floor(F.col("page_end") / bucket))).alias("bucket_")
        return df.where("page_start <= page_end").select(key, F.col("id").alias(f"{a}_id"), F.col("page_start").alias(f"{a}_start"), F.col("page_end").alias(f"{a}_end"), b)

    meets = (F.col("left_start") <= F.col("right_end")) & (F.col("right_start") <= F.col("left_end"))
    first = F.floor(F.greatest("left_start", "right_start") / bucket) == F.col("bucket_")  # each pair in its first common bucket only
    return spread(left, "left").join(spread(right, "right"), [key, "bucket_"]).where(meets & first).select(key, "left_id", "right_id")
