"""Small helpers of the text problems: latest delivery of each record, publisher sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, id_col: str, at_col: str, *cols: str) -> DataFrame:
    """One row per id with ``cols`` of its latest row; equally late rows: the greatest values. Rows without id are left out."""
    pick = F.max(F.struct(F.col(at_col).alias("at_"), *[F.col(c).alias(c) for c in cols])).alias("n_")
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(id_col)).agg(pick).select(id_col, "n_.*").drop("at_")


def publisher_key(c: Column) -> Column:
    """Publisher names compare without case and outer blanks; a blank one is none."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def with_site(df: DataFrame, publishers: DataFrame) -> DataFrame:
    """Adds ``site``: the origin of the row's publisher, its own origin if publisher is null, else null.

    ``publishers`` is a fixed list of sites, one row each, and is broadcast. A publisher that
    the list does not hold stands for itself.
    """
    known = publishers.select(publisher_key(F.col("publisher")).alias("p_"), F.col("origin").alias("g_")).where("p_ is not null").groupBy("p_").agg(F.min("g_").alias("g_"))
    joined = df.withColumn("k_", publisher_key(F.col("publisher"))).join(F.broadcast(known), F.col("k_") == F.col("p_"), "left")
    site = F.when(F.col("k_").isNotNull(), F.coalesce("g_", "k_")).otherwise(F.nullif(F.trim("origin"), F.lit("")))
    return joined.withColumn("site", site).drop("k_", "p_", "g_")
