"""Writers of records and originals; what readers read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.sources.store import VersionedTable


def write_records(df: DataFrame, path: str) -> None:
    """Manifests, pages, chunks or jobs as JSON lines in a new folder, fields that are null left out; nothing is overwritten."""
    df.write.option("ignoreNullFields", "true").json(path)


def write_originals(files: DataFrame, path: str, shares: int | None = None) -> None:
    """Files (source_id, path, content) kept byte by byte with their hash, by share of the sources."""
    kept = files.select("source_id", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content", F.length("content").cast("bigint").alias("length"), F.sha2("content", 256).alias("content_sha256"))
    (kept if shares is None else kept.repartition(shares, "source_id")).write.parquet(path)


def create_table(spark: SparkSession, root: str, schema: T.StructType) -> VersionedTable:
    """A versioned table with this schema, empty if it is new; one that is there is opened if it has these columns."""
    table = VersionedTable(spark, root)
    if table.current() is None:
        table.publish(spark.createDataFrame([], schema), key=None)
    elif missing := {f.name for f in schema} - set(table.read().columns):
        raise ValueError(f"{root} has no columns {sorted(missing)}")
    return table
