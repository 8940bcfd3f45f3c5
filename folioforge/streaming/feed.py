"""Structured Streaming: article feed with deduplication, windowed activity, queue state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from folioforge.operators.identity import content_hash, identity_key
from folioforge.sources.store import VersionedTable


def article_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Article requests arriving as parquet files, admitted a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique_articles(articles: DataFrame, lateness: str = "30 days") -> DataFrame:
    """First article of each identity within the watermark; later deliveries are dropped."""
    key = identity_key(*(F.col(c) for c in ("origin", "external_id", "canonical_url", "url")), content_hash(F.coalesce("body", F.lit(""))))
    return articles.withColumn("identity_key", key).withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["identity_key"])


def activity(events: DataFrame, size: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events and sum of values by type in tumbling windows, late ones within the watermark counted."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return stamped.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))


class ReservationState(StatefulProcessor):
    """Holds each identity for its first owner until a time-out or a release; emits the decisions."""

    def __init__(self, ttl_ms: int = 3_600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owner = handle.getValueState("owner", "owner string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for batch in rows:
            for owner, action in zip(batch["owner_id"], batch["action"]):
                held = self.owner.get()[0] if self.owner.exists() else None
                if action == "release":
                    if held == owner:
                        self.owner.clear()
                    decision = "released" if held == owner else "ignored"
                elif held is None or held == owner:
                    self.owner.update((owner,))
                    decision = "reserved"
                else:
                    decision = "busy"
                out.append((key[0], owner, action, decision))
        if out:
            yield pd.DataFrame(out, columns=["identity_key", "owner_id", "action", "decision"])

    def close(self) -> None:
        pass


def reservations(requests: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Decisions on (identity_key, owner_id, action) requests with keyed state (needs a RocksDB state store)."""
    return requests.groupBy("identity_key").transformWithStateInPandas(ReservationState(ttl_ms), "identity_key string, owner_id string, action string, decision string", "Append", "ProcessingTime")


def publish_stream(stream: DataFrame, table: VersionedTable, key: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to a versioned table; runs what is available and stops.

    A batch writes its own rows only (see ``newest`` for the reading); one that was published before is left out, so a replayed one is harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if table.current() is not None and table.read().where(F.col("batch_id") == batch_id).limit(1).count():
            return
        table.append(batch.dropDuplicates([key]).withColumn("batch_id", F.lit(batch_id)), key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(rows: DataFrame, key: str) -> DataFrame:
    """Appended rows as an upserted table: of each key the row of its last batch."""
    last = rows.groupBy(F.col(key).alias("key_")).agg(F.max("batch_id").alias("last_"))
    return rows.join(last, (F.col(key) == F.col("key_")) & (F.col("batch_id") == F.col("last_"))).drop("key_", "last_")


def compact(table: VersionedTable, key: str) -> int:
    """Publishes ``newest`` as one data folder."""
    base = table.current()
    return table.publish(newest(table.read(), key), key, base=base)
