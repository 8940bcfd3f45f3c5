"""The engine as one object over a folder of tables, and its errors with the status that a service would answer with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import page_label
from folioforge.operators import generations, identity, queue, retrieval
from folioforge.operators.filters import Filters
from folioforge.plans.config import Settings
from folioforge.plans.runtime import table
from folioforge.sources import plugins


class EngineError(RuntimeError):
    """An error that a caller can act on."""

    status = 500


class BadRequest(EngineError):
    status = 400


class Unauthorized(EngineError):
    status = 401


class NotFound(EngineError):
    status = 404


class Duplicate(EngineError):
    status = 409


class TooLarge(EngineError):
    status = 413


class Unsupported(EngineError):
    status = 415


class QueueFull(EngineError):
    status = 429


class DependencyFailed(EngineError):
    status = 502


class Unavailable(EngineError):
    status = 503


#: What a refusal of an operator means to a caller.
REFUSALS = {
    "too_large": TooLarge, "queue_full": QueueFull, "storage_full": QueueFull, "unsupported": Unsupported, "blank": BadRequest, "invalid": BadRequest, "rejected": Duplicate, "identity_held": Duplicate,
    "not_failed": Duplicate, "upload_gone": Duplicate, "unknown": NotFound,
}


def refuse(reason: str, detail: str = "") -> EngineError:
    """The error of a refusal."""
    return REFUSALS.get(reason, EngineError)(f"{reason}: {detail}" if detail else reason)


class Engine:
    """Listings, lookups, search and job control over the tables of one folder; every answer is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, embedder: Callable[[Sequence[str]], Sequence[Sequence[float]]] = plugins.hashed_vectors, model: str = "hashed-words-64"):
        self.spark, self.folder, self.settings, self.embedder, self.model = spark, folder, settings or Settings(), embedder, model

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _jobs(self) -> DataFrame:
        return queue.latest_jobs(self._table("jobs"))

    def health(self) -> DataFrame:
        return queue.queue_health(self._jobs(), self.settings.queue, sources=self._table("source_manifests"))

    def sources(self) -> DataFrame:
        cols = ("title", "source_type", "chapter")
        return identity.latest_manifests(self._table("source_manifests"), *cols).select("source_id", *cols).orderBy("source_id")

    def source(self, source_id: str) -> DataFrame:
        try:
            return identity.show_source(self._table("source_manifests"), source_id)
        except LookupError as e:
            raise NotFound(str(e)) from e

    def chunks(self, source_id: str | None = None) -> DataFrame:
        rows = self._table("chunks")
        cols = ("source_id", "title", "page_start", "page_end")
        live = retrieval.live_chunks(rows, *cols) if source_id is None else retrieval.live_matching(rows, F.col("source_id") == source_id, *cols)
        return live.select("chunk_id", "title", page_label(F.col("page_start"), F.col("page_end")).alias("pages")).orderBy("chunk_id")

    def chunk(self, chunk_id: str) -> DataFrame:
        try:
            return retrieval.show_chunk(self._table("chunks"), chunk_id)
        except LookupError as e:
            raise NotFound(str(e)) from e

    def search(self, question: str, filters: Filters | None = None, top_k: int | None = None, alpha: float | None = None, method: str = "relative", allow_mismatch: bool = False) -> DataFrame:
        """The best chunks. Chunks are embedded by the engine's embedder if it is the one that needs no service, else their own vectors of ``model`` count."""
        rows = self._table("chunks")
        if self.embedder is plugins.hashed_vectors:
            rows = rows.withColumns({"embedding": plugins.embed_column(F.coalesce("text", F.lit("")), self.embedder), "embedding_model": F.lit(self.model), "embedding_dimension": F.lit(64)})
        try:
            return retrieval.search(rows, question, self.embedder, self.model, filters, top_k, alpha, method, allow_mismatch, plugins.INSTRUCTION, self.settings.retrieval)
        except ValueError as e:
            raise (DependencyFailed if "mismatch" in str(e) else BadRequest)(str(e)) from e

    def context(self, question: str, task: str = "answer", **search) -> DataFrame:
        return retrieval.context_pack(self.search(question, **search), question, task)

    def job(self, job_id: str) -> DataFrame:
        found = queue.public_view(self._jobs().where(F.col("job_id") == job_id))
        if found.isEmpty():
            raise NotFound(f"no job {job_id!r}")
        return found

    def retry(self, job_id: str, uploads: DataFrame) -> DataFrame:
        """The jobs with this one queued again; uploads: (upload_path) of files that are there."""
        jobs = self._jobs()
        asked = self.spark.createDataFrame([(job_id,)], "job_id string")
        outcomes = queue.retry(jobs, asked, uploads, self.settings.queue)
        if (outcome := outcomes.collect()[0]["outcome"]) != "queued":
            raise refuse(outcome, job_id)
        return queue.retried(jobs, outcomes)

    def submit(self, requests: DataFrame) -> DataFrame:
        """Requests with their identity and whether they are accepted, rejected as duplicates of each other or of a published source, or invalid."""
        decided = identity.duplicate_decisions(identity.request_identities(requests))
        known = identity.backfill_identities(self._table("source_manifests")).select("source_id", "identity_key")
        joined = identity.find_by_identity(decided, known)
        clash = F.col("source_id").isNotNull() & (F.coalesce("duplicate_policy", F.lit("reject")) != "create")
        return joined.withColumn("decision", F.when(clash & (F.col("decision") == "accepted"), "rejected").otherwise(F.col("decision"))).withColumn("existing_id", F.coalesce("source_id", "existing_id")).drop("source_id")

    def backfill(self) -> DataFrame:
        """Sources with identities filled in; raises if several would share one."""
        filled = identity.backfill_identities(self._table("source_manifests"))
        if first := identity.identity_collisions(filled).limit(1).collect():
            raise Duplicate(f"identity {first[0]['identity_key']} belongs to {first[0]['source_ids']}")
        return filled

    def index_faults(self) -> DataFrame:
        return generations.snapshot_faults(self._table("chunks"))
