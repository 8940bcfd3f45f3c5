"""The queue's worker over versioned tables: recovery, reconciliation, claims and phases, one job at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from folioforge.functions.text import retryable
from folioforge.operators import queue
from folioforge.plans.config import Queue
from folioforge.sources.store import VersionedTable

#: A phase's work: takes the job's row, raises if it fails.
Phase = Callable[[Row], None]


class Worker:
    """Runs queued jobs through their phases; one worker holds the table's worker lock at a time.

    jobs: a versioned table of one row per job. Every change of a job is a published version made from the version it was read from, so a
    change by someone else in between is noticed; a job is only written back while its claim token still holds.
    """

    def __init__(self, jobs: VersionedTable, phases: Mapping[str, Phase], name: str, settings: Queue | None = None, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), recover: Callable[[], None] | None = None):
        self.jobs, self.phases, self.name, self.settings, self.clock, self.recover = jobs, dict(phases), name, settings or Queue(), clock, recover

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> None:
        base = self.jobs.current()
        self.jobs.publish(change(self.jobs.read(base)), "job_id", base=base)

    def start(self) -> None:
        """Settles interrupted publications, then queues interrupted jobs again."""
        self.jobs.recover()
        if self.recover:
            self.recover()
        if self.jobs.read().where("status = 'running'").limit(1).count():
            self._change(queue.recover_interrupted)

    def step(self) -> str | None:
        """Claims the next job and runs it to its end or failure; its id, or None if none is ready."""
        now = F.lit(self.clock())
        before = self.jobs.current()
        if queue.ready_jobs(self.jobs.read(before), now).isEmpty():
            return None
        self.jobs.publish(queue.claim(self.jobs.read(before), now, self.name), "job_id", base=before)
        job = self.jobs.read().where((F.col("status") == "running") & (F.col("worker_id") == self.name)).limit(1).collect()[0]
        phase, error, passing = self._resume(job), None, False
        try:
            while phase != "done":
                self._write(job, {"phase": F.lit(phase)})
                self.phases[phase](job)
                phase = queue.PHASES[queue.PHASES.index(phase) + 1]
        except Exception as e:  # whatever a phase raises is the job's failure, not the worker's
            error = str(e).strip() or type(e).__name__
            passing = self.jobs.spark.range(1).select(retryable(F.lit(error), kind=F.lit(type(e).__name__))).collect()[0][0]
        end = {"claim_token": F.lit(None).cast("string"), "worker_id": F.lit(None).cast("string"), "updated_at": F.lit(self.clock())}
        if error is None:
            end |= {"status": F.lit("succeeded"), "phase": F.lit("done"), "finished_at": F.lit(self.clock())}
        elif passing:
            end |= {"status": F.lit("queued"), "error": F.lit(error), "next_attempt_at": F.timestamp_seconds(F.unix_timestamp(F.lit(self.clock())) + self.settings.retry_after)}
        else:
            end |= {"status": F.lit("failed"), "error": F.lit(error), "finished_at": F.lit(self.clock())}
        self._write(job, end)
        return job["job_id"]

    @staticmethod
    def _resume(job: Row) -> str:
        return job["phase"] if job["phase"] in ("embedding", "indexing") else "extracting"

    def _write(self, job: Row, values: dict) -> None:
        """Changes the job if its claim still holds; raises if it was lost."""

        def change(jobs: DataFrame) -> DataFrame:
            mine = (F.col("job_id") == job["job_id"]) & (F.col("claim_token") == job["claim_token"]) & (F.col("status") == "running")
            if jobs.where(mine).isEmpty():
                raise RuntimeError(f"claim of job {job['job_id']} was lost")
            return jobs.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in values.items()})

        self._change(change)

    def run(self, once: bool = False, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> list[str]:
        """Runs until stopped, or with ``once`` until no job is ready; returns the ids of jobs run."""
        done = []
        with VersionedTable(self.jobs.spark, f"{self.jobs.root}.worker").lock(self.name):
            self.start()
            while True:
                job = self.step()
                if job is not None:
                    done.append(job)
                elif once:
                    return done
                else:
                    sleep(pause)
