"""Ingest queue over a table of job rows: picking, claiming, admission, retries, time-outs and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import retryable
from folioforge.plans.config import Queue

STATUSES = ("queued", "running", "succeeded", "failed")
_ACTIVE = ("queued", "running")


def latest_jobs(jobs: DataFrame, *cols: str) -> DataFrame:
    """The latest row of each job, with ``cols`` or all its columns; rows without id or with an unknown status are corrupt and left out."""
    good = jobs.where(F.col("job_id").isNotNull() & F.col("status").isin(*STATUSES))
    cols = cols or tuple(c for c in jobs.columns if c not in ("job_id", "updated_at"))
    return good.groupBy("job_id").agg(F.max(F.struct("updated_at", *cols)).alias("n_")).select("job_id", "n_.*")


def quarantined_jobs(jobs: DataFrame) -> DataFrame:
    """Rows that latest_jobs leaves out."""
    return jobs.where(F.col("job_id").isNull() | F.col("status").isNull() | ~F.col("status").isin(*STATUSES))


def is_active() -> Column:
    return F.col("status").isin(*_ACTIVE)


def is_ready(now: Column) -> Column:
    return (F.col("status") == "queued") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))


def ready_jobs(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The first ``n`` ready jobs in order of creation, then id."""
    return jobs.where(is_ready(now)).orderBy("created_at", "job_id").limit(n)


def claim(jobs: DataFrame, now: Column, worker: str) -> DataFrame:
    """All jobs, the first ready one set running for ``worker`` with a new claim token and one more attempt."""
    first = ready_jobs(jobs, now).select(F.col("job_id").alias("c_"))
    joined = jobs.join(F.broadcast(first), F.col("job_id") == F.col("c_"), "left")  # one row
    mine = F.col("c_").isNotNull()
    token = F.substring(F.sha2(F.concat_ws(":", "job_id", F.lit(worker), (F.col("attempts") + 1).cast("string")), 256), 1, 16)
    return joined.withColumns({
        "status": F.when(mine, "running").otherwise(F.col("status")), "attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "worker_id": F.when(mine, worker).otherwise(F.col("worker_id")), "claim_token": F.when(mine, token).otherwise(F.col("claim_token")),
        "started_at": F.when(mine, now).otherwise(F.col("started_at")),
    }).drop("c_")


def persist_claimed(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """(job_id, applied): whether an update still owns its job by claim token."""
    held = jobs.select("job_id", F.col("status").alias("s_"), F.col("claim_token").alias("t_"))
    applied = (F.col("s_") == "running") & (F.col("t_") == F.col("claim_token"))
    return updates.join(held, "job_id", "left").select("job_id", F.coalesce(applied, F.lit(False)).alias("applied"))


def recover_interrupted(jobs: DataFrame) -> DataFrame:
    """Running jobs queued again without owner."""
    run = F.col("status") == "running"
    return jobs.withColumn("claim_token", F.when(~run, F.col("claim_token"))).withColumn("worker_id", F.when(~run, F.col("worker_id"))).withColumn("status", F.when(run, "queued").otherwise(F.col("status")))


def after_failure(jobs: DataFrame, now: Column, settings: Queue | None = None) -> DataFrame:
    """Failed jobs with what becomes of them: requeued after a passing outage, else failed for good."""
    s = settings or Queue()
    again = retryable(F.col("error"))
    when = F.when(again, F.unix_timestamp(now) + s.retry_after)
    return jobs.where("status = 'failed'").select("job_id", "error", again.alias("retryable"), F.when(again, "queued").otherwise("failed").alias("next_status"), when.alias("next_attempt_s"))


def admit(uploads: DataFrame, active: int = 0, used: int = 0, settings: Queue | None = None, order: tuple[str, str] = ("created_at", "job_id"), size: str = "bytes", step: int = 1000) -> DataFrame:
    """Adds ``decision`` to uploads in order of arrival: admitted, queue_full, storage_full or too_large.

    ``active`` jobs and reservations and ``used`` bytes are what the queue holds now. Only admitted uploads take a place and room; one that is refused leaves both to those after it. Null
    sizes count as 0, null times come first.

    At most ``max_active`` uploads can be admitted, so they are found by looking at the next ``step`` arrivals that still fit, a bounded list: whatever
    lies between them is too large for what is left, and what is left only shrinks.
    """
    s = settings or Queue()
    at, by, bytes_ = F.coalesce(F.unix_micros(order[0]), F.lit(-(1 << 62))), F.coalesce(order[1], F.lit("")), F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    slim = uploads.select(at.alias("at"), by.alias("id"), bytes_.alias("n")).where(F.col("n") <= s.upload_bytes)
    taken: list[tuple[int, str, int]] = []
    places, left, after = s.max_active - active, s.storage_bytes - used, None
    while places > 0:
        ahead = slim.where(F.col("n") <= left)
        if after is not None:
            ahead = ahead.where((F.col("at") > after[0]) | (F.col("at") == after[0]) & (F.col("id") > after[1]))
        got = ahead.orderBy("at", "id").limit(step).collect()
        for r in got:
            if places and r["n"] <= left:
                places, left = places - 1, left - r["n"]
                taken.append((r["at"], r["id"], s.storage_bytes - left))
        if len(got) < step:
            break
        after = (got[-1]["at"], got[-1]["id"])
    entries = [F.struct(F.lit(a).alias("at"), F.lit(i).alias("id"), F.lit(u).cast("bigint").alias("used"), F.lit(k + 1).alias("n")) for k, (a, i, u) in enumerate(taken)]
    held = F.array(F.struct(F.lit(-(1 << 63) + 1).alias("at"), F.lit("").alias("id"), F.lit(used).cast("bigint").alias("used"), F.lit(0).alias("n")), *entries)
    before = F.element_at(F.filter(held, lambda x: (x["at"] < at) | (x["at"] == at) & (x["id"] < by)), -1)
    full = F.col("before_.n") + active >= s.max_active
    dear = F.col("before_.used") + F.least(bytes_, F.lit(s.upload_bytes)) > s.storage_bytes
    decision = F.when(full, "queue_full").when(dear, "storage_full").when(bytes_ > s.upload_bytes, "too_large").otherwise("admitted")
    return uploads.withColumn("before_", before).withColumn("decision", decision).drop("before_")


def retry(jobs: DataFrame, asked: DataFrame, uploads: DataFrame, settings: Queue | None = None) -> DataFrame:
    """(job_id, outcome) of jobs (job_id) that someone asks to run again: queued, unknown, not_failed, upload_gone, identity_held or queue_full.

    uploads: (upload_path) of files that are there; they are needed until extraction is over. The identity must not be held by another source's
    job. Places left are given in order of creation, then id; the places are bounded, so only as many rows are ordered.
    """
    s = settings or Queue()
    wanted = asked.select("job_id").where("job_id is not null").distinct()
    held = blocking_jobs(jobs, jobs.select("source_id").where("false")).select("job_id", F.lit(True).alias("held_"))
    there = uploads.select("upload_path").distinct().withColumn("there_", F.lit(True))
    joined = wanted.join(jobs, "job_id", "left").join(there, "upload_path", "left").join(held, "job_id", "left")
    early = F.col("phase").isin("queued", "extracting")
    outcome = (
        F.when(F.col("status").isNull(), "unknown").when(F.col("status") != "failed", "not_failed").when(F.col("there_").isNull() & early, "upload_gone")
        .when(F.col("held_").isNotNull() & (F.coalesce("duplicate_policy", F.lit("reject")) == "reject"), "identity_held")
    )
    judged = joined.select("job_id", "created_at", outcome.alias("no_"))
    active = jobs.agg(F.count_if(is_active()).alias("active_"))
    fit = judged.where("no_ is null").orderBy("created_at", "job_id").limit(s.max_active)
    places = fit.groupBy().agg(F.array_sort(F.collect_list(F.struct("created_at", "job_id"))).alias("l_")).crossJoin(active)  # one row each
    chosen = places.select(F.explode(F.slice("l_", 1, F.greatest(s.max_active - F.col("active_"), F.lit(0)).cast("int"))).alias("c_")).select(F.col("c_.job_id").alias("job_id"), F.lit("queued").alias("yes_"))
    return judged.join(chosen, "job_id", "left").select("job_id", F.coalesce("no_", "yes_", F.lit("queue_full")).alias("outcome"))


def retried(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs with those queued again whose outcome of ``retry`` says so: error, end, claim and next attempt cleared."""
    go = outcomes.where("outcome = 'queued'").select("job_id", F.lit(True).alias("go_"))
    joined = jobs.join(go, "job_id", "left")
    again = F.col("go_").isNotNull()
    cleared = {c: F.when(~again, F.col(c)) for c in ("error", "finished_at", "claim_token", "worker_id", "next_attempt_at")}
    return joined.withColumns({**cleared, "status": F.when(again, "queued").otherwise(F.col("status"))}).drop("go_").select(jobs.columns)


def terminal_cleanup(jobs: DataFrame) -> DataFrame:
    """(job_id, action, target): what goes when a job has ended: a succeeded one's upload, a failed one's hold on its identity."""
    action = F.when(F.col("status") == "succeeded", "drop_upload").when((F.col("status") == "failed") & F.col("identity_key").isNotNull(), "release_identity")
    target = F.when(F.col("status") == "succeeded", F.col("upload_path")).otherwise(F.col("identity_key"))
    return jobs.select("job_id", action.alias("action"), target.alias("target")).where("action is not null and target is not null")


def blocking_jobs(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """(job_id, blocked_by): jobs whose identity another source's job holds; the first such job by id.

    A queued or running job holds its identity; a succeeded one while its source exists.
    """
    live = sources.select("source_id").distinct()
    done = jobs.where("status = 'succeeded'").join(live, "source_id", "left_semi").select("job_id", "source_id", "identity_key")
    holders = jobs.where(is_active()).select("job_id", "source_id", "identity_key").unionByName(done).where("identity_key is not null")
    per = holders.groupBy("identity_key", "source_id").agg(F.min("job_id").alias("h_"))
    # the two first holders of different sources are enough to answer every job of the identity
    two = per.groupBy("identity_key").agg(F.slice(F.array_sort(F.collect_list(F.struct("h_", "source_id"))), 1, 2).alias("two_"))
    joined = jobs.where("identity_key is not null").select("job_id", "source_id", "identity_key").join(two, "identity_key")
    other = F.filter("two_", lambda x: ~x["source_id"].eqNullSafe(F.col("source_id")))
    return joined.select("job_id", F.try_element_at(other, F.lit(1))["h_"].alias("blocked_by")).where("blocked_by is not null")


def expired_uploads(jobs: DataFrame, now: Column, settings: Queue | None = None) -> DataFrame:
    """(job_id, upload_path, reason): uploads that can go, of succeeded jobs and of jobs failed long enough ago."""
    s = settings or Queue()
    age = F.unix_timestamp(now) - F.unix_timestamp("finished_at")
    reason = F.when(F.col("status") == "succeeded", "succeeded").when((F.col("status") == "failed") & (age >= s.failed_upload_ttl), "failed")
    return jobs.select("job_id", "upload_path", reason.alias("reason")).where("reason is not null")


def orphan_uploads(uploads: DataFrame, jobs: DataFrame, reservations: DataFrame) -> DataFrame:
    """Uploads (upload_path, job_id) that no job refers to and no reservation holds."""
    return uploads.join(jobs.select("upload_path").distinct(), "upload_path", "left_anti").join(reservations.select("job_id").distinct(), "job_id", "left_anti")


def worker_health(jobs: DataFrame, now: Column, settings: Queue | None = None) -> DataFrame:
    """(worker_id, jobs, last_seen_s, age_s, healthy) by the latest update of each worker's jobs."""
    s = settings or Queue()
    seen = jobs.where("worker_id is not null").groupBy("worker_id").agg(F.count("*").alias("jobs"), F.unix_timestamp(F.max("updated_at")).alias("last_seen_s"))
    return seen.withColumn("age_s", F.unix_timestamp(now) - F.col("last_seen_s")).withColumn("healthy", F.col("age_s") <= s.stale_after)


def queue_health(jobs: DataFrame, settings: Queue | None = None, reservations: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """One row: jobs by status, reservations, sources, whether there is room for more, and the overall state (ok or degraded)."""
    s = settings or Queue()
    counts = [F.count_if(F.col("status") == x).alias(x) for x in STATUSES]

    def number(df: DataFrame | None, key: str, name: str) -> DataFrame:
        return (jobs.where("false") if df is None else df).agg(F.count_distinct(F.col(key)).alias(name))

    out = jobs.agg(*counts).crossJoin(number(reservations, "job_id", "reserved")).crossJoin(number(sources, "source_id", "sources"))  # one row each
    out = out.withColumn("active", F.col("queued") + F.col("running") + F.col("reserved"))
    return out.withColumn("has_room", F.col("active") < s.max_active).withColumn("state", F.when(F.col("has_room"), "ok").otherwise("degraded"))


#: Phases of a job in order, by how the table writes them.
PHASES = ("queued", "extracting", "embedding", "indexing", "done")


def transition(status: Column, phase: Column, no_index: Column | None = None) -> Column:
    """Phase that follows: queued, extracting, embedding, indexing, done; with ``no_index`` a job is done once extracted. Null for ended jobs."""
    steps = F.create_map(*[F.lit(x) for pair in zip(PHASES, PHASES[1:]) for x in pair])
    plain = F.try_element_at(steps, phase)
    if no_index is not None:
        plain = F.when(F.coalesce(no_index, F.lit(False)) & phase.isin("extracting", "embedding", "indexing"), "done").otherwise(plain)
    return F.when(status.isin("queued", "running"), plain)


def resume_phase(phase: Column) -> Column:
    """Where a job goes on after an interruption: extraction begins anew, what follows it is repeated from its own phase."""
    return F.when(phase.isin("embedding", "indexing"), phase).otherwise(F.lit("extracting"))


def public_view(jobs: DataFrame) -> DataFrame:
    """Jobs without upload path, token and worker."""
    return jobs.drop("upload_path", "claim_token", "worker_id")
