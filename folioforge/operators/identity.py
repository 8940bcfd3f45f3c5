"""Source identities, duplicate decisions, collisions, backfill and reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import normalize_url, strip


def _given(c: Column) -> Column:
    """Null where nothing or an empty string was given."""
    return F.nullif(c, F.lit(""))


def identity_key(origin: Column, external_id: Column, canonical_url: Column, url: Column, content_sha256: Column) -> Column:
    """external:<origin>:<id>, else url:<normal form>, else sha256:<hash>; null if the one that applies cannot be built."""
    external, address = _given(external_id), F.coalesce(_given(canonical_url), _given(url))
    site = F.nullif(F.lower(strip(origin)), F.lit(""))
    return (
        F.when(external.isNotNull(), F.concat(F.lit("external:"), site, F.lit(":"), strip(external)))
        .when(address.isNotNull(), F.concat(F.lit("url:"), normalize_url(address)))
        .otherwise(F.concat(F.lit("sha256:"), content_sha256))
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def request_identities(requests: DataFrame) -> DataFrame:
    """(request_id, received_at, duplicate_policy, identity_key) once per request, by its latest delivery.

    Bodies are hashed where they are read, so none is shuffled.
    """
    hashed = requests.withColumn("hash_", content_hash(F.coalesce("body", F.lit(""))))
    cols = ("origin", "external_id", "canonical_url", "url", "hash_", "duplicate_policy")
    once = hashed.groupBy("request_id").agg(F.max(F.struct("received_at", *cols)).alias("n_")).select("request_id", "n_.*")
    key = identity_key(*(F.col(c) for c in ("origin", "external_id", "canonical_url", "url")), F.col("hash_"))
    return once.select("request_id", "received_at", "duplicate_policy", key.alias("identity_key"))


def duplicate_decisions(arrivals: DataFrame, key: str = "identity_key", order: tuple[str, ...] = ("received_at", "request_id"), policy: str = "duplicate_policy") -> DataFrame:
    """Adds decision (accepted, rejected or invalid) and existing_id, the first arrival of the identity.

    The first of an identity is found by a partial aggregate and joined back, so an identity that
    many rows share is never ordered in one task. Policy ``create`` always accepts.
    """
    first = arrivals.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("first_"))
    joined = arrivals.join(first, key, "left")
    mine = F.struct(*order) == F.col("first_")
    decision = F.when(F.col(key).isNull(), "invalid").when(mine | (F.col(policy) == "create"), "accepted").otherwise("rejected")
    return joined.withColumn("decision", decision).withColumn("existing_id", F.when(~mine, F.col(f"first_.{order[-1]}"))).drop("first_")


def latest_manifests(manifests: DataFrame, *cols: str) -> DataFrame:
    """The latest row of each source, with ``cols`` or all its columns."""
    cols = cols or tuple(c for c in manifests.columns if c not in ("source_id", "updated_at"))
    return manifests.groupBy("source_id").agg(F.max(F.struct("updated_at", *cols)).alias("n_")).select("source_id", "n_.*")


def show_source(manifests: DataFrame, source_id: str) -> DataFrame:
    """The latest row of one source; a lookup that reaches the scan. Raises if there is none."""
    found = manifests.where(F.col("source_id") == source_id).orderBy(F.desc("updated_at")).limit(1)
    if found.isEmpty():
        raise LookupError(f"no source {source_id!r}")
    return found


def existing_key(origin: Column, external_id: Column, canonical_url: Column, url: Column, content_sha256: Column) -> Column:
    """Key of a stored source without one: an external id counts only with its origin; null if nothing is known."""
    return identity_key(origin, F.when(_given(origin).isNotNull(), external_id), canonical_url, url, _given(content_sha256))


_PARTS = ("origin", "external_id", "canonical_url", "url", "content_sha256")


def backfill_identities(manifests: DataFrame) -> DataFrame:
    """Latest manifests with identity_key filled in where it was missing; backfilled tells where."""
    latest = latest_manifests(manifests, "identity_key", *_PARTS)
    had = _given(F.col("identity_key"))
    return latest.withColumn("backfilled", had.isNull()).withColumn("identity_key", F.coalesce(had, existing_key(*(F.col(c) for c in _PARTS))))


def identity_collisions(sources: DataFrame) -> DataFrame:
    """(identity_key, n_sources, source_ids) of identities that more than one source has.

    source_ids lists them in order. Identities of one source are dropped by a count before anything is gathered, so what is listed is
    the collisions themselves.
    """
    keyed = sources.where("identity_key is not null").select("identity_key", "source_id")
    several = keyed.groupBy("identity_key").agg(F.count("*").alias("n_sources")).where("n_sources > 1")
    return keyed.join(several, "identity_key").groupBy("identity_key", "n_sources").agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"))


def install_backfill(table, backfilled: DataFrame, seen_version: int) -> int:
    """Publishes backfilled manifests in a versioned table, all or none; returns the version.

    Refused if two sources would share an identity, or if another version was published since ``seen_version`` was read.
    """

    def collides(written: DataFrame) -> str | None:
        first = identity_collisions(written).limit(1).collect()
        return f"identity {first[0]['identity_key']} would belong to {first[0]['n_sources']} sources" if first else None

    return table.publish(backfilled, "source_id", check=collides, base=seen_version)


def find_by_identity(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests with the published source of their identity, the first by id if several; null if new."""
    known = sources.where("identity_key is not null").groupBy("identity_key").agg(F.min("source_id").alias("source_id"))
    return requests.join(known, "identity_key", "left")


def reservation_state(reservations: DataFrame, active_jobs: DataFrame, sources: DataFrame, now: Column, orphan_ttl: int = 300, direct_ttl: int = 86400) -> DataFrame:
    """Adds ``release`` to identity reservations (identity_key, owner_id, owner_type, source_id, created_at).

    Released are those whose source is published, whose job is over for orphan_ttl seconds, or that a direct ingest
    has held for direct_ttl.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    jobs = active_jobs.select(F.col("job_id").alias("owner_id"), F.lit(True).alias("active_")).distinct()
    published = sources.select("source_id", F.lit(True).alias("live_")).distinct()
    joined = reservations.join(jobs, "owner_id", "left").join(published, "source_id", "left")
    orphan = (F.col("owner_type") == "job") & F.col("active_").isNull() & (age > orphan_ttl)
    direct = (F.col("owner_type") != "job") & (age > direct_ttl)
    return joined.withColumn("release", F.col("live_").isNotNull() | orphan | direct).drop("active_", "live_")


def backfill_conflicts(seen: DataFrame, current: DataFrame) -> DataFrame:
    """Sources (source_id) that changed between a computed backfill and its installation, by update time and original path."""
    a = seen.select("source_id", F.col("updated_at").alias("u_"), F.col("original_path").alias("o_"))
    joined = current.join(a, "source_id")
    same = F.col("updated_at").eqNullSafe(F.col("u_")) & F.col("original_path").eqNullSafe(F.col("o_"))
    return joined.where(~same).select("source_id")


def publication_conflicts(staged: DataFrame, live: DataFrame) -> DataFrame:
    """(source_id, outcome) of staged sources: new, same (nothing to do) or conflict (the id has another identity or content)."""
    a = live.select("source_id", F.col("identity_key").alias("k_"), F.col("content_sha256").alias("h_"), F.lit(True).alias("there_"))
    same = F.col("identity_key").eqNullSafe(F.col("k_")) & F.col("content_sha256").eqNullSafe(F.col("h_"))
    return staged.join(a, "source_id", "left").select("source_id", F.when(F.col("there_").isNull(), "new").when(same, "same").otherwise("conflict").alias("outcome"))
