"""Session helpers shared by all operators: tables, shared storage and partition layout."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Names of plan nodes that shuffle.
_SHUFFLES = frozenset(("Aggregate", "Join", "Window", "Sort", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Distinct", "Deduplicate"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint directory set on the context.

    Where neither is set, a session on this machine alone (as in tests) gets a temporary folder, which also becomes its checkpoint
    directory; on a cluster that is an error, as no local folder is seen by all executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="folioforge-")
    atexit.register(shutil.rmtree, made, True)
    context.setCheckpointDir(f"file://{made}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is over; the shared folder's own retention applies
        pass


def save_table(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    Used wherever a result is needed by two jobs. The file is removed by ``free`` or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SAVED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_SAVED: list[tuple[SparkSession, str]] = []


def free(since: int = 0) -> None:
    """Removes the files of saved tables, those after the first ``since``: to be called when the queries that read them are done."""
    while len(_SAVED) > since:
        _remove(*_SAVED.pop())


atexit.register(free)


@contextmanager
def released() -> Iterator[None]:
    """Within it tables may be saved and read; when it ends their files go. Write or collect results inside."""
    since = len(_SAVED)
    try:
        yield
    finally:
        free(since)


@contextmanager
def sized(spark: SparkSession, rows: int, per_partition: int = 1_000_000) -> Iterator[None]:
    """Within it, shuffles begin with as many partitions as ``rows`` rows need, at least the session's number.

    For jobs whose shuffled rows are counted beforehand: a task's share then stays the same however large the input. Adaptive execution joins partitions that come out small.
    """
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    least = int(before or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(name, str(max(least, -(-rows // per_partition))))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cores(spark: SparkSession) -> int:
    """Parallel tasks of the session."""
    return max(1, spark.sparkContext.defaultParallelism)


def _shuffles(plan) -> bool:
    """Whether a logical plan holds a node that shuffles."""
    if plan.nodeName() in _SHUFFLES:
        return True
    children = plan.children()
    return any(_shuffles(children.apply(i)) for i in range(children.size()))


def fan_out(df: DataFrame, *keys: str, per_core: int = 1) -> DataFrame:
    """Spread a scan of few splits over the cluster before per-row Python work.

    A shuffle is added only if there are fewer splits than cores; larger inputs keep
    their scan splits (spark.sql.files.maxPartitionBytes). Plans that shuffle anyway are
    left as they are (counting their partitions would run them).
    """
    if _shuffles(df._jdf.queryExecution().optimizedPlan()):
        return df
    want = cores(df.sparkSession) * per_core
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)
