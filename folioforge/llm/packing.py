"""Problem 9: items of varying length into containers of fixed capacity.

Method: optimal length buckets. Dynamic programming over the global length histogram (at
most ``capacity`` numbers, however many items there are) chooses the bucket boundaries
that minimise padding; token-budget batches are then formed bucket by bucket. With ``inside`` every batch is of one bucket, as the method
has it; that leaves up to half a container empty (lengths just above
half the capacity). By default a batch opens with the largest bucket that still has items and spends the rest of its budget on further
items, of the same bucket as long as they fit, then of the largest bucket that fits. ``p9_fill`` reports both.

The plan is made on bucket counts alone, so its size depends on the capacity, not on the
data. Items find their place by rank within (bucket, salt) plus an offset; a bucket has one salt for each RUN of its items, so no task orders
more than about RUN of them, however hot their length.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.llm.tokens import VOCABULARIES, count_tokens
from folioforge.plans.runtime import save_table

CAPACITY = 2048
BUCKETS = 256
#: Items that one task may order.
RUN = 1 << 20


def _layer(best: np.ndarray, lengths: np.ndarray, count: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(padding, last cut) for each number of shortest lengths if one more bucket may be used than in ``best``.

    The best last cut never moves down as lengths are added, so the middle one bounds both halves; all halves of a level are done at once.
    """
    n = len(lengths)
    after, cuts = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    after[0] = 0.0
    lo, hi, first, last = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        size = np.minimum(last, mid - 1) - first + 1
        starts = np.cumsum(size) - size
        i = np.repeat(first - starts, size) + np.arange(int(size.sum()))
        j = np.repeat(mid, size)
        cost = best[i] + lengths[j - 1] * (count[j] - count[i]) - (weight[j] - weight[i])
        least = np.minimum.reduceat(cost, starts)
        hits = np.flatnonzero(cost == np.repeat(least, size))
        best_i = i[hits[np.searchsorted(hits, starts)]]
        after[mid], cuts[mid] = least, best_i
        lo, hi, first, last = np.concatenate((lo, mid + 1)), np.concatenate((mid - 1, hi)), np.concatenate((first, best_i)), np.concatenate((best_i, last))
        open_ = lo <= hi
        lo, hi, first, last = lo[open_], hi[open_], first[open_], last[open_]
    return after, cuts


def optimal_boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` length buckets with the least total padding.

    histogram: count by length (1 and more). Padding of an item is its bucket's upper end
    less its length. Exact, O(buckets x distinct lengths x their logarithm) in numpy.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    n = len(lengths)
    if n <= buckets:
        return lengths.tolist()
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    count = np.concatenate(([0.0], np.cumsum(counts)))
    weight = np.concatenate(([0.0], np.cumsum(counts * lengths)))
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    layers = []
    for _ in range(buckets):
        best, cuts = _layer(best, lengths, count, weight)
        layers.append(cuts)
    ends, j = [], n
    for cuts in reversed(layers):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cuts[j])
    return ends[::-1]


def plan_batches(ends: list[int], counts: list[int], capacity: int = CAPACITY, inside: bool = False) -> list[tuple[int, int, int, int, int]]:
    """Runs (bucket, first rank, per container, first container, end rank) of token-budget batches; with ``inside`` each of one bucket.

    An item of bucket b is reckoned at the bucket's upper end, so every batch keeps within
    the capacity whatever the exact lengths. Each step uses one mix of buckets for as many
    containers as the counts allow and uses up a bucket, or all but less than a mix of it.
    """
    left, taken, runs, container = list(counts), [0] * len(counts), [], 0
    top = len(ends) - 1
    while top >= 0:
        if left[top] == 0:
            top -= 1
            continue
        room, mix, b = capacity, {}, top
        while b >= 0:
            fit = min(left[b], room // ends[b])
            if fit:
                mix[b] = fit
                room -= fit * ends[b]
            b = -1 if inside else min(b - 1, bisect.bisect_right(ends, room) - 1)
        times = max(1, min(left[b] // m for b, m in mix.items()))
        for b, m in mix.items():
            runs.append((b, taken[b], m, container, taken[b] + m * times))
            taken[b] += m * times
            left[b] -= m * times
        container += times
    return sorted(runs)


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, buckets: int = BUCKETS, run: int = RUN, inside: bool = False) -> DataFrame:
    """(id, part, n_parts, token_from, part_tokens, bucket_end, container_id) of every item.

    An item longer than the capacity, and only such, is divided: full parts fill containers
    of their own, its rest is packed like any item. Items of null or no size take no room and lie
    in container 0. Repeated ids stay separate rows (each is packed). Ties of length are ordered
    by id, then part. An empty table gives an empty table. Other columns are not read.
    ``sizes`` should be cheap to read again: it is scanned two or three times (save_table it if it is computed). Collected are the histogram (at most ``capacity`` + 1 numbers) and,
    if a bucket has more than ``run`` items, one number for each ``run`` of them.
    """
    base = sizes.select(F.col(id_col).alias("id_"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size_"))
    last = F.greatest(F.ceil(F.col("size_") / capacity) - 1, F.lit(0)).cast("int")
    parts = (
        base.withColumn("last_", last)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last_"))))
        .withColumn("token_from", F.col("part").cast("long") * capacity)
        .withColumn("part_tokens", F.least(F.col("size_") - F.col("token_from"), F.lit(capacity).cast("long")))
    )
    histogram = {r["part_tokens"]: r["count"] for r in parts.groupBy("part_tokens").count().collect() if r["part_tokens"] > 0}
    ends = optimal_boundaries(histogram, buckets)
    seen = [0] * len(ends)
    for length, n in histogram.items():
        seen[bisect.bisect_left(ends, length)] += n
    salts = [-(-n // run) for n in seen]
    by_length = [min(bisect.bisect_left(ends, x), len(ends) - 1) if x and ends else -1 for x in range(capacity + 1)]

    def of_length(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("part_tokens") + 1).cast("int"))

    salt = F.pmod(F.xxhash64("id_", "part"), of_length([salts[b] if b >= 0 else 1 for b in by_length])).cast("int")
    placed = parts.withColumn("bucket_", of_length(by_length)).withColumn("salt_", salt)
    offsets = [np.zeros(max(1, k), dtype=np.int64) for k in salts]
    if any(k > 1 for k in salts):
        for r in placed.where("bucket_ >= 0").groupBy("bucket_", "salt_").count().collect():
            offsets[r["bucket_"]][r["salt_"]] = r["count"]
        offsets = [np.cumsum(o) - o for o in offsets]
    by_bucket: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {b: tuple(np.empty(0, dtype=np.int64) for _ in range(3)) for b in range(len(ends))}
    for b, mine in itertools.groupby(plan_batches(ends, seen, capacity, inside), key=lambda r: r[0]):
        by_bucket[b] = tuple(np.array(c, dtype=np.int64) for c in list(zip(*mine))[1:4])
    order = W.partitionBy("bucket_", "salt_").orderBy("id_", "part")
    ranked = placed.where("bucket_ >= 0").withColumn("rank_", F.row_number().over(order).cast("long") - 1)
    ranked = ranked.unionByName(placed.where("bucket_ < 0").withColumn("rank_", F.lit(0).cast("long")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("bucket_", "salt_", "rank_"))
            container = np.zeros(len(bucket), dtype=np.int64)
            end = np.zeros(len(bucket), dtype=np.int64)
            for b in np.unique(bucket):
                if b < 0:
                    continue
                at = np.flatnonzero(bucket == b)
                whole = rank[at] + offsets[b][salt[at]]
                first, each, opened = by_bucket[b]
                k = np.searchsorted(first, whole, side="right") - 1
                container[at] = opened[k] + (whole - first[k]) // each[k]
                end[at] = ends[b]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("id_", "part", "last_", "token_from", "part_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(end), pa.array(container)], ["id_", "part", "last_", "token_from", "part_tokens", "bucket_end", "container_id"])

    kind = dict(base.dtypes)["id_"]
    out = ranked.mapInArrow(place, f"id_ {kind}, part int, last_ int, token_from bigint, part_tokens bigint, bucket_end bigint, container_id bigint")
    return out.select(F.col("id_").alias(id_col), "part", (F.col("last_") + 1).alias("n_parts"), "token_from", "part_tokens", "bucket_end", "container_id")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, inside: bool = False) -> DataFrame:
    """``pack`` of the documents' texts measured in tokens (counted once, kept in the shared folder)."""
    return pack(document_sizes(documents, vocabulary, folder), capacity=capacity, inside=inside)


def document_sizes(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, n_tokens) of every document, in the shared folder."""
    return save_table(count_tokens(documents, vocabulary=vocabulary, folder=folder), "sizes")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the share of room used and the fullest container."""
    by = packed.where("part_tokens > 0").groupBy("container_id").agg(F.sum("part_tokens").alias("used"))
    total = by.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.select("containers", "tokens", (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"), "fullest")
