"""Problem 3: the most similar vectors of every vector.

Method: permutation index. A bounded sample of the vectors themselves are the pivots; a vector is
represented by its nearest pivots in order. Postings go to inverted files of pivot triples out of
that order (sum of places limited, so triples of the nearest pivots count); vectors that meet are ranked by
the footrule distance of their orders, all within a distance are reranked by cosine.

Scale: pivots are drawn from the rows, so dense regions hold more pivots and inverted files stay
short wherever the data crowd; the number of pivots grows with the square root of the rows, which keeps the
meetings in proportion to the rows up to MOST_PIVOTS (76 million different vectors of one model and length; beyond, meetings of a row grow with the rows).
Many pivots are searched in two levels, so a row's cost grows with their root. An inverted file that is long all the same is split into blocks (``meetings``). Equal vectors are
one node, so a vector that a third of all rows hold costs one. Recall against brute force is in the README.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.llm.meetings import in_blocks, meet
from folioforge.plans.runtime import fan_out, save_table, sized

K = 10
#: Pivots of one model and length: PIVOT_RATE times the root of their rows, within these bounds (the pivot sample is bounded).
PIVOT_RATE, LEAST_PIVOTS, MOST_PIVOTS = 7.5, 64, 1 << 16
#: Bytes of the pivots of one model and length, which are sent to all tasks.
PIVOT_BYTES = 64 << 20
#: More pivots than DENSE are searched by way of their PROBES nearest groups.
DENSE, PROBES = 4096, 12
#: Nearest pivots kept of a vector, and the greatest sum of places (from 0) of a posted triple.
PLACES, MOST_SUM = 10, 13
#: Differing bits of two 64-bit sign sketches up to which a meeting is ranked, and of both sketches together.
NEAR_BITS, BOTH_BITS = 15, 27
#: Footrule distance of two orders up to which a pair is reranked, however many such pairs a vector has; it lies between 0 and PLACES squared. Of pairs of
#: cosine 0.9 one in a thousand is beyond 85.
FOOTRULE = 90
_TRIPLES = [t for t in itertools.combinations(range(PLACES), 3) if sum(t) <= MOST_SUM]


def _unit(batch_vectors: pa.Array, dims: np.ndarray) -> list[np.ndarray | None]:
    """Unit vectors, None where a vector is null, all zero, not finite or not as long as stated."""
    offsets = batch_vectors.offsets.to_numpy()
    valid = np.array(batch_vectors.is_valid())
    flat = batch_vectors.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32)
    out: list[np.ndarray | None] = []
    for i in range(len(batch_vectors)):
        v = values[offsets[i] : offsets[i + 1]]
        if not valid[i] or len(v) == 0 or len(v) != dims[i]:
            out.append(None)
            continue
        size = float(np.sqrt(np.dot(v.astype(np.float64), v)))
        out.append((v / size).astype(np.float32) if 0 < size < math.inf else None)
    return out


def _node(model: str, unit: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(np.round(unit, 5).astype(np.float32) + np.float32(0), xxhash.xxh3_64_intdigest(model))).view(np.int64))


def _rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, at, model, dim, vec) of every delivery; vec is null where the vector is null, without model or not as long as stated."""
    good = F.col("embedding").isNotNull() & F.col("embedding_model").isNotNull() & F.coalesce(F.col("embedding_dimension") == F.size("embedding"), F.lit(False))
    vec = F.when(good, F.transform("embedding", lambda x: x.cast("float")))
    return chunks.where("chunk_id is not null").select("chunk_id", F.unix_micros("created_at").alias("at"), F.col("embedding_model").alias("model"), F.col("embedding_dimension").alias("dim"), vec.alias("vec"))


def nodes_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): distinct unit vectors (model, node, vec, nid), nid being a running number, and (chunk_id, model, node) of each chunk whose latest row has a usable vector.

    Usable: vector not null, not all zero, finite, as long as embedding_dimension says, model not null.
    """

    def units(batches: Iterator[pa.RecordBatch], with_vectors: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(4), np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False), nan=-1))
            models = batch.column(2).to_pylist()
            if with_vectors:
                keep = [i for i, u in enumerate(unit) if u is not None]
                node = pa.array([_node(models[i], unit[i]) for i in keep], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(keep, pa.int32())), node, pa.array([unit[i] for i in keep], pa.list_(pa.float32()))], ["model", "node", "vec"])
            else:
                node = pa.array([None if u is None else _node(m, u) for m, u in zip(models, unit)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), node], ["chunk_id", "at", "model", "node"])

    src = fan_out(_rows(chunks))
    vectors = src.where("vec is not null").mapInArrow(lambda it: units(it, True), "model string, node bigint, vec array<float>")
    nodes = save_table(vectors.dropDuplicates(["model", "node"]).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    rows = src.mapInArrow(lambda it: units(it, False), "chunk_id string, at bigint, model string, node bigint")
    latest_ = rows.groupBy("chunk_id").agg(F.max(F.struct("at", F.when(F.col("node").isNotNull(), F.struct("model", "node")).alias("v"))).alias("m"))
    return nodes, latest_.where("m.v is not null").select("chunk_id", "m.v.model", "m.v.node")


def pivots_of(nodes: DataFrame, rate: float = PIVOT_RATE, least: int = LEAST_PIVOTS, most: int = MOST_PIVOTS) -> dict[str, dict[int, np.ndarray]]:
    """Pivots of each model and length: a sample of its nodes by hash, at most ``most``, whatever the number of rows.

    Each length draws its own, ``least`` or all of its nodes at the least, however rare it is in its model.
    """
    length = F.size("vec")
    counts = {(r["model"], r["dim"]): r["count"] for r in nodes.groupBy("model", length.alias("dim")).count().collect()}
    out: dict[str, dict[int, np.ndarray]] = {}
    for (m, d), n in sorted(counts.items()):
        wanted = int(min(n, most, max(1, PIVOT_BYTES // (4 * max(1, d))), max(least, rate * math.sqrt(n))))
        share = min(1.0, 1.3 * wanted / n + 30 / n)
        at = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30))
        drawn = nodes.where((F.col("model") == m) & (length == d) & (at < int(share * (1 << 30)))).select(at.alias("at"), "vec").orderBy("at").limit(wanted).collect()
        if drawn:
            out.setdefault(m, {})[d] = np.array([r["vec"] for r in drawn], dtype=np.float32)
    return out


def _pairs_of_few(nodes: DataFrame) -> DataFrame:
    """(x, y), x < y: all pairs of a model and length that has fewer than three nodes and so no pivot triple."""
    kind = [F.col("model"), F.size("vec").alias("dim")]
    few = nodes.groupBy(*kind).agg(F.count("*").alias("n_"), F.min("node").alias("x"), F.max("node").alias("y"))
    return few.where("n_ = 2").select("x", "y")


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((dim, 128)).astype(np.float32)


def _bits(signs: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(signs, axis=1)).view(np.int64)


def _top(sims: np.ndarray, places: int) -> np.ndarray:
    """Columns of each row's greatest values in order, ties by column."""
    places = min(places, sims.shape[1])
    near = np.sort(np.argpartition(-sims, places - 1, axis=1)[:, :places], axis=1) if places < sims.shape[1] else np.tile(np.arange(places), (len(sims), 1))
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)


class Pivots:
    """Pivots to be searched; many of them lie in groups around the first ones, of which only the nearest are looked into."""

    def __init__(self, x: np.ndarray, dense: int = DENSE, probes: int = PROBES):
        self.x, self.groups = x, 0
        if len(x) > dense:
            self.groups, self.probes = math.isqrt(len(x)), probes
            home = np.concatenate([(x[i : i + 4096] @ x[: self.groups].T).argmax(axis=1) for i in range(0, len(x), 4096)])
            self.order = np.argsort(home, kind="stable")
            self.starts = np.searchsorted(home[self.order], np.arange(self.groups + 1))

    def __len__(self) -> int:
        return len(self.x)

    def nearest(self, vectors: np.ndarray, places: int) -> np.ndarray:
        """Indices of each vector's nearest pivots in order, ties by index."""
        step = 4096 if self.groups else 1024
        parts = [self._grouped(vectors[i : i + step], places) if self.groups else _top(vectors[i : i + step] @ self.x.T, places) for i in range(0, len(vectors), step)]
        return np.concatenate(parts) if parts else np.empty((0, min(places, len(self.x))), dtype=np.int64)

    def _grouped(self, v: np.ndarray, places: int) -> np.ndarray:
        asked = _top(v @ self.x[: self.groups].T, self.probes).ravel()
        by_group = np.argsort(asked, kind="stable")
        ends = np.searchsorted(asked[by_group], np.arange(self.groups + 1))
        probes = len(asked) // len(v)
        sims, found = np.full((len(v), probes, places), -np.inf, dtype=np.float32), np.full((len(v), probes, places), len(self.x), dtype=np.int64)
        for g in np.flatnonzero(np.diff(ends)):
            row, slot = np.divmod(by_group[ends[g] : ends[g + 1]], probes)
            members = self.order[self.starts[g] : self.starts[g + 1]]
            here = v[row] @ self.x[members].T
            best = _top(here, places)
            sims[row, slot, : best.shape[1]] = np.take_along_axis(here, best, 1)
            found[row, slot, : best.shape[1]] = members[best]
        sims, found = sims.reshape(len(v), -1), found.reshape(len(v), -1)
        order = np.lexsort((found, -sims), axis=1)[:, : min(places, len(self.x))]
        return np.take_along_axis(found, order, 1)


def postings_of(nodes: DataFrame, pivots: dict) -> DataFrame:
    """(key, node, places, sketch): one row per node and posted pivot triple; places packs the triple's places in the node's order."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)  # bounded: MOST_PIVOTS rows and PIVOT_BYTES per model and length
    tags = {k: i for i, k in enumerate(sorted((m, d) for m in pivots for d in pivots[m]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], Pivots] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 4000):
                batch = whole.slice(start, 4000)
                models, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                vectors = batch.column(2).to_pylist()
                groups: dict[tuple[str, int], list[int]] = {}
                for i, (m, v) in enumerate(zip(models, vectors)):
                    groups.setdefault((m, len(v)), []).append(i)
                for (m, d), rows in groups.items():
                    if (m, d) not in known:
                        known[m, d] = Pivots(shared.value[m][d])
                    piv = known[m, d]
                    if len(piv) < 3:  # so few nodes are compared without the index, see _pairs_of_few
                        continue
                    x = np.array([vectors[i] for i in rows], dtype=np.float32)
                    near = piv.nearest(x, PLACES)
                    sketch = _bits((x @ _planes(d)) > 0)[:, 0]
                    triples = [t for t in _TRIPLES if t[2] < near.shape[1]]
                    chosen = near[:, triples]  # rows x triples x 3
                    order = np.argsort(chosen, axis=2)
                    pivot = np.take_along_axis(chosen, order, 2)
                    place = np.take_along_axis(np.broadcast_to(np.array(triples), chosen.shape), order, 2)
                    key = ((np.int64(tags[m, d]) << 48) | (pivot[:, :, 0] << 32) | (pivot[:, :, 1] << 16) | pivot[:, :, 2]).astype(np.int64)
                    packed = place[:, :, 0] * 256 + place[:, :, 1] * 16 + place[:, :, 2]
                    t = len(triples)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ids[rows], t)), pa.array(packed.ravel().astype(np.int16)), pa.array(np.repeat(sketch, t))], ["key", "node", "places", "sketch"])

    return nodes.select("model", "node", "vec").mapInArrow(run, "key bigint, node bigint, places smallint, sketch bigint")


def _with_sketch(nodes: DataFrame) -> DataFrame:
    """(node, second): the second 64 sign bits of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, dtype=np.int64)
            groups: dict[int, list[int]] = {}
            vectors = batch.column(1).to_pylist()
            for i, v in enumerate(vectors):
                groups.setdefault(len(v), []).append(i)
            for d, rows in groups.items():
                out[rows] = _bits((np.array([vectors[i] for i in rows], dtype=np.float32) @ _planes(d)) > 0)[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["node", "second"])

    return nodes.select("node", "vec").mapInArrow(run, "node bigint, second bigint")


def similar_nodes(nodes: DataFrame, near_bits: int = NEAR_BITS, both_bits: int = BOTH_BITS, most: float = FOOTRULE) -> DataFrame:
    """(a, b, cosine) of node pairs that meet, pass the sketches and have a footrule of at most ``most``; a and b each way."""
    numbered = nodes.select("model", F.col("nid").alias("node"), "vec")  # numbers take less room in the shuffle than hashes
    posted = in_blocks(postings_of(numbered, pivots_of(nodes)))
    a, b = posted.alias("a"), posted.alias("b")
    apart = F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch")))
    moved = sum(F.abs(F.shiftright("a.places", s).bitwiseAND(15) - F.shiftright("b.places", s).bitwiseAND(15)) for s in (8, 4, 0))
    met = a.join(b, meet("a", "b") & (apart <= near_bits))
    met = met.select(F.col("a.node").alias("x"), F.col("b.node").alias("y"), moved.alias("moved"), apart.alias("apart"))
    pairs = met.groupBy("x", "y").agg(F.count("*").alias("triples"), F.sum("moved").alias("moved"), F.min("apart").alias("apart"))
    sketches = _with_sketch(numbered)
    pairs = pairs.join(sketches.select(F.col("node").alias("x"), F.col("second").alias("sx")), "x").join(sketches.select(F.col("node").alias("y"), F.col("second").alias("sy")), "y")
    pairs = pairs.where(F.col("apart") + F.bit_count(F.col("sx").bitwiseXOR(F.col("sy"))) <= both_bits)
    # s shared pivots give up to s (s - 1) (s - 2) / 6 shared triples, each moved place counted in (s - 1) (s - 2) / 2 of them
    s = F.cbrt(6.0 * F.col("triples")) + 1
    footrule = F.col("moved") / F.greatest((s - 1) * (s - 2) / 2, F.lit(1.0)) + (PLACES - s) * PLACES
    with sized(nodes.sparkSession, nodes.count() * len(_TRIPLES)):
        chosen = save_table(pairs.where(footrule <= most).select("x", "y"), "pairs")
    chosen = chosen.unionByName(_pairs_of_few(numbered))
    left = nodes.select(F.col("nid").alias("x"), F.col("vec").alias("vx"), F.col("node").alias("a_"))
    right = nodes.select(F.col("nid").alias("y"), F.col("vec").alias("vy"), F.col("node").alias("b_"))
    dot = F.aggregate(F.zip_with("vx", "vy", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, p: acc + p)
    scored = chosen.join(left, "x").join(right, "y").select("a_", "b_", F.round(F.least(F.lit(1.0), dot), 7).alias("cosine"))
    return scored.select(F.explode(F.array(F.struct(F.col("a_").alias("a"), F.col("b_").alias("b")), F.struct(F.col("b_").alias("a"), F.col("a_").alias("b")))).alias("e"), "cosine").select("e.*", "cosine")


def best_nodes(near: DataFrame, k: int) -> DataFrame:
    """(a, b, cosine): the ``k`` best of each a, ties by b."""
    return near.withColumn("r_", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r_") <= k).select("a", "b", "cosine")


def _records(near: DataFrame, members: DataFrame, k: int, asked: DataFrame) -> DataFrame:
    """Neighbours of the ``asked`` members from (a, b, cosine) of nodes: each node's list of k + 1 records, its own copies first."""
    first = members.withColumn("nth_", F.row_number().over(W.partitionBy("node").orderBy("chunk_id"))).where(F.col("nth_") <= k + 1).select("node", F.col("chunk_id").alias("id_"))
    near = best_nodes(near, k + 1)
    others = near.join(first.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "id_", "cosine")
    own = first.select("node", "id_", F.lit(1.0).alias("cosine"))
    lists = others.unionByName(own).groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col("id_").alias("id")))), 1, k + 1).alias("l_"))
    kept = F.slice(F.filter("l_", lambda e: e["id"] != F.col("chunk_id")), 1, k)
    out = asked.join(lists, "node").select("chunk_id", F.posexplode(kept).alias("p_", "e_"))
    return out.select("chunk_id", F.col("e_.id").alias("neighbour_id"), (-F.col("e_.d")).alias("cosine"), (F.col("p_") + 1).alias("rank"))


def close_records(chunks: DataFrame, k: int = K) -> DataFrame:
    """(chunk_id, neighbour_id, cosine, rank): what the permutation index finds of the ``k`` most similar chunks.

    Made for close neighbours (cosine 0.9 and more); of distant ones many are missed, see nearest_of_queries.
    """
    nodes, members = nodes_of(chunks)
    members = save_table(members, "members")
    return _records(similar_nodes(nodes), members, k, members)


def _search_shard(x: np.ndarray, ids: np.ndarray, near: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_near: np.ndarray, n_pivots: int, k: int, best: float) -> tuple[list[int], list[int], list[float]]:
    """Top k of each query in one shard: inverted files of its pivots, footrule over them, the better part reranked."""
    n, places = near.shape
    order = np.argsort(near.ravel(), kind="stable")
    row, place = order // places, order % places
    starts = np.searchsorted(near.ravel()[order], np.arange(n_pivots + 1))
    a, b, c = [], [], []
    for i in range(len(q)):
        rows = np.concatenate([row[starts[p] : starts[p + 1]] for p in q_near[i]])
        gain = np.concatenate([places - np.abs(place[starts[p] : starts[p + 1]] - j) for j, p in enumerate(q_near[i])])
        score = np.bincount(rows, weights=gain, minlength=n)  # places x (places + 1) less the footrule
        found = np.flatnonzero(score)
        keep = max(4 * k, int(best * len(found)))
        if len(found) > keep:
            found = found[np.argpartition(-score[found], keep - 1)[:keep]]
        cos = x[found] @ q[i]
        if len(cos) > k + 1:
            at = np.argpartition(-cos, k)[: k + 1]
            found, cos = found[at], cos[at]
        other = ids[found] != q_ids[i]
        exact = np.minimum(1.0, x[found[other]].astype(np.float64) @ q[i].astype(np.float64))
        a.extend([int(q_ids[i])] * len(exact))
        b.extend(ids[found[other]].tolist())
        c.extend(np.round(exact, 7).tolist())
    return a, b, c


def nearest_of_queries(chunks: DataFrame, every: int = 50, k: int = K, pivots: int = 384, places: int = 8, best: float = 0.6, block: int = 16384, shard: int = 8192) -> DataFrame:
    """(chunk_id, neighbour_id, cosine, rank): the ``k`` most similar chunks of each query chunk, whatever their distance.

    Queries are the chunks whose hashed id is divisible by ``every``, searched against all rows in blocks of about
    ``block`` queries. One block at a time is in the driver and sent to the tasks; its result is written before the next one is read. Each shard of ``shard`` rows is a permutation index of its own:
    inverted files of the nearest ``places`` of ``pivots`` pivots (a bounded sample), footrule ranking, and cosine for the
    better part ``best`` of those that share a pivot. Results of shards are merged.
    """
    nodes, members = nodes_of(chunks)
    members = save_table(members, "members")
    asked = members.where(F.pmod(F.xxhash64("chunk_id"), F.lit(every)) == 0)
    wanted = save_table(nodes.join(asked.select("model", "node").distinct(), ["model", "node"], "left_semi"), "queries")
    piv = pivots_of(nodes, 0.0, pivots, pivots)
    blocks = max(1, math.ceil(wanted.count() / block))
    spark = nodes.sparkSession
    parts = []
    for i in range(blocks):
        drawn = wanted.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(blocks)) == i).collect()  # about ``block`` rows
        groups: dict[tuple[str, int], list] = {}
        for r in drawn:
            groups.setdefault((r["model"], len(r["vec"])), []).append(r)
        packed = {}
        for (m, d), rows in groups.items():
            if d in piv[m]:
                x = np.array([r["vec"] for r in rows], dtype=np.float32)
                packed[m, d] = (x, np.array([r["node"] for r in rows], dtype=np.int64), Pivots(piv[m][d]).nearest(x, places))
        shared = spark.sparkContext.broadcast((piv, packed))
        found = nodes.select("model", "node", "vec").mapInArrow(_shard_search(shared, places, k, best, shard), "a bigint, b bigint, cosine double")
        parts.append(save_table(best_nodes(found, k + 1), "found"))
        shared.unpersist()
    return _records(reduce(DataFrame.unionByName, parts), members, k, asked)


def _shard_search(shared, places: int, k: int, best: float, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv, packed = shared.value
        held: dict[tuple[str, int], list] = {key: [] for key in packed}

        def search(key: tuple[str, int]) -> pa.RecordBatch:
            rows, held[key] = held[key], []
            x, ids = np.array([v for _, v in rows], dtype=np.float32), np.array([n for n, _ in rows], dtype=np.int64)
            p = piv[key[0]][key[1]]
            q, q_ids, q_near = packed[key]
            a, b, c = _search_shard(x, ids, Pivots(p).nearest(x, places), q, q_ids, q_near, len(p), k, best)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["a", "b", "cosine"])

        for batch in batches:
            for m, n, v in zip(*(batch.column(j).to_pylist() for j in range(3))):
                key = (m, len(v))
                if key in held:
                    held[key].append((n, v))
                    if len(held[key]) >= shard:
                        yield search(key)
        for key in held:
            if held[key]:
                yield search(key)

    return run


def close_pairs(chunks: DataFrame, k: int = K, cosine: float = 0.9) -> DataFrame:
    """(chunk_a, chunk_b): pairs of cosine at least ``cosine`` in which one is among the other's ``k`` most similar; chunk_a < chunk_b, once each."""
    near = close_records(chunks, k).where(F.col("cosine") >= cosine)
    return near.select(F.least("chunk_id", "neighbour_id").alias("chunk_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_b")).distinct()
