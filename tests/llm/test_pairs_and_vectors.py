"""Problems 1 and 3 against brute force, and their edge cases."""

from __future__ import annotations

import itertools
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import near_duplicates as nd
from folioforge.llm import neighbours as nb
from folioforge.llm.meetings import in_blocks, meet

T0 = datetime(2025, 1, 1)
REQUESTS = "request_id string, received_at timestamp, body string, key string, cls string"
CHUNKS = "chunk_id string, created_at timestamp, text string, node string, id string"


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows, least=0.5):
    out = set()
    sets = [(i, shingles(t)) for i, t in rows]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if a != b and x and y and len(x & y) >= least * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def edited(rng, words, share):
    out = list(words)
    for k in range(len(out)):
        if rng.random() < share:
            out[k] = f"w{rng.randrange(9999)}"
    return out


def texts(rng, n):
    rows = []
    for g in range(n):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(40, 160))]
        rows.append((f"{g:04d}a", " ".join(base)))
        for k in range(rng.randrange(4)):
            rows.append((f"{g:04d}{'bcd'[k]}", " ".join(edited(rng, base, rng.choice([0.0, 0.02, 0.05, 0.1])))))
    return rows


def requests(spark, rows):
    return spark.createDataFrame([(i, T0, t, "clash", "clash") for i, t in rows], REQUESTS)


def chunks(spark, rows):
    return spark.createDataFrame([(i, T0, t, "clash", "clash") for i, t in rows], CHUNKS)


def pairs(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def test_pairs_equal_brute_force(spark):
    rows = texts(random.Random(7), 120)
    got = pairs(nd.near_duplicate_pairs(requests(spark, rows), chunks(spark, [("c" + i, t) for i, t in rows[:80]])))
    want = brute(rows) | brute([("c" + i, t) for i, t in rows[:80]])
    assert got <= want and len(want - got) <= 0.02 * len(want) and len(want) > 50


def test_pairs_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [("a", long), ("b", long + " end"), ("c", None), ("d", ""), ("e", "two words"), ("f", "One two THREE!"), ("g", "one, two three"), ("h", "åäö один два"), (None, long)]
    assert pairs(nd.near_duplicate_pairs(requests(spark, rows), chunks(spark, []))) == {("a", "b"), ("f", "g")}
    assert nd.near_duplicate_pairs(requests(spark, []), chunks(spark, [])).count() == 0


def test_delivered_twice_counts_once(spark):
    df = requests(spark, [("a", "one two three four"), ("a", "one two three four")])
    assert nd.near_duplicate_pairs(df, chunks(spark, [])).count() == 0


def test_large_group_of_copies_keeps_every_link(spark):
    base = [f"v{i}" for i in range(80)]
    rows = [(f"r{i:03d}", " ".join(base)) for i in range(50)] + [("x", " ".join(base[:-2] + ["other", "end"]))]
    got = pairs(nd.near_duplicate_pairs(requests(spark, rows), chunks(spark, []), expand=10))
    assert got == {("r000", f"r{i:03d}") for i in range(1, 50)} | {("r000", "x")}
    classes = {r.record_id: (r.class_id, r.copies, r.links) for r in nd.near_duplicate_classes(requests(spark, rows), chunks(spark, [])).collect()}
    assert classes["r049"] == ("r000", 50, 1) and classes["x"] == ("x", 1, 1)


def test_signature_distance_guarantee():
    """All signatures that differ in at most 31 of the 64 positions share a key."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 2**16, (nd.CHUNKS, 4))
        b = a.copy()
        for p in rng.choice(nd.CHUNKS * 4, 31, replace=False):
            b[p // 4, p % 4] ^= 1 + rng.integers(0, 60000)
        assert ((a != b).sum(1) <= 1).any()


VECTORS = "chunk_id string, created_at timestamp, embedding_model string, embedding_dimension int, embedding array<float>, node string, vec string, key string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, T0, m, d, v, "clash", "clash", "clash") for i, m, d, v in rows], VECTORS)


def brute_close(ids, x, k=10, least=0.9):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 7)
    np.fill_diagonal(s, -2)
    out = set()
    for r in range(len(ids)):
        for c in sorted(range(len(ids)), key=lambda j: (-s[r, j], ids[j]))[:k]:
            if s[r, c] >= least:
                out.add((min(ids[r], ids[c]), max(ids[r], ids[c])))
    return out


def test_close_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((120, 24))
    x = np.concatenate([c + rng.standard_normal((rng.integers(1, 14), 24)) * 0.12 for c in centres] + [rng.standard_normal((400, 24))]) * rng.uniform(0.5, 3, (1, 1))
    ids = [f"c{i:04d}" for i in range(len(x))]
    want = brute_close(ids, x.astype(np.float32))
    got = pairs(nb.close_pairs(vectors(spark, [(i, "m", 24, v.tolist()) for i, v in zip(ids, x)])))
    assert len(want) > 200 and len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_vector_edge_cases(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.01, 0.0]
    rows = [("a", "m", 3, a), ("b", "m", 3, b), ("c", "m", 3, [0.0, 0.0, 0.0]), ("d", "m", 4, a), ("e", None, 3, a), ("f", "m", 3, None), ("g", "other", 3, a), ("h", "m", None, a), ("i", "m", 3, [float("nan"), 1.0, 0.0]), ("j", "m", 3, [None, 1.0, 0.0]), (None, "m", 3, a), ("k", "m", 0, []), ("l", "m", 3, [2.0, 0.0, 0.0])]
    assert pairs(nb.close_pairs(vectors(spark, rows))) >= {("a", "l")}
    assert all(set(p) <= {"a", "b", "l"} for p in pairs(nb.close_pairs(vectors(spark, rows))))
    assert nb.close_pairs(vectors(spark, [])).count() == 0
    assert nb.close_pairs(vectors(spark, [("c", "m", 3, [0.0, 0.0, 0.0])])).count() == 0


def test_copies_have_k_neighbours_each(spark):
    rows = [(f"c{i:03d}", "m", 2, [1.0, 2.0]) for i in range(40)]
    df = vectors(spark, rows + rows[:5])
    got = nb.nearest_of_queries(df, every=1).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("neighbour_id").alias("first"))
    assert {(r.n, r.first) for r in got.collect()} == {(10, "c000"), (10, "c001")}
    assert nb.close_pairs(df).count() == 11 * 10 // 2 + 29 * 10


@pytest.mark.parametrize("places", [3, 9, 50])
def test_nearest_pivots_in_order(places):
    rng = np.random.default_rng(0)
    x, p = rng.standard_normal((30, 5)).astype(np.float32), rng.standard_normal((20, 5)).astype(np.float32)
    got = nb.Pivots(p).nearest(x, places)
    want = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :places]
    assert (got == want).all()


def test_query_set_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    df = vectors(spark, [(f"c{i:04d}", "m", 16, v.tolist()) for i, v in enumerate(x)])
    got: dict[str, set] = {}
    for r in nb.nearest_of_queries(df, every=20, pivots=128, block=40, shard=700).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour_id)
    assert 100 < len(got) < 220 and all(len(v) == 10 for v in got.values())
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q, found in got.items():
        s = u @ u[int(q[1:])]
        s[int(q[1:])] = -2
        hit += len(found & {f"c{j:04d}" for j in np.argsort(-s)[:10]})
    assert hit >= 0.9 * 10 * len(got)
    assert nb.nearest_of_queries(vectors(spark, [])).count() == 0


def test_grouped_pivots_find_most_of_the_nearest():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 24))
    x = (centres[rng.integers(0, 60, 3000)] + rng.standard_normal((3000, 24)) * 0.4).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    dense, grouped = nb.Pivots(x[:1500]), nb.Pivots(x[:1500], dense=100, probes=12)
    a, b = dense.nearest(x[1500:], 10), grouped.nearest(x[1500:], 10)
    assert grouped.groups == 38 and b.shape == a.shape and b.max() < 1500
    assert sum(len(set(p) & set(q)) for p, q in zip(a, b)) >= 0.93 * a.size


def test_latest_row_decides_even_if_it_has_no_vector(spark):
    t = datetime(2025, 2, 1)
    rows = [("a", T0, "m", 2, [1.0, 0.0]), ("a", t, "m", 2, None), ("b", T0, "m", 2, None), ("b", t, "m", 2, [1.0, 0.01]), ("c", T0, "m", 2, [1.0, 0.02])]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], VECTORS)
    assert pairs(nb.close_pairs(df)) == {("b", "c")}
    old = [("a", T0, "one two three four"), ("a", t, None), ("b", T0, "one two three four"), ("b", t, "two"), ("c", T0, "one two three four"), ("d", T0, None), ("d", t, "one two three four")]
    df = spark.createDataFrame([(*r, "x", "x") for r in old], REQUESTS)
    assert pairs(nd.near_duplicate_pairs(df, chunks(spark, []))) == {("c", "d")}


def test_hot_keys_meet_in_blocks(spark):
    """A key that holds a third of the rows: every pair meets once, and no group holds more than about two blocks."""
    rows = [(0 if i % 3 == 0 else 1 + i, i) for i in range(900)]
    df = spark.createDataFrame(rows + [(5000 + i % 200, 1000 + i) for i in range(400)], "key bigint, node bigint")
    posted = in_blocks(df, block=30, look=3)
    assert posted.groupBy("key", "tag_").count().agg(F.max("count")).collect()[0][0] <= 110
    a, b = posted.alias("a"), posted.alias("b")
    got = [tuple(r) for r in a.join(b, meet("a", "b")).select("a.key", "a.node", "b.node").collect()]
    hot = [n for k, n in rows if k == 0]
    want = {(0, x, y) for x in hot for y in hot if x < y} | {(5000 + i, 1000 + i, 1200 + i) for i in range(200)}
    assert len(got) == len(set(got)) and set(got) == want
    assert in_blocks(df.where("false")).count() == 0


def test_pair_joins_may_be_split_where_they_are_skewed(spark):
    """With a third of the rows on one key the executed join is marked as skewed and its partition is split."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"), F.xxhash64("id").alias("node")).repartition(4)
        posted = in_blocks(df, block=1 << 20)  # no blocks: what remains is the planner's own split
        joined = posted.alias("a").join(posted.alias("b"), meet("a", "b") & (F.pmod(F.col("a.node").bitwiseXOR(F.col("b.node")), F.lit(1009)) == 0)).select("a.node")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_few_and_rare_lengths_keep_their_neighbours(spark):
    """Two vectors of a model, and two to five of a length that is rare in a large model, find each other."""
    rng = np.random.default_rng(4)
    rows = [("a", "two", 3, [1.0, 0.0, 0.0]), ("b", "two", 3, [0.99, 0.01, 0.0]), ("one", "one", 3, [1.0, 0.0, 0.0])]
    rows += [(f"m{i:04d}", "m", 16, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 16)))]
    rare = [("p0", "p1"), ("q0", "q1", "q2"), ("r0", "r1", "r2", "r3", "r4")]
    for d, names in enumerate(rare, 4):
        rows += [(c, "m", d, [1.0, 0.01 * i] + [0.0] * (d - 2)) for i, c in enumerate(names)]
    want = {("a", "b")} | {p for names in rare for p in itertools.combinations(names, 2)}
    df = vectors(spark, rows)
    assert {p for p in pairs(nb.close_pairs(df)) if p[0][0] != "m"} == want
    asked = {(r.chunk_id, r.neighbour_id) for r in nb.nearest_of_queries(df, every=1).collect() if r.chunk_id[0] != "m"}
    assert asked == want | {(y, x) for x, y in want}
