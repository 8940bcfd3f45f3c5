"""Problem 1: groups of records that share most of their wording.

Method: multi-index Hamming join. A text stands for the set of its three-word sequences. Its
signature has 64 positions of 16 bits (the low bits of 64 minima of hashed sequences), cut
into 16 chunks of 4 positions. By the pigeonhole principle two signatures that differ
in at most 31 of the 64 positions have a chunk with at most one differing position; so each chunk is posted once per
allowed error (the position left out), and all pairs under that signature distance meet under
a common key. Sketches of two and of four bits per position, which are bits of the same positions and so differ in no more of them, drop
chance meetings; no pair under the signature distance is dropped by them. The similarity is then computed on the whole sets of the texts that remain.

Scale: equal sequence sets are one node from the start, so a text that a third of all rows hold
costs one in the join. Keys that many nodes share (a notice that all texts of a site hold) are split into blocks that meet pair by
pair in groups of their own (``meetings``); beyond that AQE may split partitions, as nothing is partitioned by hand. A pair similar to the degree of exactly one half is
found with probability 0.996 (it misses all keys with probability 0.6875 ** 16 = 0.0025, the sketches with
0.001), at 0.6 with 0.9999.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.meetings import in_blocks, meet
from folioforge.plans.runtime import fan_out, save_table, sized

WORDS = 3
POSITIONS, CHUNKS = 64, 16
SIMILARITY = 0.5
#: Positions that differ in two bits up to which a meeting is looked at: 24 expected at similarity 0.5, with a spread of 3.9.
SKETCH_POSITIONS = 36
#: Positions that differ in four bits up to which a pair is computed: 30 expected at similarity 0.5, with a spread of 3.9.
FINE_POSITIONS = 43
#: Groups of copies up to this size are written as all their pairs, larger ones as pairs with their first record.
EXPAND = 64
_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)[:, None]


class Shingler:
    """Distinct hashed word sequences of texts, with memory of words."""

    def __init__(self, words: int = WORDS):
        self.words, self.memory = words, {}

    def __call__(self, text: str) -> np.ndarray:
        memory = self.memory
        if len(memory) > 500_000:
            memory.clear()
        codes = []
        for w in _WORD.findall(text.lower()):
            c = memory.get(w)
            if c is None:
                c = memory[w] = xxhash.xxh64_intdigest(w)
            codes.append(c)
        n = len(codes) - self.words + 1
        if n < 1:
            return np.empty(0, dtype=np.uint64)
        h = np.array(codes, dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(self.words):
            out = (out ^ h[k : k + n]) * _MIX[k % 4]
            out ^= out >> np.uint64(29)
        out *= _MIX[4]
        out ^= out >> np.uint64(32)
        return np.unique(out)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks of four 16-bit positions, sketch of two words of one bit per position, four words of four bits per position), all int64."""
    a, b = _permutations()
    low = ((shingles[None, :] * a + b) >> np.uint64(24)).min(axis=1)
    low = low * np.uint64(0x9E3779B97F4A7C15)
    lanes = ((low >> np.uint64(40)) & np.uint64(0xFFFF)).reshape(POSITIONS // 4, 4)
    chunks = np.bitwise_or.reduce(lanes << np.arange(0, 64, 16, dtype=np.uint64), axis=1)
    nibbles = ((low >> np.uint64(52)) & np.uint64(15)).reshape(4, 16)  # the upper bits of each position: equal positions have equal sketches
    fine = np.bitwise_or.reduce(nibbles << np.arange(0, 64, 4, dtype=np.uint64), axis=1)
    bits = np.stack([nibbles.ravel() & np.uint64(1), nibbles.ravel() >> np.uint64(1) & np.uint64(1)])
    sketch = np.bitwise_or.reduce(bits << np.arange(POSITIONS, dtype=np.uint64), axis=1)
    return chunks[:CHUNKS].view(np.int64), sketch.view(np.int64), fine.view(np.int64)


def _cls(shingles: np.ndarray, kind: int) -> int:
    """Hash of a sequence set; sets of different kinds of records never share one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), kind)).view(np.int64))


def signatures(records: DataFrame, words: int = WORDS) -> DataFrame:
    """(kind, id, at, cls, chunks, sketch, fine) of each record; all null from cls on where a text has no word sequence.

    ``records`` has (kind INT, id STRING, at, text). cls is the 64-bit hash of kind and sequence set; texts of
    one cls have the same set. Narrow: texts are not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                rows = []
                for kind, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                    seen = shingler(text) if text else ()
                    rows.append((_cls(seen, kind), *signature(seen)) if len(seen) else (None,) * 4)
                kinds = (pa.int64(), *[pa.list_(pa.int64())] * 3)
                cols = [batch.column(k) for k in range(3)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, ["kind", "id", "at", "cls", "chunks", "sketch", "fine"])

    src = records.select("kind", "id", F.unix_micros("at").alias("at"), "text")
    return src.mapInArrow(run, "kind int, id string, at bigint, cls bigint, chunks array<bigint>, sketch array<bigint>, fine array<bigint>")


def _sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(cls, shingles) of (kind, text) rows; the sequences by 32-bit hashes, enough for the sets of two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sets = [shingler(t) for t in batch.column(1).to_pylist()]
                low = [(s & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(_cls, sets, batch.column(0).to_pylist())), pa.int64()), pa.array(low, pa.list_(pa.int32()))], ["cls", "shingles"])

    return texts.where("text is not null").select("kind", "text").mapInArrow(run, "cls bigint, shingles array<int>")


def _keys(kind: Column, chunks: Column) -> Column:
    """64 keys: each chunk with one of its four positions replaced by a tag of kind, chunk and position."""
    out = []
    for c in range(CHUNKS):
        for j in range(4):
            mask = ~(0xFFFF << (16 * j)) if j < 3 else 0xFFFFFFFFFFFF  # as signed 64-bit numbers
            tag = kind.cast("bigint") * 64 + (c * 4 + j)
            out.append(F.element_at(chunks, c + 1).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(tag, 16 * j)))
    return F.array(*out)


def similar_classes(records: DataFrame, sigs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(cls_a, cls_b, similarity) of different sequence sets alike to the given degree, each pair once."""
    first = F.min(F.struct("id", "chunks", "sketch", "fine")).alias("f")
    found = sigs.where("cls is not null").groupBy("kind", "cls").agg(first).select("kind", "cls", "f.*")
    nodes = save_table(found.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers take less room in the shuffle than hashes
    posted = nodes.select(F.explode(_keys(F.col("kind"), F.col("chunks"))).alias("key"), "node", F.element_at("sketch", 1).alias("s1"), F.element_at("sketch", 2).alias("s2"))
    keyed = in_blocks(posted)
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")).bitwiseOR(F.col("a.s2").bitwiseXOR(F.col("b.s2"))))
    likely = a.join(b, meet("a", "b") & (apart <= SKETCH_POSITIONS)).select(F.col("a.node").alias("a_"), F.col("b.node").alias("b_")).distinct()
    fine = [nodes.select(F.col("node").alias(f"{x}_"), F.col("cls").alias(f"cls_{x}"), F.col("fine").alias(f"f{x}")) for x in "ab"]
    likely = likely.join(fine[0], "a_").join(fine[1], "b_")
    differ = F.lit(0)
    for w in range(1, 5):
        x = F.element_at("fa", w).bitwiseXOR(F.element_at("fb", w))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    spark = nodes.sparkSession
    with sized(spark, nodes.count() * CHUNKS * 4):
        pairs = save_table(likely.where(differ <= FINE_POSITIONS).select("cls_a", "cls_b"), "pairs")
    ends = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    wanted = nodes.join(ends, "cls", "left_semi").select("kind", "id")
    texts = records.join(wanted, ["kind", "id"], "left_semi")
    sets = _sets(texts).dropDuplicates(["cls"])
    # a text's set goes once to its pairs, and from there one set a pair to the other
    x, y = (sets.select(F.col("cls").alias(f"cls_{k}"), F.col("shingles").alias(n)) for k, n in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    share = both / (F.size("x") + F.size("y") - both)
    return pairs.join(x, "cls_a").join(y, "cls_b").select("cls_a", "cls_b", share.alias("similarity")).where(F.col("similarity") >= similarity)


def _records(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    r = requests.select(F.lit(0).alias("kind"), F.col("request_id").alias("id"), F.col("received_at").alias("at"), F.col("body").alias("text"))
    c = chunks.select(F.lit(1).alias("kind"), F.col("chunk_id").alias("id"), F.col("created_at").alias("at"), F.col("text").alias("text"))
    return r.unionByName(c).where("id is not null")


def _members(sigs: DataFrame) -> DataFrame:
    """(kind, id, cls) once per record whose latest delivery has a word sequence."""
    return sigs.groupBy("kind", "id").agg(F.max(F.struct("at", "cls")).alias("m")).select("kind", "id", "m.cls").where("cls is not null")


def near_duplicate_pairs(requests: DataFrame, chunks: DataFrame, similarity: float = SIMILARITY, expand: int = EXPAND) -> DataFrame:
    """(record_a, record_b): pairs of requests by body, or of chunks by text, alike to the given degree.

    record_a < record_b as strings, each pair once. Records of equal sequence sets are copies: a group of up to
    ``expand`` copies is written as all its pairs and all its pairs with similar groups; of a larger group every copy is paired
    with the group's first record, which alone is paired with similar groups, so that no link between
    different texts is lost. Null texts, texts under three words and empty tables give no pairs.
    """
    records = _records(requests, chunks)
    sigs = save_table(signatures(fan_out(records)), "signatures")
    members = save_table(_members(sigs), "members")
    groups = members.groupBy("kind", "cls").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    whole = members.join(groups, ["kind", "cls"])
    shown = whole.where((F.col("size") <= expand) | (F.col("id") == F.col("first"))).select("cls", "id")
    pairs = similar_classes(records, sigs, similarity)
    across = pairs.join(shown.select(F.col("cls").alias("cls_a"), F.col("id").alias("x")), "cls_a").join(shown.select(F.col("cls").alias("cls_b"), F.col("id").alias("y")), "cls_b").select("x", "y")
    copies = whole.where(F.col("size") > 1)
    small = copies.where(F.col("size") <= expand).select("kind", "cls", "id")
    within = small.select("kind", "cls", F.col("id").alias("x")).join(small.select("kind", "cls", F.col("id").alias("y")), ["kind", "cls"]).where("x < y").select("x", "y")
    star = copies.where((F.col("size") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
    return across.unionByName(within).unionByName(star).select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))


def near_duplicate_classes(requests: DataFrame, chunks: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(kind, record_id, class_id, copies, links) of every record with a word sequence.

    class_id is the first record of its group of copies (records of equal sequence sets); copies counts the
    group; links counts the different groups similar to it.
    """
    records = _records(requests, chunks)
    sigs = save_table(signatures(fan_out(records)), "signatures")
    members = _members(sigs)
    pairs = similar_classes(records, sigs, similarity)
    degree = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    groups = members.groupBy("kind", "cls").agg(F.count("*").alias("copies"), F.min("id").alias("class_id"))
    kind = F.when(F.col("kind") == 0, "request").otherwise("chunk").alias("kind")
    joined = members.join(groups.join(degree, "cls", "left"), ["kind", "cls"])
    return joined.select(kind, F.col("id").alias("record_id"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
