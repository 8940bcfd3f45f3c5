"""Meetings of postings under common keys, whatever the number of postings of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.plans.runtime import save_table

#: Postings of one key that may meet in one group; keys that hold more are split into blocks of about so many.
BLOCK = 4096
#: One node in so many is looked at to find such keys (this settles the layout only, never the result).
LOOK = 64


def in_blocks(posted: DataFrame, block: int = BLOCK, look: int = LOOK) -> DataFrame:
    """Adds ``tag_`` and ``block_`` to postings (key, node, ...); a posting of a key of b blocks comes b times.

    Two postings of a key meet under exactly one tag (see ``meet``), and no tag of a key has more than about two blocks, so the pairs of a
    hot key are spread over b (b + 1) / 2 groups. Tags below 0 are those of one block. Keys are counted on a part of the nodes drawn by hash; the table of hot keys
    has at most 1 / (block / 2) of the postings' number of rows, and Spark joins it by its size.
    """
    drawn = posted.where(F.pmod(F.xxhash64("node", F.lit(29)), F.lit(look)) == 0)
    seen = drawn.groupBy("key").agg((F.count("*") * look).alias("n_")).where(F.col("n_") > block)
    hot = save_table(seen.select("key", F.ceil(F.col("n_") / block).cast("int").alias("b_")), "hot")
    blocks = F.col("b_")
    mine = F.when(blocks.isNull(), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(31)), blocks).cast("int"))
    with_block = posted.join(hot, "key", "left").withColumn("block_", mine)

    def tag(other: Column) -> Column:
        own = F.col("block_")
        return F.when(other == own, -1 - own).otherwise(F.least(other, own) * blocks + F.greatest(other, own))

    tags = F.when(blocks.isNull(), F.array(F.lit(-1))).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), tag))
    return with_block.withColumn("tag_", F.explode(tags)).drop("b_")


def meet(a: str, b: str) -> Column:
    """Condition under which the rows of two aliases of ``in_blocks`` meet: each pair of nodes of a key once, the smaller node first.

    Both sides give the same columns to it, so that they are one exchange that is read twice. Only equalities of key and tag are join keys, and neither side is partitioned
    by hand, so the adaptive planner may split partitions that come out large.
    """
    same = (F.col(f"{a}.key") == F.col(f"{b}.key")) & (F.col(f"{a}.tag_") == F.col(f"{b}.tag_"))
    once = (F.col(f"{a}.tag_") < 0) | (F.col(f"{a}.block_") != F.col(f"{b}.block_"))
    return same & once & (F.col(f"{a}.node") < F.col(f"{b}.node"))
