"""Pairs i < j of numbered rows, without a Cartesian product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Blocks that rows are dealt to for an all-pairs join; each row is sent to so many pairs of blocks.
BLOCKS = 8


def upper_triangle(rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """All pairs i < j of rows (id, other columns): i, j, and the other columns with suffixes _i and _j.

    Every pair of blocks is a join key of its own, so the work is dealt evenly and needs no broadcast.
    """
    others = [c for c in rows.columns if c != "id"]
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = rows.select(F.col("id").alias("i"), *(F.col(c).alias(f"{c}_i") for c in others), block.alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_q"))
    right = rows.select(F.col("id").alias("j"), *(F.col(c).alias(f"{c}_j") for c in others), block.alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_p"))
    return left.join(right, ["_p", "_q"]).where("i < j").drop("_p", "_q")


def all_indices(n: int, spark) -> DataFrame:
    """(i, j) of all n (n - 1) / 2 pairs of ids 0..n-1."""
    return spark.range(max(0, n - 1)).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("j"))


def sharing(items: DataFrame) -> DataFrame:
    """Distinct pairs (i, j) of rows (id, item) that share an item."""
    one = items.distinct()
    return one.select(F.col("id").alias("i"), "item").join(one.select(F.col("id").alias("j"), "item"), "item").where("i < j").select("i", "j").distinct()


def symmetric(pairs: DataFrame, value: str) -> DataFrame:
    """(q, nn, s): each pair (i, j) both ways."""
    return pairs.select(F.col("i").alias("q"), F.col("j").alias("nn"), F.col(value).alias("s")).union(pairs.select("j", "i", value))


def neighbour_pairs(candidates: DataFrame) -> DataFrame:
    """Candidates (q, nn) as distinct pairs (i, j), without a row's own."""
    return candidates.where("q <> nn").select(F.least("q", "nn").alias("i"), F.greatest("q", "nn").alias("j")).distinct()


def sequences_of(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """(i, j, seq_i, seq_j): the sequences (id, seq) of both rows of each pair."""
    left = sequences.select(F.col("id").alias("i"), F.col("seq").alias("seq_i"))
    right = sequences.select(F.col("id").alias("j"), F.col("seq").alias("seq_j"))
    return pairs.join(left, "i").join(right, "j").select("i", "j", "seq_i", "seq_j")


def filled(n: int, computed: DataFrame, value: str, default: Column | float) -> DataFrame:
    """All pairs of ids 0..n-1 with the computed value, or the default where there is none."""
    default = F.lit(default) if isinstance(default, (int, float)) else default
    return all_indices(n, computed.sparkSession).join(computed.select("i", "j", value), ["i", "j"], "left").select("i", "j", F.coalesce(value, default).alias(value))
