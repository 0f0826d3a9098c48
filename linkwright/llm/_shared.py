"""Helpers shared by the training-data operators: tables, column names, sizing, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import released, staged

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that a table with the taken ones doesn't have (names differ by more than case)."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; one column is read, one row comes back."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def blocks_for(total_bytes: int, per_block: int) -> int:
    return max(1, -(-total_bytes // per_block))


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of edges(src, dst), both bigint: rows (node, root), root the smallest node of its component.

    Alternates large-star and small-star. Each half round finds every node's smallest neighbour by a grouped minimum
    (combined before the shuffle, so a hub is no hot key) and re-hangs the edges on it; the edge set never grows. Rounds
    are logarithmic in the longest path. Every round is staged in the shared folder, from which the round before goes.
    Empty edges give an empty result; self loops only name their node.
    """

    def half(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else e.select(
            F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        near = both.join(low, "src")
        if large:
            return near.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        own = low.where("m < src").select("src", F.col("m").alias("dst"))
        return near.where("dst > m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(own).distinct()

    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    now = staged(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), label)
    seen = None
    while True:
        before, now = now, staged(half(half(now, True), False), label)
        released(before)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return nodes.join(now.groupBy("src").agg(F.min("dst").alias("m")), nodes.node == F.col("src"), "left").select(
        "node", F.coalesce("m", "node").alias("root"))
