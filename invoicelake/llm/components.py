"""Connected components of links, and joins that broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.common import stored

#: Bytes that are broadcast at most; larger tables are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
_FIXED = ("bigint", "int", "double", "boolean")


def size_of(table: DataFrame) -> int:
    """About how many bytes a written table takes in memory: counted for numbers, measured for all else."""
    if all(kind in _FIXED for _, kind in table.dtypes):
        return table.count() * (16 + 8 * len(table.columns))
    return table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0


def beside(df: DataFrame, table: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join with a written table: broadcast if its measured size is small, by a shuffle otherwise, with the same rows."""
    return df.join(F.broadcast(table) if size_of(table) <= BROADCAST_BYTES else table, on, how)


def connected(links: DataFrame) -> DataFrame:
    """Nodes of links (a, b) with the smallest node that they reach: (node, component).

    Alternates two star operations: the neighbours above a node are linked to its smallest neighbour, then the
    neighbours below it are. Each is a count-free minimum per node and a join; the number of rounds grows with the
    logarithm of the longest path. Links between equal nodes keep the node.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u IS NOT NULL").distinct(),
        "edges",
    )
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = stored(
            both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
            "edges",
        )
        lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(lowest, "u")
        edges = stored(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(joined.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
