"""Connected components of links held in a table, by joins; nothing is gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut_lineage

TASK_EDGES = 250_000  # edges a task takes; few edges are no reason to write files for every shuffle partition


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step over edges (a, b) with a > b: hang neighbours on the smallest neighbour of each node."""
    narrow = lambda df: df.coalesce(1) if tasks == 1 else df  # noqa: E731  one partition needs no exchange
    sides = narrow(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))) if large else narrow(edges)
    lowest = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = sides.join(lowest, "a")
    if large:  # larger neighbours move to the minimum; edges to smaller ones come up at their own larger end
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the node and all its smaller neighbours hang on the smallest of them
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).coalesce(tasks).distinct().coalesce(tasks)


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): component is the smallest node it reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each stored in the shared folder, until nothing
    moves.  Degrees are merged before they move, and a hub's rows join by key, which Spark splits where skewed.  Every
    step runs in as many tasks as its counted edges need (never more than the session's shuffle partitions); the links
    are stored by ``tasks`` of them if that is given.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges.coalesce(tasks) if tasks else edges)
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == before or now["n"] == 0:
            break
        before = (now["n"], now["s"])
        tasks = 1 + now["n"] // TASK_EDGES
        edges = edges.coalesce(tasks)
        edges = cut_lineage(_star(_star(edges, large=True, tasks=tasks), large=False, tasks=tasks))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
