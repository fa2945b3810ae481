"""Checks of a directed value-chain graph: (id, name, stage, ticker) nodes and (source, target, relationship) edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import durable

from ..schema import STAGES


def bad_nodes(nodes: DataFrame) -> DataFrame:
    """(id, problem): ids that repeat and stages that aren't known."""
    repeated = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem"))
    unknown = nodes.where(~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False))).select("id", F.lit("stage").alias("problem"))
    return repeated.unionByName(unknown)


def bad_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, problem): endpoints that don't exist and self-loops."""
    ids = nodes.select("id").distinct()
    known = edges.join(ids.withColumnsRenamed({"id": "source"}), "source", "left_semi").join(ids.withColumnsRenamed({"id": "target"}), "target", "left_semi").select("source", "target")
    missing = edges.select("source", "target").distinct().join(known, ["source", "target"], "left_anti").withColumn("problem", F.lit("unknown_node"))
    loops = edges.where("source = target").select("source", "target").distinct().withColumn("problem", F.lit("self_loop"))
    return missing.unionByName(loops)


def cyclic_core(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(source, target) of what is left when nodes without incoming edges are peeled off again and again; empty if acyclic.

    Each round is a distributed semi-join, its result a table in the shared
    folder.
    """
    left = durable(edges.select("source", "target").distinct())
    count = left.count()
    for _ in range(max_rounds):
        if not count:
            break
        left = durable(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target"))
        before, count = count, left.count()
        if before == count:
            break
    return left


def node_ids(nodes: DataFrame, order: str = "ord") -> list[str]:
    """Ids of a graph's nodes in the order in which they were declared."""
    return [r.id for r in nodes.orderBy(order).select("id").collect()]


def validate(nodes: DataFrame, edges: DataFrame) -> None:
    """Raise for the first kind of problem: nodes, then edges, then a cycle."""
    if problems := bad_nodes(nodes).orderBy("problem", "id").limit(1).collect():
        raise ValueError(f"{problems[0].problem} node: {problems[0].id}")
    if problems := bad_edges(nodes, edges).orderBy("problem", "source").limit(1).collect():
        raise ValueError(f"{problems[0].problem}: {problems[0].source} -> {problems[0].target}")
    if cyclic_core(edges).limit(1).collect():
        raise ValueError("graph has a cycle")
