"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table that every executor can read; its lineage ends there.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is
    unset (tests, a laptop) a folder under the warehouse is used. Scans of the
    table group its files by size, so small tables don't make small tasks.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/.checkpoints"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``links``; a component's name is its least node.

    The least neighbour of a node is aggregated map-side first; links then join
    one row a node, so the links of a hub can be split among tasks (by adaptive
    execution) like those of any large key. Self-links and repeated links are allowed, links with a null are
    ignored.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    edges = durable(edges.where("u < v"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    before, now = None, state(edges)
    while before != now and now[0]:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # now every link goes from a smaller to a larger node
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.col("u").alias("w"), "v")
        edges = durable(small.select("u", F.explode(F.array("w", "v")).alias("v")).where("u < v").distinct())
        before, now = now, state(edges)
    members = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return members.unionAll(roots).unionAll(loops).groupBy("node").agg(F.min("component").alias("component"))
