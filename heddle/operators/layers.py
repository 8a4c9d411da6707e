"""Layers of dependants: what may run once all that it needs has run, told for a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from heddle.sources.tables import shared_path


def layers(edges: DataFrame, node: str = "node", needs: str = "needs", most_layers: int = 10_000) -> DataFrame:
    """(node, layer) of every node on an edge: 0 for those that need nothing, else one more than the highest layer it needs; NULL on a cycle or behind one.

    A round takes away the edges whose needs were placed by the last one and writes the edges it met, told apart, to the shared folder: one
    write of ever fewer edges a round, and as many rounds as layers. The last round that takes an edge of a node tells its layer. An edge
    without `needs` names a node that needs nothing; repeated edges count once.
    """
    spark = edges.sparkSession
    base, at = shared_path(spark, "layers"), 0
    edges.select(F.col(node).alias("node"), F.col(needs).alias("needs")).distinct().where("node is not null").write.parquet(f"{base}/edges")
    e = spark.read.parquet(f"{base}/edges")
    kind, left = e.select("node", "needs", F.lit(True).alias("gone"), F.lit(0).alias("round")).schema, e.where("needs is not null")
    ready = left.select("needs").distinct().join(left.select(F.col("node").alias("needs")).distinct(), "needs", "left_anti")
    while True:
        met, seen = left.join(ready.withColumn("gone", F.lit(True)), "needs", "left").select("node", "needs", F.coalesce("gone", F.lit(False)).alias("gone")), Observation()
        met.observe(seen, F.count_if("gone").alias("gone"), F.count_if(~F.col("gone")).alias("left")).write.parquet(f"{base}/rounds/round={at}")
        met = spark.read.schema(kind[:3]).parquet(f"{base}/rounds/round={at}")
        left, gone, counts = met.where("not gone").select("node", "needs"), met.where("gone"), seen.get
        if not counts.get("gone") or not counts.get("left"):
            break
        ready = gone.select(F.col("node").alias("needs")).distinct().join(left.select(F.col("node").alias("needs")).distinct(), "needs", "left_anti")
        at += 1
        if at >= most_layers:
            raise ValueError(f"more than {most_layers} layers")
    placed = spark.read.schema(kind).parquet(f"{base}/rounds").where("gone").groupBy("node").agg((F.max("round") + 1).alias("layer"))
    nodes = e.select("node").union(e.where("needs is not null").select("needs")).distinct()
    stuck = left.select("node", F.lit(True).alias("stuck")).distinct()
    return nodes.join(placed, "node", "left").join(stuck, "node", "left").select("node", F.when(F.col("stuck").isNull(), F.coalesce("layer", F.lit(0))).alias("layer"))


def on_cycles(edges: DataFrame, node: str = "node", needs: str = "needs") -> DataFrame:
    """(node): the nodes that lie on a cycle or between two, those merely behind one left out."""
    stuck = layers(edges, node, needs).where("layer is null").select("node")
    e = edges.select(F.col(node).alias("node"), F.col(needs).alias("needs")).join(stuck, "node", "left_semi").join(stuck.withColumnRenamed("node", "needs"), "needs", "left_semi")
    return layers(e.select(F.col("needs").alias("node"), F.col("node").alias("needs"))).where("layer is null").select("node")
