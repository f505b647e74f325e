"""Connected components of a large sparse graph, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of the
    undirected edges (a, b). Each round takes the smallest label among the
    neighbours, then the label's own label (pointer jumping); rounds are
    written to the shared folder. Labels move by equi-joins between written
    tables, so a node with very many edges is split by the skew join. Null
    ends are not edges; repeated edges and loops change nothing."""
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    arcs = materialise(both.select(F.col("a").alias("src"), F.col("b").alias("node"))
                       .unionByName(both.select(F.col("b").alias("src"), F.col("a").alias("node"))), "arcs")
    labels = materialise(arcs.groupBy("node").agg(F.min("src").alias("label"))
                         .select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        sent = arcs.join(labels.withColumnRenamed("node", "src"), "src").select("node", "label")
        least = materialise(
            sent.withColumn("old", F.lit(None).cast(labels.schema["label"].dataType))
            .unionByName(labels.select("node", "label", F.col("label").alias("old")))
            .groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = materialise(least.join(jump, "label").select("node", F.col("above").alias("label"), "old"), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
