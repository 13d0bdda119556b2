"""Connected components by contraction: every round joins each node to the smallest neighbour of its
smallest neighbour, then merges the joined nodes. Edges and labels stay in tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.staging import staged


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node in ``edges`` (``a, b``, both long): the smallest node it reaches."""
    edges = staged(edges.where("a <> b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).where(F.lit(False))
    first = True
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up"))
        next_ = least.select(F.col("a").alias("up"), F.col("up").alias("top"))
        parents = staged(least.join(next_, "up").select(F.col("a").alias("node"), "top"), "parents")
        if first:
            labels, first = parents.withColumnRenamed("top", "label"), False
        else:
            above = parents.withColumnRenamed("node", "label")
            labels = staged(
                labels.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels"
            )
        of_a = parents.select(F.col("node").alias("a"), F.col("top").alias("top_a"))
        of_b = parents.select(F.col("node").alias("b"), F.col("top").alias("top_b"))
        merged = edges.join(of_a, "a").join(of_b, "b").where("top_a <> top_b")
        edges = staged(
            merged.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct(),
            "edges",
        )
    return labels
