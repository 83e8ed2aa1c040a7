"""Connected components of an edge table by label propagation with pointer jumping, in logarithmically many rounds.

Only shrinking tables move: every round is one aggregation over the edges and one self join of the labels, written
to shared storage so that lineage stays short and a lost executor costs a task.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for every node of the undirected edges; label is the least node of the component."""
    both = materialize(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    labels = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")).select(F.col("x").alias("node"), F.col("l").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", F.least("label", "m").alias("to"), "label")
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        new = materialize(step.join(jump, "to").select("node", F.least("to", "next").alias("label"), (F.least("to", "next") != F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels
