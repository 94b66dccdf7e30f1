"""Weight-free reducers of graph networks: neighbour sums, maxima, attention averages and graph means.

nodes: graph_id, idx, vec (array of numbers); edges: graph_id, src, dst. Vectors are summarised element by
element inside the aggregation, with a partial result per task, instead of being exploded into rows.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = ["graph_id", "idx"]


def _vector(vec: Column) -> Column:
    return array_to_vector(vec.cast("array<double>"))


def _messages(nodes: DataFrame, edges: DataFrame, vec: str) -> DataFrame:
    """One row per edge with the vector of its source."""
    sources = nodes.select("graph_id", F.col("idx").alias("src"), _vector(F.col(vec)).alias("__x"))
    return edges.join(sources, ["graph_id", "src"])


def _filled(nodes: DataFrame, reduced: DataFrame, vec: str, out: str) -> DataFrame:
    """Reduced vectors by node; nodes without incoming edges get zeros."""
    zeros = F.transform(F.col(vec), lambda _: F.lit(0.0))
    joined = nodes.select(*NODE, vec).join(reduced.select(*NODE, "__out"), NODE, "left")
    return joined.select(*NODE, F.coalesce("__out", zeros).alias(out))


def propagate(nodes: DataFrame, edges: DataFrame, vec: str, out: str = "h", norm: str = "both") -> DataFrame:
    """Sum of source vectors over incoming edges, divided by sqrt(out-degree * in-degree) for ``norm='both'``.

    ``norm='right'`` divides by the in-degree, ``norm='none'`` does not divide. Degrees count repeated edges.
    """
    if norm not in ("both", "right", "none"):
        raise ValueError(f"unknown norm {norm!r}")
    outdeg = edges.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("outdeg"))
    indeg = edges.groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("indeg"))
    # degrees belong to nodes: join them there, not to every edge
    sources = nodes.select("graph_id", F.col("idx").alias("src"), _vector(F.col(vec)).alias("__x"))
    scaled = sources.join(outdeg, ["graph_id", "src"])
    weight = 1 / F.sqrt("outdeg") if norm == "both" else F.lit(1.0)
    messages = edges.join(scaled.withColumn("__w", weight), ["graph_id", "src"])
    total = messages.groupBy("graph_id", "dst").agg(Summarizer.sum(F.col("__x"), F.col("__w")).alias("__s"))
    scale = {"both": 1 / F.sqrt("indeg"), "right": 1 / F.col("indeg"), "none": F.lit(1.0)}[norm]
    reduced = total.join(indeg, ["graph_id", "dst"]).withColumn("__scale", scale)
    vectors = F.transform(vector_to_array("__s"), lambda v: v * F.col("__scale"))
    return _filled(nodes, reduced.select("graph_id", F.col("dst").alias("idx"), vectors.alias("__out")), vec, out)


def max_pool(nodes: DataFrame, edges: DataFrame, vec: str, out: str = "h") -> DataFrame:
    """Element-wise maximum of the source vectors over incoming edges."""
    best = _messages(nodes, edges, vec).groupBy("graph_id", "dst").agg(Summarizer.max(F.col("__x")).alias("__s"))
    reduced = best.select("graph_id", F.col("dst").alias("idx"), vector_to_array("__s").alias("__out"))
    return _filled(nodes, reduced, vec, out)


def edge_softmax(edges: DataFrame, score: str, out: str = "a") -> DataFrame:
    """exp(score - max) / sum over the incoming edges of a node; two small aggregates instead of a window."""
    key = ["graph_id", "dst"]
    top = edges.groupBy(*key).agg(F.max(score).alias("__top"))
    raised = edges.join(top, key).withColumn("__e", F.exp(F.col(score) - F.col("__top"))).drop("__top")
    total = raised.groupBy(*key).agg(F.sum("__e").alias("__total"))
    return raised.join(total, key).withColumn(out, F.col("__e") / F.col("__total")).drop("__e", "__total")


def attention_sum(nodes: DataFrame, edges: DataFrame, vec: str, score: str, out: str = "h") -> DataFrame:
    """Sum of source vectors weighted by the softmax of their edge scores."""
    weighted = _messages(nodes, edge_softmax(edges, score, "__a"), vec)
    total = weighted.groupBy("graph_id", "dst").agg(Summarizer.sum(F.col("__x"), F.col("__a")).alias("__s"))
    reduced = total.select("graph_id", F.col("dst").alias("idx"), vector_to_array("__s").alias("__out"))
    return _filled(nodes, reduced, vec, out)


def graph_mean(nodes: DataFrame, vec: str, out: str = "readout") -> DataFrame:
    """Mean node vector per graph."""
    means = nodes.groupBy("graph_id").agg(Summarizer.mean(_vector(F.col(vec))).alias("__m"))
    return means.select("graph_id", vector_to_array("__m").alias(out))
