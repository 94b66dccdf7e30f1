"""From property graphs to line graphs with statement contexts and padded id sequences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.cluster import checkpointed
from faultline.operators import graph as G
from faultline.operators import vocab


@dataclass
class LineGraphs:
    """Nodes (graph_id, line, idx, contexts), edges (graph_id, src, dst) and rejected graphs."""

    nodes: DataFrame
    edges: DataFrame
    rejects: DataFrame


def prepare_graphs(nodes: DataFrame, edges: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines for local variables, node labels, type filters, lines on edges, own nodes for shared types."""
    assigned, rejects = G.assign_lines_to_locals(nodes, edges, lines)
    placed = G.with_node_labels(G.with_assigned_lines(nodes, assigned))
    kept = G.drop_node_types(placed)
    with_lines = G.with_edge_lines(G.drop_edge_types(edges), kept)
    grown, renamed = G.split_shared_types(kept, with_lines)
    return grown, renamed, rejects


def neighbour_lines(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(graph_id, line, nature_context): previous, this and next line that exist."""
    offset = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("offset")
    wanted = nodes.select("graph_id", "line", offset).withColumn("line_no", F.col("line") + F.col("offset"))
    found = wanted.join(lines, ["graph_id", "line_no"])
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    text = F.array_join(F.transform(rows, lambda r: r["text"]), "\n")
    return found.groupBy("graph_id", "line").agg(text.alias("nature_context"))


def build_line_graphs(nodes: DataFrame, edges: DataFrame, lines: DataFrame, unreadable: DataFrame) -> LineGraphs:
    """Line graphs of all property graphs at once; ``unreadable`` lists (graph_id, reason) of bad files."""
    grown, placed, ambiguous = prepare_graphs(nodes, edges, lines)
    open_edges = checkpointed(G.project_to_lines(placed, keep_open=True))
    line_nodes = checkpointed(G.drop_lone_nodes(G.collapse_to_lines(grown), open_edges).select("graph_id", "line"))
    line_edges = open_edges.dropna(subset=["innode", "outnode"])
    known = nodes.select("graph_id").unionByName(unreadable.select("graph_id"))
    bad = unreadable.select("graph_id").unionByName(ambiguous.select("graph_id"))
    rejects = checkpointed(G.graph_gate(known, line_nodes, open_edges, bad))
    good_nodes, good_edges = G.drop_rejected(line_nodes, rejects), G.drop_rejected(line_edges, rejects)
    indexed = checkpointed(G.index_nodes(good_nodes))
    key = ["graph_id", "line"]
    sentence = lines.select("graph_id", F.col("line_no").alias("line"), F.col("text").alias("sentence"))
    contexts = (
        indexed.join(sentence, key, "left")
        .join(G.dependence_contexts(good_nodes, good_edges, lines), key, "left")
        .join(neighbour_lines(good_nodes, lines), key, "left")
    )
    filled = contexts.fillna("", subset=["sentence", "control", "data", "nature_context"])
    directed = G.index_edges(good_edges, indexed)
    undirected = G.add_self_loops(G.add_reverse_edges(directed), indexed)
    return LineGraphs(filled, undirected, rejects)


def encode_contexts(graphs: LineGraphs, vocabulary: DataFrame) -> DataFrame:
    """Padded id sequences of the four statement contexts of every node."""
    columns = ["sentence", "data", "control", "nature_context"]
    return vocab.encode_text(graphs.nodes, columns, vocabulary, vocab.GRAPH_MODEL)
