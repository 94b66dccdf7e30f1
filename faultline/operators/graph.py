"""Operators on property graphs and line graphs. Every table carries ``graph_id``, so all graphs run at once.

nodes: graph_id, id (text), label, name, code, line (NULL when unknown)
edges: graph_id, innode, outnode, etype
Joins use (graph_id, node), not graph_id alone: a graph that holds a third of all rows spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.cluster import dealt, stage_path
from faultline.functions.text import node_code, node_label, strip_blanks
from faultline.operators.ranking import quantile_bucket, row_index

# Edge types of the reduced graphs, and the node and edge types that are left out.
EDGE_SETS = {
    "reftype": ("EVAL_TYPE", "REF"),
    "ast": ("AST",),
    "pdg": ("REACHING_DEF", "CDG"),
    "cfgcdg": ("CFG", "CDG"),
    "all": ("REACHING_DEF", "CDG", "AST", "EVAL_TYPE", "REF"),
}
DROPPED_NODE_LABELS = ("COMMENT", "FILE")
DROPPED_EDGE_TYPES = ("CONTAINS", "SOURCE_FILE", "DOMINATE", "POST_DOMINATE")
MAX_TYPE_ID = 1000


def reduce_edges(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("etype").isin(*EDGE_SETS[kind]))


def symmetric_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (graph_id, a, b) in both directions."""
    there = edges.selectExpr("graph_id", "innode AS a", "outnode AS b")
    back = edges.selectExpr("graph_id", "outnode AS a", "innode AS b")
    return there.unionByName(back).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1, intermediate: bool = True) -> DataFrame:
    """(graph_id, seed, hop, node): ends of walks of exactly ``hop`` undirected steps from each seed.

    Ends are made distinct after every step, so the number of walks never grows the data. ``seeds`` holds
    (graph_id, seed). The first step only picks pairs, which are distinct already. With more steps the pairs are staged;
    frontiers are not written: every step reads the same pairs without missing ends, so Spark shuffles the pairs and each
    frontier once for all their readers. Missing ends, from which no step goes on, are reached apart.
    """
    pairs = symmetric_pairs(edges)
    open_ends = False
    if hops > 1:
        path = stage_path(edges.sparkSession, "pairs")
        pairs.write.parquet(path)
        pairs = edges.sparkSession.read.parquet(path)
        open_ends = not pairs.filter("b IS NULL").isEmpty()
    # The very condition that a further join asks for, so that all readers ask for the same rows.
    known = pairs.filter("b IS NOT NULL") if hops > 1 else pairs
    starts = seeds.select("graph_id", F.col("seed").alias("node")).distinct()
    frontier, reached = None, []
    for hop in range(1, hops + 1):

        def ends(to: DataFrame, frontier=frontier) -> DataFrame:
            there = to.withColumnRenamed("a", "node")
            if frontier is None:
                picked = there.join(starts.hint("merge"), ["graph_id", "node"], "left_semi")
                return picked.select("graph_id", F.col("node").alias("seed"), F.col("b").alias("node"))
            stepped = frontier.join(there.hint("merge"), ["graph_id", "node"])
            return stepped.select("graph_id", "seed", F.col("b").alias("node")).distinct()

        if intermediate or hop == hops:
            parts = [ends(known), ends(pairs.filter("b IS NULL"))] if open_ends else [ends(known)]
            reached += [part.select("graph_id", "seed", F.lit(hop).alias("hop"), "node") for part in parts]
        frontier = ends(known)
    result = reached[0]
    for part in reached[1:]:
        result = result.unionByName(part)
    return result


def assign_lines_to_locals(nodes: DataFrame, edges: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line of each local variable: the first line after its block that reads ``type name;`` up to blanks.

    ``lines`` holds (graph_id, line_no, text). Returns (graph_id, id, line) and (graph_id, reason) for graphs
    in which a local has several types, or not exactly one enclosing block. No join is broadcast: node tables made from few
    small columns are estimated far too small.
    """
    local = nodes.filter("label = 'LOCAL'").select("graph_id", F.col("id").alias("seed"), "name")
    seeds = local.select("graph_id", "seed")
    types = nodes.filter("label = 'TYPE'").select("graph_id", F.col("id").alias("node"), F.col("name").alias("type"))
    two_hop = neighbours(reduce_edges(edges, "reftype"), seeds, 2, intermediate=False)
    typed = (
        two_hop.join(types.hint("merge"), ["graph_id", "node"])
        .filter(F.expr("try_cast(node AS bigint)") < MAX_TYPE_ID)
        .groupBy("graph_id", "seed")
        .agg(F.count(F.lit(1)).alias("n_types"), F.min("type").alias("type"))
    )
    one_hop = neighbours(reduce_edges(edges, "ast"), seeds, 1, intermediate=False)
    blocks = nodes.filter(F.col("label").isin("BLOCK", "CONTROL_STRUCTURE")).select(
        "graph_id", F.col("id").alias("node"), F.col("line").alias("block_line"), F.lit(1).alias("is_block")
    )
    enclosed = (
        one_hop.join(blocks.hint("merge"), ["graph_id", "node"], "left")
        .groupBy("graph_id", "seed")
        .agg(
            F.count(F.lit(1)).alias("n_parents"),
            F.sum(F.coalesce("is_block", F.lit(0))).alias("n_blocks"),
            F.min("block_line").alias("block_line"),
        )
    )
    placed = typed.join(enclosed.hint("merge"), ["graph_id", "seed"], "left")
    one_type, one_block = F.col("n_types") == 1, (F.col("n_parents") == 1) & (F.col("n_blocks") == 1)
    reason = F.when(~one_type, "several types").when(~F.coalesce(one_block, F.lit(False)), "not one enclosing block")
    rejects = placed.select("graph_id", reason.alias("reason")).filter("reason IS NOT NULL").distinct()
    wanted = (
        placed.filter(one_type & one_block)
        .join(local.hint("merge"), ["graph_id", "seed"])
        .select(
            "graph_id",
            "seed",
            "block_line",
            F.concat(strip_blanks(F.concat("type", "name")), F.lit(";")).alias("declared"),
        )
    )
    stripped = lines.select("graph_id", "line_no", strip_blanks("text").alias("declared"))
    found = wanted.join(stripped.hint("merge"), ["graph_id", "declared"]).filter("line_no > block_line")
    assigned = found.groupBy("graph_id", F.col("seed").alias("id")).agg(F.min("line_no").cast("int").alias("line"))
    return assigned, rejects


def with_assigned_lines(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    fresh = assigned.select("graph_id", "id", F.col("line").alias("__line"))
    joined = nodes.join(fresh, ["graph_id", "id"], "left")
    return joined.withColumn("line", F.coalesce("__line", "line")).drop("__line")


def with_node_labels(nodes: DataFrame) -> DataFrame:
    """Fill empty code from the name and add the printable ``node_label``."""
    filled = nodes.withColumn("code", node_code("code", "name"))
    return filled.withColumn("node_label", node_label("label", "line", "code", "name"))


def drop_node_types(nodes: DataFrame, labels: Sequence[str] = DROPPED_NODE_LABELS) -> DataFrame:
    return nodes.filter(~F.col("label").isin(*labels))


def drop_edge_types(edges: DataFrame, types: Sequence[str] = DROPPED_EDGE_TYPES) -> DataFrame:
    return edges.filter(~F.col("etype").isin(*types))


def with_edge_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach the lines of both ends; edges with an unknown end or without any line disappear."""
    place = nodes.select("graph_id", "id", "line")
    out = place.select("graph_id", F.col("id").alias("outnode"), F.col("line").alias("line_out"))
    into = place.select("graph_id", F.col("id").alias("innode"), F.col("line").alias("line_in"))
    joined = edges.join(out, ["graph_id", "outnode"]).join(into, ["graph_id", "innode"])
    return joined.filter("line_in IS NOT NULL OR line_out IS NOT NULL")


def split_shared_types(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give every use of a lineless end its own node ``out_in``; the new node takes the line of the other end."""
    lineless = F.col("line_out").isNull()
    own = F.concat_ws("_", F.col("outnode"), F.col("innode"))
    names = nodes.select("graph_id", F.col("id").alias("outnode"), "name")
    uses = edges.filter(lineless).select("graph_id", "outnode", "innode", "line_in").distinct()
    made = uses.join(names, ["graph_id", "outnode"]).select(
        "graph_id",
        own.alias("id"),
        F.col("line_in").alias("line"),
        F.concat(F.lit("TYPE_"), F.col("line_in").cast("string"), F.lit(": "), "name").alias("node_label"),
    )
    renamed = edges.withColumn("outnode", F.when(lineless, own).otherwise(F.col("outnode")))
    return nodes.unionByName(made.distinct(), allowMissingColumns=True), renamed


def collapse_to_lines(nodes: DataFrame) -> DataFrame:
    """One node per line: the one with the longest code, the lowest id on ties. Pre-aggregated, no sort."""
    text = F.coalesce(F.col("code"), F.lit(""))
    best = F.min(F.struct((-F.length(text)).alias("n"), F.col("id"), text.alias("code")))
    kept = nodes.filter("line IS NOT NULL").groupBy("graph_id", "line").agg(best.alias("b"))
    return kept.select("graph_id", "line", F.col("b.id").alias("id"), F.col("b.code").alias("code"))


def project_to_lines(edges: DataFrame, keep_open: bool = False) -> DataFrame:
    """Distinct dependence edges between lines, REACHING_DEF renamed to DDG.

    ``keep_open=True`` keeps edges with one unknown end; they count when lone nodes are dropped.
    """
    pdg = reduce_edges(edges, "pdg")
    etype = F.when(F.col("etype") == "REACHING_DEF", F.lit("DDG")).otherwise(F.col("etype"))
    lines = pdg.select("graph_id", F.col("line_in").alias("innode"), F.col("line_out").alias("outnode"), etype.alias("etype"))
    return (lines if keep_open else lines.dropna(subset=["innode", "outnode"])).distinct()


def drop_lone_nodes(nodes: DataFrame, edges: DataFrame, node: str = "line") -> DataFrame:
    ends = edges.select("graph_id", F.col("innode").alias(node)).unionByName(
        edges.select("graph_id", F.col("outnode").alias(node))
    )
    return nodes.join(ends.distinct(), ["graph_id", node], "left_semi")


def dependence_pairs(nodes: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Long form (graph_id, line, kind, other): each line's control and data neighbours and the line itself."""
    rows = _pair_rows(nodes, edges) if rows is None else rows
    kind = F.when(F.col("etype") == "CDG", F.lit("control")).when(F.col("etype") == "DDG", F.lit("data"))
    there = edges.select("graph_id", F.col("innode").alias("line"), kind.alias("kind"), F.col("outnode").alias("other"))
    back = edges.select("graph_id", F.col("outnode").alias("line"), kind.alias("kind"), F.col("innode").alias("other"))
    linked = dealt(there.unionByName(back).filter("line <> other AND kind IS NOT NULL"), rows, "graph_id", "line").distinct()
    both = F.explode(F.array(F.lit("control"), F.lit("data"))).alias("kind")
    own = nodes.select("graph_id", "line", both, F.col("line").alias("other"))
    known = nodes.select("graph_id", "line").hint("merge")
    return linked.join(known, ["graph_id", "line"], "left_semi").unionByName(own)


def _pair_rows(nodes: DataFrame, edges: DataFrame) -> int:
    """Rows of ``dependence_pairs`` at most."""
    return 2 * (nodes.count() + edges.count())


def dependence_sets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, line, control, data): sorted neighbour lines including the line itself.

    A set holds at most the lines of one function, whose text is a single cell. As many tasks as the rows ask for.
    """
    rows = _pair_rows(nodes, edges)
    pairs = dealt(dependence_pairs(nodes, edges, rows), rows, "graph_id", "line")
    sets = {k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("other")))) for k in ("control", "data")}
    return pairs.groupBy("graph_id", "line").agg(*[c.alias(k) for k, c in sets.items()])


def dependence_contexts(nodes: DataFrame, edges: DataFrame, lines: DataFrame) -> DataFrame:
    """(graph_id, line, control, data): texts of the dependence sets, one line each, in line order.

    As many tasks as the rows ask for.
    """
    rows = _pair_rows(nodes, edges)
    text = lines.select("graph_id", F.col("line_no").alias("other"), "text").hint("merge")
    pairs = dealt(dependence_pairs(nodes, edges, rows), rows, "graph_id", "other")
    found = dealt(pairs.join(text, ["graph_id", "other"]), rows, "graph_id", "line")

    def joined(kind: str) -> Column:
        rows = F.collect_list(F.when(F.col("kind") == kind, F.struct("other", "text")))
        return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), "\n").alias(kind)

    return found.groupBy("graph_id", "line").agg(joined("control"), joined("data"))


def index_nodes(nodes: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Add ``idx`` 0..n-1 per graph in line order; a huge graph is numbered bucket by bucket."""
    bucket = quantile_bucket(nodes, "line") if bucket is None else bucket
    return row_index(nodes, "idx", [F.col("line")], bucket, ["graph_id"])


def index_edges(edges: DataFrame, indexed: DataFrame) -> DataFrame:
    """(graph_id, src, dst, etype) by node index, source = outnode; edges with an unknown end disappear."""
    place = indexed.select("graph_id", "line", "idx")
    src = place.select("graph_id", F.col("line").alias("outnode"), F.col("idx").alias("src"))
    dst = place.select("graph_id", F.col("line").alias("innode"), F.col("idx").alias("dst"))
    return (
        edges.join(src, ["graph_id", "outnode"]).join(dst, ["graph_id", "innode"]).select("graph_id", "src", "dst", "etype")
    )


def add_reverse_edges(edges: DataFrame) -> DataFrame:
    """Add (dst, src) for every edge that is no self loop; repeated edges stay repeated."""
    back = edges.filter("src <> dst").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("graph_id", "src", "dst").unionByName(back)


def add_self_loops(edges: DataFrame, indexed: DataFrame) -> DataFrame:
    loops = indexed.select("graph_id", F.col("idx").alias("src"), F.col("idx").alias("dst"))
    return edges.select("graph_id", "src", "dst").unionByName(loops)


def graph_gate(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, unreadable: DataFrame) -> DataFrame:
    """(graph_id, reason) of graphs to drop: unreadable, or without line nodes or dependence edges."""
    n_nodes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    n_edges = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    broken = unreadable.select("graph_id").distinct().withColumn("broken", F.lit(True))
    joined = (
        graphs.select("graph_id").distinct().join(n_nodes, "graph_id", "left").join(n_edges, "graph_id", "left")
    ).join(broken, "graph_id", "left")
    reason = (
        F.when(F.col("broken"), F.lit("unreadable"))
        .when(F.col("n_nodes").isNull(), F.lit("no nodes"))
        .when(F.col("n_edges").isNull(), F.lit("no edges"))
    )
    return joined.select("graph_id", reason.alias("reason")).filter("reason IS NOT NULL")


def drop_rejected(df: DataFrame, rejects: DataFrame, key: str = "graph_id") -> DataFrame:
    return df.join(rejects.select(F.col("graph_id").alias(key)), key, "left_anti")
