"""Queries over property graphs and line graphs.

Order lines act as edges of one property graph per supplier; documents act as line graphs with a control edge
to the next line and a data edge to the line after it; embeddings act as node vectors.
"""

from pyspark.sql import functions as F

from faultline.cluster import checkpointed, dealt, stage_path
from faultline.operators import graph as G
from faultline.operators import propagate as P
from faultline.operators.ranking import quantile_bucket
from faultline.registry.catalog import query, sql_lines, table
from faultline.sources.files import write_files
from faultline.sources.graphs import CODE_SUFFIX, EDGES_SUFFIX, NODES_SUFFIX, parse_graphs, read_code_lines, read_graphs

# --- order lines as a property graph ---------------------------------------------------------------

_PROPERTY_SQL = """edges AS (SELECT l_suppkey AS graph_id, 'o' || l_orderkey AS innode, 'p' || l_partkey AS outnode,
    CASE WHEN l_returnflag = 'A' THEN 'CDG' WHEN l_returnflag = 'R' THEN 'AST'
      WHEN l_linestatus = 'F' THEN 'CONTAINS' ELSE 'REACHING_DEF' END AS etype FROM lineitem),
  nodes AS MATERIALIZED (SELECT graph_id, id, graph_id || ':' || id AS place, k, CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 40)::int END AS line,
      CASE WHEN k % 11 = 0 THEN 'COMMENT' ELSE 'IDENTIFIER' END AS label, 'n' || (k % 9) AS name,
      repeat('x', (k % 7)::int) AS code
    FROM (SELECT DISTINCT l_suppkey AS graph_id, 'o' || l_orderkey AS id, l_orderkey AS k FROM lineitem
      UNION SELECT DISTINCT l_suppkey, 'p' || l_partkey, l_partkey FROM lineitem)),
  ends AS MATERIALIZED (SELECT e.*, o.line AS line_out, o.name AS name_out FROM edges e
    JOIN nodes o ON o.place = e.graph_id || ':' || e.outnode),
  placed AS MATERIALIZED (SELECT e.*, i.line AS line_in FROM ends e
    JOIN nodes i ON i.place = e.graph_id || ':' || e.innode
    WHERE e.line_out IS NOT NULL OR i.line IS NOT NULL)"""


def _edges(spark, d):
    flag = F.col("l_returnflag")
    etype = (
        F.when(flag == "A", F.lit("CDG"))
        .when(flag == "R", F.lit("AST"))
        .when(F.col("l_linestatus") == "F", F.lit("CONTAINS"))
        .otherwise(F.lit("REACHING_DEF"))
    )
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("graph_id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("innode"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("outnode"),
        etype.alias("etype"),
    )


def _nodes(spark, d):
    items = table(spark, d, "lineitem")
    ends = F.array(
        F.struct(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_orderkey").alias("k")),
        F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_partkey").alias("k")),
    )
    keyed = items.select(F.col("l_suppkey").alias("graph_id"), F.inline(ends)).distinct()
    k = F.col("k")
    return keyed.select(
        "graph_id",
        "id",
        F.when(k % 11 == 0, F.lit("COMMENT")).otherwise(F.lit("IDENTIFIER")).alias("label"),
        F.concat(F.lit("n"), (k % 9).cast("string")).alias("name"),
        F.expr("repeat('x', cast(k % 7 as int))").alias("code"),
        F.when(k % 5 != 0, (k % 40).cast("int")).alias("line"),
    )


@query(
    "reduced_edges",
    f"""WITH {_PROPERTY_SQL} SELECT 'pdg' AS kind, graph_id, innode, outnode, etype FROM edges
      WHERE etype IN ('CDG', 'REACHING_DEF')
    UNION ALL SELECT 'ast', graph_id, innode, outnode, etype FROM edges WHERE etype = 'AST'
    UNION ALL SELECT 'all', graph_id, innode, outnode, etype FROM edges WHERE etype <> 'CONTAINS'""",
)
def reduced_edges(spark, d):
    edges = _edges(spark, d)
    parts = [G.reduce_edges(edges, k).select(F.lit(k).alias("kind"), "*") for k in ("pdg", "ast", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "khop_neighbours",
    """WITH pairs AS (SELECT DISTINCT l_suppkey AS g, 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem),
      sym AS (SELECT g, a, b FROM pairs UNION SELECT g, b, a FROM pairs),
      h1 AS (SELECT DISTINCT g, a AS seed, b AS node FROM sym),
      h2 AS (SELECT DISTINCT h1.g, seed, s.b AS node FROM h1 JOIN sym s ON s.g = h1.g AND s.a = h1.node),
      h3 AS (SELECT DISTINCT h2.g, seed, s.b AS node FROM h2 JOIN sym s ON s.g = h2.g AND s.a = h2.node)
    SELECT g AS graph_id, seed, 1 AS hop, node FROM h1 UNION ALL SELECT g, seed, 2, node FROM h2
    UNION ALL SELECT g, seed, 3, node FROM h3""",
)
def khop_neighbours(spark, d):
    edges = _edges(spark, d)
    seeds = G.symmetric_pairs(edges).select("graph_id", F.col("a").alias("seed"))
    return G.neighbours(edges, seeds, 3)


@query(
    "filtered_graph_types",
    f"""WITH {_PROPERTY_SQL} SELECT 'node' AS part, graph_id, label AS kind, count(*) AS n FROM nodes
      WHERE label <> 'COMMENT' GROUP BY ALL
    UNION ALL SELECT 'edge', graph_id, etype, count(*) FROM edges WHERE etype <> 'CONTAINS' GROUP BY ALL""",
)
def filtered_graph_types(spark, d):
    nodes = G.drop_node_types(_nodes(spark, d)).select(F.lit("node").alias("part"), "graph_id", F.col("label").alias("kind"))
    edges = G.drop_edge_types(_edges(spark, d)).select(F.lit("edge").alias("part"), "graph_id", F.col("etype").alias("kind"))
    return nodes.unionByName(edges).groupBy("part", "graph_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("edges_with_lines", f"WITH {_PROPERTY_SQL} SELECT graph_id, innode, outnode, etype, line_in, line_out FROM placed")
def edges_with_lines(spark, d):
    placed = G.with_edge_lines(_edges(spark, d), _nodes(spark, d))
    return placed.select("graph_id", "innode", "outnode", "etype", "line_in", "line_out")


@query(
    "split_shared_types",
    f"""WITH {_PROPERTY_SQL} SELECT 'edge' AS part, graph_id, innode AS a,
        CASE WHEN line_out IS NULL THEN outnode || '_' || innode ELSE outnode END AS b, line_in AS line FROM placed
    UNION ALL SELECT 'node', graph_id, id, NULL, line FROM nodes
    UNION ALL SELECT DISTINCT 'node', p.graph_id, p.outnode || '_' || p.innode,
        'TYPE_' || p.line_in || ': ' || p.name_out, p.line_in FROM placed p WHERE p.line_out IS NULL""",
)
def split_shared_types(spark, d):
    nodes = _nodes(spark, d)
    grown, edges = G.split_shared_types(nodes, G.with_edge_lines(_edges(spark, d), nodes))
    a = edges.select(
        F.lit("edge").alias("part"), "graph_id", F.col("innode").alias("a"), F.col("outnode").alias("b"),
        F.col("line_in").alias("line"),
    )
    b = grown.select(F.lit("node").alias("part"), "graph_id", F.col("id").alias("a"), F.col("node_label").alias("b"), "line")
    return a.unionByName(b)


@query(
    "line_nodes",
    f"""WITH {_PROPERTY_SQL} SELECT graph_id, line, id, code FROM (SELECT *, row_number() OVER (
      PARTITION BY graph_id, line ORDER BY length(code) DESC, id) AS r FROM nodes WHERE line IS NOT NULL) WHERE r = 1""",
)
def line_nodes(spark, d):
    return G.collapse_to_lines(_nodes(spark, d))


_LINE_EDGES_SQL = """SELECT DISTINCT graph_id, line_in AS innode, line_out AS outnode,
  CASE WHEN etype = 'REACHING_DEF' THEN 'DDG' ELSE etype END AS etype FROM placed
  WHERE etype IN ('CDG', 'REACHING_DEF')"""


@query(
    "line_edges",
    f"WITH {_PROPERTY_SQL} {_LINE_EDGES_SQL} AND line_in IS NOT NULL AND line_out IS NOT NULL",
)
def line_edges(spark, d):
    return G.project_to_lines(G.with_edge_lines(_edges(spark, d), _nodes(spark, d)))


@query(
    "connected_line_nodes",
    f"""WITH {_PROPERTY_SQL}, le AS ({_LINE_EDGES_SQL}) SELECT DISTINCT n.graph_id, n.line FROM nodes n
    WHERE n.line IS NOT NULL AND (EXISTS (SELECT 1 FROM le WHERE le.graph_id = n.graph_id AND le.innode = n.line)
      OR EXISTS (SELECT 1 FROM le WHERE le.graph_id = n.graph_id AND le.outnode = n.line))""",
)
def connected_line_nodes(spark, d):
    nodes = _nodes(spark, d)
    edges = G.project_to_lines(G.with_edge_lines(_edges(spark, d), nodes), keep_open=True)
    return G.drop_lone_nodes(G.collapse_to_lines(nodes), edges).select("graph_id", "line")


@query(
    "graph_gate",
    """WITH orders_as_graphs AS (SELECT o_orderkey AS graph_id, o_orderstatus AS s FROM orders),
      edges AS (SELECT DISTINCT l_orderkey AS graph_id FROM lineitem WHERE l_returnflag = 'A'),
      nodes AS (SELECT DISTINCT l_orderkey AS graph_id FROM lineitem WHERE l_linestatus = 'O')
    SELECT graph_id, CASE WHEN s = 'P' THEN 'unreadable' WHEN graph_id NOT IN (SELECT graph_id FROM nodes) THEN 'no nodes'
      ELSE 'no edges' END AS reason FROM orders_as_graphs WHERE s = 'P' OR graph_id NOT IN (SELECT graph_id FROM nodes)
      OR graph_id NOT IN (SELECT graph_id FROM edges)""",
)
def graph_gate(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id"), "o_orderstatus")
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "graph_id")
    nodes, edges = items.filter("l_linestatus = 'O'"), items.filter("l_returnflag = 'A'")
    return G.graph_gate(orders, nodes, edges, orders.filter("o_orderstatus = 'P'"))


@query(
    "kept_graphs",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem
      WHERE l_linestatus = 'O') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""",
)
def kept_graphs(spark, d):
    return G.drop_rejected(table(spark, d, "orders").select("o_orderkey"), graph_gate(spark, d), "o_orderkey")


# --- local variables: one small graph per part -----------------------------------------------------
# Line of the block = p_size % 5 + 1. The declaration stands one line after the block, or (every seventh part)
# only in front of it. Every thirteenth part has two types, every seventeenth hangs on no block.


def _locals(spark, d):
    parts = table(spark, d, "part").selectExpr("p_partkey AS graph_id", "p_size", "split(p_name, ' ')[1] AS word")
    key, block = F.col("graph_id"), (F.col("p_size") % 5 + 1).cast("int")

    def node(id_, label, name, line=None):
        line = F.lit(None).cast("int") if line is None else line
        return F.struct(
            F.lit(id_).alias("id"), F.lit(label).alias("label"), name.alias("name"), line.alias("line")
        )

    no_block = key % 17 == 0
    nodes = parts.select(
        "graph_id",
        F.inline(
            F.array(
                node("1001", "LOCAL", F.concat(F.lit("v"), key.cast("string"))),
                node("5", "TYPE", F.concat("word", F.lit(" *"))),
                node("7", "TYPE", F.lit("int")),
                node("2005", "TYPE", F.lit("far")),
                node("1002", "BLOCK", F.lit(""), block),
                node("1003", "CALL", F.lit("")),
            )
        ),
    )

    def edge(a, b, kind):
        return F.struct(F.lit(a).alias("innode"), F.lit(b).alias("outnode"), F.lit(kind).alias("etype"))

    always = F.array(edge("1001", "900", "REF"), edge("900", "5", "EVAL_TYPE"), edge("900", "2005", "EVAL_TYPE"))
    second = F.when(key % 13 == 0, F.array(edge("900", "7", "EVAL_TYPE")))
    parent = F.when(no_block, F.array(edge("1003", "1001", "AST"))).otherwise(F.array(edge("1002", "1001", "AST")))
    edges = parts.select("graph_id", F.inline(F.flatten(F.array(always, F.coalesce(second, F.array().cast(
        "array<struct<innode:string,outnode:string,etype:string>>")), parent))))
    declared = F.concat(F.lit("  "), "word", F.lit("  * v"), key.cast("string"), F.lit(" ;"))
    numbers = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("line_no")
    lines = parts.select("graph_id", numbers, block.alias("b"), declared.alias("declared"))
    here = F.when(key % 7 == 0, F.col("line_no") == 1).otherwise(F.col("line_no").isin(1) | (F.col("line_no") > F.col("b") + 1))
    text = F.when(here, F.col("declared")).otherwise(F.lit("return;"))
    return nodes, edges, lines.select("graph_id", "line_no", text.alias("text"))


@query(
    "local_variable_lines",
    """SELECT p_partkey AS graph_id, '1001' AS id, (p_size % 5 + 3)::int AS line FROM part
    WHERE p_partkey % 7 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0""",
)
def local_variable_lines(spark, d):
    return G.assign_lines_to_locals(*_locals(spark, d))[0]


@query(
    "local_variable_rejects",
    """SELECT p_partkey AS graph_id, CASE WHEN p_partkey % 13 = 0 THEN 'several types' ELSE 'not one enclosing block' END
      AS reason FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 17 = 0""",
)
def local_variable_rejects(spark, d):
    return G.assign_lines_to_locals(*_locals(spark, d))[1]


# --- graph JSON: one pair of texts per part; some are broken ----------------------------------------


def _graph_texts(spark, d):
    key = F.col("p_partkey").cast("string")
    nodes = F.concat(
        F.lit('[{"id":'), key, F.lit(',"_label":"METHOD","name":"f'), key, F.lit('","code":"<empty>"'),
        F.when(F.col("p_partkey") % 19 == 0, F.lit("}")).otherwise(F.lit(',"lineNumber":1}')),
        F.lit(',{"id":9,"_label":"CALL","name":"g","code":"g(x)"'),
        F.when(F.col("p_size") % 2 == 0, F.lit(',"controlStructureType":"IF"')).otherwise(F.lit("")),
        F.when(F.col("p_partkey") % 23 == 0, F.lit("}")).otherwise(F.lit("}]")),
    )
    edges = F.concat(F.lit("[["), key, F.lit(',9,"AST",null],[9,'), key, F.lit(',"CDG","x"]]'))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("graph_id"), nodes.alias("nodes_json"), edges.alias("edges_json")
    )


@query(
    "parsed_graph_nodes",
    """SELECT p_partkey AS graph_id, p_partkey::varchar AS id, 'METHOD' AS label, 'f' || p_partkey AS name,
      '<empty>' AS code, 1 AS line, '' AS control_structure_type FROM part WHERE p_partkey % 19 <> 0 AND p_partkey % 23 <> 0
    UNION ALL SELECT p_partkey, '9', 'CALL', 'g', 'g(x)', NULL, CASE WHEN p_size % 2 = 0 THEN 'IF' ELSE '' END
    FROM part WHERE p_partkey % 19 <> 0 AND p_partkey % 23 <> 0""",
)
def parsed_graph_nodes(spark, d):
    return parse_graphs(_graph_texts(spark, d))[0]


@query(
    "parsed_graph_edges",
    """SELECT p_partkey AS graph_id, p_partkey::varchar AS innode, '9' AS outnode, 'AST' AS etype, '' AS dataflow
      FROM part WHERE p_partkey % 19 <> 0 AND p_partkey % 23 <> 0
    UNION ALL SELECT p_partkey, '9', p_partkey::varchar, 'CDG', 'x' FROM part
      WHERE p_partkey % 19 <> 0 AND p_partkey % 23 <> 0""",
)
def parsed_graph_edges(spark, d):
    return parse_graphs(_graph_texts(spark, d))[1]


@query(
    "rejected_graphs",
    """SELECT p_partkey AS graph_id, CASE WHEN p_partkey % 23 = 0 THEN 'unreadable' ELSE 'missing column' END AS reason
    FROM part WHERE p_partkey % 19 = 0 OR p_partkey % 23 = 0""",
)
def rejected_graphs(spark, d):
    return parse_graphs(_graph_texts(spark, d))[2]


@query(
    "graph_files",
    """WITH kinds AS (SELECT p_partkey AS k, p_size, CASE WHEN p_partkey % 29 = 0 OR p_partkey % 23 = 0 THEN 'unreadable'
        WHEN p_partkey % 19 = 0 THEN 'missing column' END AS reason FROM part)
    SELECT 'reject' AS part, k::varchar AS graph_id, reason AS a, NULL AS b, NULL AS c, NULL::int AS line
      FROM kinds WHERE reason IS NOT NULL
    UNION ALL SELECT 'node', k::varchar, k::varchar, 'METHOD', 'f' || k, 1 FROM kinds WHERE reason IS NULL
    UNION ALL SELECT 'node', k::varchar, '9', 'CALL', 'g', NULL FROM kinds WHERE reason IS NULL
    UNION ALL SELECT 'edge', k::varchar, k::varchar, '9', 'AST', NULL FROM kinds WHERE reason IS NULL
    UNION ALL SELECT 'edge', k::varchar, '9', k::varchar, 'CDG', NULL FROM kinds WHERE reason IS NULL
    UNION ALL SELECT 'code', k::varchar, 'int f' || k || '()', NULL, NULL, 1 FROM kinds
    UNION ALL SELECT 'code', k::varchar, 'g(' || p_size || ');', NULL, NULL, 2 FROM kinds""",
)
def graph_files(spark, d):
    """Written as pairs of graph files with their code, then read back; every 29th pair lacks its edges."""
    texts = _graph_texts(spark, d)
    folder = stage_path(spark, "graphs")
    key = F.col("graph_id").cast("string")
    code = F.concat(F.lit("int f"), F.col("p_partkey").cast("string"), F.lit("()\n  g("), F.col("p_size").cast("string"), F.lit(");\n"))
    codes = table(spark, d, "part").select(F.col("p_partkey").alias("graph_id"), code.alias("text"))
    pairs = (
        (texts.withColumnRenamed("nodes_json", "text"), NODES_SUFFIX),
        (texts.filter("graph_id % 29 <> 0").withColumnRenamed("edges_json", "text"), EDGES_SUFFIX),
        (codes, CODE_SUFFIX),
    )
    for rows, suffix in pairs:
        write_files(rows.withColumn("name", F.concat(key, F.lit(suffix))), folder, "name", "text", sliced=True)
    nodes, edges, rejects = read_graphs(spark, folder)
    none = F.lit(None).cast("string")
    shape = lambda part, a, b, c, line=F.lit(None): [
        F.lit(part).alias("part"), "graph_id", a.alias("a"), b.alias("b"), c.alias("c"), line.cast("int").alias("line")
    ]
    return (
        rejects.select(*shape("reject", F.col("reason"), none, none))
        .unionByName(nodes.select(*shape("node", F.col("id"), F.col("label"), F.col("name"), F.col("line"))))
        .unionByName(edges.select(*shape("edge", F.col("innode"), F.col("outnode"), F.col("etype"))))
        .unionByName(read_code_lines(spark, folder).select(*shape("code", F.col("text"), none, none, F.col("line_no"))))
    )


# --- documents as line graphs ----------------------------------------------------------------------

_LINE_GRAPH_SQL = f"""ls AS (SELECT doc_id AS g, {sql_lines('text')} AS ls FROM documents),
  lines AS (SELECT g, i::int AS line, trim(list_extract(ls, i)) AS t FROM (
    SELECT g, ls, unnest(range(1, len(ls) + 1)) AS i FROM ls)),
  edges AS (SELECT a.g, a.line AS a, b.line AS b, CASE b.line - a.line WHEN 1 THEN 'CDG' ELSE 'DDG' END AS etype
    FROM lines a JOIN lines b ON a.g = b.g AND b.line IN (a.line + 1, a.line + 2)),
  near AS (SELECT g, a AS line, etype, b AS other FROM edges UNION SELECT g, b, etype, a FROM edges
    UNION SELECT g, line, 'CDG', line FROM lines UNION SELECT g, line, 'DDG', line FROM lines)"""


def _line_graph(spark, d):
    from faultline.operators.clean import explode_lines

    lines = explode_lines(table(spark, d, "documents"), "doc_id", "text").withColumnsRenamed(
        {"doc_id": "graph_id", "line": "text"}
    )
    nodes = lines.select("graph_id", F.col("line_no").alias("line"))
    last = lines.groupBy("graph_id").agg(F.max("line_no").alias("n"))
    step = F.explode(F.array(F.lit(1), F.lit(2))).alias("step")
    numbers = dealt(lines.select("graph_id", "line_no"), 4 * lines.count(), "graph_id")
    edges = (
        numbers.join(last.hint("merge"), "graph_id")
        .select("graph_id", "line_no", "n", step)
        .filter("line_no + step <= n")
        .select(
            "graph_id",
            F.col("line_no").alias("innode"),
            (F.col("line_no") + F.col("step")).alias("outnode"),
            F.when(F.col("step") == 1, F.lit("CDG")).otherwise(F.lit("DDG")).alias("etype"),
        )
    )
    return nodes, edges, lines


@query(
    "dependence_sets",
    f"""WITH {_LINE_GRAPH_SQL} SELECT g AS graph_id, line,
      string_agg(CASE WHEN etype = 'CDG' THEN other::varchar END, ' ' ORDER BY other) AS control,
      string_agg(CASE WHEN etype = 'DDG' THEN other::varchar END, ' ' ORDER BY other) AS data
    FROM near GROUP BY g, line""",
)
def dependence_sets(spark, d):
    nodes, edges, _ = _line_graph(spark, d)
    sets = G.dependence_sets(nodes, edges)
    text = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("control", "data")]
    return sets.select("graph_id", "line", *text)


@query(
    "dependence_contexts",
    f"""WITH {_LINE_GRAPH_SQL} SELECT n.g AS graph_id, n.line,
      string_agg(CASE WHEN n.etype = 'CDG' THEN l.t END, chr(10) ORDER BY n.other) AS control,
      string_agg(CASE WHEN n.etype = 'DDG' THEN l.t END, chr(10) ORDER BY n.other) AS data
    FROM near n JOIN lines l ON l.g = n.g AND l.line = n.other GROUP BY n.g, n.line""",
)
def dependence_contexts(spark, d):
    return G.dependence_contexts(*_line_graph(spark, d))


@query(
    "indexed_line_graph",
    f"""WITH {_LINE_GRAPH_SQL}, sides AS (SELECT g, a, b, etype FROM edges)
    SELECT g AS graph_id, (b - 1)::bigint AS src, (a - 1)::bigint AS dst, etype FROM sides""",
)
def indexed_line_graph(spark, d):
    nodes, edges, _ = _line_graph(spark, d)
    return G.index_edges(edges, checkpointed(G.index_nodes(nodes, quantile_bucket(nodes, "line"))))


@query(
    "undirected_graph_with_loops",
    f"""WITH {_LINE_GRAPH_SQL} SELECT graph_id, src, dst, count(*) AS n FROM (
      SELECT g AS graph_id, (b - 1)::bigint AS src, (a - 1)::bigint AS dst FROM edges
      UNION ALL SELECT g, (a - 1)::bigint, (b - 1)::bigint FROM edges
      UNION ALL SELECT g, (line - 1)::bigint, (line - 1)::bigint FROM lines) GROUP BY ALL""",
)
def undirected_graph_with_loops(spark, d):
    nodes, edges, _ = _line_graph(spark, d)
    indexed = checkpointed(G.index_nodes(nodes))
    both = G.add_self_loops(G.add_reverse_edges(G.index_edges(edges, indexed)), indexed)
    return both.groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


# --- embeddings as node vectors --------------------------------------------------------------------

_VECTOR_SQL = """nodes AS (SELECT label AS g, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
    embedding::double[] AS x FROM embeddings),
  edges AS (SELECT a.g, a.idx AS src, b.idx AS dst, (a.idx * 7 % 5 - b.idx % 3) / 4.0::double AS score
    FROM nodes a JOIN nodes b ON a.g = b.g AND b.idx IN (a.idx + 1, a.idx + 2)),
  dims AS (SELECT g, idx, k::int AS dim, x[k] AS v FROM (SELECT g, idx, x, unnest(range(1, len(x) + 1)) AS k FROM nodes)),
  outd AS (SELECT g, src, count(*) AS d FROM edges GROUP BY ALL),
  ind AS (SELECT g, dst, count(*) AS d FROM edges GROUP BY ALL)"""


def _vectors(spark, d):
    rows = table(spark, d, "embeddings").selectExpr("label AS graph_id", "vec_id AS line", "embedding AS vec")
    nodes = checkpointed(G.index_nodes(rows, quantile_bucket(rows, "line")))
    last = rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    ends = F.explode(F.array(F.col("idx") + 1, F.col("idx") + 2))
    steps = nodes.select("graph_id", F.col("idx").alias("src"), ends.alias("dst")).join(last, "graph_id")
    score = (F.col("src") * 7 % 5 - F.col("dst") % 3) / 4.0
    return nodes.select("graph_id", "idx", "vec"), steps.filter("dst < n").select("graph_id", "src", "dst", score.alias("score"))


def _long(df, vec, digits=6):
    exploded = df.select(*[c for c in df.columns if c != vec], F.posexplode(vec).alias("pos", "v"))
    value = F.round("v", digits) + F.lit(0.0)
    return exploded.select(
        *[c for c in df.columns if c != vec], (F.col("pos") + 1).alias("dim"), value.alias("value")
    )


def _reduced_sql(select, group="GROUP BY ALL"):
    return f"""WITH {_VECTOR_SQL}, r AS ({select} {group})
    SELECT d.g AS graph_id, d.idx, d.dim, round(coalesce(r.v, 0), 6) + 0.0 AS value FROM dims d
    LEFT JOIN r ON r.g = d.g AND r.idx = d.idx AND r.dim = d.dim"""


@query(
    "neighbour_sum",
    _reduced_sql("""SELECT e.g, e.dst AS idx, s.dim, sum(s.v / sqrt(o.d * i.d)) AS v FROM edges e
      JOIN dims s ON s.g = e.g AND s.idx = e.src JOIN outd o ON o.g = e.g AND o.src = e.src
      JOIN ind i ON i.g = e.g AND i.dst = e.dst"""),
)
def neighbour_sum(spark, d):
    nodes, edges = _vectors(spark, d)
    return _long(P.propagate(nodes, edges, "vec"), "h")


@query(
    "neighbour_max",
    _reduced_sql("SELECT e.g, e.dst AS idx, s.dim, max(s.v) AS v FROM edges e JOIN dims s ON s.g = e.g AND s.idx = e.src"),
)
def neighbour_max(spark, d):
    nodes, edges = _vectors(spark, d)
    return _long(P.max_pool(nodes, edges, "vec"), "h")


_SOFTMAX_SQL = """SELECT g, src, dst, exp(score - max(score) OVER (PARTITION BY g, dst)) /
  sum(exp(score)) OVER (PARTITION BY g, dst) * exp(max(score) OVER (PARTITION BY g, dst)) AS a FROM edges"""


@query(
    "edge_softmax",
    f"WITH {_VECTOR_SQL} SELECT g AS graph_id, src, dst, round(a, 6) AS a FROM ({_SOFTMAX_SQL})",
)
def edge_softmax(spark, d):
    _, edges = _vectors(spark, d)
    return P.edge_softmax(edges, "score").select("graph_id", "src", "dst", F.round("a", 6).alias("a"))


@query(
    "attention_sum",
    _reduced_sql(f"""SELECT e.g, e.dst AS idx, s.dim, sum(e.a * s.v) AS v FROM ({_SOFTMAX_SQL}) e
      JOIN dims s ON s.g = e.g AND s.idx = e.src"""),
)
def attention_sum(spark, d):
    nodes, edges = _vectors(spark, d)
    return _long(P.attention_sum(nodes, edges, "vec", "score"), "h")


@query(
    "graph_readout",
    f"WITH {_VECTOR_SQL} SELECT g AS graph_id, dim, round(avg(v), 6) + 0.0 AS value FROM dims GROUP BY g, dim",
)
def graph_readout(spark, d):
    nodes, _ = _vectors(spark, d)
    return _long(P.graph_mean(nodes, "vec"), "readout")
