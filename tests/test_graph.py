import json


from faultline.operators import graph as G
from faultline.operators import propagate as P
from faultline.operators import vocab
from faultline.plans.linegraphs import build_line_graphs, encode_contexts
from faultline.sources import graphs as S


def test_neighbours_are_exact_walks(spark):
    edges = spark.createDataFrame([(1, "1", "2", "AST"), (1, "2", "3", "AST")], "graph_id int, innode string, outnode string, etype string")
    seeds = spark.createDataFrame([(1, "1")], "graph_id int, seed string")
    rows = [(r["hop"], r["node"]) for r in G.neighbours(edges, seeds, 2).collect()]
    assert sorted(rows) == [(1, "2"), (2, "1"), (2, "3")]
    five = G.neighbours(edges, seeds, 5, intermediate=False)  # also crosses the checkpoint
    assert [r["node"] for r in five.collect()] == ["2"]


def test_longest_code_wins(spark):
    nodes = spark.createDataFrame(
        [(1, "1", "CALL", "a", "a", 5), (1, "2", "CALL", "b", "a = b", 5), (1, "3", "CALL", "c", "c = d", 5)],
        "graph_id int, id string, label string, name string, code string, line int",
    )
    assert tuple(G.collapse_to_lines(nodes).first()) == (1, 5, "2", "a = b")


def test_reverse_edges_and_loops(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (1, 1, 1)], "graph_id int, src int, dst int")
    indexed = spark.createDataFrame([(1, 0), (1, 1)], "graph_id int, idx int")
    both = G.add_self_loops(G.add_reverse_edges(edges), indexed)
    assert sorted(tuple(r) for r in both.collect()) == sorted(
        [(1, 0, 1), (1, 0, 1), (1, 1, 1), (1, 1, 0), (1, 1, 0), (1, 0, 0), (1, 1, 1)]
    )


def test_reducers(spark):
    nodes = spark.createDataFrame([(1, 0, [1.0, -2.0]), (1, 1, [3.0, 4.0]), (1, 2, [0.0, 1.0])], "graph_id int, idx int, vec array<double>")
    edges = spark.createDataFrame([(1, 0, 2, 0.0), (1, 1, 2, 0.0), (1, 0, 1, 1.0)], "graph_id int, src int, dst int, s double")
    get = lambda df: {r["idx"]: [round(x, 6) for x in r["h"]] for r in df.collect()}
    both = get(P.propagate(nodes, edges, "vec"))
    half = 2**-0.5
    assert both[2] == [round(1 * half * half + 3 * half, 6), round(-2 * half * half + 4 * half, 6)]
    assert both[0] == [0.0, 0.0]
    assert get(P.propagate(nodes, edges, "vec", norm="none"))[2] == [4.0, 2.0]
    assert get(P.max_pool(nodes, edges, "vec"))[2] == [3.0, 4.0]
    assert get(P.attention_sum(nodes, edges, "vec", "s"))[2] == [2.0, 1.0]
    mean = P.graph_mean(nodes, "vec").first()["readout"]
    assert [round(x, 6) for x in mean] == [round(4 / 3, 6), 1.0]


CODE = "int f() {\nint x;\nx = 1;\nreturn x;\n}\n"
NODES = [
    {"id": 1, "_label": "METHOD", "name": "f", "code": "f", "lineNumber": 1},
    {"id": 1000100, "_label": "BLOCK", "name": "", "code": "<empty>", "lineNumber": 1},
    {"id": 1000101, "_label": "LOCAL", "name": "x", "code": "x"},
    {"id": 1000102, "_label": "IDENTIFIER", "name": "x", "code": "x = 1", "lineNumber": 3},
    {"id": 1000103, "_label": "RETURN", "name": "", "code": "return x;", "lineNumber": 4},
    {"id": 7, "_label": "TYPE", "name": "int", "code": "<empty>"},
    {"id": 8, "_label": "COMMENT", "name": "", "code": "// c", "lineNumber": 2},
]
EDGES = [
    [1000101, 1000100, "AST", None],
    [1000101, 900, "REF", None],
    [900, 7, "EVAL_TYPE", None],
    [1000103, 1000102, "REACHING_DEF", "x"],
    [1000102, 1, "CDG", None],
    [1000102, 8, "CDG", None],
    [1000101, 7, "EVAL_TYPE", None],
    [1, 1000102, "CONTAINS", None],
]


def write_graphs(folder):
    for name in ("10", "11", "12", "13"):
        (folder / f"{name}.c").write_text(CODE)
    for name, nodes, edges in (("10", NODES, EDGES), ("11", NODES, [])):
        (folder / f"{name}.c.nodes.json").write_text(json.dumps(nodes))
        (folder / f"{name}.c.edges.json").write_text(json.dumps(edges))
    (folder / "12.c.nodes.json").write_text("[{")
    (folder / "12.c.edges.json").write_text("[]")
    (folder / "13.c.nodes.json").write_text(json.dumps([{"id": 1, "_label": "METHOD", "name": "f"}]))
    (folder / "13.c.edges.json").write_text("[]")


def test_line_graphs_from_files(spark, tmp_path):
    write_graphs(tmp_path)
    nodes, edges, rejects = S.read_graphs(spark, str(tmp_path))
    assert {r["graph_id"]: r["reason"] for r in rejects.collect()} == {"12": "unreadable", "13": "missing column"}
    assert nodes.filter("graph_id = '10'").count() == 7
    lines = S.read_code_lines(spark, str(tmp_path))
    assigned, _ = G.assign_lines_to_locals(nodes, edges, lines)
    assert [tuple(r) for r in assigned.collect()] == [("10", "1000101", 2)]
    graphs = build_line_graphs(nodes, edges, lines, rejects)
    assert {r["graph_id"] for r in graphs.rejects.collect()} == {"11", "12", "13"}
    rows = {r["line"]: r for r in graphs.nodes.collect()}
    assert sorted(rows) == [1, 3, 4]
    assert rows[3]["data"] == "x = 1;\nreturn x;" and rows[3]["control"] == "int f() {\nx = 1;"
    assert rows[4]["nature_context"] == "x = 1;\nreturn x;\n}"
    assert [rows[n]["idx"] for n in (1, 3, 4)] == [0, 1, 2]
    edges_out = sorted((r["src"], r["dst"]) for r in graphs.edges.collect())
    assert edges_out == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]
    words = spark.createDataFrame([("x", 2), ("=", 3)], "token string, id int")
    ids = encode_contexts(graphs, words).filter("line = 3").first()["sentence_feature"]
    assert ids[:4] == [2, 3, 0, 1] and len(ids) == vocab.GRAPH_MODEL["length"]


def test_index_is_the_same_for_any_partitioning(spark):
    rows = [(g, line) for g in (1, 2) for line in range(1, 200 if g == 1 else 5)]
    df = spark.createDataFrame(rows, "graph_id int, line int")
    one = sorted(tuple(r) for r in G.index_nodes(df.repartition(1)).collect())
    seven = sorted(tuple(r) for r in G.index_nodes(df.repartition(7)).collect())
    assert one == seven == [(g, line, line - 1) for g, line in sorted(rows)]
