"""Property graphs from pairs of JSON files, one pair per function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.cluster import stage_path
from faultline.functions.text import unfold
from faultline.sources.files import read_files

# File name endings and node properties; only the last property may be absent from a file.
NODES_SUFFIX, EDGES_SUFFIX, CODE_SUFFIX = ".c.nodes.json", ".c.edges.json", ".c"
REQUIRED = ("id", "_label", "name", "code", "lineNumber")
OPTIONAL = ("controlStructureType",)


def read_texts(spark: SparkSession, folder: str, suffix: str, column: str) -> DataFrame:
    """(graph_id, text) of all files with an ending; the file name in front of the ending is the id."""
    stem = F.expr(f"substr(name, 1, length(name) - {len(suffix)})")
    return read_files(spark, folder, suffix).select(stem.alias("graph_id"), F.col("text").alias(column))


def parse_graphs(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects) from (graph_id, nodes_json, edges_json).

    Node records may have any keys. A required key that no record of a file has rejects the file, like text
    that is no JSON array; the optional key is added as an empty text.
    """
    parsed = files.select(
        "graph_id",
        F.from_json("nodes_json", "array<map<string,string>>").alias("n"),
        F.from_json("edges_json", "array<array<string>>").alias("e"),
    )
    keys = F.array_distinct(F.flatten(F.transform("n", lambda r: F.map_keys(r))))
    lacking = F.size(F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), keys)) > 0
    unreadable = F.col("n").isNull() | F.col("e").isNull() | F.exists("e", lambda t: t.isNull() | (F.size(t) < 3))
    reason = F.when(F.coalesce(unreadable, F.lit(True)), "unreadable").when(lacking, "missing column")
    judged = parsed.withColumn("reason", reason)
    good = judged.filter("reason IS NULL")
    records = good.select("graph_id", unfold("n").alias("r"))
    get = lambda key: F.try_element_at("r", F.lit(key))
    nodes = records.select(
        "graph_id",
        get("id").alias("id"),
        get("_label").alias("label"),
        F.coalesce(get("name"), F.lit("")).alias("name"),
        F.coalesce(get("code"), F.lit("")).alias("code"),
        get("lineNumber").try_cast("int").alias("line"),
        F.coalesce(get(OPTIONAL[0]), F.lit("")).alias("control_structure_type"),
    )
    quads = good.select("graph_id", unfold("e").alias("t"))
    edges = quads.select(
        "graph_id",
        F.get("t", F.lit(0)).alias("innode"),
        F.get("t", F.lit(1)).alias("outnode"),
        F.get("t", F.lit(2)).alias("etype"),
        F.coalesce(F.get("t", F.lit(3)), F.lit("")).alias("dataflow"),
    )
    return nodes, edges, judged.filter("reason IS NOT NULL").select("graph_id", "reason")


def read_graphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and rejects of all file pairs in a folder; a lone file counts as unreadable.

    The small files are opened once: their texts go into a stage table, from which all three are taken.
    """
    nodes = read_texts(spark, folder, NODES_SUFFIX, "nodes_json")
    edges = read_texts(spark, folder, EDGES_SUFFIX, "edges_json")
    path = stage_path(spark, "graph-texts")
    nodes.join(edges.hint("merge"), "graph_id", "full").write.parquet(path)
    return parse_graphs(spark.read.parquet(path))


def read_code_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, line_no, text) of the source files next to the graphs, lines stripped."""
    from faultline.operators.clean import explode_lines

    codes = read_texts(spark, folder, CODE_SUFFIX, "code")
    return explode_lines(codes, "graph_id", "code").withColumnRenamed("line", "text")
