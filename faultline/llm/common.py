"""What several corpus operators share: stage tables, row keys, connected components, files in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.cluster import stage_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, and any lost task can be run again."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(text: str | Column) -> Column:
    """The UTF-8 bytes of a text; a missing text is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def shared_file(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a file in the shared folder, whatever its scheme."""
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few rows copied at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links (``a``, ``b``: long): one row (``node``, ``component``) per linked node.

    The component is its smallest node. Rounds of large-star and small-star: every node passes its smallest known
    neighbour on to its other neighbours, until each component is a star. Minima are aggregated before the shuffle, and
    the join back is one that Spark splits where a node has very many neighbours.
    """

    def smallest(edges: DataFrame) -> DataFrame:
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")

    edges = staged(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            smallest(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        hop = smallest(large)
        small = hop.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            hop.select("u", F.col("m").alias("v"))
        )
        edges = staged(small.filter("u <> v").distinct(), "stars")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
