"""Near-duplicate embeddings by the flat graph of ``flatgraph``; an exact comparison over cells is its audit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import flatgraph
from faultline.llm.common import components, staged
from faultline.llm.flatgraph import forest

COSINE = 0.93
# Vectors of a cell or of a block of one; a label of more is cut along centres, a cell with more in pairs of blocks.
CELL_ROWS = 4_096
# Vectors that one task assigns to centres at a time.
ASSIGN_ROWS = 2_048
# Rows of a block that are compared with the other block at a time.
SLICE_ROWS = 512


def representatives(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (``vec_id``, ``rep``), and one row (``label``, ``rep``, ``least``, ``unit``, ``copies``) per distinct vector.

    ``rep`` numbers the different vectors of a label, ``least`` is the smallest id; ``rep`` is null where a vector cannot
    link with any. The label carries the vector's length too, as vectors of different lengths have no cosine.
    """
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    label = F.concat(F.col(label_col).cast("string"), F.lit(":"), F.size(vector_col).cast("string"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), doubles.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    tested = rows.withColumn("fit", fit & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)))
    groups = tested.filter("fit").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    groups = staged(groups.withColumn("rep", F.monotonically_increasing_id()), "groups")
    # Divided by the largest component first, so that no square is lost or overflows.
    scaled = groups.withColumn("most", F.array_max(F.transform("vector", F.abs))).withColumn(
        "vector", F.transform("vector", lambda x: x / F.col("most"))
    )
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    units = scaled.withColumn("n", length).select(
        "label", "rep", "least", F.transform("vector", lambda x: x / F.col("n")).alias("unit"), "copies"
    )
    owners = tested.filter("fit").join(groups.select("label", "vector", "rep"), ["label", "vector"]).select("vec_id", "rep")
    lone = tested.filter("NOT fit").select("vec_id", F.lit(None).cast("long").alias("rep"))
    return owners.unionByName(lone), units


def visited(near: np.ndarray, centre: np.ndarray, threshold: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and which other cells it visits, from its products ``near`` with the centres.

    Let x live with c and y with h. Then y.h - y.c = (y - x).(h - c) + x.(h - c), and the last term is not above 0, so a
    link needs y.h - y.c <= |y - x| |h - c|. All cells that meet this bound are visited, so no link is lost; of two cells
    only one visits the other.
    """
    home = near.argmax(axis=1)
    reach = np.sqrt(2 - 2 * threshold)
    apart = np.linalg.norm(centre[:, None, :] - centre[None, :, :], axis=2)
    gap = near[np.arange(len(near)), home][:, None] - near
    cells = np.arange(len(centre))
    one_way = (cells[None, :] < home[:, None]) == ((cells[None, :] + home[:, None]) % 2 == 0)
    return home, (gap <= reach * apart[home] + 1e-9) & one_way & (cells[None, :] != home[:, None])


def members(units: DataFrame) -> DataFrame:
    """(``label``, ``cell``, ``low``, ``high``, ``own``, ``rep``, ``unit``, ``copies``): each vector where it can have links.

    A cell consists of blocks of those who live there and then blocks of visitors, ``own`` is the block of the row. Every
    block of the first kind meets itself and every other one in a group (``low``, ``high``) of two blocks at most.
    """
    kind = units.schema["label"].dataType.simpleString()
    parts = units.groupBy("label").agg(F.ceil(F.count("*") / ASSIGN_ROWS).cast("int").alias("parts"))
    dealt = units.join(parts, "label").select(
        "label", "rep", "unit", "copies", F.pmod(F.xxhash64("rep"), "parts").alias("part")
    )
    copied = flatgraph.centres(units, CELL_ROWS).join(parts, "label")
    copied = copied.select("label", "centres", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - F.lit(1).cast("long"))).alias("part"))

    def assign(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["label", "rep", "unit", "copies"]]
        if not len(rows) or not len(found):
            return rows.assign(cell=0, lives=True)
        points = np.stack(rows["unit"].to_numpy())
        centre = np.frombuffer(found["centres"].iloc[0]).reshape(-1, points.shape[1])
        home, visits = visited(points @ centre.T, centre)
        at, cell = np.nonzero(visits)
        return pd.concat([rows.assign(cell=home, lives=True), rows.iloc[at].assign(cell=cell, lives=False)])

    both = dealt.groupBy("label", "part").cogroup(copied.groupBy("label", "part"))
    placed = both.applyInPandas(
        assign, f"label {kind}, rep long, unit array<double>, copies long, cell int, lives boolean"
    )
    placed = staged(placed, "cells")
    blocks = lambda lives: F.ceil(F.count_if(lives) / CELL_ROWS).cast("int")
    sizes = placed.groupBy("label", "cell").agg(
        blocks(F.col("lives")).alias("homes"), blocks(~F.col("lives")).alias("guests")
    )
    # A cell where nobody lives has no links.
    blocked = placed.join(sizes.filter("homes > 0"), ["label", "cell"])
    spread = F.xxhash64("rep", F.lit(1))
    own = F.when(F.col("lives"), F.pmod(spread, "homes")).otherwise(F.col("homes") + F.pmod(spread, "guests")).cast("int")
    last = F.when(F.col("lives"), F.col("homes") + F.col("guests")).otherwise(F.col("homes")) - 1
    dealt = blocked.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select(
        "label", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "rep", "unit", "copies",
    )


def compare(left: np.ndarray, right: np.ndarray, same: bool, threshold: float = COSINE) -> np.ndarray:
    """Which rows of ``left`` link with which of ``right``; ``same`` if both are one block, whose diagonal is no link."""
    linked = np.empty((len(left), len(right)), dtype=bool)
    for at in range(0, len(left), SLICE_ROWS):
        linked[at : at + SLICE_ROWS] = left[at : at + SLICE_ROWS] @ right.T >= threshold
    if same:
        np.fill_diagonal(linked, False)
    return linked


def exact_counts(units: DataFrame, threshold: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """The audit of ``flatgraph.linked_counts``: the same tables from an exact comparison, whose work nears rows x rows.

    Every two vectors of a label that can link meet in one group and are compared there in double precision. Links are
    counted where they are found, so a large group of near-equal vectors does not make rows by its pairs.
    """
    held = staged(members(units), "members")

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, low, high = key
        sides = [rows[rows["own"] == low], rows[rows["own"] == high]]
        made = pd.DataFrame({"a": [], "b": [], "others": []}, dtype="Int64")
        if not len(sides[0]) or not len(sides[1]):
            return made
        points = [np.stack(x["unit"].to_numpy()) for x in sides]
        ids, copies = [x["rep"].to_numpy() for x in sides], [x["copies"].to_numpy() for x in sides]
        linked = compare(*points, low == high, threshold)
        if not linked.any():
            return made
        totals = [(ids[0], linked @ copies[1])] + ([(ids[1], copies[0] @ linked)] if low != high else [])
        row, mate, hub, column = forest(linked)
        stars = [(ids[0][row], ids[0][mate]), (ids[0][hub], ids[1][column])]
        counted = [pd.DataFrame({"a": a[n > 0], "others": n[n > 0]}) for a, n in totals]
        paired = [pd.DataFrame({"a": a, "b": b}) for a, b in stars]
        return pd.concat([*counted, *paired])[["a", "b", "others"]].astype("Int64")

    found = held.groupBy("label", "cell", "low", "high").applyInPandas(count, "a long, b long, others long")
    found = staged(found, "counts")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("others").alias("others"))
    return counts, found.filter("b IS NOT NULL").select("a", "b")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(``vec_id``, ``n_links``, ``component_id``, ``kept``) per row of ``vectors``.

    Vectors link if their labels are equal and their cosine is COSINE or more; vectors of different lengths do not. A
    vector that is null, zero, or holds null or non-finite components, and one without label or id, links with nothing and
    is its own component. Equal vectors of a label are searched once and link with one another. Rows that repeat an id
    count as vectors of their own with the same id.
    """
    rows, units = representatives(vectors, id_col, vector_col, label_col)
    rows, units = staged(rows, "vectors"), staged(units, "units")
    linked, stars = flatgraph.linked_counts(units, COSINE)
    reached = components(stars).withColumnRenamed("node", "rep")
    known = units.select("rep", "least", "copies").join(linked, "rep", "left").join(reached, "rep", "left")
    known = staged(known.withColumn("component", F.coalesce("component", "rep")), "known")
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select(
        "rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    named = rows.join(known, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return named.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def recall(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> float:
    """Share of the true links, by the exact comparison, of the vectors with an id divisible by 20 that the graph finds."""
    _, units = representatives(vectors, id_col, vector_col, label_col)
    units = staged(units, "units")
    found, true = (x.withColumnRenamed("others", name) for x, name in (
        (flatgraph.linked_counts(units, COSINE)[0], "found"), (exact_counts(units)[0], "true")))
    asked = units.filter("least % 20 = 0").join(true, "rep").join(found, "rep", "left")
    total = asked.agg(F.sum("true").alias("true"), F.sum(F.coalesce("found", F.lit(0))).alias("found")).first()
    return total["found"] / total["true"] if total["true"] else 1.0
