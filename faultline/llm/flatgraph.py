"""Flat neighbour graphs: robust-pruned lists built on overlapping cluster shards, united, searched in growing ranges.

1. Centres of a label come from a bounded sample; every vector joins the shards of its OVERLAP nearest centres and lives
   in the nearest one. A shard above SHARD_ROWS is cut into blocks by hash.
2. Each block builds the lists of its members by robust pruning over near and some far candidates, with edges back. The
   lists that a vector has in several shards are united; an entry carries the shard where the other one lives.
3. Every vector asks its own shards first. Within a block a search starts from the medoid, follows the nearest vectors
   found and then all in range. Where a list of a vector in range leads to another shard, the asking vector goes there in
   the next round, until no new shard is asked. A shard that is asked is asked in all its blocks.

Links are verified in double precision and counted where they are found, so a large group of near-equal vectors makes no
rows by its pairs. No task holds more than one block and QUERY_ROWS asking vectors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import staged

# Members of a block; a label of more is cut along centres, a shard with more in blocks.
SHARD_ROWS = 4_096
OVERLAP = 3
# Centres of a label come from so many of its vectors at most, the smallest hashes; further growth goes to the blocks.
CENTRE_SAMPLE = 2_048
MAX_CENTRES = 512
# Vectors that one task assigns to centres, or that ask one block in a task.
ASSIGN_ROWS = 2_048
QUERY_ROWS = 2_048
DEGREE = 24
CANDIDATES = 40
LONG_RANGE = 8
ALPHA = 1.2
# Near asking vectors walk through a block together; each follows its BEAM nearest vectors.
BATCH = 64
BEAM = 8
# How far below the threshold a vector is still in range.
SLACK = 0.06


def centres(units: DataFrame, rows: int = SHARD_ROWS, overlap: int = 1) -> DataFrame:
    """(``label``, ``centres``: doubles, one centre after the other) of each label with more than ``rows`` vectors."""
    sizes = units.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > rows)
    draws = units.withColumn("draw", F.xxhash64("rep"))
    # About CENTRE_SAMPLE vectors of the smallest hashes: the share of the hash range that holds them.
    low, span = -(2.0**63), 2.0**64
    sampled = draws.join(sizes, "label").filter(
        (F.col("draw").cast("double") - low) / span <= F.lit(float(CENTRE_SAMPLE)) / F.col("n")
    )

    def cluster(rows_: pd.DataFrame) -> pd.DataFrame:
        rows_ = rows_.sort_values("draw")
        points = np.stack(rows_["unit"].to_numpy())
        wanted = min(MAX_CENTRES, int(np.ceil(overlap * rows_["n"].iloc[0] / rows)), len(points))
        found = points[:wanted].copy()
        for _ in range(4):
            nearest = (points @ found.T).argmax(axis=1)
            sums = np.zeros_like(found)
            np.add.at(sums, nearest, points)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            found = np.where(length > 0, sums / np.maximum(length, 1e-300), found)
        return pd.DataFrame({"label": [rows_["label"].iloc[0]], "centres": [found.tobytes()]})

    kind = units.schema["label"].dataType.simpleString()
    return sampled.groupBy("label").applyInPandas(cluster, f"label {kind}, centres binary")


def members(units: DataFrame) -> DataFrame:
    """(``label``, ``cell``, ``home``, ``block``, ``blocks``, ``rep``, ``unit``, ``copies``): each vector in its shards."""
    kind = units.schema["label"].dataType.simpleString()
    parts = units.groupBy("label").agg(F.ceil(F.count("*") / ASSIGN_ROWS).cast("int").alias("parts"))
    dealt = units.join(parts, "label").select(
        "label", "rep", "unit", "copies", F.pmod(F.xxhash64("rep"), "parts").alias("part")
    )
    copied = centres(units, SHARD_ROWS, OVERLAP).join(parts, "label").select(
        "label", "centres", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - F.lit(1).cast("long"))).alias("part")
    )

    def assign(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["label", "rep", "unit", "copies"]]
        if not len(rows) or not len(found):
            return rows.assign(cell=0, home=0)
        points = np.stack(rows["unit"].to_numpy())
        centre = np.frombuffer(found["centres"].iloc[0]).reshape(-1, points.shape[1])
        best = np.argsort(-(points @ centre.T), axis=1, kind="stable")[:, :OVERLAP]
        return pd.concat([rows.assign(cell=best[:, k], home=best[:, 0]) for k in range(best.shape[1])])

    both = dealt.groupBy("label", "part").cogroup(copied.groupBy("label", "part"))
    placed = staged(both.applyInPandas(assign, f"label {kind}, rep long, unit array<double>, copies long, cell int, home int"), "placed")
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("blocks"))
    return placed.join(sizes, ["label", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("rep", F.lit(1)), "blocks").cast("int")
    )


def pruned_edges(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a block, both ways: the nearest candidate stays and drops those ALPHA times closer to it."""
    n = len(points)
    keep = min(CANDIDATES, n - 1)
    if keep < 1:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    rng = np.random.default_rng(n)
    ends: list[np.ndarray] = []
    for start in range(0, n, 256):
        own = np.arange(start, min(start + 256, n))
        near = points[own] @ points.T
        near[np.arange(len(own)), own] = -3.0
        best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
        found = np.concatenate([best, rng.integers(0, n, (len(own), LONG_RANGE))], axis=1)
        value = np.take_along_axis(near, found, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        found, value = np.take_along_axis(found, order, axis=1), np.take_along_axis(value, order, axis=1)
        away = np.sqrt(np.maximum(0.0, 2 - 2 * value))
        vectors = points[found]
        between = ALPHA * np.sqrt(np.maximum(0.0, 2 - 2 * vectors @ vectors.transpose(0, 2, 1)))
        alive, taken = value > -2.5, np.zeros(value.shape, dtype=bool)
        left = np.full(len(own), DEGREE)
        for at in range(value.shape[1]):
            pick = alive[:, at] & (left > 0)
            taken[pick, at] = True
            left -= pick
            alive &= ~(pick[:, None] & (between[:, at] <= away))
        row, at = np.nonzero(taken)
        ends.append(own[row] * n + found[row, at])
        ends.append(found[row, at] * n + own[row])
    edges = np.unique(np.concatenate(ends))
    return edges // n, edges % n


def united_lists(placed: DataFrame) -> DataFrame:
    """(``rep``, ``near``, ``leads``): all neighbours of a vector over its shards, and the shards where these live."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids, homes = rows["rep"].to_numpy(), rows["home"].to_numpy()
        left, right = pruned_edges(np.stack(rows["unit"].to_numpy()))
        cuts = np.searchsorted(left, np.arange(1, len(ids)))
        return pd.DataFrame({
            "rep": ids, "near": np.split(ids[right], cuts), "leads": [np.unique(x) for x in np.split(homes[right], cuts)],
        })

    columns = placed.select("label", "cell", "block", "rep", "unit", "home")
    lists = columns.groupBy("label", "cell", "block").applyInPandas(build, "rep long, near array<long>, leads array<int>")
    united = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731  at most OVERLAP lists
    return lists.groupBy("rep").agg(united("near"), united("leads"))


def heads_of(cuts: np.ndarray, heads: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """All neighbours of ``nodes``; those of node k are ``heads[cuts[k]:cuts[k + 1]]``."""
    lengths = cuts[nodes + 1] - cuts[nodes]
    ends = np.cumsum(lengths)
    return heads[np.repeat(cuts[nodes] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def entries(points: np.ndarray, cuts: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The medoid, and one vector of every part of the graph that cannot be reached from there."""
    wave = np.array([int((points @ points.mean(axis=0)).argmax())])
    starts, seen, free = [wave], np.zeros(len(points), dtype=bool), 0
    while True:
        while len(wave):
            seen[wave] = True
            wave = np.unique(heads_of(cuts, heads, wave))
            wave = wave[~seen[wave]]
        while free < len(points) and seen[free]:
            free += 1
        if free == len(points):
            return np.concatenate(starts)
        wave = np.array([free])
        starts.append(wave)


def walk(
    points: np.ndarray, cuts: np.ndarray, heads: np.ndarray, starts: np.ndarray, asking: np.ndarray, low: float
) -> tuple[np.ndarray, np.ndarray]:
    """Vectors met by a batch, and their products with it: the nearest of each are followed, and all above ``low``."""
    n = len(points)
    near, nodes, count = np.empty((len(asking), n)), np.empty(n, dtype=np.int64), 0
    seen, followed = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    new = np.unique(starts)
    while True:
        near[:, count : count + len(new)] = asking @ points[new].T
        nodes[count : count + len(new)] = new
        seen[new] = True
        count += len(new)
        shown = near[:, :count]
        best = np.argpartition(-shown, min(BEAM, count) - 1, axis=1)[:, :BEAM]
        ready = (shown >= low).any(axis=0)
        ready[best.ravel()] = True
        at = nodes[:count][ready]
        at = at[~followed[at]]
        if not len(at):
            return nodes[:count], shown
        followed[at] = True
        new = np.unique(heads_of(cuts, heads, at))
        new = new[~seen[new]]


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stars with the components of the links: (row, row) and (row, column) index pairs, at most one per row and column."""
    across = np.ascontiguousarray(linked.T)
    free_row, free_column = linked.any(axis=1), np.ones(linked.shape[1], dtype=bool)
    stars: tuple[list, list, list, list] = ([], [], [], [])
    for seed in np.flatnonzero(free_row):
        if not free_row[seed]:
            continue
        free_row[seed] = False
        rows = np.array([seed])
        while len(rows):
            columns = np.flatnonzero(linked[rows].any(axis=0) & free_column)
            free_column[columns] = False
            stars[2].append(np.full(len(columns), seed))
            stars[3].append(columns)
            rows = np.flatnonzero(across[columns].any(axis=0) & free_row)
            free_row[rows] = False
            stars[0].append(np.full(len(rows), seed))
            stars[1].append(rows)
    return tuple(np.concatenate(x) if x else np.array([], dtype=np.int64) for x in stars)  # type: ignore[return-value]


def searched(asking: pd.DataFrame, block: pd.DataFrame, cell: int, threshold: float) -> pd.DataFrame:
    """What ``asking`` finds in a block: links counted per vector, stars of the links, shards to ask next."""
    block = block.sort_values("rep")
    ids, points, copies = block["rep"].to_numpy(), np.stack(block["unit"].to_numpy()), block["copies"].to_numpy()
    lists = [np.searchsorted(ids, x) for x in block["near"]]
    lists = [at[ids[np.minimum(at, len(ids) - 1)] == x] for at, x in zip(lists, block["near"], strict=True)]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    heads = np.concatenate(lists).astype(np.int64)
    starts = entries(points, cuts, heads)
    cells = np.unique(np.concatenate([np.asarray(x) for x in block["leads"]])).astype(np.int64)
    cells = cells[cells != cell]
    leads = np.zeros((len(ids), len(cells)), dtype=np.float32)
    for at, found in enumerate(block["leads"]):
        leads[at] = np.isin(cells, found)
    queries, own = np.stack(asking["unit"].to_numpy()), asking["rep"].to_numpy()
    order = np.argsort((queries @ points[:: max(1, len(ids) // 64)].T).argmax(axis=1), kind="stable")
    linked = np.zeros((len(own), len(ids)), dtype=bool)
    going = np.zeros((len(own), len(cells)), dtype=bool)
    at_home = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    lives = ids[at_home] == own
    for start in range(0, len(own), BATCH):
        rows = order[start : start + BATCH]
        own_nodes = at_home[rows][lives[rows]]
        nodes, near = walk(points, cuts, heads, np.concatenate([starts, own_nodes]), queries[rows], threshold - SLACK)
        linked[np.ix_(rows, nodes)] = near >= threshold
        going[rows] = (near >= threshold - SLACK).astype(np.float32) @ leads[nodes] > 0
    linked[np.flatnonzero(lives), at_home[lives]] = False
    others = linked @ copies
    row, mate, hub, column = forest(linked)
    asks, at = np.nonzero(going)
    tables = [
        pd.DataFrame({"a": own[others > 0], "others": others[others > 0]}),
        pd.DataFrame({"a": own[row], "b": own[mate]}),
        pd.DataFrame({"a": own[hub], "b": ids[column]}),
        pd.DataFrame({"a": own[asks], "next": cells[at]}),
    ]
    return pd.concat(tables).reindex(columns=["a", "b", "others", "next"]).astype("Int64")


def linked_counts(units: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(``rep``, ``others``): the rows found that each vector links with, and (``a``, ``b``): pairs with the same components."""
    kind = units.schema["label"].dataType.simpleString()
    placed = staged(members(units), "shards")
    lists = united_lists(placed)
    living = placed.filter("cell = home").select("label", "cell", "block", "blocks", "rep", "unit", "copies")
    graph = staged(living.join(lists, "rep"), "graph")
    blocks = graph.select("label", "cell", "block").distinct()
    asked = placed.select("label", "cell", "rep")
    made = "a long, b long, others long, next int"

    def look(key: tuple, asking: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(block):
            return pd.DataFrame(columns=["label", "a", "b", "others", "next"])
        found = searched(asking, block, key[1], threshold)
        found.insert(0, "label", key[0])
        return found

    found, done, new = [], asked, asked
    while True:
        parts = staged(
            new.groupBy("label", "cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts")).join(blocks, ["label", "cell"]),
            "parts",
        )
        place = F.pmod(F.xxhash64("rep", F.lit(2)), "parts").cast("int").alias("part")
        asking = new.join(units.select("rep", "unit"), "rep").join(parts, ["label", "cell"])
        asking = asking.select("label", "cell", "block", place, "rep", "unit")
        copied = graph.join(parts, ["label", "cell", "block"]).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        ).select("label", "cell", "block", "part", "rep", "unit", "copies", "near", "leads")
        keys = ["label", "cell", "block", "part"]
        both = asking.groupBy(*keys).cogroup(copied.groupBy(*keys))
        found.append(staged(both.applyInPandas(look, f"label {kind}, {made}"), "found"))
        wanted = found[-1].filter("next IS NOT NULL").select("label", F.col("next").alias("cell"), F.col("a").alias("rep"))
        new = staged(wanted.distinct().join(done, ["label", "cell", "rep"], "left_anti"), "asking")
        if new.isEmpty():
            break
        done = done.unionByName(new)
    every = reduce(DataFrame.unionByName, found)
    counts = every.filter("others IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("others").alias("others"))
    return counts, every.filter("b IS NOT NULL").select("a", "b")
