"""Mix sources to target weights by hash-random order and distributed prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import staged

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Rows of a source that one window task sums up; a source is cut into as many slices of the hash order as it needs.
SLICE_ROWS = 2_000
HASH_SPACE = 16**12


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    Sources in code point order, the missing one last, take ``weights`` in turn and share the sum of all sizes. A target
    stops at ``max_epochs`` times its source's size; what is over goes to the others by weight. The sources that stop are
    those with the least room per weight, so one pass over them in that order finds the common level.
    ``sources`` has one row per mixture component, so its windows are small whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    by_room = Window.orderBy("room_per_weight", F.col("source").asc_nulls_last())
    exact = "decimal(38,0)"
    shares = (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
        .withColumn("room", F.col("source_size") * max_epochs)
        .withColumn("room_per_weight", F.col("room").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("stopped", F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open_weight", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("left", F.col("total") - F.coalesce("stopped", F.lit(0)))
    )
    # A source fits if its share stays within its room once all sources with less room per weight have stopped.
    # The first that fits in that order, the one with the largest open weight, gives the level.
    fits = F.col("left").cast(exact) * F.col("weight") <= F.col("room").cast(exact) * F.col("open_weight")
    level = F.max(F.when(fits, F.struct("open_weight", "left"))).over(Window.partitionBy())
    leveled = shares.withColumn("level", level)
    share = F.col("level.left").cast("double") / F.col("level.open_weight") * F.col("weight")
    return leveled.select("source", "source_size", F.least(F.col("room").cast("double"), share).alias("target"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, seed: str = "mix") -> DataFrame:
    """(``doc_id``, ``text_md5``, ``size``, ``source_size``, ``target``, ``taken``) per row of ``docs``.

    ``size`` counts words (missing text: 0). A source takes whole passes over its documents while its budget, the target
    rounded down, allows; of the last pass it takes documents in md5 order up to the exact word, so one document is cut.
    The order depends on id and text only: reruns agree, and repeated rows are interchangeable. Empty texts take nothing.
    Missing sources form a source of their own. Sources without words have the target 0. No rows give no rows.
    """
    rows = staged(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"),
        ).withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), "text_md5"))),
        "sizes",
    )
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    budgets = targets(per_source.select("source", "source_size"), weights)
    plan = staged(
        budgets.join(per_source.select(F.col("source").alias("s"), "n"), F.expr("source <=> s")).drop("s"), "budgets"
    )
    at = F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(HASH_SPACE))
    placed = (
        rows.withColumnRenamed("source", "s")
        .join(plan, F.expr("s <=> source"))
        .withColumn("slice", F.floor(at * F.ceil(F.col("n") / SLICE_ROWS)))
        .drop("s", "n")
    )
    sums = placed.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("s"), F.col("slice").alias("p"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")
    )
    inside = (
        Window.partitionBy("source", "slice").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("offset")
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    summed = placed.join(offsets, F.expr("source <=> s AND slice = p")).withColumn("before", before)
    return (
        summed.withColumn("passes", passes)
        .withColumn("rest", budget - F.col("passes") * F.col("source_size"))
        .withColumn(
            "taken",
            F.col("passes") * F.col("size")
            + F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("before"))),
        )
        .select("doc_id", "text_md5", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
    )


def mixture(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id``, ``text``, ``source``) as often as the mix takes them, all columns.

    A document that the budget cuts counts as taken once more if at least half of its words are in. Documents without
    words cost nothing and stay once.
    """
    mixed = mix(docs)
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(1)
    wanted = mixed.select(F.col("doc_id").alias("mixed_id"), F.col("text_md5").alias("mixed_md5"), times.alias("times"))
    # Rows that repeat id and text are one row here, taken as often as all of them.
    wanted = wanted.groupBy("mixed_id", "mixed_md5").agg(F.sum("times").alias("times")).filter("times > 0")
    named = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").cast("long").alias("row_id"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("row_md5"),
    ).dropDuplicates(["row_id", "row_md5"])
    taken = named.join(wanted, F.expr("row_id <=> mixed_id AND row_md5 = mixed_md5"))
    copies = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    return copies.select("row.*")
