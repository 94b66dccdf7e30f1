"""How filters interact: one byte transducer measures each text, and every order of the filters is counted."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import spans
from faultline.llm.common import staged, text_bytes

FILTERS = "ABCDE"
# The limits of the five filters.
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"

# What a byte is, and what the transducer puts out on it: the state is whether a word is open.
_SPACE, _CAPITAL, _SYMBOL, _POINT = 1, 2, 4, 8
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] |= _SPACE
_KIND[ord("A") : ord("Z") + 1] |= _CAPITAL
_KIND[list(SYMBOLS)] |= _SYMBOL
_KIND[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT

MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def transduce(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """MEASURES of each row (a matrix, one line each), and (first byte, end, row) of the different words of the rows."""
    kind = _KIND[data]
    starts, ends, row = spans.words((kind & _SPACE) == 0, offsets)
    rows = len(offsets) - 1
    own = spans.representatives(data, starts, ends, row) == np.arange(len(starts))
    return (
        np.stack(
            [
                np.bincount(row, minlength=rows),
                np.bincount(row[own], minlength=rows),
                *(_per_row(kind & bit > 0, offsets) for bit in (_CAPITAL, _POINT, _SYMBOL)),
            ]
        ),
        starts[own],
        ends[own],
        row[own],
    )


def _long_text(data: np.ndarray, size: int) -> np.ndarray:
    """MEASURES of one text, cut at white space into blocks; different words of the blocks meet in one set."""
    total = np.zeros(len(MEASURES), dtype=np.int64)
    seen: set[bytes] = set()
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data):  # the block goes on to the next white space
            gap = np.flatnonzero(_KIND[data[end : end + size]] & _SPACE)
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + size)
        part = data[at:end]
        found, starts, ends, _ = transduce(part, np.array([0, len(part)]))
        total += found[:, 0]
        raw = part.tobytes()
        seen.update(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        at = end
    total[1] = len(seen)
    return total


def measures(docs: DataFrame, text_col: str = "text", block: int = spans.BLOCK) -> DataFrame:
    """``docs`` without the text, with MEASURES and ``digest``, by which equal texts are known."""
    others = [c for c in docs.columns if c != text_col]
    width = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                transduce(data, offsets)[0] if len(offsets) > 2 or len(data) <= block else _long_text(data, block)[:, None]
                for _, offsets, data in spans.blocks(batch.column(width + 1), block)
            ]
            table = np.concatenate(found, axis=1) if found else np.zeros((len(MEASURES), 0), dtype=np.int64)
            columns = [batch.column(k) for k in range(width + 1)] + [pa.array(line, pa.int64()) for line in table]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "digest", *MEASURES])

    kept = docs.select(*others, F.md5(text_bytes(text_col)).alias("digest"), text_bytes(text_col).alias("body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, schema + "".join(f", {m} long" for m in MEASURES))


def failures() -> Column:
    """Bits of the filters A to D that a row of ``measures`` fails."""
    tests = (
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("n_capitals") > CAPITAL_PERCENT * F.col("n_points"),
        F.col("n_symbols") > 0,
    )
    bits = [F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)]
    return sum(bits[1:], bits[0])


def failure_counts(docs: DataFrame, labels: DataFrame, part: Column | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(``part``, ``mask``: bits of the filters that fail, ``n``, ``good``, ``toxic``: how many rows) of ``docs``.

    E fails where a smaller id has the same text. All rows of a text fail the same other filters, so a text shrinks to
    its smallest id and to counts before rows of one text meet.
    """
    rows = measures(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce((F.col("lang") if part is None else part).cast("string"), F.lit("")).alias("part"),
            F.col(text_col).alias("text"),
        )
    ).select("doc_id", "part", "digest", failures().alias("fails"))
    judged = labels.groupBy(F.col(id_col).cast("long").alias("label_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    same = ["digest", "part", "fails", "good", "toxic"]
    zero = F.lit(0)
    once = (
        rows.groupBy("doc_id", "digest", "part", "fails")
        .agg(F.count("*").alias("n"))
        .join(judged, F.expr("doc_id = label_id"), "left")
        .select("doc_id", "digest", "part", "fails", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"), "n")
    )
    each = once.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), zero).alias("nameless"),
    )
    each = staged(each, "texts")
    least = each.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    original = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("nameless")
    split = each.join(least, "digest").select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("fails").alias("mask"), original.alias("n")),
            F.struct((F.col("fails") + (1 << 4)).alias("mask"), (F.col("n") - original).alias("n")),
        )).alias("s"),
    )
    return split.groupBy("part", "s.mask").agg(
        F.sum("s.n").alias("n"),
        F.sum(F.col("s.n") * F.col("good")).alias("good"),
        F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"),
    )


def _bits(letters: Column) -> Column:
    each = [F.when(F.instr(letters, x) > 0, 1 << k).otherwise(0) for k, x in enumerate(FILTERS)]
    return sum(each[1:], each[0])


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per part, order of the filters and step: what the filter of that step removes, and what it costs.

    (``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost``, ``shapley``). The texts are read once; all orders come from the counts of failing combinations.

    Missing texts are empty, missing parts the empty string. Rows without an id are never repeats and never make others
    repeats; rows that share an id and a text do not make each other repeats. Several labels of an id count as one that
    is good or toxic if any is; missing labels are neither. Columns of other names are not read. No rows give none.
    """
    counts = failure_counts(docs, labels, part, id_col, text_col)
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = counts.select(
        "*", F.explode(orders).alias("filter_order")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.withColumn("earlier", _bits(F.expr("substring(filter_order, 1, step - 1)"))).withColumn(
        "own", _bits(F.expr("substring(filter_order, step, 1)"))
    )
    fails = F.col("mask").bitwiseAND(F.col("own")) > 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) > 0
    here = fails & ~gone

    def total(when: Column, of: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0)).cast("long")

    # A combination of k failing filters is removed by each of them in 1 of k orders.
    share = F.expr("n * (120 div bit_count(mask))")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(here).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).cast("long").alias("shapley"),
    )
