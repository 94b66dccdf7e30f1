"""Substrings of texts counted in the tasks: characters as code points, substrings of one slice of texts sorted at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.cluster import checkpointed, spread

# Characters of one slice of texts (a longer text is one slice), and counted grams that a task holds before it sends them on.
SLICE_CHARS = 2_000_000
HELD_GRAMS = 4_000_000
# Longest list of grams that every task gets, in rows; the rest of a longer list is joined.
LISTED_GRAMS = 1_000_000


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, without missing texts, of about ``size`` characters each."""
    batch = batch.filter(pc.is_valid(batch.column(text)))
    upto = np.cumsum(pc.utf8_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, row of each, characters of its text from it on)."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return points, row, ends[row] - np.arange(len(points))


def strings(points: np.ndarray) -> pa.Array:
    """Texts of the rows of a code point matrix."""
    body = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    sizes = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets), pa.py_buffer(body))


def texts_per_gram(texts: pa.Array, low: int, high: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(grams, texts that hold each) for every length. A gram is a whole number: the numbers of its characters side by side, or
    the rank of such a number where it would pass 64 bits."""
    points, row, left = characters(texts)
    known, char = np.unique(points, return_inverse=True)
    bits, row_bits = max(1, int(len(known) - 1).bit_length()), int(len(texts)).bit_length()
    code, used = char.astype(np.int64), bits
    ranked: dict[int, tuple[np.ndarray, int]] = {}  # length: numbers that the ranks up to it stand for
    for n in range(1, high + 1):
        if n > 1:
            if used + bits + row_bits > 63:
                ranked[n - 1] = np.unique(code, return_inverse=True)
                numbers, code = ranked[n - 1]
                ranked[n - 1], used = numbers, int(len(numbers)).bit_length()
            code = (code[:-1] << bits) | char[n - 1 :]
            used += bits
        if n < low or not len(code):
            continue
        whole = left[: len(code)] >= n
        pairs = np.sort((code[whole] << row_bits) | row[: len(code)][whole])
        once = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] >> row_bits if len(pairs) else pairs
        heads = np.flatnonzero(np.concatenate(([True], once[1:] != once[:-1]))) if len(once) else np.zeros(0, np.int64)
        if not len(heads):
            continue
        rest, chars = once[heads], np.empty((len(heads), n), dtype=np.uint32)
        for place in range(n - 1, 0, -1):
            chars[:, place] = known[rest & ((1 << bits) - 1)]
            rest = rest >> bits
            if place in ranked:
                rest = ranked[place][rest]
        chars[:, 0] = known[rest]
        yield strings(chars), np.diff(np.append(heads, len(once)))


def gram_documents(texts: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """(term, df): substrings of low..high characters and how many texts hold each; counted per slice, then per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            found = pa.concat_tables(held).group_by("term").aggregate([("df", "sum")])
            return found.select(["term", "df_sum"]).rename_columns(["term", "df"])

        for batch in batches:
            for part in slices(batch, text):
                for terms, df in texts_per_gram(part.column(text), low, high):
                    held.append(pa.table({"term": terms, "df": df.astype(np.int64)}))
                if sum(len(t) for t in held) > HELD_GRAMS:
                    held = [merged()]
                    if len(held[0]) > HELD_GRAMS // 2:
                        yield from held[0].to_batches(max_chunksize=100_000)
                        held = []
        if held:
            yield from merged().to_batches(max_chunksize=100_000)

    counted = spread(texts.select(text)).mapInArrow(count, "term string, df long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


class Listed:
    """A list of different grams as a tree: one sorted array per length of (node of the shorter gram, next character)."""

    def __init__(self, terms: pa.Array, idx: np.ndarray):
        points, row, left = characters(terms)
        sizes = np.bincount(row, minlength=len(terms))
        first = np.cumsum(sizes) - sizes
        node = np.zeros(len(terms), dtype=np.int64)
        self.width = int(idx.max(initial=-1)) + 1
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, int(sizes.max(initial=0)) + 1):
            own = np.flatnonzero(sizes >= n)
            keys, node[own] = np.unique((node[own] << 21) | points[first[own] + n - 1], return_inverse=True)
            ends = np.full(len(keys), -1, dtype=np.int64)
            whole = own[sizes[own] == n]
            ends[node[whole]] = idx[whole]
            self.levels.append((keys, ends))

    def counts(self, texts: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, idx, tf) of the listed grams of low..high characters, rows and then numbers ascending."""
        points, row, left = characters(texts)
        at, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        found = [np.zeros(0, dtype=np.int64)]
        for n, (keys, ends) in enumerate(self.levels[:high], 1):
            own = left[at] >= n
            at, key = at[own], (node[own] << 21) | points[at[own] + n - 1]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[place] == key
            at, node = at[known], place[known]
            if n >= low:
                listed = ends[node] >= 0
                found.append(row[at[listed]] * self.width + ends[node[listed]])
        pairs, tf = np.unique(np.concatenate(found), return_counts=True)
        rows, idx = np.divmod(pairs, max(1, self.width))
        return rows, idx, tf


def listed_grams(terms: DataFrame, rows: int | None = None) -> Listed | None:
    """``terms`` (term, idx) for the tasks; None when they are more than ``rows`` or not all different."""
    rows = LISTED_GRAMS if rows is None else rows
    table = terms.select("term", F.col("idx").cast("long").alias("idx")).limit(rows + 1).toArrow().combine_chunks()
    term = table.column("term").combine_chunks()
    if len(term) > rows or term.null_count or pc.count_distinct(term).as_py() < len(term):
        return None
    return Listed(term, table.column("idx").to_numpy())


def gram_counts(df: DataFrame, key: str, text: str, listed: Listed, low: int, high: int) -> DataFrame:
    """(key, idx, tf): counts of the listed grams. Only the counts of keys that stand in several rows are shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(listed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows, idx, tf = sent.value.counts(part.column(text), low, high)
                columns = [part.column(key).take(pa.array(rows)), pa.array(idx.astype(np.int32)), pa.array(tf.astype(np.int64))]
                out = pa.RecordBatch.from_arrays(columns, names=[key, "idx", "tf"])
                yield from (out.slice(at, 200_000) for at in range(0, out.num_rows, 200_000))

    texts = spread(df.select(key, text))
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, idx int, tf long"
    again = checkpointed(texts.groupBy(F.col(key).alias("__again")).count().filter("count > 1").select("__again"))
    if again.isEmpty():
        return texts.mapInArrow(count, schema)
    same = F.col(key).eqNullSafe(F.col("__again"))
    single = texts.join(again, same, "left_anti").mapInArrow(count, schema)
    several = texts.join(again, same, "left_semi").mapInArrow(count, schema)
    return single.unionByName(several.groupBy(key, "idx").agg(F.sum("tf").alias("tf")))


def gram_vectors(df: DataFrame, text: str, listed: Listed, size: int, low: int, high: int, out: str) -> DataFrame:
    """``df`` and the sparse vector of the counts of the listed grams, numbered 0..size-1; made in the tasks, no shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(listed)
    schema = T.StructType([*df.schema.fields, T.StructField(out, VectorUDT())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            filled = batch.set_column(place, text, pc.fill_null(batch.column(place), ""))
            at = 0
            for part in slices(filled, text):
                rows, idx, tf = sent.value.counts(part.column(text), low, high)
                offsets = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32))
                fields = [
                    pa.array(np.zeros(part.num_rows, np.int8)), pa.array(np.full(part.num_rows, size, np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(idx.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.float64))),
                ]
                made = pa.StructArray.from_arrays(fields, names=["type", "size", "indices", "values"])
                own = batch.slice(at, part.num_rows)
                yield pa.RecordBatch.from_arrays([*own.columns, made], names=[*own.schema.names, out])
                at += part.num_rows

    return df.mapInArrow(vectors, schema)
