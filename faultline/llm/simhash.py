"""Near-duplicate documents by 64-bit SimHash fingerprints, matched over deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import components, rows_of, staged, text_bytes

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
# Buckets of more different fingerprints are linked by double wildcards instead of by comparing their members.
PAIRED_BUCKET = 512


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the lower-cased words' shingles; shorter texts have one shingle, texts without words give 0."""
    words = text.lower().split()  # of bytes: A-Z only, and the white space of ASCII
    if not words:
        return 0
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-shingle_words]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle_words - 1 :] - 1).tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``fp``: signed long) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, paired_bucket: int = PAIRED_BUCKET) -> DataFrame:
    """Links that connect exactly the fingerprints (``fp``, all different) within two differing bits.

    Of the two 32-bit halves one differs by at most one bit. So each fingerprint is indexed under 64 variants: a half
    with one of its bits left out. Fingerprints that share a variant are compared, each pair in the first variant it
    shares. In a bucket above ``paired_bucket`` members every member gives its 2016 variants without two of the 64 bits
    instead; members of such a variant (four at most) are within two bits of each other, so the work stays in proportion
    to the members and no pair is lost.
    """
    variants = fps.select(
        "fp",
        F.explode(
            F.expr(
                "transform(sequence(0, 63), i -> (cast(i as bigint) << 32) | "
                "(if(i < 32, fp & 4294967295L, shiftrightunsigned(fp, 32)) & ~(1L << (i % 32))))"
            )
        ).alias("key"),
    )
    shared = variants.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    # Sizes are estimated before the explode, 64 times too low: without a hint the variants of all fingerprints are broadcast.
    found = staged(variants.join(shared.hint("merge"), "key"), "variants")
    few = found.filter(F.col("members") <= paired_bucket)
    other = few.select("key", F.col("fp").alias("other"))
    # The first shared variant: of the lower half if that differs by one bit or less, else of the upper half.
    low = "((fp ^ other) & 4294967295L)"
    first = (
        f"shiftrightunsigned(key, 32) = if({low} = 0, 0, if(bit_count({low}) = 1, bit_count({low} - 1), "
        "32 + if(shiftrightunsigned(fp ^ other, 32) = 0, 0, bit_count(shiftrightunsigned(fp ^ other, 32) - 1))))"
    )
    pairs = few.join(other.hint("merge"), "key").filter(f"fp < other AND bit_count(fp ^ other) <= {MAX_BITS} AND {first}")
    many = found.filter(F.col("members") > paired_bucket).select("fp").distinct()
    doubled = many.select(
        "fp",
        F.explode(
            F.expr(
                "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> "
                "struct(cast(i * 64 + j as smallint) as ij, fp & ~((1L << i) | (1L << j)) as rest))))"
            )
        ).alias("key"),
    )
    close = doubled.groupBy("key.ij", "key.rest").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = close.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.select(F.col("fp").alias("a"), F.col("other").alias("b")).unionByName(stars.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``fp``, ``component_id``) per row of ``docs``.

    The component is the smallest id reached over links. Missing and empty texts, and texts of white space, have the
    fingerprint 0 and link like others. Equal texts share a fingerprint and meet as one. Rows without an id take part;
    a component of such rows alone has no id. Repeated rows give repeated rows, no rows give none. Other columns of
    ``docs`` are not looked at.
    """
    rows = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    reached = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    classes = fps.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    classes = staged(classes, "classes")
    smallest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id``, ``text``) without all but the smallest id of each near-duplicate component.

    Of rows with the same id one stays. Rows without an id are kept, as nothing names their representative.
    """
    kept = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
