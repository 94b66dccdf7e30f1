"""Secrets in documents: pattern spans, and how many owners share each candidate. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import staged

# The base patterns and their least lengths.
KEYWORD = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = KEYWORD + "([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE = 8
# Runs are taken whole, so a least length in the pattern finds what dropping shorter matches would leave.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "owned")
# Candidates of the method: unbroken runs with upper-case and lower-case letters and digits.
RUN = "[A-Za-z0-9+/_-]{20,}"
# A value seen under this many owners or more is a copied example.
EXAMPLE_OWNERS = 3


def pieces(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Leftmost matches that do not overlap: array of (``gap``: code points before it, ``size``, ``found``, ``value``).

    The text between the matches is cut by the same pattern. A text without a match is read once.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(found))
    zipped = F.arrays_zip(
        gaps.alias("gap"), F.transform(found, F.length).alias("size"), value.alias("value")
    )
    none = F.expr("cast(array() as array<struct<gap:int,size:int,value:string>>)")
    return F.when(text.rlike(pattern), zipped).otherwise(none)


def candidate_spans(rows: DataFrame) -> DataFrame:
    """(``key``, ``repo``, ``owner``, ``kind``: index in KINDS, ``first``, ``end``, ``value``) of rows with ``body``.

    Positions are running sums over the matches of one document and kind.
    """
    body = F.col("body")
    cut = (
        ("assign", pieces(body, ASSIGN, 2)),
        ("access", pieces(body, ACCESS)),
        ("hex", pieces(body, HEX)),
        ("owned", pieces(body, RUN)),
    )
    kinds = staged(rows.select("key", "repo", "owner", *(c.alias(k) for k, c in cut)).filter(
        " OR ".join(f"size({k}) > 0" for k, _ in cut)
    ), "matches")
    kinds = kinds.dropDuplicates(["key"])
    rest = ["key", "repo", "owner"]
    each = None
    for number, (kind, _) in enumerate(cut):
        one = kinds.select(*rest, F.lit(number).alias("kind"), F.posexplode(kind).alias("nth", "m"))
        each = one if each is None else each.unionByName(one)
    so_far = Window.partitionBy("key", "kind").orderBy("nth")
    placed = each.withColumn("end", F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(so_far))
    spans = placed.select(
        *rest, "kind", (F.col("end") - F.col("m.size")).alias("first"), "end", F.col("m.value").alias("value")
    )
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    long_enough = F.when(F.col("kind") == 0, F.length("value") >= ASSIGN_VALUE).when(F.col("kind") == 3, mixed)
    return spans.filter(F.coalesce(long_enough, F.lit(True))).withColumn("value", F.md5("value"))


def ownership(spans: DataFrame) -> DataFrame:
    """(``value``, ``n_owners``, ``n_repos``) over the whole corpus; repeats in a repository shrink before the shuffle."""
    once = spans.select("value", "owner", "repo").distinct()
    by_owner = once.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.count("owner").alias("n_owners"), F.sum("repos").alias("n_repos"))


def joined(array: Column) -> Column:
    """kind:start:end of (first, kind, end) structs, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(array, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["first"], s["end"])), ","
    )


def find_secrets(
    docs: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_live``, ``n_example``) per row.

    A candidate value is ``example`` if at least EXAMPLE_OWNERS owners hold it anywhere in the corpus, else ``live``.
    Runs of upper-case and lower-case letters and digits that no base span touches are added as ``owned`` if live. Base
    spans are kept whatever their frequency. Missing and empty texts have no spans; a missing owner counts as one owner.
    Repeated rows give repeated rows and count once. No rows give none.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
    ).withColumn("key", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "repo", "owner", "body")))
    spans = staged(candidate_spans(rows), "spans")
    judged = spans.join(ownership(spans), "value").withColumn("live", F.col("n_owners") < EXAMPLE_OWNERS)
    in_order = Window.partitionBy("key").orderBy("first")
    base = F.col("kind") < 3
    behind = F.max(F.when(base, F.col("end"))).over(in_order.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(base, F.col("first"))).over(in_order.rangeBetween(0, Window.unboundedFollowing))
    touched = (F.coalesce(behind, F.lit(-1)) > F.col("first")) | (F.coalesce(ahead, F.col("end")) < F.col("end"))
    kept = judged.withColumn("touched", touched).filter(base | (F.col("live") & ~F.col("touched")))
    span = F.struct("first", "kind", "end")
    per_doc = kept.groupBy("key").agg(
        *(F.count_if(F.col("kind") == n).alias(f"n_{k}") for n, k in enumerate(KINDS[:3])),
        F.sha2(joined(F.array_sort(F.collect_list(F.when(base, span)))), 256).alias("base_sha256"),
        joined(F.array_sort(F.collect_list(span))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    zero = F.lit(0).cast("long")
    counts = ("n_assign", "n_access", "n_hex")
    return rows.select("doc_id", "key").join(per_doc, "key", "left").select(
        "doc_id",
        *(F.coalesce(c, zero).alias(c) for c in counts),
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *(F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example")),
    )
