"""Row filters, null handling, column selection and duplicate removal for function tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import code_lines, line_count, unfold_numbered

# Fixed value: functions with more lines than this are left out.
MAX_LINES = 200
FAILED_LABEL = "-1"


def changed_rows(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rows whose code changed; two missing texts count as unchanged."""
    return df.filter(~F.col(before).eqNullSafe(F.col(after)))


def drop_failed_labels(df: DataFrame, column: str, sentinel: str = FAILED_LABEL) -> DataFrame:
    return df.filter(F.col(column) != sentinel)


def with_deleted_lines(df: DataFrame, column: str = "del_lines") -> DataFrame:
    return df.filter(F.col(column) != 0)


def drop_long_functions(df: DataFrame, code: str, max_lines: int = MAX_LINES) -> DataFrame:
    return df.filter(line_count(code) <= max_lines)


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_helper_columns(df: DataFrame, helpers: Sequence[str] = ()) -> DataFrame:
    """Drop columns a CSV index left behind (``Unnamed...``) and the named helper columns."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed") or c in set(helpers)])


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_missing(df: DataFrame, columns: Sequence[str], how: str = "all") -> DataFrame:
    return df.dropna(how=how, subset=list(columns))


def keep_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every listed column has a value."""
    return df.dropna(how="any", subset=list(columns))


def fill_text(df: DataFrame, columns: Sequence[str], value: str = "") -> DataFrame:
    return df.fillna(value, subset=list(columns))


def partition_rows(df: DataFrame, partition: str, column: str = "partition") -> DataFrame:
    """Rows of one split; prunes folders when the table is stored partitioned by the split."""
    return df.filter(F.col(column) == partition)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest keys (top-n per task, then a merge; no full sort)."""
    return df.orderBy(key).limit(n)


def override_column(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` by the value of ``overrides`` for the keys listed there."""
    fresh = overrides.select(key, F.col(column).alias("__fresh"))
    joined = df.join(fresh, key, "left")
    return joined.withColumn(column, F.coalesce(F.col("__fresh"), F.col(column))).drop("__fresh")


def rows_with_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def rows_without_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def text_key(c: Column) -> list[Column]:
    """Shuffle key that stands for a text: its md5 and its length."""
    return [F.md5(c.cast("binary")).alias("__md5"), F.length(c).alias("__len")]


def drop_all_duplicates(df: DataFrame, text: str, key: str) -> DataFrame:
    """Remove every member of a group of equal texts; ``key`` is unique per row.

    Copies collapse to (hash, count) before the shuffle, so a huge group costs one row per task. The
    surviving keys are unique, so the semi join that follows cannot be skewed either.
    """
    groups = df.groupBy(*text_key(F.col(text))).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(key))
    return df.join(groups.filter("n = 1").select(key), key, "left_semi")


def drop_duplicate_edges(edges: DataFrame, keys: Sequence[str] = ("innode", "outnode", "etype")) -> DataFrame:
    """Distinct edges; only the key columns survive, so the result does not depend on row order."""
    return edges.select(*keys).distinct()


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that do not occur in ``right``."""
    return left.subtract(right)


def union_partial(*parts: DataFrame) -> DataFrame:
    """Union by name; columns missing in a part become NULL."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per source line: key, 1-based line number, stripped text."""
    lines = df.select(key, unfold_numbered(code_lines(text), "pos", "raw"))
    stripped = F.regexp_replace("raw", r"^\s+|\s+$", "")
    return lines.select(key, (F.col("pos") + 1).alias("line_no"), stripped.alias("line"))
