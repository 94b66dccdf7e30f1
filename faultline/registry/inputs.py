"""Inputs both engines derive from the given tables in the same way."""

from pyspark.sql import functions as F

from faultline.functions.text import code_lines, let
from faultline.registry.catalog import sql_lines, table


def listed(lines):
    """1-based numbers of the lines whose md5 starts with 0..3; stands in for the changed lines."""
    hit = lambda l: F.substring(F.md5(l.cast("binary")), 1, 1) < "4"
    numbers = F.transform(lines, lambda l, i: F.when(hit(l), i + 1))
    return F.filter(numbers, lambda n: n.isNotNull())


def documents_with_lines(spark, d):
    """doc_id, code, listed line numbers."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.col("text").alias("code"), let(code_lines("text"), listed).alias("nums"))


DOC_LINES_SQL = f"""docs AS (
  SELECT doc_id, text AS code, ls, len(ls)::int AS n,
    list_filter(list_transform(range(1, len(ls) + 1), lambda i: i::int),
      lambda i: substr(md5(list_extract(ls, i)), 1, 1) < '4') AS nums
  FROM (SELECT doc_id, text, {sql_lines('text')} AS ls FROM documents))"""
