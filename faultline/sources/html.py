"""Labelled fields from HTML pages that are already in a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where a vulnerability page shows its score and its vector.
SCORE_SELECTOR = "#Cvss2CalculatorAnchor"
VECTOR_SELECTOR = ".tooltipCvss2NistMetrics"


def element_pattern(selector: str) -> str:
    """Pattern for the text of the first element with an ``#id``, a ``.class`` or a tag name."""
    if selector.startswith("#"):
        opening = rf"""<\w+\b[^>]*\bid=["']{selector[1:]}["'][^>]*>"""
    elif selector.startswith("."):
        opening = rf"""<\w+\b[^>]*\bclass=["'](?:[^"']*\s)?{selector[1:]}(?:\s[^"']*)?["'][^>]*>"""
    else:
        opening = rf"<{selector}\b[^>]*>"
    return rf"(?s){opening}([^<]*)"


def first_text(html: Column, selector: str) -> Column:
    """Text of the first match up to its next tag; NULL when the page has no such element."""
    pattern = element_pattern(selector)
    return F.when(F.rlike(html, F.lit(pattern)), F.regexp_extract(html, pattern, 1))


def extract_html_fields(pages: DataFrame, html: str, fields: Mapping[str, str], keep: list[str]) -> DataFrame:
    return pages.select(*keep, *[first_text(F.col(html), s).alias(name) for name, s in fields.items()])


def extract_metric_fields(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Score and vector texts of vulnerability pages."""
    return extract_html_fields(pages, html, {"score": SCORE_SELECTOR, "vector": VECTOR_SELECTOR}, keep)
