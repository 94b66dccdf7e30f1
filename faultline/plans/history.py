"""Change history: candidate commits, introducing functions, one table for all projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import clean
from faultline.operators import history as H


def blame_fixes(
    fixes: DataFrame, deleted: DataFrame, line_history: DataFrame, methods: DataFrame, files: DataFrame, bucket: Column
) -> DataFrame:
    """(id, blaming commit, function before and after) for fixes that have candidates and a function after.

    All projects run in one job; the project is part of every line key.
    """
    candidates = H.blame_candidates(deleted, line_history, bucket)
    found = H.introducing_functions(fixes, candidates, methods, files)
    known = clean.rows_with_keys(found, candidates.hint("merge"), ["fix_id"])
    return known.filter(F.col("blaming_func_after") != "").withColumnRenamed("fix_id", "id")
