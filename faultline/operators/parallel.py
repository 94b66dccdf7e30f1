"""Parallel map of a Python function over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def parallel_map(
    df: DataFrame,
    function: Callable,
    result: T.DataType,
    key: str,
    columns: str | Sequence[str] | None = None,
    ordered: bool = False,
    workers: int | None = None,
) -> DataFrame:
    """(key, result) of a function of one column, a record of several columns, or the whole row.

    Tasks are the workers, Arrow batches the chunks. ``ordered=True`` sorts the result by ``key``.
    """
    schema = T.StructType([df.schema[key], T.StructField("result", result)])
    wanted = [columns] if isinstance(columns, str) else list(columns or df.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            items = frame[columns].tolist() if isinstance(columns, str) else frame[wanted].to_dict("records")
            yield pd.DataFrame({key: frame[key], "result": [function(item) for item in items]})

    source = df.select(*dict.fromkeys([key, *wanted]))
    if workers:
        source = source.repartition(workers)
    mapped = source.mapInPandas(run, schema)
    return mapped.orderBy(key) if ordered else mapped
