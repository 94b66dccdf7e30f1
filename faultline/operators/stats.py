"""Two-sample statistics per group: rank tests, effect size and comparison tables.

``side`` holds 'A' or 'B'. Values are reduced to distinct values with counts before anything is ranked, and
ranks come from bucketed running sums, so neither a hot group nor the overall row lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.cluster import checkpointed
from faultline.operators.ranking import md5_bucket, md5_digits, quantile_bucket, row_index, running_sum
from faultline.operators.splits import shuffle_key

ALTERNATIVES = ("two-sided", "less", "greater", "compat")


# Sample sizes up to which p-values are exact (without ties).
EXACT_RANK_SUM = 8
EXACT_SIGNED_RANK = 25


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


@lru_cache(maxsize=None)
def _part_polynomial(parts: int) -> tuple[int, list[int]]:
    """(period, numerator): 1 / ((1-q)(1-q)(1-q^2)..(1-q^parts)) is numerator(q) / (1-q^period)^(parts+1)."""
    period = math.lcm(*range(1, parts + 1))
    numerator = [1]
    for size in (1, *range(1, parts + 1)):  # times 1 + q^size + q^(2 size) + .. up to below the period
        wide = numerator + [0] * (period - size)
        for at in range(size, len(wide)):
            wide[at] += wide[at - size] - (numerator[at - period] if 0 <= at - period < len(numerator) else 0)
        numerator = wide
    return period, numerator


def _sums_up_to(parts: int, limit: int) -> int:
    """How many multisets of 1..parts have a sum of ``limit`` at most; work and memory do not grow with ``limit``."""
    if limit < 0:
        return 0
    period, numerator = _part_polynomial(parts)
    first = limit % period
    return sum(
        numerator[at] * math.comb((limit - at) // period + parts, parts)
        for at in range(first, min(limit, len(numerator) - 1) + 1, period)
    )


def rank_sum_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) without ties, exact, for a smaller sample of few values and a larger one of any size.

    U counts like the partitions with at most ``small`` parts of at most ``large`` each: the bound on the parts is taken
    off by inclusion and exclusion over the factors 1 - q^(large+1) .. 1 - q^(large+small), 2^small terms. By symmetry
    P(U >= u) = P(U <= n1 n2 - u).
    """
    small, large = sorted((n1, n2))
    limit = math.floor(n1 * n2 - u)
    if limit >= n1 * n2:
        return 1.0
    terms = {0: 1}
    for i in range(1, small + 1):
        for total, sign in list(terms.items()):
            if total + large + i <= limit:
                terms[total + large + i] = terms.get(total + large + i, 0) - sign
    upto = sum(sign * _sums_up_to(small, limit - total) for total, sign in terms.items())
    return upto / math.comb(n1 + n2, small)


def signed_rank_two_sided(n: int, w: float) -> float:
    """Two-sided probability of a smaller rank sum at or below ``w`` without ties."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for rank in range(1, n + 1):
        counts[rank:] += counts[:-rank].copy()
    return float(min(1.0, 2.0 * counts[: int(w) + 1].sum() / counts.sum()))


@F.pandas_udf(T.DoubleType())
def _rank_sum_p(n1: pd.Series, n2: pd.Series, u: pd.Series, z: pd.Series, tied: pd.Series) -> pd.Series:
    def p(a, b, stat, score, ties):
        if stat is None or math.isnan(stat) or not a or not b:
            return None
        if not ties and min(a, b) <= EXACT_RANK_SUM:
            return rank_sum_tail(int(a), int(b), stat)
        return None if score is None or math.isnan(score) else normal_tail(score)

    return pd.Series([p(*row) for row in zip(n1, n2, u, z, tied)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _signed_rank_p(n: pd.Series, w: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
    def p(count, stat, score, use_exact):
        if use_exact and count <= EXACT_SIGNED_RANK:
            return signed_rank_two_sided(int(count), stat)
        return None if score is None or math.isnan(score) else 2.0 * normal_tail(abs(score))

    return pd.Series([p(*row) for row in zip(n, w, z, exact)], dtype="float64")


def _mean_rank(first: Column, count: Column) -> Column:
    """Rank shared by ``count`` equal values that follow ``first`` smaller ones."""
    return first + (count + 1) / 2


def side_counts(df: DataFrame, group: Sequence[str], side: str, value: str) -> DataFrame:
    """(group, v, a, b): how often each value occurs on the sides; all the tests but the paired one need."""
    is_a = F.col(side) == "A"
    return df.groupBy(*group, F.col(value).cast("double").alias("v")).agg(
        F.sum(is_a.cast("bigint")).alias("a"), F.sum((~is_a).cast("bigint")).alias("b")
    )


def side_summary(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sizes, sums, means, squares, rank sum and ties per group of staged ``side_counts``, in one pass over them."""
    counts = counts.withColumn("t", F.col("a") + F.col("b"))
    ranked = running_sum(counts, F.col("t"), "upto", [F.col("v")], quantile_bucket(counts, "v"), group)
    rank = _mean_rank(F.col("upto") - F.col("t"), F.col("t"))
    t = F.col("t").cast("double")
    return ranked.groupBy(*group).agg(
        F.sum("a").alias("n1"),
        F.sum("b").alias("n2"),
        F.sum(F.col("a") * rank).alias("r1"),
        F.sum(t * t * t - t).alias("ties"),
        (F.sum(F.col("a") * F.col("v")) / F.sum("a")).alias("mean1"),
        (F.sum(F.col("b") * F.col("v")) / F.sum("b")).alias("mean2"),
        F.sum(F.col("a") * F.col("v") * F.col("v")).alias("squares1"),
        F.sum(F.col("b") * F.col("v") * F.col("v")).alias("squares2"),
    )


def _rank_test(sums: DataFrame, keep: Sequence[str], alternative: str, with_p: bool) -> DataFrame:
    """``keep`` plus u1, z and p of the rank sum test."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u2 = n1 * n2 - u1
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    greater, less, both = u1, u2, F.greatest(u1, u2)
    chosen = {
        "greater": greater,
        "less": less,
        "two-sided": both,
        "compat": F.when(F.col("mean1") < F.col("mean2"), greater).otherwise(less),
    }[alternative]
    z = F.when(sd > 0, (chosen - n1 * n2 / 2 - 0.5) / sd)
    columns = [*keep, u1.alias("u1"), z.alias("z")]
    if not with_p:
        return sums.select(*columns)
    tails = 2.0 if alternative == "two-sided" else 1.0
    sizes = [F.col("n1").alias("__n1"), F.col("n2").alias("__n2")]
    wide = sums.select(*columns, *sizes, chosen.alias("__u"), (F.col("ties") > 0).alias("__tied"))
    p = _rank_sum_p("__n1", "__n2", "__u", "z", "__tied") * tails
    return wide.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))).drop("__n1", "__n2", "__u", "__tied")


def mann_whitney(
    df: DataFrame, group: Sequence[str], side: str, value: str, alternative: str = "two-sided", with_p: bool = True
) -> DataFrame:
    """(group, n1, n2, u1, z, p): rank sum test with tie and continuity correction.

    p is exact for small samples without ties, otherwise from the normal approximation.

    ``compat`` picks 'greater' when the first mean is smaller and 'less' otherwise, against the data.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unknown alternative {alternative!r}")
    counts = checkpointed(side_counts(df, group, side, value))  # distinct values only, read three times
    return _rank_test(side_summary(counts, group), [*group, "n1", "n2"], alternative, with_p)


def paired_sample(df: DataFrame, group: Sequence[str], side: str, key: str, value: str, seed: int = 42) -> DataFrame:
    """(group, a, b): both sides cut to the smaller size in hash order and paired by position."""
    salted = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    order = [shuffle_key(F.col(key), seed), F.col(key)]
    ranked = row_index(df, "__row", order, md5_bucket(salted, md5_digits(df.count())), [*group, side])
    pair = ranked.groupBy(*group, "__row").agg(
        F.max(F.when(F.col(side) == "A", F.col(value))).alias("a"),
        F.max(F.when(F.col(side) == "B", F.col(value))).alias("b"),
    )
    return pair.filter("a IS NOT NULL AND b IS NOT NULL").drop("__row")


def wilcoxon(pairs: DataFrame, group: Sequence[str], a: str = "a", b: str = "b", with_p: bool = True) -> DataFrame:
    """(group, n, w, z, p): two-sided signed-rank test, zero differences dropped.

    p is exact for up to 25 differences without zeros and ties, otherwise from the normal approximation.
    """
    diff = pairs.select(*group, (F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
    counts = diff.groupBy(*group, F.abs("d").alias("v")).agg(
        F.count(F.lit(1)).alias("t"), F.sum((F.col("d") > 0).cast("bigint")).alias("up")
    )
    every = checkpointed(counts)  # distinct differences only, read four times
    zeros = every.filter("v = 0").select(*group, F.lit(1).alias("__zero"))
    counts = every.filter("v > 0")
    ranked = running_sum(counts, F.col("t"), "upto", [F.col("v")], quantile_bucket(counts, "v"), group)
    rank = _mean_rank(F.col("upto") - F.col("t"), F.col("t"))
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*group).agg(
        F.sum("t").alias("n"), F.sum(F.col("up") * rank).alias("plus"), F.sum(t * t * t - t).alias("ties")
    )
    n = F.col("n").cast("double")
    whole = n * (n + 1) / 2
    w = F.least(F.col("plus"), whole - F.col("plus"))
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    columns = [*group, "n", w.alias("w"), F.when(sd > 0, (w - whole / 2) / sd).alias("z")]
    if not with_p:
        return sums.select(*columns)
    marked = sums.select(*columns, "ties").join(zeros, list(group), "left") if group else sums.select(*columns, "ties").withColumn(
        "__zero", zeros.agg(F.max("__zero")).scalar()
    )
    exact = (F.col("ties") == 0) & F.col("__zero").isNull()
    return marked.withColumn("p", _signed_rank_p("n", "w", "z", exact)).drop("ties", "__zero")


def cohen_d(df: DataFrame, group: Sequence[str], side: str, value: str) -> DataFrame:
    """(group, n1, n2, mean1, mean2, d): absolute difference of means over the pooled deviation."""
    a, b = F.when(F.col(side) == "A", F.col(value)), F.when(F.col(side) == "B", F.col(value))
    sums = df.groupBy(*group).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"),
        F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"),
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    d = F.when(pooled > 0, F.abs(F.col("mean1") - F.col("mean2")) / pooled)
    return sums.select(*group, "n1", "n2", "mean1", "mean2", d.alias("d"))


def compare_results(
    df: DataFrame, side: str, scenario: str, key: str, metrics: Sequence[str], alternative: str = "two-sided", with_p: bool = True
) -> DataFrame:
    """Comparison of A and B per metric, for every scenario and for all of them together (``overall``).

    Sizes, means, deviations and ranks come from one table of value counts; ``overall`` is its sum over the scenarios.
    Only the pairing needs rows. The raw values stay in the input table; a hot scenario's values are never gathered into
    one row.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unknown alternative {alternative!r}")
    values = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = df.select(F.col(side).alias("side"), F.col(key).alias("key"), F.col(scenario).alias("scenario"), *metrics)
    long = long.select("side", "key", "scenario", values).filter("value IS NOT NULL")
    group = ["metric", "scenario"]
    counts = checkpointed(side_counts(long, group, "side", "value"))
    overall = counts.groupBy("metric", F.lit("overall").alias("scenario"), "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = checkpointed(side_summary(checkpointed(counts.unionByName(overall)), group))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    spread1 = F.col("squares1") - n1 * F.col("mean1") * F.col("mean1")
    spread2 = F.col("squares2") - n2 * F.col("mean2") * F.col("mean2")
    pooled = F.sqrt(F.greatest(F.lit(0.0), spread1 + spread2) / (n1 + n2 - 2))
    d = F.when((n1 > 1) & (n2 > 1) & (pooled > 0), F.abs(F.col("mean1") - F.col("mean2")) / pooled).alias("d")
    ranks = _rank_test(sums.withColumn("d", d), [*group, "n1", "n2", "mean1", "mean2", "d"], alternative, with_p)
    levels = F.explode(F.array("scenario", F.lit("overall"))).alias("scenario")
    both = long.select("side", "key", "metric", "value", levels)
    signs = wilcoxon(paired_sample(both, group, "side", "key", "value"), group, with_p=with_p)
    ranks = ranks.withColumnsRenamed({"z": "mwu_z", "p": "mwu_p"})
    signs = signs.withColumnsRenamed({"n": "wilcoxon_n", "w": "wilcoxon_w", "z": "wilcoxon_z", "p": "wilcoxon_p"})
    return ranks.join(signs, group, "left")
