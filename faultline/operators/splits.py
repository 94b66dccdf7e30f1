"""Reproducible train/test/valid splits, folds, shuffles and balanced samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.ranking import md5_bucket, md5_digits, row_index

# 20 % is held out and halved into test and valid.
SPLIT_RATIOS = {"train": 0.8, "test": 0.1, "valid": 0.1}


def hash_fraction(key: Column, seed: int = 0, slots: int = 10_000) -> Column:
    """Slot of a key in [0, slots), from the first 32 bits of its salted md5."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(slots))


def shuffle_key(key: Column, seed: int = 0) -> Column:
    """Pseudo-random but reproducible sort key."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def _role(position: Column, total: Column, ratios: dict[str, float]) -> Column:
    names = list(ratios)
    role = F.lit(names[-1])
    upper = sum(ratios[n] for n in names[:-1])
    for name in reversed(names[:-1]):
        role = F.when(position < F.round(total * upper, 0), F.lit(name)).otherwise(role)
        upper -= ratios[name]
    return role


def assign_split(
    df: DataFrame, key: str, ratios: dict[str, float] | None = None, seed: int = 0, exact: bool = False
) -> DataFrame:
    """Add ``partition``. By default a key's hash decides, without a shuffle; ``exact=True`` fixes the sizes."""
    ratios = ratios or SPLIT_RATIOS
    if not exact:
        slots = 10_000
        return df.withColumn("partition", _role(hash_fraction(F.col(key), seed, slots), F.lit(slots), ratios))
    salted = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    total = df.count()
    bucket = md5_bucket(salted, md5_digits(total))
    ranked = row_index(df, "__row", [shuffle_key(F.col(key), seed), F.col(key)], bucket)
    return ranked.withColumn("partition", _role(F.col("__row"), F.lit(total), ratios)).drop("__row")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffle_key(F.col(key), seed), F.col(key))


def fold_bounds(total: Column, folds: int | Sequence[float]) -> list[Column]:
    """Inclusive last row of every fold; the first fold starts at 0 and the remainder goes to the last one."""
    if isinstance(folds, int):
        width = F.floor(total / folds)
        ends = [width * (i + 1) for i in range(folds - 1)]
    else:
        ends, reached = [], F.lit(0)
        for share in list(folds)[:-1]:
            reached = reached + F.floor(total * share)
            ends.append(reached)
    return [*ends, total - 1]


def contiguous_folds(df: DataFrame, key: str, folds: int | Sequence[float], bucket: Column) -> DataFrame:
    """Fold number per key for contiguous runs of keys; ``bucket`` follows the key order."""
    ranked = row_index(df.select(key), "__row", [F.col(key)], bucket)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    bounds = fold_bounds(total, folds)
    fold = F.lit(len(bounds) - 1)
    for number in range(len(bounds) - 2, -1, -1):
        fold = F.when(F.col("__row") <= bounds[number], F.lit(number)).otherwise(fold)
    return ranked.select(key, fold.cast("int").alias("fold"))


def fold_roles(folds: DataFrame, k: int, key: str) -> DataFrame:
    """Role of every key in each of the k rounds: valid is the next fold, test the one after, the rest train."""
    rounds = folds.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    ahead = F.pmod(F.col("fold") - F.col("round"), F.lit(k))
    role = F.when(ahead == 1, F.lit("valid")).when(ahead == 2, F.lit("test")).otherwise(F.lit("train"))
    return rounds.select("round", key, "fold", role.alias("role"))


def equal_size_groups(df: DataFrame, side: str, key: str, seed: int = 42) -> DataFrame:
    """Down-sample every side to the size of the smallest one, in hash order."""
    salted = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    sizes = df.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.min("n").alias("smallest"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    bucket = md5_bucket(salted, md5_digits(row["total"]))
    ranked = row_index(df, "__row", [shuffle_key(F.col(key), seed), F.col(key)], bucket, [side])
    return ranked.filter(F.col("__row") < F.lit(row["smallest"])).drop("__row")
