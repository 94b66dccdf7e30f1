"""Column profiles, class counts and multi-class evaluation.

Everything below ``confusion`` works on counts per (keys, true class, predicted class), a table whose size
depends on the number of classes, not on the number of predictions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1", "gmean", "mcc")


def column_profile(df: DataFrame) -> DataFrame:
    """Row count and non-null count of every column, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in df.columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, column: str, n: int = 1) -> DataFrame:
    """The n most frequent values; smaller values first on ties."""
    return value_counts(df, column).orderBy(F.col("n").desc(), column).limit(n)


def length_summary(df: DataFrame, tokens: str) -> DataFrame:
    size = F.size(tokens)
    return df.agg(
        F.count(F.lit(1)).alias("texts"),
        F.min(size).alias("shortest"),
        F.max(size).alias("longest"),
        F.round(F.avg(size), 6).alias("mean"),
    )


def confusion(df: DataFrame, keys: Sequence[str], true: str, pred: str) -> DataFrame:
    return df.groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, class, support, predicted, hits) over the classes seen in truth or prediction."""
    zero = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(
            F.col("true").alias("class"), F.col("n").alias("support"), zero.alias("predicted"),
            F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(zero).alias("hits"),
        ),
        F.struct(F.col("pred").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")),
    )
    rows = conf.select(*keys, F.inline(roles))
    return rows.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def _class_scores(zero_division: float) -> dict[str, Column]:
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    empty = F.lit(float(zero_division))
    return {
        "precision": F.when(predicted == 0, empty).otherwise(hits / predicted),
        "recall": F.when(support == 0, empty).otherwise(hits / support),
        "f1": 2 * hits / (support + predicted),
    }


def evaluate(
    df: DataFrame,
    keys: Sequence[str],
    true: str = "true",
    pred: str = "pred",
    average: str = "macro",
    zero_division: float = 0.0,
    single_class_is_accuracy: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Accuracy, averaged precision/recall/F1, their geometric mean and the Matthews correlation per key.

    ``average``: macro, weighted, micro, or binary (scores of the largest class). ``digits`` rounds the scores
    before anything else is computed from them, except the geometric mean, which uses the exact ones.
    """
    classes = per_class(confusion(df, keys, true, pred), keys)
    scores = _class_scores(zero_division)
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    total = F.sum(support)
    if average == "macro":
        merged = {n: F.avg(c) for n, c in scores.items()}
    elif average == "weighted":
        merged = {n: F.sum(c * support) / total for n, c in scores.items()}
    elif average == "micro":
        merged = {n: F.sum(hits) / total for n in scores}
    elif average == "binary":
        merged = {n: F.max_by(c, F.col("class")) for n, c in scores.items()}
    else:
        raise ValueError(f"unknown average {average!r}")
    sums = classes.groupBy(*keys).agg(
        (F.sum(hits) / total).alias("accuracy"),
        *[c.alias(n) for n, c in merged.items()],
        F.sum(F.when(support > 0, 1).otherwise(0)).alias("__true_classes"),
        F.sum(hits).cast("double").alias("__c"),
        total.cast("double").alias("__s"),
        F.sum(support.cast("double") * predicted).alias("__tp"),
        F.sum(support.cast("double") * support).alias("__tt"),
        F.sum(predicted.cast("double") * predicted).alias("__pp"),
    )
    if single_class_is_accuracy:
        single = F.col("__true_classes") == 1
        sums = sums.withColumns({n: F.when(single, F.col("accuracy")).otherwise(F.col(n)) for n in scores})
    s2 = F.col("__s") * F.col("__s")
    spread = (s2 - F.col("__pp")) * (s2 - F.col("__tt"))
    mcc = F.when(spread == 0, F.lit(0.0)).otherwise((F.col("__c") * F.col("__s") - F.col("__tp")) / F.sqrt(spread))
    full = sums.withColumn("gmean", F.sqrt(F.col("precision") * F.col("recall"))).withColumn("mcc", mcc)
    rounded = [F.round(m, digits).alias(m) if digits is not None else F.col(m) for m in METRICS]
    return full.select(*keys, *rounded)


def unpivot_targets(df: DataFrame, keep: Sequence[str], targets: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Wide predictions to (keep, target, true, pred): ``targets`` maps a name to its two columns."""
    rows = [
        F.struct(F.lit(t).alias("target"), F.col(y).cast("string").alias("true"), F.col(p).cast("string").alias("pred"))
        for t, (y, p) in targets.items()
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def evaluate_targets(
    df: DataFrame,
    keys: Sequence[str],
    targets: Mapping[str, tuple[str, str]],
    digits: int | None = 3,
    zero_division: float = 0.0,
) -> DataFrame:
    """Metrics of all targets in one job: (keys, target, metrics)."""
    long = unpivot_targets(df, keys, targets)
    return evaluate(long, [*keys, "target"], zero_division=zero_division, digits=digits)


def mean_over_targets(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the per-target metrics; rounded inputs give the mean of rounded values."""
    return results.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])


def task_losses(df: DataFrame, targets: Mapping[str, tuple[str, str]], logits: bool = False) -> DataFrame:
    """(target, loss): mean cross-entropy per task. ``targets`` maps a name to (class index, score array)."""
    rows = [
        F.struct(F.lit(t).alias("target"), F.col(y).cast("int").alias("y"), F.col(p).cast("array<double>").alias("p"))
        for t, (y, p) in targets.items()
    ]
    long = df.select(F.inline(F.array(*rows)))
    chosen = F.get("p", F.col("y"))
    if logits:
        top = F.array_max("p")
        log_sum = top + F.log(F.aggregate(F.transform("p", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
        loss = log_sum - chosen
    else:
        loss = -F.log(chosen)
    return long.groupBy("target").agg(F.avg(loss).alias("loss"))


def total_loss(losses: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Sum of the task losses; weights are divided by the largest one."""
    weight = F.lit(1.0)
    if weights:
        largest = max(weights.values())
        for target, value in weights.items():
            weight = F.when(F.col("target") == target, F.lit(value / largest)).otherwise(weight)
    return losses.agg(F.sum(F.col("loss") * weight).alias("loss"))
