import math

import pytest
from pyspark.sql import functions as F

from faultline.operators import metrics as M
from faultline.operators import runs as R
from faultline.operators import selection as S
from faultline.operators import stats as ST
from faultline.operators.ranking import quantile_bucket, row_index, running_max, running_sum

GOLDEN = """
cvss2_A,lgbm,200-100,0.769,0.834,0.86,0.755,0.776,0.735,60.697
cvss2_AC,lgbm,200-100,0.644,0.772,0.843,0.652,0.706,0.55,60.199
cvss2_AU,lgbm,200-100,0.35,0.984,0.992,0.65,0.727,0.543,15.815
cvss2_AV,lgbm,200-100,0.908,0.942,0.866,0.711,0.747,0.857,45.326
cvss2_C,lgbm,200-100,0.749,0.814,0.811,0.798,0.804,0.709,70.544
cvss2_I,lgbm,200-100,0.766,0.819,0.825,0.8,0.809,0.718,73.26
cvss2_severity,lgbm,200-100,0.643,0.783,0.812,0.67,0.712,0.596,68.877
cvss2_A,lgbm,300-100,0.769,0.834,0.86,0.753,0.774,0.735,72.13
cvss2_AC,lgbm,300-100,0.645,0.776,0.847,0.638,0.69,0.558,86.711
cvss2_AU,lgbm,300-100,0.35,0.984,0.992,0.65,0.727,0.543,16.971
cvss2_AV,lgbm,300-100,0.908,0.942,0.866,0.711,0.747,0.857,55.167
cvss2_C,lgbm,300-100,0.753,0.812,0.81,0.795,0.802,0.705,86.779
cvss2_I,lgbm,300-100,0.767,0.814,0.819,0.796,0.805,0.711,78.877
cvss2_severity,lgbm,300-100,0.634,0.785,0.813,0.672,0.714,0.6,79.496
cvss2_A,rf,200-300,0.698,0.801,0.842,0.702,0.717,0.682,1.072
cvss2_AC,rf,200-300,0.544,0.736,0.82,0.588,0.638,0.475,1.066
cvss2_AU,rf,200-300,0.35,0.987,0.993,0.7,0.782,0.628,0.556
cvss2_AV,rf,200-300,0.908,0.933,0.776,0.652,0.664,0.834,0.757
cvss2_C,rf,200-300,0.662,0.749,0.772,0.714,0.731,0.606,1.09
cvss2_I,rf,200-300,0.667,0.776,0.82,0.731,0.747,0.654,1.07
cvss2_severity,rf,200-300,0.602,0.756,0.771,0.582,0.612,0.547,1.05
cvss2_A,rf,500-300,0.691,0.801,0.842,0.705,0.72,0.681,2.222
cvss2_AC,rf,500-300,0.557,0.747,0.827,0.615,0.668,0.499,2.236
cvss2_AU,rf,500-300,0.35,0.987,0.993,0.7,0.782,0.628,1.123
cvss2_AV,rf,500-300,0.901,0.931,0.773,0.65,0.662,0.829,1.616
cvss2_C,rf,500-300,0.655,0.74,0.767,0.706,0.724,0.591,2.357
cvss2_I,rf,500-300,0.663,0.783,0.825,0.74,0.757,0.665,2.243
cvss2_severity,rf,500-300,0.604,0.758,0.776,0.583,0.613,0.553,2.216
"""
COLUMNS = "problem,classifier,parameters,val_mcc,test_acc,test_prec,test_rec,test_f1,test_mcc,train_time".split(",")


@pytest.fixture(scope="module")
def golden(spark):
    rows = [line.split(",") for line in GOLDEN.strip().splitlines()]
    schema = ", ".join(f"{c} {'string' if i < 3 else 'double'}" for i, c in enumerate(COLUMNS))
    return spark.createDataFrame([tuple(r[:3]) + tuple(map(float, r[3:])) for r in rows], schema)


def test_golden_best_settings(golden):
    best = S.best_settings(golden)
    chosen = {(r["classifier"], r["parameters"]) for r in best.collect()}
    assert chosen == {("lgbm", "200-100"), ("rf", "200-300")}
    metrics = ["test_acc", "test_prec", "test_rec", "test_f1", "test_mcc"]
    means = S.average_repeats(best, ["classifier"], metrics).collect()
    got = {r["classifier"]: [round(r[m], 3) for m in metrics] for r in means}
    assert got == {"lgbm": [0.85, 0.858, 0.719, 0.754, 0.673], "rf": [0.82, 0.828, 0.667, 0.699, 0.632]}


def test_golden_best_per_problem(golden):
    lgbm = golden.filter("classifier = 'lgbm'")
    best = {r["problem"]: r["parameters"] for r in S.best_per_group(lgbm, ["problem"], "val_mcc", ["parameters"]).collect()}
    assert best["cvss2_A"] == "200-100" and best["cvss2_C"] == "300-100"


def test_settings():
    assert len(S.settings("rf")) == 15 and len(S.settings("knn")) == 16
    assert S.settings("rf")[:4] == ["100-100", "100-200", "100-300", "200-100"]


def test_perfect_and_single_class(spark):
    df = spark.createDataFrame([("k", "a", "a"), ("k", "b", "b"), ("s", "a", "a"), ("s", "a", "a")], "k string, true string, pred string")
    rows = {r["k"]: r for r in M.evaluate(df, ["k"]).collect()}
    assert rows["k"]["mcc"] == 1.0 and rows["k"]["f1"] == 1.0
    assert rows["s"]["mcc"] == 0.0


def test_known_mcc(spark):
    pairs = [(1, 1)] * 6 + [(0, 0)] * 3 + [(0, 1)] * 1 + [(1, 0)] * 2
    df = spark.createDataFrame(pairs, "true int, pred int")
    row = M.evaluate(df, []).first()
    assert math.isclose(row["mcc"], (6 * 3 - 1 * 2) / math.sqrt(7 * 8 * 4 * 5))
    binary = M.evaluate(df, [], average="binary").first()
    assert math.isclose(binary["precision"], 6 / 7) and math.isclose(binary["recall"], 6 / 8)


def test_losses(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0])], "y int, p array<double>")
    losses = M.task_losses(df, {"t": ("y", "p")}, logits=True)
    assert math.isclose(M.total_loss(losses).first()["loss"], math.log(2))


def sides(spark, a, b):
    rows = [("A", i, float(v)) for i, v in enumerate(a)] + [("B", i, float(v)) for i, v in enumerate(b)]
    return spark.createDataFrame(rows, "side string, key int, v double")


def test_rank_sum(spark):
    df = sides(spark, [19, 22, 16, 29, 24], [20, 11, 17, 12])
    row = ST.mann_whitney(df, [], "side", "v").first()
    assert row["u1"] == 17.0 and math.isclose(row["p"], 0.1111111111111111)  # published example
    assert math.isclose(2 * ST.normal_tail(row["z"]), 0.11134688653314041)
    assert ST.mann_whitney(df, [], "side", "v", "compat").first()["p"] > 0.9
    assert ST.mann_whitney(df, [], "side", "v", "greater").first()["p"] < 0.06


def test_signed_rank(spark):
    d = [6, 8, 14, 16, 23, 24, 28, 29, 41, -48, 49, 56, 60, -67, 75]
    pairs = spark.createDataFrame([(float(x), 0.0) for x in d], "a double, b double")
    row = ST.wilcoxon(pairs, []).first()
    assert row["w"] == 24.0 and math.isclose(row["p"], 0.041259765625)  # published example
    with_zero = pairs.unionByName(spark.createDataFrame([(1.0, 1.0)], "a double, b double"))
    assert math.isclose(ST.wilcoxon(with_zero, []).first()["p"], 2 * ST.normal_tail(36 / math.sqrt(15 * 16 * 31 / 24)))


def test_effect_size_and_sampling(spark):
    df = sides(spark, [1, 2, 3, 4], [2, 4])
    row = ST.cohen_d(df, [], "side", "v").first()
    assert math.isclose(row["d"], 0.5 / math.sqrt((3 * 5 / 3 + 1 * 2) / 4))
    assert ST.paired_sample(df, [], "side", "key", "v").count() == 2


def test_compare_has_overall(spark):
    rows = [(s, sc, i, 0.1 * i + (s == "A")) for s in "AB" for sc in ("x", "y") for i in range(12)]
    df = spark.createDataFrame(rows, "side string, scenario string, key int, mcc double")
    out = {r["scenario"]: r for r in ST.compare_results(df, "side", "scenario", "key", ["mcc"]).collect()}
    assert set(out) == {"x", "y", "overall"} and out["overall"]["n1"] == 24
    assert out["x"]["mwu_p"] < 0.05


def epochs(spark, scores):
    return spark.createDataFrame([("r", i, s) for i, s in enumerate(scores)], "run string, epoch int, score double")


def test_early_stop(spark):
    marked = R.mark_improvements(epochs(spark, [0.5, 0.6, 0.6, 0.55, 0.7]), "run", "epoch", "score")
    row = R.stop_points(marked, "run", "epoch", patience=2).first()
    assert (row["best_epoch"], row["stop_epoch"], row["stopped"]) == (1, 3, True)
    rates = [round(r["rate"], 4) for r in R.learning_rates(marked, "run", "epoch", 1.0).orderBy("epoch").collect()]
    assert rates == [1.0, 1.0, 1.0, 0.9, 0.9]


def test_early_stop_with_delta(spark):
    scores = [0.5, 0.55, 0.58, 0.61, 0.62, 0.75, 0.7]
    marked = R.mark_improvements(epochs(spark, scores), "run", "epoch", "score", delta=0.1).orderBy("epoch").collect()
    best, expected, counter = None, [], 0
    for s in scores:
        better = best is None or s > best + 0.1
        best, counter = (s, 0) if better else (best, counter + 1)
        expected.append((better, counter))
    assert [(r["improved"], r["counter"]) for r in marked] == expected


def test_falling_loss(spark):
    marked = R.mark_improvements(epochs(spark, [3.0, 2.0, 2.5, 2.4, 2.3, 1.0]), "run", "epoch", "score", smaller_is_better=True)
    rates = R.learning_rates(marked, "run", "epoch", 1.0, R.DROP, R.DROP_AFTER, exactly=True).orderBy("epoch")
    assert [round(r["rate"], 3) for r in rates.collect()] == [1.0, 1.0, 1.0, 1.0, 0.2, 0.2]


LOG = "".join(
    f"Current partition: {p}\n"
    + "".join(
        f"Run # {r}\n"
        + "".join(
            f"Epoch {e}/3\n1/1 - {10 * e + r}s - loss: 0.{e}\nValidation time: {e}.5 s.\n"
            + (f"Saving best model at epoch {e}\n" if e < 3 else "")
            for e in range(1, 4)
        )
        + "Evaluating the best model\nx\nEvaluating the best model\nValidation time: 9.25 s.\n"
        for r in range(2)
    )
    for p in range(2)
)


def test_logs(spark):
    logs = spark.createDataFrame([("a.out", LOG), ("b.out", LOG.replace("Epoch 2/3", "Epoch 5/3", 1))], "path string, text string")
    runs = R.log_runs(logs)
    parsed = R.log_epochs(runs)
    row = R.log_times(runs, parsed).filter("path = 'a.out' AND partition = 1 AND run = 1").first()
    assert row["number_of_epoch_at_best_model"] == 2 and row["number_of_epoch_at_finish"] == 3
    assert row["total_train_time_at_best_model"] == 32 and row["total_time_at_finish"] == 63 + 7.5
    assert row["final_evaluation_time"] == 9.25
    problems = R.log_violations(runs, parsed, partitions=2, runs_each=2).collect()
    assert [(r["path"], r["problem"]) for r in problems] == [("b.out", "epoch numbers")]
    assert R.log_violations(runs, parsed).filter("path = 'a.out'").count() == 1 + 2


def test_wide_to_long(spark):
    df = spark.createDataFrame([(1, "val", 0, 0.8, 0.5, 0.7, 0.1)], "run int, set string, fold int, accuracy double, mcc double, cvss2_conf_acc double, pred_time double")
    rows = {r["scenario"]: r for r in R.wide_to_long(df, ["run", "set", "fold"]).collect()}
    assert rows["multitask"]["acc"] == 0.8 and rows["multitask"]["mcc"] == 0.5
    assert rows["cvss2_conf"]["acc"] == 0.7 and rows["cvss2_conf"]["mcc"] is None


def test_running_values_equal_plain_ones(spark):
    rows = [(g, i, (i * 37) % 101) for g in ("hot", "b") for i in range(500 if g == "hot" else 7)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    bucket = quantile_bucket(df, "i", 8)
    got = running_sum(df, F.col("v"), "s", [F.col("i")], bucket, ["g"])
    got = running_max(got, F.col("v"), "m", [F.col("i")], bucket, ["g"], before=True)
    got = {(r["g"], r["i"]): (r["s"], r["m"]) for r in row_index(got, "n", [F.col("i")], bucket, ["g"]).collect()}
    total, best = {}, {}
    for g, i, v in rows:
        total[g] = total.get(g, 0) + v
        assert got[(g, i)] == (total[g], best.get(g))
        best[g] = max(best.get(g, -1), v)
