"""Queries over evaluation, statistics, epochs and logs."""

from pyspark.sql import functions as F

from faultline.cluster import checkpointed, spread, stage_path
from faultline.operators import metrics as M
from faultline.operators import runs as R
from faultline.operators import selection as S
from faultline.operators import stats as ST
from faultline.operators.ranking import quantile_bucket, row_index
from faultline.registry.catalog import query, table
from faultline.sources.files import write_files
from faultline.sources.tables import read_results

# --- evaluation: true class = order status or priority, predicted class from the key -------------------

_PRED_SQL = """preds AS (SELECT o_orderpriority AS scope, o_orderstatus AS t,
    CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS p FROM orders),
  conf AS (SELECT scope, t, p, count(*) AS n FROM preds GROUP BY ALL),
  classes AS (SELECT scope, t AS c FROM conf UNION SELECT scope, p FROM conf),
  per AS (SELECT c.scope, c.c, coalesce(sum(n) FILTER (t = c.c), 0)::double AS support,
      coalesce(sum(n) FILTER (p = c.c), 0)::double AS predicted, coalesce(sum(n) FILTER (t = c.c AND p = c.c), 0)::double AS hits
    FROM classes c JOIN conf f ON c.scope = f.scope GROUP BY ALL),
  scored AS (SELECT *, CASE WHEN predicted = 0 THEN {zd} ELSE hits / predicted END AS pr,
      CASE WHEN support = 0 THEN {zd} ELSE hits / support END AS re, 2 * hits / (support + predicted) AS f FROM per)"""
_MCC_SQL = """CASE WHEN (sum(support)^2 - sum(predicted^2)) * (sum(support)^2 - sum(support^2)) = 0 THEN 0 ELSE
  (sum(hits) * sum(support) - sum(support * predicted)) /
  sqrt((sum(support)^2 - sum(predicted^2)) * (sum(support)^2 - sum(support^2))) END"""


def _predictions(spark, d):
    key = F.col("o_orderkey")
    pred = F.when(key % 3 == 0, F.lit("F")).when(key % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("scope"), F.col("o_orderstatus").alias("true"), pred.alias("pred")
    )


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("confusion_counts", f"WITH {_PRED_SQL.format(zd=0)} SELECT scope, t AS true, p AS pred, n FROM conf")
def confusion_counts(spark, d):
    return M.confusion(_predictions(spark, d), ["scope"], "true", "pred")


def _evaluation_sql(p, r, f, zd=0):
    return f"""WITH {_PRED_SQL.format(zd=zd)}, e AS (SELECT scope, sum(hits) / sum(support) AS accuracy, {p} AS precision,
      {r} AS recall, {f} AS f1, {_MCC_SQL} AS mcc FROM scored GROUP BY scope)
    SELECT scope, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, round(sqrt(precision * recall), 6) AS gmean, round(mcc, 6) AS mcc FROM e"""


@query("macro_scores", _evaluation_sql("avg(pr)", "avg(re)", "avg(f)"))
def macro_scores(spark, d):
    return M.evaluate(_predictions(spark, d), ["scope"], digits=6)


@query("macro_scores_one_for_empty", _evaluation_sql("avg(pr)", "avg(re)", "avg(f)", zd=1))
def macro_scores_one_for_empty(spark, d):
    return M.evaluate(_predictions(spark, d), ["scope"], zero_division=1.0, digits=6)


@query(
    "weighted_scores",
    _evaluation_sql(*[f"sum({x} * support) / sum(support)" for x in ("pr", "re", "f")]),
)
def weighted_scores(spark, d):
    return M.evaluate(_predictions(spark, d), ["scope"], average="weighted", digits=6)


@query("micro_scores", _evaluation_sql(*["sum(hits) / sum(support)"] * 3))
def micro_scores(spark, d):
    return M.evaluate(_predictions(spark, d), ["scope"], average="micro", digits=6)


@query("binary_scores", _evaluation_sql(*[f"arg_max({x}, c)" for x in ("pr", "re", "f")]))
def binary_scores(spark, d):
    return M.evaluate(_predictions(spark, d), ["scope"], average="binary", digits=6)


@query(
    "single_class_scores",
    """SELECT o_orderstatus AS scope, round(avg((o_orderkey % 4 <> 0)::int), 6) AS accuracy,
      round(avg((o_orderkey % 4 <> 0)::int), 6) AS precision, round(avg((o_orderkey % 4 <> 0)::int), 6) AS recall,
      round(avg((o_orderkey % 4 <> 0)::int), 6) AS f1, round(avg((o_orderkey % 4 <> 0)::int), 6) AS gmean,
      0.0::double AS mcc FROM orders GROUP BY o_orderstatus""",
)
def single_class_scores(spark, d):
    pred = F.when(F.col("o_orderkey") % 4 == 0, F.lit("?")).otherwise(F.col("o_orderstatus"))
    rows = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("scope"), F.col("o_orderstatus").alias("true"), pred.alias("pred")
    )
    return M.evaluate(rows, ["scope"], single_class_is_accuracy=True, digits=6)


_TARGETS = {"status": ("t0", "p0"), "priority": ("t1", "p1")}
_TARGET_SQL = """long AS (SELECT 'status' AS target, o_orderstatus AS t,
      CASE WHEN o_orderkey % 5 = 0 THEN 'O' ELSE o_orderstatus END AS p, o_orderkey % 2 AS half FROM orders
    UNION ALL SELECT 'priority', o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN '5-LOW' ELSE o_orderpriority END,
      o_orderkey % 2 FROM orders),
  conf AS (SELECT half, target, t, p, count(*) AS n FROM long GROUP BY ALL),
  classes AS (SELECT half, target, t AS c FROM conf UNION SELECT half, target, p FROM conf),
  per AS (SELECT c.half, c.target, c.c, coalesce(sum(n) FILTER (t = c.c), 0)::double AS support,
      coalesce(sum(n) FILTER (p = c.c), 0)::double AS predicted, coalesce(sum(n) FILTER (t = c.c AND p = c.c), 0)::double AS hits
    FROM classes c JOIN conf f ON c.half = f.half AND c.target = f.target GROUP BY ALL),
  e AS (SELECT half, target, sum(hits) / sum(support) AS accuracy,
      avg(CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END) AS precision,
      avg(CASE WHEN support = 0 THEN 0 ELSE hits / support END) AS recall, avg(2 * hits / (support + predicted)) AS f1,
      """ + _MCC_SQL + """ AS mcc FROM per GROUP BY half, target),
  rounded AS (SELECT half, target, round(accuracy, 3) AS accuracy, round(precision, 3) AS precision,
      round(recall, 3) AS recall, round(f1, 3) AS f1, round(sqrt(precision * recall), 3) AS gmean, round(mcc, 3) AS mcc FROM e)"""


def _targets(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        (key % 2).alias("half"),
        F.col("o_orderstatus").alias("t0"),
        F.when(key % 5 == 0, F.lit("O")).otherwise(F.col("o_orderstatus")).alias("p0"),
        F.col("o_orderpriority").alias("t1"),
        F.when(key % 3 == 0, F.lit("5-LOW")).otherwise(F.col("o_orderpriority")).alias("p1"),
    )


@query("target_scores", f"WITH {_TARGET_SQL} SELECT * FROM rounded")
def target_scores(spark, d):
    return M.evaluate_targets(_targets(spark, d), ["half"], _TARGETS)


@query(
    "mean_target_scores",
    f"""WITH {_TARGET_SQL} SELECT half, {', '.join(f'round(avg({m}), 6) AS {m}' for m in M.METRICS)} FROM rounded
    GROUP BY half""",
)
def mean_target_scores(spark, d):
    results = M.evaluate_targets(_targets(spark, d), ["half"], _TARGETS)
    return _rounded(M.mean_over_targets(results, ["half"]), M.METRICS)


@query(
    "weighted_task_loss",
    """WITH scores AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::double)) AS e FROM embeddings),
      l AS (SELECT avg(-ln(e[vec_id % len(e) + 1] / list_sum(e))) AS first,
        avg(-ln(e[vec_id // 2 % len(e) + 1] / list_sum(e))) AS second FROM scores)
    SELECT round(first + 0.5 * second, 6) AS loss FROM l""",
)
def weighted_task_loss(spark, d):
    rows = table(spark, d, "embeddings").select(
        (F.col("vec_id") % F.size("embedding")).alias("y0"),
        (F.floor(F.col("vec_id") / 2) % F.size("embedding")).alias("y1"),
        F.col("embedding").cast("array<double>").alias("logits"),
    )
    losses = M.task_losses(rows, {"first": ("y0", "logits"), "second": ("y1", "logits")}, logits=True)
    return M.total_loss(losses, {"first": 2.0, "second": 1.0}).select(F.round("loss", 6).alias("loss"))


@query(
    "task_losses",
    """SELECT 'quality' AS target, round(avg(-ln(CASE WHEN quality = 1 THEN 0.8 ELSE 0.2 END)), 6) AS loss FROM labels
    UNION ALL SELECT 'toxic', round(avg(-ln(CASE WHEN toxic = 1 THEN 0.25 ELSE 0.75 END)), 6) FROM labels""",
)
def task_losses(spark, d):
    quality, toxic = F.array(F.lit(0.2), F.lit(0.8)), F.array(F.lit(0.75), F.lit(0.25))
    rows = table(spark, d, "labels").withColumns({"pq": quality, "pt": toxic})
    losses = M.task_losses(rows, {"quality": ("quality", "pq"), "toxic": ("toxic", "pt")})
    return losses.select("target", F.round("loss", 6).alias("loss"))


@query(
    "most_common_values",
    "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3",
)
def most_common_values(spark, d):
    return M.most_common(table(spark, d, "events"), "event_type", 3)


@query(
    "length_summary",
    """SELECT count(*) AS texts, min(n)::int AS shortest, max(n)::int AS longest, round(avg(n), 6) AS mean FROM (
      SELECT len(regexp_extract_all(text, '[a-zA-Z0-9]+')) AS n FROM documents)""",
)
def length_summary(spark, d):
    words = F.regexp_extract_all(F.col("text"), F.lit("[a-zA-Z0-9]+"), F.lit(0))
    return M.length_summary(table(spark, d, "documents").select(words.alias("words")), "words")


# --- selection: flag = problem, line status = classifier, line number = setting ------------------------

_RESULT_SQL = """results AS (SELECT l_returnflag AS problem, l_linestatus AS classifier,
    (l_linenumber * 100)::varchar || '-100' AS parameters, avg(l_discount) AS val_mcc, avg(l_tax) AS test_mcc
  FROM lineitem GROUP BY ALL)"""


def _results(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("problem"),
        F.col("l_linestatus").alias("classifier"),
        F.concat((F.col("l_linenumber") * 100).cast("string"), F.lit("-100")).alias("parameters"),
        F.col("l_discount").alias("val_mcc"),
        F.col("l_tax").alias("test_mcc"),
    )
    return S.average_repeats(rows, ["problem", "classifier", "parameters"], ["val_mcc", "test_mcc"])


@query(
    "averaged_repeats",
    f"""WITH {_RESULT_SQL} SELECT problem, classifier, parameters, round(val_mcc, 9) AS val_mcc,
      round(test_mcc, 9) AS test_mcc FROM results""",
)
def averaged_repeats(spark, d):
    return _rounded(_results(spark, d), ["val_mcc", "test_mcc"], 9)


@query(
    "best_per_problem",
    f"""WITH {_RESULT_SQL} SELECT problem, classifier, parameters, round(val_mcc, 6) AS val_mcc,
      round(test_mcc, 6) AS test_mcc FROM (SELECT *, row_number() OVER (PARTITION BY problem
        ORDER BY round(val_mcc, 9) DESC, classifier, parameters) AS r FROM results) WHERE r = 1""",
)
def best_per_problem(spark, d):
    results = _rounded(_results(spark, d), ["val_mcc"], 9)
    best = S.best_per_group(results, ["problem"], "val_mcc", ["classifier", "parameters"])
    return _rounded(best, ["val_mcc", "test_mcc"])


@query(
    "best_settings",
    f"""WITH {_RESULT_SQL}, means AS (SELECT classifier, parameters, round(avg(round(val_mcc, 9)), 9) AS m FROM results
      GROUP BY ALL),
      best AS (SELECT classifier, parameters FROM (SELECT *, row_number() OVER (PARTITION BY classifier ORDER BY m DESC,
        string_split(parameters, '-')[1]::int) AS r FROM means WHERE m > 0) WHERE r = 1)
    SELECT problem, classifier, parameters, round(val_mcc, 6) AS val_mcc, round(test_mcc, 6) AS test_mcc
    FROM results JOIN best USING (classifier, parameters)""",
)
def best_settings(spark, d):
    results = _rounded(_results(spark, d), ["val_mcc"], 9)
    return _rounded(S.best_settings(results), ["val_mcc", "test_mcc"])


@query(
    "run_table",
    """SELECT o_orderpriority AS problem, 'rf' AS classifier, (e * 100) || '-' || (l * 100) AS parameters
      FROM (SELECT DISTINCT o_orderpriority FROM orders), range(1, 6) a(e), range(1, 4) b(l)
    UNION ALL SELECT o_orderpriority, 'knn', k || '-' || w || '-' || p FROM (SELECT DISTINCT o_orderpriority FROM orders),
      (SELECT unnest(['5', '11', '31', '51']) AS k), (SELECT unnest(['uniform', 'distance']) AS w), range(1, 3) c(p)
    UNION ALL SELECT o_orderpriority, name, (e * 100) || '-' || (l * 100) FROM (SELECT DISTINCT o_orderpriority FROM orders),
      (SELECT unnest(['xgb', 'lgbm']) AS name), range(1, 6) a(e), range(1, 4) b(l)
    UNION ALL SELECT o_orderpriority, name, c FROM (SELECT DISTINCT o_orderpriority FROM orders),
      (SELECT unnest(['lr', 'svm']) AS name), (SELECT unnest(['0.01', '0.1', '1', '10', '100']) AS c)""",
)
def run_table(spark, d):
    problems = table(spark, d, "orders").select(F.col("o_orderpriority").alias("problem")).distinct()
    return S.run_table(problems, list(S.GRIDS))


# --- two-sample statistics: line status = side, return flag = scenario ---------------------------------

_SAMPLE_SQL = """sample AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS side, scenario,
    l_orderkey * 10000000000000 + l_partkey * 100000000 + l_suppkey * 1000 + l_linenumber * 100 + l_quantity::bigint AS key, metric, v FROM (
      SELECT *, unnest(['discount', 'quantity']) AS metric, unnest([l_discount, l_quantity]) AS v,
      FROM lineitem), (SELECT unnest(['one', 'overall']) AS level),
    LATERAL (SELECT CASE WHEN level = 'one' THEN l_returnflag ELSE 'overall' END AS scenario))"""


def _sample(spark, d):
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", F.lit("A")).otherwise(F.lit("B")).alias("side"),
        F.col("l_returnflag").alias("scenario"),
        # Wider than 64 bits, which order keys of a larger table leave; the digits are the same.
        F.expr(
            "cast(l_orderkey AS decimal(19, 0)) * 10000000000000BD + cast(l_partkey AS decimal(19, 0)) * 100000000BD "
            "+ l_suppkey * 1000 + l_linenumber * 100 + cast(l_quantity AS bigint)"
        ).alias("key"),
        F.col("l_discount").alias("discount"),
        F.col("l_quantity").alias("quantity"),
    )


_RANK_SQL = """ranked AS (SELECT metric, scenario, side, rank() OVER w + (count(*) OVER (PARTITION BY metric, scenario, v) - 1)
      / 2.0::double AS r, count(*) OVER (PARTITION BY metric, scenario, v)::double AS t FROM sample
      WINDOW w AS (PARTITION BY metric, scenario ORDER BY v)),
  sums AS (SELECT metric, scenario, (count(*) FILTER (side = 'A'))::double AS n1, (count(*) FILTER (side = 'B'))::double AS n2,
      sum(r) FILTER (side = 'A') AS r1, sum(t * t - 1) AS ties FROM ranked GROUP BY ALL),
  mwu AS (SELECT metric, scenario, r1 - n1 * (n1 + 1) / 2 AS u1, n1 * n2 AS nn,
      sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM sums)"""


def _two_sided_sql(z):
    """Two-sided tail of the normal distribution, from the series of the error function; above 12 it is zero."""
    x = f"greatest(least(abs({z}) / sqrt(2), 12), 1e-9)"
    return f"1 - list_sum(list_transform(range(300), lambda i: exp((2 * i + 1) * ln({x}) - lgamma(i + 1.5::double) - {x} * {x})))"


@query(
    "rank_sum_test",
    f"""WITH {_SAMPLE_SQL}, {_RANK_SQL}, tested AS (SELECT scenario, u1, (greatest(u1, nn - u1) - nn / 2 - 0.5) / sd AS z
      FROM mwu WHERE metric = 'quantity' AND scenario <> 'overall')
    SELECT scenario, round(u1, 3) AS u1, round(z, 6) AS z, abs(round({_two_sided_sql('z')}, 6)) AS p FROM tested""",
)
def rank_sum_test(spark, d):
    result = ST.mann_whitney(_sample(spark, d), ["scenario"], "side", "quantity")
    return _rounded(result, ["z", "p"]).select("scenario", F.round("u1", 3).alias("u1"), "z", "p")


_PAIR_SQL = """numbered AS (SELECT metric, scenario, side, v, row_number() OVER (PARTITION BY metric, scenario, side
      ORDER BY md5(key::varchar || ':42'), key) AS i FROM sample),
  diffs AS (SELECT a.metric, a.scenario, a.v - b.v AS d FROM numbered a JOIN numbered b
      ON a.metric = b.metric AND a.scenario = b.scenario AND a.i = b.i AND a.side = 'A' AND b.side = 'B' WHERE a.v <> b.v),
  signed AS (SELECT metric, scenario, d, rank() OVER (PARTITION BY metric, scenario ORDER BY abs(d)) +
      (count(*) OVER (PARTITION BY metric, scenario, abs(d)) - 1) / 2.0::double AS r,
      count(*) OVER (PARTITION BY metric, scenario, abs(d))::double AS t FROM diffs),
  wsum AS (SELECT metric, scenario, count(*)::double AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus,
      sum(t * t - 1) AS ties FROM signed GROUP BY ALL),
  wil AS (SELECT metric, scenario, n, least(plus, n * (n + 1) / 2 - plus) AS w,
      sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS sd FROM wsum)"""


@query(
    "signed_rank_test",
    f"""WITH {_SAMPLE_SQL}, {_PAIR_SQL}, tested AS (SELECT *, (w - n * (n + 1) / 4) / sd AS z FROM wil
      WHERE metric = 'quantity' AND scenario <> 'overall')
    SELECT scenario, n::bigint AS n, round(w, 3) AS w, round(z, 6) AS z, abs(round({_two_sided_sql('z')}, 6)) AS p FROM tested""",
)
def signed_rank_test(spark, d):
    pairs = ST.paired_sample(_sample(spark, d), ["scenario"], "side", "key", "quantity")
    result = ST.wilcoxon(pairs, ["scenario"])
    return _rounded(result, ["z", "p"]).select("scenario", "n", F.round("w", 3).alias("w"), "z", "p")


_EFFECT_SQL = """effect AS (SELECT metric, scenario, count(*) FILTER (side = 'A') AS n1, count(*) FILTER (side = 'B') AS n2,
    avg(v) FILTER (side = 'A') AS mean1, avg(v) FILTER (side = 'B') AS mean2,
    var_samp(v) FILTER (side = 'A') AS v1, var_samp(v) FILTER (side = 'B') AS v2 FROM sample GROUP BY ALL)"""


@query(
    "effect_size",
    f"""WITH {_SAMPLE_SQL}, {_EFFECT_SQL} SELECT scenario, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2,
      round(abs(mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d
    FROM effect WHERE metric = 'quantity' AND scenario <> 'overall'""",
)
def effect_size(spark, d):
    return _rounded(ST.cohen_d(_sample(spark, d), ["scenario"], "side", "quantity"), ["mean1", "mean2", "d"])


@query(
    "compared_results",
    f"""WITH {_SAMPLE_SQL}, {_EFFECT_SQL}, {_RANK_SQL}, {_PAIR_SQL}, tested AS (
      SELECT metric, scenario, effect.n1, effect.n2, mean1, mean2, v1, v2, u1, n::bigint AS wilcoxon_n,
        (greatest(u1, nn - u1) - nn / 2 - 0.5) / m.sd AS mz, (w - n * (n + 1) / 4) / wil.sd AS wz
      FROM effect JOIN mwu m USING (metric, scenario) JOIN wil USING (metric, scenario))
    SELECT metric, scenario, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2,
      round(abs(mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d, round(u1, 3) AS u1,
      round(mz, 6) AS mwu_z, abs(round({_two_sided_sql('mz')}, 6)) AS mwu_p, wilcoxon_n, round(wz, 6) AS wilcoxon_z,
      abs(round({_two_sided_sql('wz')}, 6)) AS wilcoxon_p FROM tested""",
)
def compared_results(spark, d):
    result = ST.compare_results(_sample(spark, d), "side", "scenario", "key", ["discount", "quantity"])
    result = _rounded(result, ["mean1", "mean2", "d", "mwu_z", "mwu_p", "wilcoxon_z", "wilcoxon_p"]).withColumn("u1", F.round("u1", 3))
    return result.drop("wilcoxon_w")


# --- epochs: conversation = run, turn = epoch, text length = score --------------------------------------

_EPOCH_SQL = """scored AS (SELECT conv_id, turn, row_number() OVER w - 1 AS position, length(text) AS score,
      max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  marked AS (SELECT *, before IS NULL OR score > before AS improved FROM scored),
  counted AS (SELECT *, position - max(CASE WHEN improved THEN position END) OVER (PARTITION BY conv_id ORDER BY turn)
    AS counter FROM marked),
  stops AS (SELECT conv_id, min(position) AS stop FROM counted WHERE counter >= 8 GROUP BY conv_id)"""

# Long runs: customer = run, order = epoch, price = score.
_ORDER_SQL = _EPOCH_SQL.replace("conversations", "runs").replace("length(text)", "score").replace(
    "scored AS", "runs AS (SELECT o_custkey AS conv_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS turn,\n    o_totalprice AS score FROM orders),\n  scored AS", 1
)


def _epochs(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("score"))


@query(
    "improvement_marks",
    f"WITH {_EPOCH_SQL} SELECT conv_id, turn, improved, counter FROM counted",
)
def improvement_marks(spark, d):
    marked = R.mark_improvements(_epochs(spark, d), "conv_id", "turn", "score")
    return marked.select("conv_id", "turn", "improved", "counter")


@query(
    "improvement_marks_with_delta",
    """WITH RECURSIVE e AS (SELECT conv_id, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn) - 1 AS position FROM conversations),
      walk AS (SELECT conv_id, position, score::double AS best, true AS improved, 0::bigint AS counter FROM e
          WHERE position = 0
        UNION ALL SELECT e.conv_id, e.position, CASE WHEN e.score > w.best + 25 THEN e.score ELSE w.best END,
          e.score > w.best + 25, CASE WHEN e.score > w.best + 25 THEN 0 ELSE w.counter + 1 END
        FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.position = w.position + 1)
    SELECT e.conv_id, e.turn, w.improved, w.counter FROM walk w JOIN e USING (conv_id, position)""",
)
def improvement_marks_with_delta(spark, d):
    marked = R.mark_improvements(_epochs(spark, d), "conv_id", "turn", "score", delta=25.0)
    return marked.select("conv_id", "turn", "improved", "counter")


def _orders_as_epochs(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("conv_id"), "o_orderkey", F.col("o_totalprice").alias("score"))
    bucket = quantile_bucket(rows, "o_orderkey")
    return row_index(rows, "turn", [F.col("o_orderkey")], bucket, ["conv_id"]).drop("o_orderkey")


@query(
    "early_stops",
    f"""WITH {_ORDER_SQL} SELECT c.conv_id, max(CASE WHEN improved THEN turn END) AS best_epoch, max(turn) AS stop_epoch,
      bool_or(s.stop IS NOT NULL) AS stopped FROM counted c LEFT JOIN stops s ON c.conv_id = s.conv_id
    WHERE s.stop IS NULL OR c.position <= s.stop GROUP BY c.conv_id""",
)
def early_stops(spark, d):
    marked = R.mark_improvements(_orders_as_epochs(spark, d), "conv_id", "turn", "score")
    return R.stop_points(marked, "conv_id", "turn")


@query(
    "learning_rates",
    f"""WITH {_ORDER_SQL} SELECT conv_id, turn, round(0.1 * pow(0.9, sum((counter >= 2)::int) OVER w), 9) AS decayed,
      round(0.1 * pow(0.2, sum((counter = 3)::int) OVER w), 9) AS dropped FROM counted
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def learning_rates(spark, d):
    marked = checkpointed(R.mark_improvements(_orders_as_epochs(spark, d), "conv_id", "turn", "score"))
    first = R.learning_rates(marked, "conv_id", "turn", 0.1).withColumnRenamed("rate", "decayed")
    second = R.learning_rates(marked, "conv_id", "turn", 0.1, R.DROP, R.DROP_AFTER, exactly=True).withColumnRenamed("rate", "dropped")
    both = first.join(second.select("conv_id", "turn", "dropped"), ["conv_id", "turn"])
    return _rounded(both.select("conv_id", "turn", "decayed", "dropped"), ["decayed", "dropped"], 9)


_TIME_SQL = """times AS (SELECT conv_id, turn, length(text) AS t, length(role) AS v FROM conversations),
  best AS (SELECT conv_id, arg_max(turn, (length(text), -turn)) AS best FROM conversations GROUP BY conv_id),
  totals AS (SELECT conv_id, avg(t) AS avg_time_per_epoch, max(best) AS number_of_epoch_at_best_model,
      count(*) AS number_of_epoch_at_finish,
      sum(CASE WHEN turn <= best THEN t ELSE 0 END)::bigint AS total_train_time_at_best_model,
      sum(t)::bigint AS total_train_time_at_finish,
      sum(CASE WHEN turn <= best THEN v ELSE 0 END)::bigint AS total_val_time_at_best_model,
      sum(v)::bigint AS total_val_time_at_finish,
      sum(CASE WHEN turn <= best THEN t + v ELSE 0 END)::bigint AS total_time_at_best_model,
      sum(t + v)::bigint AS total_time_at_finish FROM times JOIN best USING (conv_id) GROUP BY conv_id)"""


def _times(spark, d):
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn", F.length("text").alias("t"), F.length("role").alias("v")
    )
    best = rows.groupBy("conv_id").agg(F.max_by("turn", F.struct("t", -F.col("turn"))).alias("best"))
    return R.time_totals(rows.join(best, "conv_id"), ["conv_id"], "turn", "t", "v", "best")


@query("time_totals", f"WITH {_TIME_SQL} SELECT * REPLACE (round(avg_time_per_epoch, 6) AS avg_time_per_epoch) FROM totals")
def time_totals(spark, d):
    return _rounded(_times(spark, d), ["avg_time_per_epoch"])


@query(
    "collapsed_times",
    f"""WITH {_TIME_SQL} SELECT 'mean' AS how, round(avg(total_train_time_at_finish), 6) AS train,
      round(avg(total_time_at_finish), 6) AS total FROM totals
    UNION ALL SELECT 'sum', sum(total_train_time_at_finish)::double, sum(total_time_at_finish)::double FROM totals""",
)
def collapsed_times(spark, d):
    renamed = _times(spark, d).withColumnsRenamed(
        {"total_train_time_at_finish": "train", "total_time_at_finish": "total"}
    )
    columns = ["train", "total"]
    mean = _rounded(R.collapse_times(renamed, columns, "mean"), columns).select(F.lit("mean").alias("how"), *columns)
    total = R.collapse_times(renamed, columns, "sum").select(F.lit("sum"), *[F.col(c).cast("double") for c in columns])
    return mean.union(total)


# --- logs: one log text per customer, ten partitions of ten runs of three epochs ---------------------------


def _logs(spark, d):
    key = F.col("c_custkey")

    def text(column):
        return column.cast("string")

    def run(p, r):
        parts = [F.lit("Run # "), text(r), F.lit("\n")]
        for e in range(1, 4):
            seconds, shown = key % 50 + e + 10 * r, F.when(key % 10 == 9, F.lit(4)).otherwise(F.lit(e))
            parts += [
                F.lit("Epoch "), text(shown if e == 2 else F.lit(e)), F.lit("/50\n - "), text(seconds),
                F.lit("s - loss: 0.5\nValidation time: "), text(key % 7 + p), F.lit(".25 s.\n"),
                F.when(key % 3 + 1 >= e, F.lit(f"Saving best model at epoch {e}\n")).otherwise(F.lit("")),
            ]
        parts += [
            F.lit("Evaluating the best model on valid\nx\nEvaluating the best model on test\nValidation time: "),
            text(key % 11), F.lit(".5 s.\n"),
        ]
        return F.concat(*parts)

    ten = F.sequence(F.lit(0), F.lit(9))
    runs = lambda p: F.array_join(F.transform(ten, lambda r: run(p, r)), "")
    parts = F.transform(ten, lambda p: F.concat(F.lit("Current partition: "), text(p), F.lit("\n"), runs(p)))
    # A few numbers of a customer become a log of 35 kB, so the rows are spread over all cores first.
    customers = spread(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return customers.select(key.alias("path"), F.array_join(parts, "").alias("text"))


@query(
    "log_times",
    """SELECT path, p::int AS partition, r::int AS run, (path % 50 + 2 + 10 * r)::double AS avg_time_per_epoch,
      CASE WHEN path % 10 = 9 AND path % 3 >= 1 THEN greatest(4, path % 3 + 1) ELSE path % 3 + 1 END::int
        AS number_of_epoch_at_best_model, 3::bigint AS number_of_epoch_at_finish,
      (path % 50 * 3 + 6 + 30 * r)::bigint AS total_train_time_at_finish,
      3 * (path % 7 + p + 0.25::double) AS total_val_time_at_finish, path % 11 + 0.5::double AS final_evaluation_time
    FROM (SELECT c_custkey AS path FROM customer), range(10) a(p), range(10) b(r)""",
)
def log_times(spark, d):
    runs = R.log_runs(_logs(spark, d))
    times = R.log_times(runs, R.log_epochs(runs))
    return times.select(
        "path", "partition", "run", "avg_time_per_epoch", "number_of_epoch_at_best_model", "number_of_epoch_at_finish",
        "total_train_time_at_finish", "total_val_time_at_finish", "final_evaluation_time",
    )


@query(
    "log_violations",
    """SELECT path, p::int AS partition, r::int AS run, 'epoch numbers' AS problem
      FROM (SELECT c_custkey AS path FROM customer WHERE c_custkey % 10 = 9), range(10) a(p), range(10) b(r)""",
)
def log_violations(spark, d):
    runs = R.log_runs(_logs(spark, d))
    return R.log_violations(runs, R.log_epochs(runs))


# --- result tables: one wide row per supplier ----------------------------------------------------------


def _wide(spark, d):
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        key.alias("run"),
        F.lit("val").alias("set"),
        F.col("s_nationkey").alias("fold"),
        F.round(F.col("s_acctbal") / 1000, 3).alias("accuracy"),
        (key % 10 / 10).alias("mcc"),
        (key % 7 / 7.0).alias("cvss2_conf_acc"),
        (key % 5 / 5.0).alias("cvss2_conf_mcc"),
        (key % 4 / 4.0).alias("cvss2_avail_mcc"),
        F.lit(0.5).alias("pred_time"),
    )


@query(
    "long_results",
    """SELECT s_suppkey AS run, 'val' AS set, s_nationkey AS fold, 0.5::double AS pred_time, 'multitask' AS scenario,
        round(s_acctbal / 1000, 3) AS acc, s_suppkey % 10 / 10 AS mcc FROM supplier
    UNION ALL SELECT s_suppkey, 'val', s_nationkey, 0.5::double, 'cvss2_conf', s_suppkey % 7 / 7.0::double, s_suppkey % 5 / 5.0::double
      FROM supplier
    UNION ALL SELECT s_suppkey, 'val', s_nationkey, 0.5::double, 'cvss2_avail', NULL, s_suppkey % 4 / 4.0::double FROM supplier""",
)
def long_results(spark, d):
    return R.wide_to_long(_wide(spark, d), ["run", "set", "fold"])


@query(
    "mean_long_results",
    """SELECT 'multitask' AS scenario, round(avg(round(s_acctbal / 1000, 3)), 6) AS acc,
        round(avg(s_suppkey % 10 / 10), 6) AS mcc, 0.5::double AS pred_time FROM supplier
    UNION ALL SELECT 'cvss2_conf', round(avg(s_suppkey % 7 / 7.0::double), 6), round(avg(s_suppkey % 5 / 5.0::double), 6), 0.5::double
      FROM supplier
    UNION ALL SELECT 'cvss2_avail', NULL, round(avg(s_suppkey % 4 / 4.0::double), 6), 0.5::double FROM supplier""",
)
def mean_long_results(spark, d):
    return _rounded(R.wide_to_long(_wide(spark, d), ["run", "set", "fold"], average=True), ["acc", "mcc"])


@query(
    "wide_results",
    """SELECT s_suppkey AS run, round(s_acctbal / 1000, 3) AS multitask_acc, s_suppkey % 10 / 10 AS multitask_mcc,
      s_suppkey % 7 / 7.0::double AS cvss2_conf_acc, s_suppkey % 5 / 5.0::double AS cvss2_conf_mcc FROM supplier""",
)
def wide_results(spark, d):
    long = R.wide_to_long(_wide(spark, d), ["run", "set", "fold"])
    return R.long_to_wide(long, ["run"], ["multitask", "cvss2_conf"], ["acc", "mcc"])


@query(
    "result_files",
    """SELECT l_returnflag AS feature_type, l_linestatus AS feature_scope, 's' || l_suppkey AS token,
      (l_linenumber % 3)::varchar AS fold, l_linenumber::int AS epoch, sum(l_quantity)::double AS mcc,
      CASE WHEN l_suppkey % 3 < 2 THEN count(*)::double END AS f1
    FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey, l_linenumber""",
)
def result_files(spark, d):
    """One result file per supplier, flag, status and fold; columns swapped in every third file, one missing in another third."""
    kind = F.col("l_suppkey") % 3
    totals = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.sum("l_quantity").cast("double").cast("string").alias("mcc"), F.count(F.lit(1)).cast("string").alias("f1")
    )
    epoch = F.col("l_linenumber").cast("string")
    line = (
        F.when(kind == 0, F.concat_ws(",", F.lit("7"), epoch, "mcc", "f1"))
        .when(kind == 1, F.concat_ws(",", "f1", F.concat(F.lit('"'), epoch, F.lit('"')), "mcc"))
        .otherwise(F.concat_ws(",", "mcc", epoch))
    )
    head = F.when(kind == 0, ",epoch,mcc,f1").when(kind == 1, "f1,epoch, mcc").otherwise("mcc,epoch")
    name = F.concat_ws(
        "_", "l_returnflag", "l_linestatus", F.concat(F.lit("s"), F.col("l_suppkey")), F.col("l_linenumber") % 3, F.lit("result.csv")
    )
    # A supplier has at most as many rows in a file as there are line numbers.
    files = totals.select(name.alias("name"), head.alias("head"), line.alias("line")).groupBy("name", "head").agg(
        F.sort_array(F.collect_list("line")).alias("lines")
    )
    texts = files.select("name", F.concat("head", F.lit("\r\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))
    folder = write_files(texts, stage_path(spark, "results"), "name", "text", sliced=True)
    return read_results(spark, folder, 5, "epoch int, mcc double, f1 double")
