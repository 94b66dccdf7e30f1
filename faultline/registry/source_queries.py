"""Queries that write a stage in the shared folder and read it back, train models, or run a stream."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from faultline.cluster import stage_path
from faultline.operators import models, selection, splits, vocab
from faultline.operators.ranking import quantile_bucket
from faultline.functions.text import TOKEN_PATTERN
from faultline.registry.catalog import query, sql_quote, table
from faultline.registry.clean_queries import sql_split
from faultline.registry.text_queries import sql_clean
from faultline.sources import tables
from faultline.streaming import texts

_SHORT_CLEAN = f"(SELECT doc_id, {sql_clean('text')} AS code FROM documents)"


@query("csv_round_trip", "SELECT doc_id AS id, text, lang FROM documents")
def csv_round_trip(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias(tables.INDEX_COLUMN), "text", "lang")
    path = tables.write_stage(docs, stage_path(spark, "functions"), [], "csv")
    return tables.read_csv(spark, path, f"`{tables.INDEX_COLUMN}` bigint, text string, lang string")


@query(
    "stage_round_trip",
    f"SELECT doc_id, lang FROM documents WHERE {sql_split('doc_id')} = 'valid'",
)
def stage_round_trip(spark, d):
    docs = splits.assign_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    path = tables.write_stage(docs, stage_path(spark, "split"))
    return spark.read.parquet(path).filter("partition = 'valid'").select("doc_id", "lang")


@query("project_folders", "SELECT source AS project, count(*) AS n FROM documents GROUP BY source")
def project_folders(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("project"))
    path = tables.write_by_project(docs, stage_path(spark, "projects"))
    return spark.read.parquet(path).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dense_row_ids",
    """SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS id FROM orders""",
)
def dense_row_ids(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return tables.with_dense_id(orders, ["o_custkey", "o_orderkey"], quantile_bucket(orders, "o_custkey", tie="o_orderkey"))


@query(
    "sequence_cells",
    """SELECT vec_id, vec_id || ' ' || (vec_id + 1) AS ints, (vec_id * 2 + 1)::bigint AS total,
      round(list_sum(list_transform(embedding, lambda x: x::double)), 5) AS floats FROM embeddings""",
)
def sequence_cells(spark, d):
    key = F.col("vec_id")
    cells = table(spark, d, "embeddings").select(
        "vec_id",
        F.concat_ws("  ", key.cast("string"), (key + 1).cast("string")).alias("ints"),
        F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ", "), F.lit("]")).alias("floats"),
    )
    ints, floats = tables.parse_ints(F.col("ints")), tables.parse_floats(F.col("floats"))
    add = lambda a, x: a + x
    return cells.select(
        "vec_id",
        tables.format_numbers(ints).alias("ints"),
        F.aggregate(ints, F.lit(0).cast("bigint"), add).alias("total"),
        F.round(F.aggregate(floats, F.lit(0.0), add), 5).alias("floats"),
    )


@query(
    "result_file_columns",
    """SELECT s_suppkey, 'code' AS feature_type, 'hc' AS feature_scope, 'word' AS token, NULL::varchar AS scenario,
      s_nationkey::varchar AS fold FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT s_suppkey, 'ast', 'hc', 'char', 'cvss2_C', s_nationkey::varchar FROM supplier
      WHERE s_suppkey % 2 = 1 AND s_nationkey <> 3""",
)
def result_file_columns(spark, d):
    key, fold = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    name = (
        F.when(key % 2 == 0, F.concat(F.lit("/x/code_hc_word_"), fold, F.lit("_a.csv")))
        .when(fold == "3", F.lit("/x/notes.txt"))
        .otherwise(F.concat(F.lit("/x/ast_hc_char_cvss2_C_"), fold, F.lit("_b.csv")))
    )
    rows = table(spark, d, "supplier").select("s_suppkey", name.alias("path"))
    five = tables.with_file_columns(rows, F.col("path"), 5)
    seven = tables.with_file_columns(rows, F.col("path"), 7)
    return five.unionByName(seven, allowMissingColumns=True).drop("path")


# --- streaming -----------------------------------------------------------------------------------------


def _stream_path(d, name):
    """Pattern that only the table matches: a stream reads a table of one file, or of a folder of files, by a pattern."""
    return f"{d}/[{name[0]}]{name[1:]}.parquet"


@query(
    "streamed_functions",
    f"""SELECT doc_id, code, {sql_split('doc_id')} AS partition FROM {_SHORT_CLEAN}
    WHERE len(string_split(code, chr(10))) <= 200""",
)
def streamed_functions(spark, d):
    schema = table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(_stream_path(d, "documents"))
    prepared = texts.prepare_stream(stream.select("doc_id", F.col("text").alias("code")), "doc_id", "code")
    path = texts.run_available(prepared, stage_path(spark, "stream"), stage_path(spark, "progress"))
    return spark.read.parquet(path).select("doc_id", "code", "partition")


@query(
    "streamed_token_ids",
    f"""WITH prepared AS (SELECT doc_id, regexp_extract_all(code, {sql_quote(TOKEN_PATTERN)}) AS words FROM {_SHORT_CLEAN}
      WHERE len(string_split(code, chr(10))) <= 200),
      placed AS (SELECT doc_id, unnest(words) AS t, unnest(range(len(words))) AS p FROM prepared),
      vocab AS (SELECT t, row_number() OVER (ORDER BY n DESC, first) + 1 AS id FROM (
        SELECT t, count(*) AS n, min((doc_id, p)) AS first FROM placed WHERE {sql_split('doc_id')} = 'train'
        GROUP BY t ORDER BY n DESC, first LIMIT 9998)),
      ids AS (SELECT doc_id, list(coalesce(id, {vocab.GRAPH_MODEL['unknown']}) ORDER BY p) AS ids FROM placed
        LEFT JOIN vocab USING (t) WHERE p < 128 GROUP BY doc_id)
    SELECT doc_id, array_to_string(list_slice(list_concat(coalesce(ids, []),
      list_transform(range(128), lambda i: {vocab.GRAPH_MODEL['pad']})), 1, 128), ' ') AS ids
    FROM prepared LEFT JOIN ids USING (doc_id)""",
)
def streamed_token_ids(spark, d):
    docs = table(spark, d, "documents")
    batch = texts.prepare_stream(docs.select("doc_id", F.col("text").alias("code")), "doc_id", "code")
    found = vocab.freeze(vocab.fit_vocabulary(batch.filter("partition = 'train'"), "doc_id", "tokens"))
    stream = spark.readStream.schema(docs.schema).parquet(_stream_path(d, "documents"))
    prepared = texts.prepare_stream(stream.select("doc_id", F.col("text").alias("code")), "doc_id", "code")
    encoded = texts.encode_stream(prepared, found, vocab.GRAPH_MODEL).select("doc_id", "ids")
    path = texts.run_available(encoded, stage_path(spark, "stream"), stage_path(spark, "progress"))
    return spark.read.parquet(path).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


# --- classifiers: embeddings with their label, split by vector id -----------------------------------------


def _labelled(spark, d):
    rows = splits.assign_split(table(spark, d, "embeddings"), "vec_id")
    return rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


def _knn_sql(k, weight, norm):
    gap = "list_transform(list_zip(q.x, t.x), lambda p: abs(p[1] - p[2]))"
    dist = f"list_sum({gap})" if norm == 1 else f"sqrt(list_sum(list_transform({gap}, lambda g: g * g)))"
    return f"""WITH e AS (SELECT vec_id, label, embedding::double[] AS x, {sql_split('vec_id')} AS part FROM embeddings),
      near AS (SELECT q.vec_id AS qid, t.label, {dist} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {dist}, t.vec_id)
        AS r FROM e q JOIN e t ON q.part <> 'train' AND t.part = 'train'),
      votes AS (SELECT qid, label, round(sum({weight}), 12) AS w FROM near WHERE r <= {k} GROUP BY qid, label)
    SELECT qid, arg_max(label, (w, -label)) AS prediction FROM votes GROUP BY qid"""


def _knn(spark, d, **options):
    rows = splits.assign_split(table(spark, d, "embeddings"), "vec_id")
    train = rows.filter("partition = 'train'").selectExpr("vec_id AS id", "label", "embedding AS vec")
    queries = rows.filter("partition <> 'train'").selectExpr("vec_id AS qid", "embedding AS vec")
    return models.knn_predict(train, queries, **options)


@query("nearest_neighbours", _knn_sql(5, "1", 2))
def nearest_neighbours(spark, d):
    return _knn(spark, d, k=5)


@query("nearest_neighbours_by_blocks", _knn_sql(11, "1 / d", 1))
def nearest_neighbours_by_blocks(spark, d):
    return _knn(spark, d, k=11, weights="distance", norm=1, block_rows=150)


# The given labels are unrelated to the vectors, so no classifier can be told from a broken one by them. The grids learn
# which of the first three components is the largest.


def _grid(spark, d, name, every):
    """Checked result rows; with ``every`` each setting has to beat the largest class, else the best one."""
    first = F.slice(F.col("embedding"), 1, 3)
    data = _labelled(spark, d).withColumn("strongest", F.array_position(first, F.array_max(first)).cast("int") - 1).persist()
    results = models.run_grid(data, "strongest", name, selection.settings(name)).persist()
    sizes = data.groupBy("strongest").count().agg(F.max("count") / F.sum("count")).first()[0]
    data.unpersist()
    accuracy = (F.col("val_accuracy") + F.col("test_accuracy")) / 2
    if every:
        beats = results.select(F.col("parameters").alias("p"), (accuracy > sizes).alias("beats_majority"))
        return models.checked_results(results).join(beats, F.col("parameters") == F.col("p")).drop("p")
    best = results.agg(F.max(accuracy)).first()[0]
    return models.checked_results(results).withColumn("best_beats_majority", F.lit(bool(best > sizes)))


def _grid_sql(name, condition):
    """What is determined without training: every setting once, scores in range, and better than the largest class."""
    rows = " UNION ALL ".join(f"SELECT '{s}' AS parameters" for s in selection.settings(name))
    return f"SELECT 'strongest' AS problem, '{name}' AS classifier, parameters, true AS in_range, true AS {condition} FROM ({rows})"


@query("logistic_regression_grid", _grid_sql("lr", "best_beats_majority"))
def logistic_regression_grid(spark, d):
    return _grid(spark, d, "lr", every=False)


@query("linear_svm_grid", _grid_sql("svm", "best_beats_majority"))
def linear_svm_grid(spark, d):
    return _grid(spark, d, "svm", every=False)


@query("neighbour_grid", _grid_sql("knn", "best_beats_majority"))
def neighbour_grid(spark, d):
    return _grid(spark, d, "knn", every=False)


@query("random_forest_grid", _grid_sql("rf", "beats_majority"))
def random_forest_grid(spark, d):
    return _grid(spark, d, "rf", every=True)


@query("boosted_trees_grid", _grid_sql("lgbm", "beats_majority"))
def boosted_trees_grid(spark, d):
    return _grid(spark, d, "lgbm", every=True)


@query("regularised_boosting_grid", _grid_sql("xgb", "beats_majority"))
def regularised_boosting_grid(spark, d):
    return _grid(spark, d, "xgb", every=True)
