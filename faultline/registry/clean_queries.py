"""Queries over row filters, duplicate removal, splits and folds."""

from pyspark.sql import functions as F

from faultline.cluster import checkpointed
from faultline.functions.text import TOKEN_PATTERN, clean_code, tokenize_code
from faultline.operators import clean, splits, vocab
from faultline.operators.ranking import md5_bucket, quantile_bucket
from faultline.registry.catalog import query, sql_quote, table
from faultline.registry.text_queries import sql_clean

_SLOT_SQL = "(('0x' || substr(md5({key}::varchar || ':{seed}'), 1, 8))::bigint % 10000)"


def sql_slot(key, seed=0):
    return _SLOT_SQL.format(key=key, seed=seed)


def sql_split(key, seed=0):
    slot = sql_slot(key, seed)
    return f"CASE WHEN {slot} < 8000 THEN 'train' WHEN {slot} < 9000 THEN 'test' ELSE 'valid' END"


@query(
    "changed_rows",
    """SELECT doc_id, text AS before, replace(text, ' the ', ' a ') AS after FROM documents
    WHERE text IS DISTINCT FROM replace(text, ' the ', ' a ')""",
)
def changed_rows(spark, d):
    docs = table(spark, d, "documents")
    after = F.replace(F.col("text"), F.lit(" the "), F.lit(" a "))
    pair = docs.select("doc_id", F.col("text").alias("before"), after.alias("after"))
    return clean.changed_rows(pair, "before", "after")


@query(
    "labelled_with_deletions",
    """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '-1' ELSE l_returnflag END
      AS label, (l_quantity::int % 3) AS del_lines FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity::int % 3 <> 0""",
)
def labelled_with_deletions(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit("-1")).otherwise(F.col("l_returnflag")).alias("label"),
        (F.col("l_quantity").cast("int") % 3).alias("del_lines"),
    )
    return clean.with_deleted_lines(clean.drop_failed_labels(rows, "label"))


@query("short_functions", "SELECT doc_id, text FROM documents WHERE len(string_split(text, chr(10))) <= 200")
def short_functions(spark, d):
    return clean.drop_long_functions(table(spark, d, "documents").select("doc_id", "text"), "text")


@query(
    "renamed_columns",
    "SELECT l_orderkey AS id, l_partkey AS cve, l_shipdate AS published FROM lineitem",
)
def renamed_columns(spark, d):
    rows = clean.rename_columns(
        table(spark, d, "lineitem").withColumn("Unnamed: 0", F.lit(1)),
        {"l_orderkey": "id", "l_partkey": "cve", "l_shipdate": "published"},
    )
    tidy = clean.drop_helper_columns(rows, ["l_suppkey", "l_tax"])
    return clean.keep_columns(tidy, ["id", "cve", "published"])


@query(
    "null_handling",
    """SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN d.lang END, '') AS label, l.quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality IS NOT NULL OR l.toxic IS NOT NULL""",
)
def null_handling(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    present = clean.drop_missing(joined, ["quality", "toxic"], how="all")
    labelled = present.withColumn("label", F.when(F.col("toxic") == 1, F.col("lang")))
    return clean.fill_text(labelled, ["label"]).select("doc_id", "label", "quality")


@query(
    "rows_with_every_value",
    """SELECT d.doc_id, d.source, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality = 1""",
)
def rows_with_every_value(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    marked = joined.withColumn("good", F.when(F.col("quality") == 1, F.col("quality")))
    return clean.keep_present(marked, ["good", "toxic"]).select("doc_id", "source", "toxic")


@query("train_rows", f"SELECT doc_id, lang, source FROM documents WHERE {sql_split('doc_id')} = 'train'")
def train_rows(spark, d):
    docs = splits.assign_split(table(spark, d, "documents"), "doc_id")
    return clean.partition_rows(docs, "train").select("doc_id", "lang", "source")


@query("first_rows", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def first_rows(spark, d):
    return clean.first_rows(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 10)


@query(
    "overridden_file_names",
    """SELECT p.page_id, coalesce('doc' || d.doc_id, p.url) AS url FROM pages p
    LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON p.page_id = d.doc_id""",
)
def overridden_file_names(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'")
    fresh = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("url"))
    return clean.override_column(table(spark, d, "pages").select("page_id", "url"), fresh, "page_id", "url")


@query(
    "semi_and_anti_rows",
    """SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents""",
)
def semi_and_anti_rows(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    inside = clean.rows_with_keys(docs, labels, ["doc_id"]).withColumn("labelled", F.lit(True))
    outside = clean.rows_without_keys(docs, labels, ["doc_id"]).withColumn("labelled", F.lit(False))
    return inside.unionByName(outside)


@query(
    "drop_all_duplicates",
    "SELECT doc_id, text FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)",
)
def drop_all_duplicates(spark, d):
    return clean.drop_all_duplicates(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query(
    "drop_duplicate_edges",
    "SELECT DISTINCT l_orderkey AS innode, l_partkey AS outnode, l_returnflag AS etype FROM lineitem",
)
def drop_duplicate_edges(spark, d):
    edges = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS innode", "l_partkey AS outnode", "l_returnflag AS etype"
    )
    return clean.drop_duplicate_edges(edges)


@query(
    "set_difference",
    """SELECT DISTINCT p_partkey AS key FROM part EXCEPT SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48""",
)
def set_difference(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    sold = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("key"))
    return clean.set_difference(parts, sold)


@query(
    "union_partial_results",
    """SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, NULL::varchar AS name FROM customer
    UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_name FROM supplier""",
)
def union_partial_results(spark, d):
    customers = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation", "c_mktsegment AS segment")
    suppliers = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS nation", "s_name AS name")
    return clean.union_partial(customers, suppliers)


@query("hash_split", f"SELECT doc_id, {sql_split('doc_id')} AS partition FROM documents")
def hash_split(spark, d):
    return splits.assign_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    "exact_split",
    """SELECT o_orderkey, CASE WHEN r < round(n * 0.8) THEN 'train' WHEN r < round(n * 0.9) THEN 'test' ELSE 'valid' END
      AS partition FROM (SELECT o_orderkey, count(*) OVER () AS n,
      row_number() OVER (ORDER BY md5(o_orderkey::varchar || ':0'), o_orderkey) - 1 AS r FROM orders)""",
)
def exact_split(spark, d):
    return splits.assign_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", exact=True)


_FOLD_SQL = """folds AS (SELECT doc_id, CASE WHEN r <= w THEN 0 WHEN r <= 2 * w THEN 1 WHEN r <= 3 * w THEN 2
    WHEN r <= 4 * w THEN 3 ELSE 4 END::int AS fold
  FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () // 5 AS w FROM documents))"""


def _folds(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return splits.contiguous_folds(docs, "doc_id", 5, quantile_bucket(docs, "doc_id"))


@query("contiguous_folds", f"WITH {_FOLD_SQL} SELECT doc_id, fold FROM folds")
def contiguous_folds(spark, d):
    return _folds(spark, d)


@query(
    "ratio_folds",
    """SELECT o_orderkey, CASE WHEN r <= a THEN 0 WHEN r <= a + b THEN 1 ELSE 2 END::int AS fold FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r,
        floor(count(*) OVER () * 0.5::double)::bigint AS a, floor(count(*) OVER () * 0.3::double)::bigint AS b
      FROM orders)""",
)
def ratio_folds(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return splits.contiguous_folds(orders, "o_orderkey", [0.5, 0.3, 0.2], quantile_bucket(orders, "o_orderkey"))


@query(
    "rotating_folds",
    f"""WITH {_FOLD_SQL} SELECT round::int AS round, doc_id, fold, CASE (fold - round + 5) % 5 WHEN 1 THEN 'valid'
      WHEN 2 THEN 'test' ELSE 'train' END AS role FROM folds, range(5) t(round)""",
)
def rotating_folds(spark, d):
    return splits.fold_roles(_folds(spark, d), 5, "doc_id")


@query(
    "shuffled_rows",
    """SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::varchar || ':42'), doc_id) - 1 AS position
    FROM documents""",
)
def shuffled_rows(spark, d):
    from faultline.operators.ranking import row_index

    docs = table(spark, d, "documents").select("doc_id")
    salted = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("42"))
    order = [splits.shuffle_key(F.col("doc_id"), 42), F.col("doc_id")]
    return row_index(docs, "position", order, md5_bucket(salted))


@query(
    "equal_size_groups",
    """WITH ranked AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
        ORDER BY md5(event_id::varchar || ':42'), event_id) - 1 AS r FROM events)
    SELECT event_id, event_type FROM ranked
    WHERE r < (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))""",
)
def equal_size_groups(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    return splits.equal_size_groups(events, "event_type", "event_id")


@query("column_profile", """SELECT count(*) AS "rows", count(toxic) AS toxic, count(quality) AS quality,
    count(doc_id) AS doc_id, count(CASE WHEN lang <> 'en' THEN lang END) AS lang
    FROM documents LEFT JOIN labels USING (doc_id)""")
def column_profile(spark, d):
    from faultline.operators.metrics import column_profile as profile

    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    marked = joined.select("doc_id", "toxic", "quality", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    return profile(marked)


@query(
    "partition_sizes",
    f"SELECT {sql_split('doc_id')} AS partition, count(*) AS n FROM documents GROUP BY 1",
)
def partition_sizes(spark, d):
    from faultline.operators.metrics import value_counts

    return value_counts(splits.assign_split(table(spark, d, "documents"), "doc_id"), "partition")


_PREPARED_SQL = f"""cleaned AS (SELECT doc_id, {sql_clean('text')} AS code FROM documents),
    prepared AS (SELECT doc_id, code, {sql_split('doc_id')} AS partition,
        regexp_extract_all(code, {sql_quote(TOKEN_PATTERN)}) AS tokens FROM cleaned
      WHERE code IN (SELECT code FROM cleaned GROUP BY code HAVING count(*) = 1)
        AND len(string_split(code, chr(10))) <= 200),
    words AS (SELECT doc_id, partition, t, p FROM (
        SELECT doc_id, partition, unnest(tokens) AS t, unnest(range(len(tokens))) AS p FROM prepared)),
    vocab AS (SELECT t FROM (SELECT t, count(*) AS n, min((doc_id, p)) AS first FROM words WHERE partition = 'train'
        GROUP BY t) ORDER BY n DESC, first LIMIT 9998)"""


@query(
    "token_coverage",
    f"""WITH {_PREPARED_SQL}
    SELECT p.partition, count(*) AS docs, sum(p.tokens) AS tokens, sum(p.unknown) AS unknown,
      round(sum(p.unknown) / sum(p.tokens), 6) AS unknown_rate FROM (
        SELECT r.partition, r.doc_id, len(r.tokens) AS tokens, coalesce(u.unknown, 0) AS unknown FROM prepared r
        LEFT JOIN (SELECT doc_id, count(*) AS unknown FROM words WHERE t NOT IN (SELECT t FROM vocab) GROUP BY doc_id) u
          ON r.doc_id = u.doc_id) p GROUP BY p.partition""".replace(
        "sum(p.tokens) AS tokens, sum(p.unknown) AS unknown", "sum(p.tokens)::bigint AS tokens, sum(p.unknown)::bigint AS unknown"
    ),
)
def token_coverage(spark, d):
    docs = table(spark, d, "documents").select("doc_id", clean_code("text").alias("code"))
    unique = clean.drop_all_duplicates(docs, "code", "doc_id")
    ready = splits.assign_split(clean.drop_long_functions(unique, "code"), "doc_id")
    # read by the vocabulary and again by the encoder
    tokens = checkpointed(ready.select("doc_id", "partition", tokenize_code("code").alias("tokens")))
    train = clean.partition_rows(tokens, "train")
    words = vocab.fit_vocabulary(train, "doc_id", "tokens")
    ids = vocab.encode(tokens, "tokens", words, "ids", unknown=1)
    sizes = ids.select("partition", F.size("ids").alias("n"), F.size(F.filter("ids", lambda i: i == 1)).alias("u"))
    return sizes.groupBy("partition").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("n").cast("bigint").alias("tokens"),
        F.sum("u").cast("bigint").alias("unknown"),
        F.round(F.sum("u") / F.sum("n"), 6).alias("unknown_rate"),
    )
