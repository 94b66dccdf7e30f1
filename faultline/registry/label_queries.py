"""Queries over severity vectors, labels and class tables. Vectors and labels are derived from row keys."""

from pyspark.sql import functions as F

from faultline.functions import cvss
from faultline.operators import labels
from faultline.registry.catalog import query, sql_quote, table
from faultline.sources import html

# A vector per customer; every seventh customer has none.
_VECTOR_SQL = """CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE
  '(AV:' || substr('NLA', (c_custkey % 3)::int + 1, 1) || '/AC:' || substr('LMH', (c_custkey // 3 % 3)::int + 1, 1) ||
  '/Au:' || substr('SN', (c_custkey % 2)::int + 1, 1) || '/C:' || substr('PNC', (c_custkey // 2 % 3)::int + 1, 1) ||
  '/I:' || substr('PNC', (c_custkey // 5 % 3)::int + 1, 1) || '/A:' || substr('PNC', (c_custkey // 7 % 3)::int + 1, 1)
  || ')' END"""
_SCORE_SQL = """CASE WHEN c_custkey % 11 = 0 THEN 'NaN' ELSE (c_custkey % 100 / 10)::decimal(4,1)::varchar || ' ' ||
  list_extract(['LOW', 'MEDIUM', 'HIGH'], (c_custkey % 3)::int + 1) END"""


def crawl(spark, d):
    key = F.col("c_custkey")

    def pick(letters, divisor):
        return F.substr(F.lit(letters), (F.floor(key / divisor) % len(letters)).cast("int") + 1, F.lit(1))

    vector = F.concat(
        F.lit("(AV:"), pick("NLA", 1), F.lit("/AC:"), pick("LMH", 3), F.lit("/Au:"), pick("SN", 1),
        F.lit("/C:"), pick("PNC", 2), F.lit("/I:"), pick("PNC", 5), F.lit("/A:"), pick("PNC", 7), F.lit(")"),
    )
    word = F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (key % 3).cast("int") + 1)
    score = F.concat((key % 100 / 10).cast("decimal(4,1)").cast("string"), F.lit(" "), word)
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("cve id"),
        F.when(key % 7 != 0, vector).alias("vector"),
        F.when(key % 11 == 0, F.lit("NaN")).otherwise(score).alias("score"),
    )


_CRAWL_SQL = f'crawl AS (SELECT c_custkey AS cve, {_VECTOR_SQL} AS vector, {_SCORE_SQL} AS score FROM customer)'
_LETTERS_SQL = ", ".join(
    f"regexp_extract(vector, '{tag}:([A-Z])', 1) AS \"{name}\""
    for tag, name in (("AV", "AV"), ("AC", "AC"), ("Au", "AU"), ("/C", "C"), ("/I", "I"), ("/A", "A"))
)


@query(
    "parsed_vectors",
    f"WITH {_CRAWL_SQL} SELECT cve, {_LETTERS_SQL} FROM crawl",
)
def parsed_vectors(spark, d):
    parts = cvss.parse_vector(F.col("vector"))
    return crawl(spark, d).select(F.col("cve id").alias("cve"), *[c.alias(n) for n, c in parts.items()])


@query(
    "parsed_scores",
    f"""WITH {_CRAWL_SQL} SELECT cve, try_cast(regexp_extract(score, '^(\\S+) (\\S+)$', 1) AS double) AS "SCORE",
      nullif(regexp_extract(score, '^(\\S+) (\\S+)$', 2), '') AS label FROM crawl""",
)
def parsed_scores(spark, d):
    parts = cvss.parse_score(F.col("score"))
    return crawl(spark, d).select(F.col("cve id").alias("cve"), *[c.alias(n) for n, c in parts.items()])


_METRIC_SQL = f"""{_CRAWL_SQL}, metric AS (SELECT cve, try_cast(regexp_extract(score, '^(\\S+) (\\S+)$', 1) AS double)
  AS score, nullif(regexp_extract(score, '^(\\S+) (\\S+)$', 2), '') AS label, {_LETTERS_SQL}
  FROM crawl WHERE vector IS NOT NULL)"""


@query(
    "attached_metrics",
    f"""WITH {_METRIC_SQL} SELECT o_orderkey, o_custkey, coalesce(score, -1) AS "SCORE", coalesce(label, '-1') AS label,
      coalesce("AV", '-1') AS "AV", coalesce("AC", '-1') AS "AC", coalesce("AU", '-1') AS "AU", coalesce("C", '-1') AS "C",
      coalesce("I", '-1') AS "I", coalesce("A", '-1') AS "A"
    FROM orders LEFT JOIN metric ON o_custkey = cve""",
)
def attached_metrics(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return labels.attach_metrics(orders, labels.parse_metrics(crawl(spark, d)), "o_custkey")


@query(
    "first_labels",
    """SELECT c_custkey, c_name, f.o_orderpriority AS label FROM customer JOIN (SELECT o_custkey,
      arg_min(o_orderpriority, (o_orderkey, o_orderpriority)) AS o_orderpriority FROM orders GROUP BY o_custkey) f
      ON c_custkey = f.o_custkey""",
)
def first_labels(spark, d):
    source = table(spark, d, "orders").selectExpr("o_custkey AS c_custkey", "o_orderkey", "o_orderpriority AS label")
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    return labels.lookup_labels(customers, source, "c_custkey", "o_orderkey", ["label"])


def _labelled_orders(spark, d):
    """Seven labels per order, from the order key."""
    key = F.col("o_orderkey")
    columns = []
    for i, (target, codes) in enumerate(cvss.LABEL_CODES.items()):
        names = F.array(*[F.lit(n) for n in codes])
        columns.append(F.element_at(names, (F.floor(key / (i + 1)) % len(codes)).cast("int") + 1).alias(target))
    return table(spark, d, "orders").select("o_orderkey", *columns)


_CODES_SQL = ", ".join(
    f"(o_orderkey // {i + 1} % {len(codes)})::int AS \"{t}\"" for i, (t, codes) in enumerate(cvss.LABEL_CODES.items())
)


@query("encoded_labels", f"SELECT o_orderkey, {_CODES_SQL} FROM orders")
def encoded_labels(spark, d):
    return labels.encode_labels(_labelled_orders(spark, d))


@query(
    "class_counts",
    """SELECT 'o_orderpriority' AS target, count(DISTINCT o_orderpriority)::int AS n_classes FROM orders
    UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus)::int FROM orders""",
)
def class_counts(spark, d):
    return labels.class_counts(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@query(
    "binarized_labels",
    """WITH c AS (SELECT list(p ORDER BY p) AS cs FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)),
      q AS (SELECT list(p ORDER BY p) AS cs FROM (SELECT DISTINCT quality::varchar AS p FROM labels)),
      s AS (SELECT list_extract(cs, 2) AS second, len(cs) AS n FROM q)
    SELECT o_orderkey, (SELECT array_to_string(list_transform(cs, lambda x: (x = o_orderpriority)::int), ',') FROM c)
      AS priority, (SELECT CASE WHEN n = 2 THEN ((o_orderkey % 2)::varchar = second)::int::varchar END FROM s) AS parity
    FROM orders""",
)
def binarized_labels(spark, d):
    orders = table(spark, d, "orders").withColumn("parity", F.col("o_orderkey") % 2)
    quality = table(spark, d, "labels").select(F.col("quality").alias("parity"))
    out = labels.binarize(orders, "o_orderpriority", labels.class_table(orders, ["o_orderpriority"]), "p")
    out = labels.binarize(out, "parity", labels.class_table(quality, ["parity"]), "q")
    return out.select(
        "o_orderkey",
        F.array_join(F.col("p").cast("array<string>"), ",").alias("priority"),
        F.array_join(F.col("q").cast("array<string>"), ",").alias("parity"),
    )


@query(
    "decoded_predictions",
    """SELECT vec_id, (list_position(p, list_max(p)) - 1)::int AS best,
      'class ' || list_position(p, list_max(p)) AS label, (CASE WHEN list_max(p) > 0.5 THEN 1 ELSE 0 END)::int AS single
    FROM (SELECT vec_id, embedding AS p FROM embeddings)""",
)
def decoded_predictions(spark, d):
    rows = table(spark, d, "embeddings").withColumn("p", F.col("embedding"))
    single = F.array(F.array_max("p"))
    classes = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.concat(F.lit("class "), i.cast("string")))
    return rows.select(
        "vec_id",
        cvss.predicted_index(F.col("p")).alias("best"),
        cvss.predicted_class(F.col("p"), classes).alias("label"),
        cvss.predicted_index(single).alias("single"),
    )


_LEVELS = {
    "cvss2_accessvect": ("NETWORK", "LOCAL", "ADJACENT"),
    "cvss2_auth": ("NONE", "SINGLE", "MULTIPLE"),
    **cvss.ORDERED_LEVELS,
}


def _predictions(spark, d):
    key = F.col("o_orderkey")
    columns = []
    for i, target in enumerate(cvss.SCORED_TARGETS):
        names = F.array(*[F.lit(n) for n in _LEVELS[target]])
        true = F.element_at(names, (key % 3).cast("int") + 1)
        pred = F.element_at(names, (F.floor(key / (i + 2)) % 3).cast("int") + 1)
        columns += [true.alias(target), pred.alias(f"{target}-pred")]
    return table(spark, d, "orders").select(key.alias("commit"), *columns)


def _distance_sql():
    absolute, partial = [], []
    for i, target in enumerate(cvss.SCORED_TARGETS):
        diff = f"abs(o_orderkey % 3 - o_orderkey // {i + 2} % 3)"
        absolute.append(f"({diff} > 0)::int")
        partial.append(f"({diff} / 2.0::double)" if target in cvss.ORDERED_LEVELS else f"({diff} > 0)::int")
    return (
        f"SELECT o_orderkey AS commit, ({' + '.join(absolute)})::int AS score_abs, "
        f"({' + '.join(partial)})::double AS score_partial FROM orders"
    )


@query("label_distance", _distance_sql())
def label_distance(spark, d):
    targets = list(cvss.SCORED_TARGETS)
    return _predictions(spark, d).select(
        "commit", cvss.absolute_score(targets).alias("score_abs"), cvss.partial_score(targets).alias("score_partial")
    )


def _field_sql(selector):
    pattern = sql_quote(html.element_pattern(selector))
    return f"CASE WHEN regexp_matches(html, {pattern}) THEN regexp_extract(html, {pattern}, 1) END"


@query(
    "html_fields",
    f"SELECT page_id, {_field_sql('.ad')} AS ad, {_field_sql('title')} AS title, {_field_sql('#Cvss2CalculatorAnchor')} "
    "AS score FROM pages",
)
def html_fields(spark, d):
    fields = {"ad": ".ad", "title": "title", "score": html.SCORE_SELECTOR}
    return html.extract_html_fields(table(spark, d, "pages"), "html", fields, ["page_id"])


@query(
    "page_metrics",
    f"""WITH {_CRAWL_SQL}
    SELECT cve, CASE WHEN score = 'NaN' THEN NULL ELSE score END AS score, vector FROM crawl
      WHERE vector IS NOT NULL""",
)
def page_metrics(spark, d):
    facts = crawl(spark, d).filter("vector IS NOT NULL").withColumnRenamed("cve id", "cve")
    anchor = F.when(
        F.col("score") != "NaN",
        F.concat(F.lit('<a class="label" id="Cvss2CalculatorAnchor" href="/x">'), "score", F.lit("</a>")),
    ).otherwise(F.lit("<a>none</a>"))
    page = F.concat(
        F.lit("<html><body>"), anchor, F.lit("<span class='tooltip tooltipCvss2NistMetrics'>"), "vector",
        F.lit("</span></body></html>"),
    )
    return html.extract_metric_fields(facts.select("cve", page.alias("html")), "html", ["cve"])
