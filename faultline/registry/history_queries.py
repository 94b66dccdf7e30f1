"""Queries over change history. Events are writes of a line (user = line, event type = file); orders are fixes."""

from pyspark.sql import functions as F

from faultline.operators import history as H
from faultline.operators.ranking import quantile_bucket
from faultline.plans import history
from faultline.registry.catalog import query, table

_BLAME_SQL = """writes AS (SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS file, user_id AS line_key,
    event_id AS commit, epoch_us(ts) AS commit_ts FROM events),
  lines AS (SELECT o_custkey AS fix_id, o_orderkey % 5 AS file, o_custkey % 7 AS fix_file, o_orderkey % 150 AS line_key,
    1704067200000000 + (o_orderkey * 7919 % 2592000) * 1000000 AS fix_ts FROM orders),
  kept AS (SELECT * FROM lines l WHERE file = fix_file OR NOT EXISTS (
    SELECT 1 FROM lines s WHERE s.fix_id = l.fix_id AND s.file = s.fix_file)),
  found AS (SELECT DISTINCT k.fix_id, w.commit, w.commit_ts FROM kept k ASOF JOIN writes w
    ON k.file = w.file AND k.line_key = w.line_key AND k.fix_ts > w.commit_ts)"""


def _file(number):
    return F.concat(F.lit("src/f"), number.cast("string"), F.lit(".c"))


def _blame(spark, d):
    events, orders = table(spark, d, "events"), table(spark, d, "orders")
    kinds = events.select("event_type").distinct()
    number = kinds.agg(F.array_sort(F.collect_list("event_type")).alias("k")).scalar()
    writes = events.withColumn("kinds", number).select(
        F.lit("p").alias("project"),
        _file(F.array_position("kinds", F.col("event_type")) - 1).alias("file"),
        F.col("user_id").alias("line_key"),
        F.col("event_id").alias("commit"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("commit_ts"),
    )
    key = F.col("o_orderkey")
    lines = orders.select(
        F.col("o_custkey").alias("fix_id"),
        F.lit("p").alias("project"),
        _file(key % 5).alias("file"),
        (key % 150).alias("line_key"),
        (F.lit(1704067200000000) + (key * 7919 % 2592000) * 1000000).alias("fix_ts"),
        _file(F.col("o_custkey") % 7).alias("fix_file"),
    )
    bucket = quantile_bucket(writes.select(F.col("commit_ts").alias("ts")), "ts", 16)
    return H.blame_candidates(lines, writes, bucket)


@query("blame_candidates", f"WITH {_BLAME_SQL} SELECT fix_id, commit, commit_ts FROM found")
def blame_candidates(spark, d):
    return _blame(spark, d)


@query(
    "blame_candidate_lists",
    f"""WITH {_BLAME_SQL} SELECT fix_id, string_agg(commit::varchar, ',' ORDER BY commit_ts, commit) AS commits
    FROM found GROUP BY fix_id""",
)
def blame_candidate_lists(spark, d):
    return H.candidate_lists(_blame(spark, d))


# Parts are methods: size = commit, brand = file. Customers are fixes with four candidate commits each.

_METHOD_SQL = r"""methods AS (SELECT p_size::bigint AS commit, p_brand || '.c' AS base, p_partkey AS position,
    string_split(p_name, ' ')[2] || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '_' || lower(p_type) END AS name,
    (p_partkey % 3 + 1)::int AS s, (p_partkey % 3 + 2)::int AS e FROM part),
  signed AS (SELECT *, name || CASE WHEN position % 5 = 0 THEN '(intx)' ELSE '(longy)' END AS signature FROM methods),
  fixes AS (SELECT c_custkey AS fix_id, 'Brand#' || (c_custkey % 5 + 1) || '.c' AS base,
    list_extract(['ring', 'gear', 'bolt', 'ing', 'no_such', 'x'], (c_custkey % 6)::int + 1) AS function FROM customer),
  asked AS (SELECT fix_id, base, function, function || '(intx)' AS signature,
    ((fix_id * 3 + k * 11) % 50 + 1)::bigint AS commit, k AS ts FROM fixes, range(4) r(k)),
  matches AS (SELECT a.fix_id, CASE WHEN m.signature = a.signature THEN 1 ELSE 2 END AS tier, a.ts, a.commit, m.position,
    m.s, m.e, a.base FROM asked a JOIN signed m ON m.commit = a.commit AND m.base = a.base
    WHERE m.signature = a.signature OR contains(m.name, a.function)),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY tier, ts, commit, position) AS r
    FROM matches) WHERE r = 1)"""


def _methods(spark, d):
    part, customer = table(spark, d, "part"), table(spark, d, "customer")
    key = F.col("p_partkey")
    path = F.concat(F.lit("lib/"), "p_brand", F.lit(".c"))
    name = F.concat(
        F.get(F.split("p_name", " "), F.lit(1)),
        F.when(key % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("_"), F.lower("p_type"))),
    )
    long_name = F.concat(name, F.when(key % 5 == 0, F.lit(" ( int x )")).otherwise(F.lit(" ( long y )")))
    start = (key % 3 + 1).cast("int")
    methods = part.select(
        F.col("p_size").cast("bigint").alias("commit"), path.alias("file"), key.alias("position"), name.alias("name"),
        long_name.alias("long_name"), start.alias("before_start"), (start + 1).alias("before_end"),
        start.alias("after_start"), (start + 1).alias("after_end"),
    )
    lines = [F.concat(F.lit(f"line{i} "), F.col("commit").cast("string")) for i in range(1, 6)]
    files = methods.select("commit", "file").distinct().select(
        "commit", "file", F.array_join(F.array(*lines), "\n").alias("source_before"),
        F.array_join(F.array(*[F.concat(F.lit("new "), c) for c in lines]), "\n").alias("source_after"),
    )
    cust = F.col("c_custkey")
    words = F.array(*[F.lit(w) for w in ("ring", "gear", "bolt", "ing", "no_such", "x")])
    function = F.element_at(words, (cust % 6).cast("int") + 1)
    fixes = customer.select(
        cust.alias("fix_id"),
        F.concat(F.lit("src/deep/Brand#"), (cust % 5 + 1).cast("string"), F.lit(".c")).alias("file_name"),
        F.concat(F.lit("static int *"), function, F.lit(" (int\n x)\n{\n  return 0;\n}")).alias("func_before"),
    )
    step = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("commit_ts")
    candidates = fixes.select("fix_id", step).withColumn("commit", (F.col("fix_id") * 3 + F.col("commit_ts") * 11) % 50 + 1)
    return fixes, candidates, methods, files


@query(
    "matched_methods",
    f"WITH {_METHOD_SQL} SELECT fix_id, tier::int AS tier, commit, 'lib/' || base AS file, position FROM best",
)
def matched_methods(spark, d):
    fixes, candidates, methods, _ = _methods(spark, d)
    return H.match_methods(fixes, candidates, methods)


@query(
    "introducing_functions",
    f"""WITH {_METHOD_SQL} SELECT f.fix_id, b.commit AS blaming_commit,
      coalesce('line' || s || ' ' || commit || chr(10) || 'line' || e || ' ' || commit, '') AS blaming_func_before,
      coalesce('new line' || s || ' ' || commit || chr(10) || 'new line' || e || ' ' || commit, '') AS blaming_func_after
    FROM fixes f LEFT JOIN best b ON f.fix_id = b.fix_id""",
)
def introducing_functions(spark, d):
    return H.introducing_functions(*_methods(spark, d))


# The whole job: every size of a brand has written the line with its number; each fix removes four of them.

_JOB_SQL = _METHOD_SQL.replace("k AS ts", "(fix_id * 3 + k * 11) % 50 AS ts")


@query(
    "blamed_functions",
    f"""WITH {_JOB_SQL} SELECT fix_id AS id, commit AS blaming_commit,
      'line' || s || ' ' || commit || chr(10) || 'line' || e || ' ' || commit AS blaming_func_before,
      'new line' || s || ' ' || commit || chr(10) || 'new line' || e || ' ' || commit AS blaming_func_after FROM best""",
)
def blamed_functions(spark, d):
    fixes, candidates, methods, files = _methods(spark, d)
    line = {"project": F.lit("p"), "fix_ts": F.lit(1000).cast("bigint")}
    removed = candidates.join(fixes.select("fix_id", "file_name"), "fix_id").select(
        "fix_id", F.col("file_name").alias("file"), (F.col("commit") - 1).alias("line_key"), F.col("file_name").alias("fix_file")
    )
    writes = table(spark, d, "part").select(
        F.lit("p").alias("project"), F.concat(F.lit("src/deep/"), "p_brand", F.lit(".c")).alias("file"),
        (F.col("p_size") - 1).cast("bigint").alias("line_key"), F.col("p_size").cast("bigint").alias("commit"),
        (F.col("p_size") - 1).cast("bigint").alias("commit_ts"),
    ).distinct()
    bucket = quantile_bucket(writes.select(F.col("commit_ts").alias("ts")), "ts", 16)
    return history.blame_fixes(fixes, removed.withColumns(line), writes, methods, files, bucket)
