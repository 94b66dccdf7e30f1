"""Queries over changed lines and their contexts."""

from pyspark.sql import functions as F

from faultline.cluster import checkpointed
from faultline.functions import contexts as C
from faultline.functions.diff import lcs_length
from faultline.functions.text import code_lines
from faultline.operators import changes
from faultline.registry.catalog import query, sql_lines, sql_quote, table
from faultline.registry.inputs import DOC_LINES_SQL, documents_with_lines
from faultline.registry.text_queries import _CUT_SQL, _mask_sql, pages_as_code, sql_page_code

_PICK = "array_to_string(list_transform({nums}, lambda i: list_extract(ls, i)), chr(10))"
_CUT_PICK = (
    "array_to_string(list_transform(list_transform({nums}, lambda i: list_extract(ls, i)), lambda l: "
    + _CUT_SQL
    + "), chr(10))"
)
_ALL = "list_transform(range(1, n + 1), lambda i: i::int)"
_REST = f"list_filter({_ALL}, lambda i: NOT list_contains(nums, i))"


def _around(k):
    return f"list_filter({_ALL}, lambda i: len(list_filter(nums, lambda c: abs(c - i) <= {k})) > 0)"


_AROUND_ONLY = f"list_filter({_around(6)}, lambda i: NOT list_contains(nums, i))"
_RANDOM = f"""list_transform(list_slice(list_sort(list_transform({_REST}, lambda i:
    struct_pack(h := md5(doc_id::varchar || ':' || i::varchar), i := i))), 1, least(len(nums), n - len(nums))),
    lambda s: s.i)"""


# --- line diff: the new text drops all listed lines and ends with one marker line --------------------


def _pair(spark, d):
    docs = documents_with_lines(spark, d).withColumn("lines", code_lines("code"))
    lines = F.col("lines")
    kept = C.pick_lines(lines, C.other_line_numbers(F.col("code"), F.col("nums")))
    after = F.concat(F.array_join(F.concat(kept, F.array(F.lit("/*marker*/"))), "\n"), F.lit("\n"))
    before = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    pairs = docs.filter(F.size(lines) > 0).select("doc_id", before.alias("before"), after.alias("after"))
    return checkpointed(pairs)  # stands in for a stored function table


@query(
    "line_diff",
    f"""WITH {DOC_LINES_SQL} SELECT doc_id, nums AS delete_lines, [n - len(nums) + 1]::int[] AS add_lines FROM docs
    WHERE n > 0""",
)
def line_diff(spark, d):
    return changes.with_line_diff(_pair(spark, d), "before", "after").select("doc_id", "delete_lines", "add_lines")


@query(
    "changed_line_rows",
    f"""WITH {DOC_LINES_SQL} SELECT doc_id, 'delete' AS side, i AS line_no, list_extract(ls, i) AS text FROM (
      SELECT doc_id, ls, unnest(nums) AS i FROM docs)
    UNION ALL SELECT doc_id, 'add', (n - len(nums) + 1)::int, '/*marker*/' FROM docs WHERE n > 0""",
)
def changed_line_rows(spark, d):
    return changes.changed_line_rows(_pair(spark, d), "doc_id", "before", "after")


@query(
    "unified_diff",
    f"""WITH {DOC_LINES_SQL} SELECT doc_id, array_to_string(list_transform({_ALL}, lambda i:
      (CASE WHEN list_contains(nums, i) THEN '-' ELSE ' ' END) || list_extract(ls, i)), chr(10)) || chr(10) ||
      '+/*marker*/' AS diff FROM docs WHERE n > 0""",
)
def unified_diff(spark, d):
    return changes.with_unified_diff(_pair(spark, d), "before", "after").select("doc_id", "diff")


@query(
    "diff_counts",
    f"""WITH {DOC_LINES_SQL} SELECT doc_id, len(nums)::int AS deleted, 1 AS added FROM docs WHERE n > 0""",
)
def diff_counts(spark, d):
    pair = _pair(spark, d).select(
        "doc_id", code_lines("before").alias("old"), code_lines("after").alias("new")
    )
    common = pair.select("doc_id", "old", "new", lcs_length(F.col("old"), F.col("new")).alias("lcs"))
    return common.select(
        "doc_id", (F.size("old") - F.col("lcs")).alias("deleted"), (F.size("new") - F.col("lcs")).alias("added")
    )


# --- contexts inside the row ----------------------------------------------------------------------


@query("listed_lines_text", f"WITH {DOC_LINES_SQL} SELECT doc_id, {_PICK.format(nums='nums')} AS code FROM docs")
def listed_lines_text(spark, d):
    return documents_with_lines(spark, d).select("doc_id", C.extract_code(F.col("code"), F.col("nums")).alias("code"))


@query(
    "code_context_whole",
    f"""WITH {DOC_LINES_SQL} SELECT doc_id, {_CUT_PICK.format(nums='nums')} AS listed, {_CUT_PICK.format(nums=_REST)}
      AS context, {_CUT_PICK.format(nums=_ALL)} AS whole FROM docs""",
)
def code_context_whole(spark, d):
    code, nums = F.col("code"), F.col("nums")
    return documents_with_lines(spark, d).select(
        "doc_id",
        C.scope_text(code, nums).alias("listed"),
        C.scope_text(code, C.other_line_numbers(code, nums)).alias("context"),
        C.whole_text(code).alias("whole"),
    )


@query(
    "surrounding_lines",
    f"""WITH {DOC_LINES_SQL} SELECT doc_id, array_to_string({_around(6)}, ' ') AS scope,
      array_to_string({_AROUND_ONLY}, ' ') AS surrounding FROM docs""",
)
def surrounding_lines(spark, d):
    code, nums = F.col("code"), F.col("nums")
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return documents_with_lines(spark, d).select(
        "doc_id",
        text(C.surrounding_line_numbers(code, nums, 6)).alias("scope"),
        text(C.surrounding_only_line_numbers(code, nums, 6)).alias("surrounding"),
    )


@query(
    "surrounding_lines_compat",
    f"""WITH {DOC_LINES_SQL} SELECT doc_id, array_to_string(list_filter(list_transform(range(0, n + 1), lambda i: i::int),
      lambda i: list_contains(nums, i) OR (i < n AND len(list_filter(nums, lambda c: abs(c - i) <= 6)) > 0)), ' ')
      AS scope FROM docs""",
)
def surrounding_lines_compat(spark, d):
    numbers = C.surrounding_line_numbers(F.col("code"), F.col("nums"), 6, mode="compat")
    return documents_with_lines(spark, d).select(
        "doc_id", F.array_join(numbers.cast("array<string>"), " ").alias("scope")
    )


@query(
    "random_context",
    f"WITH {DOC_LINES_SQL} SELECT doc_id, array_to_string({_RANDOM}, ' ') AS picked FROM docs",
)
def random_context(spark, d):
    numbers = C.random_line_numbers(F.col("doc_id"), F.col("code"), F.col("nums"))
    return documents_with_lines(spark, d).select(
        "doc_id", F.array_join(numbers.cast("array<string>"), " ").alias("picked")
    )


@query(
    "neighbour_contexts",
    f"""WITH {DOC_LINES_SQL} SELECT doc_id, i::int AS line_no,
      array_to_string(list_slice(ls, greatest(i - 1, 1), least(i + 1, n)), chr(10)) AS context
    FROM (SELECT doc_id, ls, n, unnest(range(1, n + 1)) AS i FROM docs)""",
)
def neighbour_contexts(spark, d):
    return changes.neighbour_contexts(documents_with_lines(spark, d), "doc_id", "code")


def _scopes_sql():
    variants = {
        "whole": _ALL,
        "lines_without_context": "nums",
        "lines_with_surrounding_context": _around(6),
        "context_only": _REST,
        "surrounding_only": _AROUND_ONLY,
        "random_context": _RANDOM,
    }
    parts = [f"SELECT doc_id, '{s}' AS scope, {_CUT_PICK.format(nums=e)} AS code FROM docs" for s, e in variants.items()]
    return f"WITH {DOC_LINES_SQL} " + " UNION ALL ".join(parts)


@query("scope_variants", _scopes_sql())
def scope_variants(spark, d):
    return changes.build_scopes(documents_with_lines(spark, d), "doc_id", "code", "nums")


# --- enclosing scopes from braces: the SQL searches every line pair, Spark uses running extremes -------

_PAGE_LINES_SQL = f"""code AS (SELECT page_id, {sql_lines('code')} AS ls FROM (
    SELECT page_id, {sql_page_code()} AS code FROM pages)),
  lines AS (SELECT page_id, i::int AS i, list_extract(ls, i) AS raw FROM (
    SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM code)),
  masked AS (SELECT *, {_mask_sql('raw', True)} AS m, {_mask_sql('raw', False)} AS m2,
    substr(md5(raw), 1, 1) < '4' AS listed FROM lines),
  flags AS (SELECT page_id, i, listed, contains(m, '{{')::int AS o, contains(m, '}}')::int AS c,
    CASE WHEN contains(m, '}}') THEN contains(substr(m, 1, instr(m, '}}') - 1), '{{')::int ELSE contains(m, '{{')::int
      END AS pre,
    CASE WHEN contains(m, '}}') THEN contains(substr(m, instr(m, '}}')), '{{')::int ELSE 0 END AS post,
    regexp_matches(m2, '[;{{}}]') AS stop FROM masked),
  sums AS (SELECT *, sum(c - o) OVER w AS s,
    sum(CASE WHEN c = 1 THEN pre - 1 + post ELSE o END) OVER w AS f,
    coalesce(sum(CASE WHEN c = 1 THEN pre - 1 + post ELSE o END) OVER (PARTITION BY page_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fb,
    coalesce(max(CASE WHEN stop THEN i END) OVER (PARTITION BY page_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_stop
    FROM flags WINDOW w AS (PARTITION BY page_id ORDER BY i)),
  openers AS (SELECT d.page_id, d.i AS d, max(i.i) AS i FROM sums d JOIN sums i ON d.page_id = i.page_id
    AND i.i <= d.i AND i.o = 1 AND i.s >= d.s WHERE d.listed GROUP BY ALL),
  closers AS (SELECT d.page_id, d.i AS d, min(i.i) AS i FROM sums d JOIN sums i ON d.page_id = i.page_id
    AND i.i >= d.i AND i.c = 1 AND i.fb - d.fb + i.pre - 1 < 0 WHERE d.listed GROUP BY ALL),
  headers AS (SELECT DISTINCT s.page_id, h.i FROM openers p JOIN sums s ON s.page_id = p.page_id AND s.i = p.i
    JOIN lines h ON h.page_id = s.page_id AND h.i > s.last_stop AND h.i < s.i WHERE s.c = 0),
  found AS (SELECT page_id, i FROM openers UNION SELECT page_id, i FROM closers UNION SELECT page_id, i FROM headers)"""


def _pages_with_lines(spark, d):
    from faultline.functions.text import let
    from faultline.registry.inputs import listed

    return pages_as_code(spark, d).select("page_id", "code", let(code_lines("code"), listed).alias("nums"))


@query(
    "enclosing_scope_lines",
    f"""WITH {_PAGE_LINES_SQL} SELECT page_id, string_agg(i::varchar, ' ' ORDER BY i) AS lines FROM found
    GROUP BY page_id""",
)
def enclosing_scope_lines(spark, d):
    lines = changes.scope_lines(_pages_with_lines(spark, d), "page_id", "code", "nums")
    return lines.select("page_id", F.array_join(F.col("lines").cast("array<string>"), " ").alias("lines"))


@query(
    "enclosing_scope_text",
    f"""WITH {_PAGE_LINES_SQL} SELECT p.page_id, coalesce(string_agg(l.raw, chr(10) ORDER BY f.i), '') AS context
    FROM pages p LEFT JOIN found f ON p.page_id = f.page_id
    LEFT JOIN lines l ON l.page_id = f.page_id AND l.i = f.i GROUP BY p.page_id""",
)
def enclosing_scope_text(spark, d):
    pages = changes.with_scope_context(_pages_with_lines(spark, d), "page_id", "code", "nums", "context")
    return pages.select("page_id", "context")
