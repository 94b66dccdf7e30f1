"""Queries over code-text functions. HTML pages are the code-like input: they hold comments, braces and quotes."""

from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.operators import clean
from faultline.registry.catalog import query, sql_lines, sql_quote, table

LEX_SQL = sql_quote(T.LEXEME_PATTERN)
TOKEN_SQL = sql_quote(T.TOKEN_PATTERN)


def sql_uncomment(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, {LEX_SQL}), lambda t: "
        "CASE WHEN t LIKE '//%' OR (t LIKE '/*%' AND length(t) > 1) THEN ' ' ELSE t END), '')"
    )


def sql_clean(text: str) -> str:
    step1 = f"regexp_replace({text}, '(?m)^\\n', '', 'g')"
    step3 = f"regexp_replace({sql_uncomment(step1)}, '(?m)\\s+$', '', 'g')"
    return f"regexp_replace({step3}, '(?m)^\\s+', '', 'g')"


# Pages have few line breaks; both engines add them behind tags, braces and semicolons.
def sql_page_code() -> str:
    return (
        "replace(replace(replace(replace(html, '>', '>' || chr(10)), ';', ';' || chr(10)), "
        "'{', '{' || chr(10)), '}', '}' || chr(10))"
    )


def page_code():
    code = F.col("html")
    for mark in (">", ";", "{", "}"):
        code = F.replace(code, F.lit(mark), F.lit(mark + "\n"))
    return code


def pages_as_code(spark, d):
    return table(spark, d, "pages").select("page_id", page_code().alias("code"))


@query("remove_empty_lines", r"SELECT doc_id, regexp_replace(text, '(?m)^\n', '', 'g') AS code FROM documents")
def remove_empty_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", T.remove_empty_lines("text").alias("code"))


@query("remove_comments", f"SELECT page_id, {sql_uncomment('html')} AS code FROM pages")
def remove_comments(spark, d):
    return table(spark, d, "pages").select("page_id", T.remove_comments("html").alias("code"))


@query("strip_line_ends", r"SELECT doc_id, regexp_replace(text, '(?m)\s+$', '', 'g') AS code FROM documents")
def strip_line_ends(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_line_ends("text").alias("code"))


@query("strip_line_starts", r"SELECT doc_id, regexp_replace(text, '(?m)^\s+', '', 'g') AS code FROM documents")
def strip_line_starts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_line_starts("text").alias("code"))


@query(
    "clean_code",
    f"""SELECT 'document' AS kind, doc_id AS id, {sql_clean('text')} AS code FROM documents
    UNION ALL SELECT 'page', page_id, {sql_clean('html')} FROM pages""",
)
def clean_code(spark, d):
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html"))
    both = docs.unionByName(pages.withColumnRenamed("html", "text"))
    return both.select("kind", "id", T.clean_code("text").alias("code"))


_CUT_SQL = """CASE WHEN contains(l, '//') THEN substr(l, 1, instr(l, '//') - 1)
    WHEN contains(l, '/*') AND contains(l, '*/')
      THEN substr(l, 1, instr(l, '/*') - 1) || substr(l, instr(l, '*/') + 2)
    ELSE l END"""


@query(
    "filter_comments_per_line",
    f"""SELECT page_id, array_to_string(list_transform({sql_lines('code')}, lambda l: {_CUT_SQL}), chr(10)) AS code
    FROM (SELECT page_id, {sql_page_code()} AS code FROM pages)""",
)
def filter_comments_per_line(spark, d):
    return pages_as_code(spark, d).select("page_id", T.filter_lines(T.code_lines("code")).alias("code"))


# Pages hold url slashes but few block comments; both engines turn tag brackets into block comment marks.
_COMMENTED_SQL = (
    "replace(replace(replace(replace(html, '<!--', '/*'), '-->', '*/'), '<style>', chr(10) || '/*'), "
    "'</style>', '*/' || chr(10))"
)


def _annotation_sql(body: str) -> str:
    """State of a line = last earlier line that opened or closed a block; written as a window, not as a fold."""
    closed_here = "contains(l, '*/')" if body == "compat" else "contains(substr(l, instr(l, '/*') + 2), '*/')"
    if body == "compat":
        rest = "substr(l, instr(l, '/*') + 2)"
    else:
        tail = "substr(l, instr(l, '/*') + 2)"
        rest = f"substr({tail}, instr({tail}, '*/') + 2)"
    return f"""
    WITH lines AS (
      SELECT page_id, i, list_extract(ls, i) AS l FROM (
        SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
          SELECT page_id, string_split({_COMMENTED_SQL}, chr(10)) AS ls FROM pages))),
    marked AS (SELECT *, CASE WHEN contains(l, '//') THEN NULL
        WHEN contains(l, '/*') THEN (CASE WHEN {closed_here} THEN 0 ELSE 1 END)
        WHEN contains(l, '*/') THEN 0 END AS sets FROM lines),
    state AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM marked),
    cut AS (SELECT page_id, i, CASE WHEN contains(l, '//') THEN substr(l, 1, instr(l, '//') - 1)
        WHEN contains(l, '/*') AND {closed_here} THEN substr(l, 1, instr(l, '/*') - 1) || {rest}
        WHEN contains(l, '/*') THEN substr(l, 1, instr(l, '/*') - 1)
        WHEN contains(l, '*/') THEN substr(l, instr(l, '*/') + 2)
        WHEN open = 0 THEN l END AS t FROM state)
    SELECT p.page_id, coalesce(c.code, '') AS code FROM pages p LEFT JOIN (
      SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS code FROM cut
      WHERE t IS NOT NULL AND regexp_matches(t, '\\S') GROUP BY page_id) c ON p.page_id = c.page_id"""


def _commented(spark, d):
    code = F.col("html")
    for old, new in (("<!--", "/*"), ("-->", "*/"), ("<style>", "\n/*"), ("</style>", "*/\n")):
        code = F.replace(code, F.lit(old), F.lit(new))
    return table(spark, d, "pages").select("page_id", code.alias("code"))


@query("remove_annotations", _annotation_sql("fixed"))
def remove_annotations(spark, d):
    return _commented(spark, d).select("page_id", T.remove_annotations("code").alias("code"))


@query("remove_annotations_compat", _annotation_sql("compat"))
def remove_annotations_compat(spark, d):
    return _commented(spark, d).select("page_id", T.remove_annotations("code", "compat").alias("code"))


@query(
    "remove_file_separators",
    r"""SELECT conv_id, turn, regexp_replace(replace(text, ' ', '##<END>##' || chr(10)), '##<END>##[\r\n]', '', 'g')
    AS code FROM conversations""",
)
def remove_file_separators(spark, d):
    joined = F.replace(F.col("text"), F.lit(" "), F.lit("##<END>##\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.remove_file_separators(joined).alias("code"))


@query(
    "tokenize_code",
    f"""SELECT 'document' AS kind, doc_id AS id, array_to_string(regexp_extract_all(text, {TOKEN_SQL}), ' ') AS tokens
    FROM documents UNION ALL
    SELECT 'page', page_id, array_to_string(regexp_extract_all(html, {TOKEN_SQL}), ' ') FROM pages""",
)
def tokenize_code(spark, d):
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, d, "pages").selectExpr("'page' AS kind", "page_id AS id", "html AS text")
    return docs.unionByName(pages).select("kind", "id", F.array_join(T.tokenize_code("text"), " ").alias("tokens"))


@query(
    "signature_key",
    r"""SELECT page_id, regexp_replace(regexp_extract(head, '(\S+)\s*$', 1), '^[^_a-zA-Z]+', '') AS name,
      regexp_replace(regexp_replace(regexp_extract(head, '(\S+)\s*$', 1), '^[^_a-zA-Z]+', '') ||
        (CASE WHEN instr(html, ')') > instr(html, '(')
         THEN substr(html, instr(html, '('), instr(html, ')') - instr(html, '(') + 1) ELSE '' END),
        '\s+', '', 'g') AS signature
    FROM (SELECT *, CASE WHEN instr(html, '(') > 0 THEN substr(html, 1, instr(html, '(') - 1) END AS head FROM pages)""",
)
def signature_key(spark, d):
    return table(spark, d, "pages").select(
        "page_id", T.function_name("html").alias("name"), T.signature_key("html").alias("signature")
    )


def _mask_sql(text: str, braces: bool) -> str:
    spans = ["``[^\n]*``", "'[^\n]*'", '"[^\n]*"'] + ([r"\{[^\n]*\}"] if braces else [])
    for span in spans:
        text = f"regexp_replace({text}, {sql_quote(span)}, '<STR>', 'g')"
    return text


@query(
    "mask_literals",
    f"""SELECT page_id, {_mask_sql('html', True)} AS with_braces, {_mask_sql('html', False)} AS without_braces
    FROM pages""",
)
def mask_literals(spark, d):
    return table(spark, d, "pages").select(
        "page_id",
        T.mask_literals("html").alias("with_braces"),
        T.mask_literals("html", braces=False).alias("without_braces"),
    )


@query(
    "same_ignoring_blanks",
    r"""SELECT doc_id, regexp_replace(text, '\s+', '', 'g') = regexp_replace(replace(text, '.', ' . '), '\s+', '', 'g')
      AS padded_equal, regexp_replace(text, '\s+', '', 'g') = regexp_replace(lower(text), '\s+', '', 'g') AS lower_equal
    FROM documents""",
)
def same_ignoring_blanks(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        T.same_ignoring_blanks("text", F.replace(F.col("text"), F.lit("."), F.lit(" . "))).alias("padded_equal"),
        T.same_ignoring_blanks("text", F.lower("text")).alias("lower_equal"),
    )


@query(
    "node_label",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
      'IDENTIFIER_' || (CASE WHEN l_linestatus = 'O' THEN l_linenumber::varchar ELSE '' END) || ': ' ||
      (CASE WHEN l_returnflag = 'N' THEN 'part' || l_partkey ELSE 'n' || l_orderkey END) AS node_label
    FROM lineitem""",
)
def node_label(spark, d):
    items = table(spark, d, "lineitem")
    line = F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))
    code = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("part"), F.col("l_partkey").cast("string"))).when(
        F.col("l_returnflag") == "A", F.lit("<empty>")
    )
    name = F.concat(F.lit("n"), F.col("l_orderkey").cast("string"))
    return items.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        T.node_label(F.lit("IDENTIFIER"), line, code, name).alias("node_label"),
    )


@query(
    "numbered_lines",
    f"""SELECT doc_id, i::int AS line_no, regexp_replace(list_extract(ls, i), '^\\s+|\\s+$', '', 'g') AS line FROM (
      SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
        SELECT doc_id, {sql_lines('text')} AS ls FROM documents))""",
)
def numbered_lines(spark, d):
    return clean.explode_lines(table(spark, d, "documents"), "doc_id", "text")


@query(
    "project_and_file_names",
    """SELECT page_id,
      CASE WHEN contains(link, '+') THEN list_extract(string_split(substr(link, 1, instr(link, '+') - 2), '/'), -1) END
        AS project, list_extract(string_split(url, '/'), -1) AS file_name
    FROM (SELECT page_id, url, replace(url, '?', '/+/') AS link FROM pages)""",
)
def project_and_file_names(spark, d):
    link = F.replace(F.col("url"), F.lit("?"), F.lit("/+/"))
    return table(spark, d, "pages").select(
        "page_id", T.project_name(link).alias("project"), T.base_name("url").alias("file_name")
    )
