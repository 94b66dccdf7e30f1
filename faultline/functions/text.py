"""Code-text functions: comment removal, whitespace clean-up, tokenizer, signatures, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Operator tokens, longest spelling first where one is a prefix of another.
OPERATOR_TOKENS = (
    r"<=", r">=", r"<", r">", r"\?", r"/=", r"\+=", r"-=", r"\+\+", r"--", r"\*=", r"\+", r"-", r"\*", r"/",
    r"!=", r"==", r"=", r"!", r"&=", r"&", r"%", r"\|\|", r"\|=", r"\|", r"\$", r":",
)
TOKEN_PATTERN = "|".join(OPERATOR_TOKENS) + "|[a-zA-Z0-9]+"

# One alternative per lexeme: line comment, block comment, character literal, string literal, plain run, and
# a single leftover quote or slash. Literal loops are unrolled so long strings cannot overflow the regex stack.
LEXEME_PATTERN = (
    r"(?s)//[^\n]*|/\*.*?\*/"
    r"|'[^'\\]*(?:\\.[^'\\]*)*'"
    r'|"[^"\\]*(?:\\.[^"\\]*)*"'
    r"""|[^/'"]+|[/'"]"""
)
MASK = "<STR>"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unfold(array: ColumnOrName) -> Column:
    """Rows of an array. A bare explode of a computed array makes the optimizer test its size first, which
    computes the array twice; behind a transform it is computed once."""
    return F.explode(F.transform(array, lambda x: x))


def unfold_numbered(array: ColumnOrName, position: str, value: str) -> Column:
    """Rows of an array with their 0-based position, computed once as in ``unfold``."""
    return F.inline(F.transform(array, lambda x, i: F.struct(i.alias(position), x.alias(value))))


def code_lines(c: ColumnOrName) -> Column:
    """Lines of a text as an array; a final newline does not start another line, empty text has none."""
    return let(
        F.split(_col(c), "\n"),
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a),
    )


def line_count(c: ColumnOrName) -> Column:
    """Number of newline-separated pieces, counting a trailing empty one."""
    c = _col(c)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def remove_empty_lines(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), r"(?m)^\n", "")


def remove_comments(c: ColumnOrName) -> Column:
    """Replace ``//`` and ``/* */`` comments by one space; literals and unterminated openers stay."""
    lexemes = F.regexp_extract_all(_col(c), F.lit(LEXEME_PATTERN), F.lit(0))
    is_comment = lambda t: t.startswith("//") | (t.startswith("/*") & (F.length(t) > 1))
    return F.array_join(F.transform(lexemes, lambda t: F.when(is_comment(t), F.lit(" ")).otherwise(t)), "")


def strip_line_ends(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), r"(?m)\s+$", "")


def strip_line_starts(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), r"(?m)^\s+", "")


def clean_code(c: ColumnOrName) -> Column:
    """Empty lines, comments, trailing blanks, leading blanks - removed in this order."""
    return strip_line_starts(strip_line_ends(remove_comments(remove_empty_lines(c))))


def cut_line_comment(line: Column) -> Column:
    """Text before ``//``, else the line without its first same-line block comment."""
    opened, closed = F.instr(line, "/*"), F.instr(line, "*/")
    without_block = F.concat(F.substr(line, F.lit(1), opened - 1), F.substr(line, closed + 2))
    return (
        F.when(F.contains(line, F.lit("//")), F.substring_index(line, "//", 1))
        .when((opened > 0) & (closed > 0), without_block)
        .otherwise(line)
    )


def filter_lines(lines: Column) -> Column:
    """Apply ``cut_line_comment`` to every line of an array and join with newlines."""
    return F.array_join(F.transform(lines, cut_line_comment), "\n")


def remove_annotations(c: ColumnOrName, mode: str = "fixed") -> Column:
    """Drop comments line by line, carrying an in-block flag over lines; blank results disappear.

    ``mode='compat'`` keeps a known quirk: after a same-line block comment the text following ``/*`` survives.
    Lines are folded in blocks of about sqrt(n), so growing the output array stays cheap for long texts.
    """
    if mode not in ("fixed", "compat"):
        raise ValueError(f"unknown mode {mode!r}")
    state = "struct<open:boolean,out:array<string>>"

    def step(acc: Column, line: Column) -> Column:
        slashes = F.contains(line, F.lit("//"))
        opens = F.contains(line, F.lit("/*"))
        closes = F.contains(line, F.lit("*/"))
        before = F.substring_index(line, "/*", 1)
        if mode == "compat":
            rest = F.substr(line, F.instr(line, "/*") + 2)
        else:
            # the closer that follows the opener, not one that ends an earlier block
            rest = let(
                F.substr(line, F.instr(line, "/*") + 2),
                lambda r: F.when(F.instr(r, "*/") > 0, F.substr(r, F.instr(r, "*/") + 2)).otherwise(F.lit("")),
            )
        closed_here = closes if mode == "compat" else F.instr(F.substr(line, F.instr(line, "/*") + 2), "*/") > 0
        text = (
            F.when(slashes, F.substring_index(line, "//", 1))
            .when(opens & closed_here, F.concat(before, rest))
            .when(opens, before)
            .when(closes, F.substr(line, F.instr(line, "*/") + 2))
            .when(~acc["open"], line)
        )
        still_open = (
            F.when(slashes, acc["open"]).when(opens, ~closed_here).when(closes, F.lit(False)).otherwise(acc["open"])
        )
        kept = let(
            text,
            lambda t: F.when(
                t.isNotNull() & F.rlike(t, F.lit(r"\S")), F.concat(acc["out"], F.array(t))
            ).otherwise(acc["out"]),
        )
        return F.struct(still_open.alias("open"), kept.alias("out")).cast(state)

    def start(open_: Column) -> Column:
        return F.struct(open_.alias("open"), F.array().cast("array<string>").alias("out")).cast(state)

    def over_blocks(lines: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(lines))).cast("int"), F.lit(1))
        firsts = F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)), width)
        blocks = F.transform(firsts, lambda s: F.slice(lines, s, width))
        outer = "struct<open:boolean,out:array<array<string>>>"
        zero = F.struct(F.lit(False).alias("open"), F.array().cast("array<array<string>>").alias("out")).cast(outer)
        folded = F.aggregate(
            blocks,
            zero,
            lambda acc, block: let(
                F.aggregate(block, start(acc["open"]), step),
                lambda r: F.struct(r["open"].alias("open"), F.concat(acc["out"], F.array(r["out"])).alias("out")).cast(
                    outer
                ),
            ),
        )
        return F.array_join(F.flatten(folded["out"]), "\n")

    return let(F.split(_col(c), "\n"), over_blocks)


def remove_file_separators(c: ColumnOrName) -> Column:
    """Drop ``##<END>##`` markers together with the one line break character behind them."""
    return F.regexp_replace(_col(c), r"##<END>##[\r\n]", "")


def tokenize_code(c: ColumnOrName) -> Column:
    """Operators and alphanumeric runs, case kept; brackets, ``;``, ``,``, ``.`` and ``_`` separate tokens."""
    return F.regexp_extract_all(_col(c), F.lit(TOKEN_PATTERN), F.lit(0))


def strip_blanks(c: ColumnOrName) -> Column:
    """Remove all whitespace; two lines are equal up to blanks iff these are equal."""
    return F.regexp_replace(_col(c), r"\s+", "")


def function_name(c: ColumnOrName) -> Column:
    """Last word before the first ``(`` without leading ``*``/``&`` marks; NULL when there is no ``(``."""
    c = _col(c)
    head = F.when(F.instr(c, "(") > 0, F.substring_index(c, "(", 1))
    word = F.regexp_extract(head, r"(\S+)\s*$", 1)
    return F.regexp_replace(word, r"^[^_a-zA-Z]+", "")


def signature_key(c: ColumnOrName) -> Column:
    """Function name plus parameter list up to the first ``)``, without whitespace."""
    c = _col(c)
    opened, closed = F.instr(c, "("), F.instr(c, ")")
    params = F.when(closed > opened, F.substr(c, opened, closed - opened + 1)).otherwise(F.lit(""))
    return strip_blanks(F.concat(function_name(c), params))


def mask_literals(c: ColumnOrName, braces: bool = True) -> Column:
    """Mask double-backtick, single-quoted, double-quoted and (optionally) braced spans, greedy within a line."""
    spans = ["``[^\n]*``", "'[^\n]*'", '"[^\n]*"'] + ([r"\{[^\n]*\}"] if braces else [])
    masked = _col(c)
    for span in spans:
        masked = F.regexp_replace(masked, span, MASK)
    return masked


def same_ignoring_blanks(a: ColumnOrName, b: ColumnOrName) -> Column:
    return strip_blanks(a) == strip_blanks(b)


def node_code(code: ColumnOrName, name: ColumnOrName) -> Column:
    """Code of a graph node, falling back to its name when the code is ``<empty>``, blank or missing."""
    code = _col(code)
    return F.when(code.isNull() | code.isin("<empty>", ""), _col(name)).otherwise(code)


def node_label(label: ColumnOrName, line: ColumnOrName, code: ColumnOrName, name: ColumnOrName) -> Column:
    """``LABEL_line: code`` with an empty line part for nodes without a line."""
    number = F.coalesce(_col(line).cast("string"), F.lit(""))
    return F.concat(_col(label), F.lit("_"), number, F.lit(": "), F.coalesce(node_code(code, name), F.lit("")))


def base_name(path: ColumnOrName) -> Column:
    """File name without its folders."""
    return F.substring_index(_col(path), "/", -1)


# Repository paths that stand for a short project name.
PROJECT_ALIASES = {
    "platform%2Fsystem%2Fcore": "core",
    "kernel%2Fcommon": "common",
    "platform%2Fframeworks%2Fav": "av",
}


def project_name(link: ColumnOrName) -> Column:
    """Last path segment before ``/+`` in a code link, with three aliases; NULL without a ``+``."""
    head = F.regexp_extract(_col(link), r"^([^+]*)[^+]\+", 1)
    segment = F.when(F.contains(_col(link), F.lit("+")), F.substring_index(head, "/", -1))
    named = segment
    for path, short in PROJECT_ALIASES.items():
        named = F.when(segment == path, F.lit(short)).otherwise(named)
    return named
