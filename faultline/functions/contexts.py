"""Line-number contexts around listed lines, computed inside the row.

Inputs enter every lambda through ``let``: the optimizer may replace a captured column by the expression behind
it, which would then be computed again for every array element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import code_lines, filter_lines, let

# Surrounding lines on either side, at the call and by default.
SCOPE_LINES = 6
DEFAULT_SCOPE_LINES = 5


def _empty() -> Column:
    return F.array().cast("array<int>")


def _as_int(numbers: Column) -> Column:
    return F.transform(F.coalesce(numbers, _empty()), lambda n: n.cast("int"))


def pick_lines(lines: Column, numbers: Column, wrap_zero: bool = False) -> Column:
    """Listed 1-based lines in list order, as an array; numbers outside the text are skipped.

    ``wrap_zero`` reads the last line for number 0, which goes with the ``compat`` surroundings.
    """

    def pick(v: Column) -> Column:
        wanted = v["nums"]
        if wrap_zero:
            wanted = F.transform(wanted, lambda n: F.when(n == 0, F.size(v["lines"])).otherwise(n))
        inside = F.filter(wanted, lambda n: (n >= 1) & (n <= F.size(v["lines"])))
        return F.transform(inside, lambda n: F.get(v["lines"], n - 1))

    return let(F.struct(lines.alias("lines"), _as_int(numbers).alias("nums")), pick)


def extract_code(code: Column, numbers: Column) -> Column:
    """Listed lines joined by newlines; a missing list gives an empty text."""
    return F.array_join(pick_lines(code_lines(code), numbers), "\n")


def all_line_numbers(code: Column) -> Column:
    return let(
        code_lines(code),
        lambda lines: F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines))).otherwise(_empty()),
    )


def other_line_numbers(code: Column, numbers: Column) -> Column:
    """Lines of the text that are not listed."""
    return F.array_except(all_line_numbers(code), _as_int(numbers))


def surrounding_line_numbers(
    code: Column, numbers: Column, k: int = DEFAULT_SCOPE_LINES, mode: str = "clamped"
) -> Column:
    """Listed lines plus k lines on either side, sorted and distinct, within 1..n.

    ``mode='compat'`` clamps to 0..n-1 on 1-based numbers: 0 then stands for the last line and line n is lost
    unless it is listed.
    """
    if mode not in ("clamped", "compat"):
        raise ValueError(f"unknown mode {mode!r}")
    first, last_offset = (1, 0) if mode == "clamped" else (0, 1)

    def around(v: Column) -> Column:
        n_lines, listed = v["n"], v["listed"]
        last = n_lines - last_offset
        if mode == "clamped":
            listed = F.filter(listed, lambda n: (n >= 1) & (n <= n_lines))

        def window(n: Column) -> Column:
            low, high = F.greatest(F.lit(first), n - k), F.least(last, n + k)
            return F.when(low <= high, F.sequence(low, high)).otherwise(_empty())

        spans = F.flatten(F.transform(listed, window))
        return F.array_sort(F.array_distinct(F.concat(listed, spans)))

    return let(F.struct(F.size(code_lines(code)).alias("n"), _as_int(numbers).alias("listed")), around)


def surrounding_only_line_numbers(code: Column, numbers: Column, k: int = SCOPE_LINES) -> Column:
    return F.array_except(surrounding_line_numbers(code, numbers, k), _as_int(numbers))


def random_line_numbers(key: Column, code: Column, numbers: Column) -> Column:
    """As many unlisted lines as there are listed ones, in the order of md5(key:line)."""

    def choose(v: Column) -> Column:
        keyed = F.transform(
            v["rest"],
            lambda n: F.struct(
                F.md5(F.concat_ws(":", v["key"], n.cast("string")).cast("binary")).alias("h"), n.alias("n")
            ),
        )
        size = F.least(F.size(F.array_distinct(v["listed"])), F.size(v["rest"]))
        return F.transform(F.slice(F.array_sort(keyed), F.lit(1), size), lambda s: s["n"])

    rest = other_line_numbers(code, numbers)
    values = F.struct(key.cast("string").alias("key"), rest.alias("rest"), _as_int(numbers).alias("listed"))
    return let(values, choose)


def scope_text(code: Column, numbers: Column, wrap_zero: bool = False) -> Column:
    """Listed lines with per-line comments cut."""
    return filter_lines(pick_lines(code_lines(code), numbers, wrap_zero))


def whole_text(code: Column) -> Column:
    return filter_lines(code_lines(code))


def neighbour_text(lines: Column, index: Column) -> Column:
    """Previous, this and next line that exist, for a 0-based position in an array of lines."""
    start = F.greatest(index, F.lit(1))
    stop = F.least(index + 2, F.size(lines))
    return F.array_join(F.slice(lines, start, stop - start + 1), "\n")
