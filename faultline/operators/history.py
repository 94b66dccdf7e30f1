"""Which change introduced a defect: candidate commits per fix, and the function inside them.

Repository history comes as tables:
  deleted: fix_id, project, file, line_key, fix_ts, fix_file   - lines a fix removed
  history: project, file, line_key, commit, commit_ts          - every commit that wrote a line
  methods: commit, file, position, name, long_name, before_start, before_end, after_start, after_end
  files:   commit, file, source_before, source_after
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.contexts import extract_code
from faultline.functions.text import base_name, function_name, signature_key, strip_blanks, unfold
from faultline.operators.ranking import running_max

LINE = ["project", "file", "line_key"]


def _in_fixed_file(deleted: DataFrame) -> DataFrame:
    """Only lines of the fixed file where the fix touched it by name, otherwise all its lines."""
    same = base_name("file") == base_name("fix_file")
    touched = deleted.filter(same).select("fix_id").distinct().withColumn("__touched", F.lit(True))
    marked = deleted.join(touched.hint("merge"), "fix_id", "left")
    return marked.filter(same | F.col("__touched").isNull()).drop("__touched")


def blame_candidates(deleted: DataFrame, history: DataFrame, bucket: Column) -> DataFrame:
    """Distinct (fix_id, commit, commit_ts): per deleted line the latest commit strictly before the fix.

    An as-of join without pairs: both tables become one time line per source line, and a running maximum of
    (time, commit) is read off at every fix. ``bucket`` follows ``ts`` and splits lines with a long history.
    """
    writes = history.select(
        *LINE, F.col("commit_ts").alias("ts"), F.lit(1).alias("kind"), F.struct("commit_ts", "commit").alias("write")
    )
    asks = _in_fixed_file(deleted).select(*LINE, F.col("fix_ts").alias("ts"), F.lit(0).alias("kind"), "fix_id")
    events = writes.unionByName(asks, allowMissingColumns=True)
    order = [F.col("ts"), F.col("kind")]  # a fix comes before a write of the same instant
    latest = running_max(events, F.col("write"), "latest", order, bucket, LINE, many_groups=True)
    found = latest.filter("kind = 0 AND latest IS NOT NULL")
    return found.select("fix_id", "latest.commit", "latest.commit_ts").distinct()


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """(fix_id, commits): comma-joined in commit time. A list holds at most one commit per deleted line."""
    ordered = F.array_sort(F.collect_list(F.struct("commit_ts", "commit")))
    names = F.transform(ordered, lambda c: c["commit"].cast("string"))
    return candidates.groupBy("fix_id").agg(F.array_join(names, ",").alias("commits"))


def _keys(text: Column, longest: int = 3) -> Column:
    """Distinct substrings of up to three characters."""
    grams = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in range(1, longest + 1)]
    return F.array_distinct(F.flatten(F.array(*grams)))


def match_methods(fixes: DataFrame, candidates: DataFrame, methods: DataFrame) -> DataFrame:
    """Best method per fix: (fix_id, tier, commit, file, position).

    Tier 1: equal signature up to blanks. Tier 2: the function name occurs in the method name. Within a tier the
    earliest commit and the first method win. Both tiers are equi-joins: the second one meets on a short piece
    of the name before it tests containment, so a file with many methods is not paired with every fix.
    Methods of equal name shrink to the first one, and fixes that ask for the same function of the same file ask once,
    so no join pairs repeated rows with each other. The joins are never broadcast, as the size of a text column computed
    from a small one is estimated far too low.
    ``fixes`` holds fix_id, file_name, func_before; ``candidates`` fix_id, commit, commit_ts.
    """
    wanted = fixes.select(
        "fix_id",
        base_name("file_name").alias("base"),
        signature_key("func_before").alias("signature"),
        function_name("func_before").alias("function"),
    )
    asked = candidates.join(wanted.hint("merge"), "fix_id").filter("function IS NOT NULL AND function <> ''")
    offered = methods.select(
        "commit", "file", base_name("file").alias("base"), "position", "name", strip_blanks("long_name").alias("signature")
    )
    place = ["commit", "base"]
    first = F.min(F.struct("position", "file")).alias("method")

    def best(matches: DataFrame, tier: int) -> DataFrame:
        earliest = F.min(F.struct("commit_ts", "commit", "method"))
        return matches.groupBy("fix_id").agg(F.struct(F.lit(tier).alias("tier"), earliest.alias("m")).alias("b"))

    signed = offered.groupBy(*place, "signature").agg(first)
    by_signature = best(asked.join(signed.hint("merge"), [*place, "signature"]), 1)
    open_fixes = asked.join(by_signature.select("fix_id").hint("merge"), "fix_id", "left_anti")
    named = offered.groupBy(*place, "name").agg(first).withColumn("piece", unfold(_keys(F.col("name"))))
    probe = open_fixes.select(*place, "function").distinct().withColumn("piece", F.substring("function", 1, 3))
    holding = probe.join(named.hint("merge"), [*place, "piece"]).filter(F.contains(F.col("name"), F.col("function")))
    answers = holding.groupBy(*place, "function").agg(F.min("method").alias("method"))
    by_name = best(open_fixes.join(answers.hint("merge"), [*place, "function"]), 2)
    found = by_signature.unionByName(by_name)
    return found.select("fix_id", "b.tier", "b.m.commit", "b.m.method.file", "b.m.method.position")


def introducing_functions(
    fixes: DataFrame, candidates: DataFrame, methods: DataFrame, files: DataFrame
) -> DataFrame:
    """(fix_id, blaming_commit, blaming_func_before, blaming_func_after); empty texts where nothing matches."""
    best = match_methods(fixes, candidates, methods)
    spans = methods.select("commit", "file", "position", "before_start", "before_end", "after_start", "after_end")
    texts = best.join(spans.hint("merge"), ["commit", "file", "position"]).join(files.hint("merge"), ["commit", "file"])

    def cut(source: str, start: str, end: str) -> Column:
        numbers = F.when(F.col(start) <= F.col(end), F.sequence(F.col(start), F.col(end)))
        return F.coalesce(extract_code(F.col(source), numbers), F.lit(""))

    found = texts.select(
        "fix_id",
        F.col("commit").alias("blaming_commit"),
        cut("source_before", "before_start", "before_end").alias("blaming_func_before"),
        cut("source_after", "after_start", "after_end").alias("blaming_func_after"),
    )
    joined = fixes.select("fix_id").join(found.hint("merge"), "fix_id", "left")
    return joined.fillna("", subset=["blaming_func_before", "blaming_func_after"])
