"""Stage tables: CSV with multi-line code, Parquet, folders per project or split, result files, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.cluster import stage_path
from faultline.operators.ranking import row_index
from faultline.sources.files import read_files

# Names of the index column, and of the parts of result file names.
INDEX_COLUMN = "Unnamed: 0"
RESULT_LAYOUTS = {
    5: ("feature_type", "feature_scope", "token", "fold"),
    7: ("feature_type", "feature_scope", "token", "cvss", "label", "fold"),
}

# Fixed value: the only label family that seven-part names may carry.
LABEL_FAMILY = "cvss2"

FUNCTION_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType())]
    + [
        T.StructField(name, T.StringType())
        for name in (
            "CVE ID", "CWE ID", "file_name", "files_changed", "codeLink", "Publish Date", "Score", "Summary",
            "Update Date", "commit_id", "commit_message", "func_before", "func_after", "project", "diff",
        )
    ]
    + [T.StructField(name, T.IntegerType()) for name in ("vul", "del_lines")]
    + [T.StructField("Complexity", T.StringType())]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, index: str | None = "id") -> DataFrame:
    """CSV whose cells may hold line breaks and quotes; a leading unnamed index column becomes ``index``.

    Columns are matched by position, so the schema lists them in file order. One file is one task: large
    inputs should come as many files, or be turned into Parquet once.
    """
    frame = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return frame.withColumnRenamed(INDEX_COLUMN, index) if index and INDEX_COLUMN in frame.columns else frame


def read_functions(spark: SparkSession, path: str, schema: T.StructType = FUNCTION_SCHEMA) -> DataFrame:
    return read_csv(spark, path, schema)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ("partition",), format: str = "parquet") -> str:
    """Write a stage table, in folders per split by default, so a split is read without the others."""
    keys = [c for c in partition_by if c in df.columns]
    writer = df.write.mode("overwrite")
    if keys:
        writer = writer.partitionBy(*keys)
    if format == "csv":
        writer.csv(path, header=True, quote='"', escape='"')
    else:
        writer.format(format).save(path)
    return path


def write_by_project(df: DataFrame, path: str, column: str = "project") -> str:
    """One folder per project. Tasks write their own files, so a large project is not funnelled into one task."""
    return write_stage(df, path, [column])


def with_dense_id(df: DataFrame, order: Sequence[str], bucket: Column, out: str = "id") -> DataFrame:
    """Append 0..n-1 in the order of the given columns, numbered bucket by bucket."""
    return row_index(df, out, [F.col(c) for c in order], bucket)


# --- sequences in cells ------------------------------------------------------------------------------


def parse_ints(c: Column) -> Column:
    """``"3 4 5"`` to an array; empty or missing text gives an empty array."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: w.cast("int"))


def parse_floats(c: Column) -> Column:
    """``"[0.5, 1e-3]"`` to an array of doubles."""
    return F.from_json(c, "array<double>")


def format_numbers(c: Column) -> Column:
    """Array to space-joined text."""
    return F.array_join(c.cast("array<string>"), " ")


# --- result files ------------------------------------------------------------------------------------


def with_file_columns(df: DataFrame, path: Column, parts: int) -> DataFrame:
    """Keep rows whose file name has exactly that many parts and turn the parts into columns.

    Five parts: feature type, scope, token, fold. Seven: the two label parts become ``scenario``.
    """
    names = RESULT_LAYOUTS[parts]
    split = df.withColumn("__parts", F.split(F.element_at(F.split(path, "/"), -1), "_"))
    kept = split.filter(F.size("__parts") == parts)
    columns = {n: F.get("__parts", F.lit(i)) for i, n in enumerate(names)}
    if parts == 7:
        kept = kept.filter(F.get("__parts", F.lit(names.index("cvss"))) == LABEL_FAMILY)
        columns["scenario"] = F.concat_ws("_", columns.pop("cvss"), columns.pop("label"))
    return kept.withColumns(columns).drop("__parts")


def read_results(spark: SparkSession, folder: str, parts: int, schema: T.StructType | str) -> DataFrame:
    """All result CSV files of a folder whose names have the given number of parts, as one table.

    Columns are matched by name in the task that reads a file, so headers neither reach the driver nor add to the plan,
    and one task reads many files. A column that a file does not have is null, like a cell that does not parse. A header
    with a column that ``schema`` does not list is refused. A file is one row until it is cut, so files must fit a task;
    a cell holds no line break. Rows have ``schema`` and the columns of the file name; file names may repeat rows.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    # The small files are opened once: the test of the headers and the rows both read the staged texts.
    path = stage_path(spark, "result-texts")
    read_files(spark, folder).withColumnsRenamed({"name": "__file", "text": "value"}).write.parquet(path)
    named = with_file_columns(spark.read.parquet(path), F.col("__file"), parts)
    width = len(wanted) + 1
    cells = ", ".join(f"c{i} string" for i in range(width))

    def parsed(line: Column, strip: bool) -> Column:
        options = {"ignoreLeadingWhiteSpace": str(strip).lower(), "ignoreTrailingWhiteSpace": str(strip).lower()}
        row = F.from_csv(line, cells, options)
        return F.array(*[row[f"c{i}"] for i in range(width)])

    lines = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")
    headed = named.withColumns({"__lines": F.filter(lines, lambda x: x != "")}).drop("value").filter(F.size("__lines") > 0)
    headed = headed.withColumn("__head", parsed(F.get("__lines", F.lit(0)), strip=True))
    # More columns than the schema and the index column: at least one is not listed.
    listed = F.array(*[F.lit(c) for c in (*wanted.names, INDEX_COLUMN, "")])
    strange = F.array_except(F.array_compact("__head"), listed)
    first = F.split(F.get("__lines", F.lit(0)), ",")
    bad = headed.select("__file", F.when(F.size(strange) > 0, strange).when(F.size(first) > width, first).alias("strange"))
    refused = bad.filter("strange IS NOT NULL").first()
    if refused is not None:
        raise ValueError(f"columns {list(refused['strange'])} of {refused['__file']} are not in the schema")
    rows = headed.withColumn("__line", F.explode(F.slice("__lines", 2, F.greatest(F.size("__lines") - 1, F.lit(0)))))
    rows = rows.withColumn("__cells", parsed(F.col("__line"), strip=False))

    def column(field: T.StructField) -> Column:
        at = F.array_position("__head", F.lit(field.name)) - 1
        return F.when(at >= 0, F.get("__cells", at.cast("int"))).try_cast(field.dataType)

    table = rows.withColumns({f.name: column(f) for f in wanted})
    return table.drop("__file", "__lines", "__line", "__head", "__cells")
