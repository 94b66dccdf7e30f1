import pytest
from pyspark.sql import functions as F

from faultline.functions import contexts as C
from faultline.functions import cvss
from faultline.functions import text as T


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(column("c").alias("out")).first()["out"]


@pytest.mark.parametrize(
    "source,expected",
    [
        ("a; // x\nb", "a;  \nb"),
        ('s="//no"; /* m\nl */ t', 's="//no";   t'),
        ("x/y /* open", "x/y /* open"),
        ("it's // c", "it's  "),
        ("'\\'' // q", "'\\''  "),
    ],
)
def test_remove_comments(spark, source, expected):
    assert one(spark, source, T.remove_comments) == expected


def test_blank_handling(spark):
    assert one(spark, "a  \n\n  b \nc  ", T.strip_line_ends) == "a\n  b\nc"
    assert one(spark, "\n\na\n\nb", T.remove_empty_lines) == "a\nb"
    assert one(spark, "  a\n\n\tb", T.strip_line_starts) == "a\nb"
    assert one(spark, "\n  int a; // x\n\n  /* y */ b;  ", T.clean_code) == "int a;\nb;"


def test_per_line_comments(spark):
    df = spark.createDataFrame([("x; // c\na /* b */ d\n*/ a /* b",)], "c string")
    out = df.select(T.filter_lines(T.code_lines("c")).alias("o")).first()["o"]
    assert out == "x; \na  d\n*/ a  a /* b"


def test_remove_annotations_modes(spark):
    source = "a /* one */ b\n/* two\nthree\n*/ c\nd // e\n  \nf"
    assert one(spark, source, T.remove_annotations) == "a  b\n c\nd \nf"
    compat = one(spark, source, lambda c: T.remove_annotations(c, "compat"))
    assert compat == "a  one */ b\n c\nd \nf"


def reference_annotations(code):
    kept, inside = [], False
    for line in code.split("\n"):
        if "//" in line:
            text = line.split("//", 1)[0]
        elif "/*" in line:
            head, tail = line.split("/*", 1)
            inside = "*/" not in tail
            text = head if inside else head + tail.split("*/", 1)[1]
        elif "*/" in line:
            text, inside = line.split("*/", 1)[1], False
        elif inside:
            continue
        else:
            text = line
        if text.strip():
            kept.append(text)
    return "\n".join(kept)


def test_remove_annotations_long(spark):
    pieces = ["x", "/* a", "b */ c", "d // e", "", "f /* g */ h", "*/ i"]
    source = "\n".join(pieces[(i * i + i // 3) % 7] for i in range(400))
    assert one(spark, source, T.remove_annotations) == reference_annotations(source)


def test_tokens_and_signature(spark):
    assert one(spark, "if(a_1<=b) c++;", T.tokenize_code) == ["if", "a", "1", "<=", "b", "c", "++"]
    assert one(spark, "static int *foo (int a)\n{", T.signature_key) == "foo(inta)"
    assert one(spark, "static int *foo (int a)\n{", T.function_name) == "foo"
    assert one(spark, "no_call", T.function_name) is None


def test_project_and_label(spark):
    link = "https://x.org/platform%2Fsystem%2Fcore/+/abc"
    assert one(spark, link, T.project_name) == "core"
    assert one(spark, "https://x.org/libpng/+/1", T.project_name) == "libpng"
    assert one(spark, "name.c", T.base_name) == "name.c"
    df = spark.createDataFrame([("LOCAL", 3, "<empty>", "n")], "l string, i int, c string, n string")
    assert df.select(T.node_label("l", "i", "c", "n").alias("x")).first()["x"] == "LOCAL_3: n"


def test_contexts(spark):
    text = "\n".join("abcdefghij")
    df = spark.createDataFrame([(text, [2])], "code string, nums array<int>")
    code, nums = F.col("code"), F.col("nums")
    row = df.select(
        C.surrounding_line_numbers(code, nums, 6).alias("s"),
        C.surrounding_line_numbers(code, nums, 6, "compat").alias("q"),
        C.surrounding_only_line_numbers(code, nums, 6).alias("o"),
        C.extract_code(code, F.lit(None).cast("array<int>")).alias("none"),
        C.random_line_numbers(F.lit(1), code, nums).alias("r"),
        C.scope_text(code, F.lit([0, 1]), wrap_zero=True).alias("w"),
    ).first()
    assert row["w"] == "j\na"
    assert row["s"] == list(range(1, 9))
    assert row["q"] == list(range(0, 9))
    assert row["o"] == [1, 3, 4, 5, 6, 7, 8]
    assert row["none"] == ""
    assert len(row["r"]) == 1 and row["r"][0] != 2


def test_vectors_and_scores(spark):
    df = spark.createDataFrame([("(AV:N/AC:L/Au:N/C:P/I:P/A:P)", "7.5 HIGH"), ("NaN", "NaN")], "v string, s string")
    parts = {**cvss.parse_vector(F.col("v")), **cvss.parse_score(F.col("s"))}
    rows = df.select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert tuple(rows[0]) == ("N", "L", "N", "P", "P", "P", 7.5, "HIGH")
    assert all(v is None for v in rows[1])


def test_label_distance(spark):
    names = cvss.SCORED_TARGETS
    true = ["NONE", "PARTIAL", "PARTIAL", "NETWORK", "LOW", "NONE", "LOW"]
    pred = ["PARTIAL", "PARTIAL", "PARTIAL", "LOCAL", "LOW", "NONE", "HIGH"]
    schema = ", ".join(f"`{n}` string, `{n}-pred` string" for n in names)
    df = spark.createDataFrame([tuple(v for pair in zip(true, pred) for v in pair)], schema)
    row = df.select(cvss.absolute_score(list(names)).alias("a"), cvss.partial_score(list(names)).alias("p")).first()
    assert (row["a"], row["p"]) == (3, 2.5)


def test_predicted_index(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5],), ([0.7],), ([0.5],)], "p array<double>")
    assert [r["i"] for r in df.select(cvss.predicted_index(F.col("p")).alias("i")).collect()] == [1, 1, 0]
