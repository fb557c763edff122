import re
import uuid

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V


def one(spark, expression, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expression.alias("y")).first()["y"]


def test_sentences(spark):
    cases = {
        "Term. Next.[web:5] After": ["Term.", "Next.", "After"],
        "1. Start with x. 2. Then y": ["1. Start with x.", "2. Then y"],
        "line one\nline two": ["line one", "line two"],
        "[web:1] [web:2]": [],
        "A b.  C d.": ["A b.", "C d."],
        "ends with 3.": ["ends with 3."],
        "x. 4.": ["x.", "4."],
        "1. 2. x": ["1. 2.", "x"],
        "": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", T.sentences(F.col("x")).alias("s")).collect()
    assert {r["x"]: r["s"] for r in rows} == cases


def test_junk(spark):
    junk = ["", "***", "12", "Page 3 of 9", "CO1 (2)", "START", "[web:3]", " 7. "]
    kept = ["Page 30 of 9000 x", "Start", "real", "12 apples", "page 1234567 of 9"]
    rows = spark.createDataFrame([(x,) for x in junk + kept], "x string").select("x", T.is_junk(F.col("x")).alias("j")).collect()
    assert {r["x"] for r in rows if r["j"]} == set(junk)


def test_stems_and_tokens(spark):
    got = one(spark, F.array_sort(T.lexical_tokens(F.col("x"))), "Processes process series Studies is ab cats a1_b-c")
    assert got == sorted({"process", "proces", "sery", "study", "cat", "a1_b-c"})


def test_lines(spark):
    for text in ["a", "a\nb", "a\nb\n", "a\r\nb", "a\x0bb\x85c", "\n"]:
        assert one(spark, T.n_lines(F.col("x")), text) == len(text.splitlines()), repr(text)


def test_uuid5(spark):
    for name in ["", "a:b:1:2", "straße::0:1"]:
        assert one(spark, V.uuid5(F.col("x")), name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_citations(spark):
    df = spark.createDataFrame([("A [1].\nCITATIONS: [2, 1, 2]",), ("none",), ("x citations: []",), ("CITATIONS: [9] and CITATIONS: [3, 1] tail",)], "x string")
    answer, numbers = T.split_citations(F.col("x"))
    assert [tuple(r) for r in df.select(answer, numbers).collect()] == [("A [1].", [1, 2]), ("none", []), ("x", []), ("CITATIONS: [9] and", [1, 3])]


def test_titles(spark):
    assert one(spark, T.upload_title(F.col("x")), ["a/Plan.v2.pdf"], "x array<string>") == "Plan.v2"
    assert one(spark, T.upload_title(F.col("x")), ["Plan.pdf", "b", "c"], "x array<string>") == "Plan + 2 more"
    assert one(spark, T.chat_title(F.col("x").cast("timestamp")), "2024-01-31 20:00:00") == "Document chat — 01 Feb 2024, 01:30"
    assert one(spark, T.has_default_title(F.col("x")), "Document chat — 1")


def test_cosine_zero_norm(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_pdf_heading(spark):
    lines = [("Key concepts", 10.0, False, True), ("Normal time: x", 10.0, False, False), ("b" * 60, 10.0, True, True), ("b" * 61, 10.0, True, False), ("12", 20.0, True, False), ("A", 20.0, True, False), ("1.2 Scope of it", 10.0, False, True), ("x" * 121, 20.0, True, False), ("lower start", 12.0, False, True)]
    df = spark.createDataFrame(lines, "t string, s double, b boolean, want boolean")
    rows = df.select("t", "want", T.is_pdf_heading(F.col("t"), F.col("s"), F.col("b"), F.lit(10.0)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows), [r["t"] for r in rows if r["want"] != r["got"]]


def test_patterns_compile_in_python():
    for pattern in (T.NUMBERED_ITEM, T.DEFINITION_ITEM, T.NUMBERED_HEADING):
        re.compile(pattern.removeprefix("(?U)"))
