"""Headers of stored texts."""

from pyspark.sql import functions as F

from tidemark.functions import meta as M
from tidemark.functions import text as T


def test_a_header_is_read_once(spark):
    shown = spark.createDataFrame([], "t string").select(M.any_header("t").alias("h"))._jdf.queryExecution().analyzed().toString()
    # the lines of a text are named a few times, not once for each use of what follows from them
    assert shown.count("split(") <= 2 and shown.count("from_json") <= 2


def test_headers(spark):
    texts = ["---\na: 1\na: 2\n b : x:y\n---\n\nbody\n", "---\nno field\nc: 3", "---\n---\nrest", '```json\n{"k": "v"}\n```\ntext', "```json\n{broken\n```\nx", "", None]
    want = [
        ({"a": "2", "b": "x:y"}, "body"), ({"c": "3"}, "---\nno field\nc: 3"), ({}, "---\n---\nrest"), ({"k": "v"}, "text"),
        ({}, "```json\n{broken\n```\nx"), ({}, ""), ({}, None),
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", M.any_header("t").alias("h"))
    assert [(r.h.metadata, r.h.body) for r in rows.orderBy("i").collect()] == want


def test_let(one):
    assert one(T.let(F.upper("x"), lambda v: F.concat(v, v)), x="ab") == "ABAB"
