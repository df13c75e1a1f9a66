"""Raw files are read once, and none of them passes through the driver."""

from pyspark.sql import functions as F

from tidemark.plans import ingest
from tidemark.sources import readers, writers


def test_contents_of_raw_files_are_not_broadcast(spark):
    df = ingest.raw_file_pages(spark, "/root/testdata/sf0.001")
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # tables of names are small, whatever the size of their files
    assert "Join" not in plan and "BroadcastExchange" not in plan
    assert {r.source_id for r in rows} == {f"page_{r.page_id}" for r in readers.table(spark, "/root/testdata/sf0.001", "pages").collect()}


def test_pages_keep_columns_of_their_files(spark, tmp_path):
    files = {"a.html": "<p>é</p>", "b.html": "<p>b</p>", "a.pdf": "%PDF", "none.html": ""}
    table = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in [*files.items(), ("b.html", files["b.html"])]], "name string, content binary")
    raw = readers.raw_files(spark, str(tmp_path / "raw"), writers.raw_files(table.repartition(1), str(tmp_path / "raw")))
    got = readers.raw_pages(raw, "suffix", "size")
    assert got.columns == ["page_id", "source_id", "html", "suffix", "size"]
    want = raw.filter("suffix = '.html'").select("source_id", F.decode("content", "UTF-8").alias("html"), "suffix", "size")
    assert sorted(got.drop("page_id").collect()) == sorted(want.collect()) != []
    assert sorted(r.source_id for r in got.collect()) == ["a", "b"]
    assert readers.raw_pages(raw).columns == ["page_id", "source_id", "html"]
