"""Streams against their batch twins."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import chunk as K
from tidemark.operators import embed as E
from tidemark.operators import progress as PR
from tidemark.plans import ingest
from tidemark.plans import queries as Q
from tidemark.plans import review as V
from tidemark.sources import readers, writers
from tidemark.sources.writers import VersionedTable
from tidemark.streaming import jobs
from tidemark.streaming import progress as SP

FOLDER = "/root/testdata/sf0.001"


def test_step_states_as_in_batch(spark, tmp_path):
    SP.use_state_store(spark)
    events = Q._events(spark, FOLDER).withColumn("event", F.lit("progress")).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SP.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # a silence never ends here, so that no timer interferes
    out = SP.step_state_stream(stream, fixed.GENERATE_STEPS, watermark="60 days", idle=10**8, timeout=10**9)
    query = out.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    names = ["run_id", "step", "status", "duration_ms", "server_message", "error_message"]
    got = {}
    for r in sorted(spark.table("states").collect(), key=lambda r: r["at"]):
        got[r.run_id, r.step] = tuple(r[n] for n in names)
    want = PR.step_states(Q._events(spark, FOLDER), fixed.GENERATE_STEPS).select(*names)
    assert {tuple(r) for r in want.collect()} == set(got.values())


def test_silence_ends_a_run(spark, tmp_path):
    SP.use_state_store(spark)

    def event(run, second, no):
        return (run, "progress", "profiler", "active", "go", None, None, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second), no)

    for i, rows in enumerate([[event("a", 0, 1)], [event("b", 100, 2)], [event("b", 400, 3)], [event("b", 401, 4)]]):
        spark.createDataFrame(rows, SP.EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={i}"))
    stream = spark.readStream.schema(SP.EVENT_SCHEMA + ", f int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = SP.step_state_stream(stream.drop("f"), fixed.GENERATE_STEPS, watermark="0 seconds", idle=60, timeout=120)
    query = out.writeStream.format("memory").queryName("beats").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    kinds = [r.kind for r in spark.table("beats").filter("run_id = 'a' and kind <> 'step'").orderBy("at").collect()]
    assert kinds == ["heartbeat", "timeout"]


def test_a_late_event_does_not_revive_a_run(spark, tmp_path):
    SP.use_state_store(spark)

    def event(run, kind, second, no):
        return (run, kind, "profiler", "active", "go", None, None, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second), no)

    batches = [[event("a", "progress", 0, 1)], [event("a", "complete", 10, 2)], [event("a", "progress", 9, 3)], [event("b", "progress", 900, 4)], [event("b", "progress", 901, 5)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SP.EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={i}"))
    stream = spark.readStream.schema(SP.EVENT_SCHEMA + ", f int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = SP.step_state_stream(stream.drop("f"), fixed.GENERATE_STEPS, watermark="60 seconds", idle=60, timeout=120)
    query = out.writeStream.format("memory").queryName("ends").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    kinds = [r.kind for r in spark.table("ends").filter("run_id = 'a' and kind <> 'step'").collect()]
    assert kinds == ["complete"]


@pytest.mark.parametrize("keys", [None, ["doc_id"]])
def test_index_job_rebuilds_only_changes(spark, tmp_path, keys):
    table = VersionedTable(spark, str(tmp_path / "index"), keys)

    def docs(rows):
        df = spark.createDataFrame(rows, "id string, t string, size long, mtime long")
        src = K.plain_source(df, F.col("id"), F.col("id"), F.col("t"))
        return src.join(df.select(F.col("id").alias("doc_id"), "size", "mtime"), "doc_id")

    job = jobs.index_job(table)
    first = docs([("a", "one", 3, 1), ("b", "two", 3, 1)])
    job(first, 0)
    job(docs([("a", "one", 3, 1), ("b", "changed", 7, 2), ("c", "new", 3, 1)]), 1)
    again = {(r.doc_id, r.text) for r in table.read().collect()}
    job(docs([("a", "one", 3, 1), ("b", "changed", 7, 2), ("c", "new", 3, 1)]), 1)
    assert again == {(r.doc_id, r.text) for r in table.read().collect()} == {("a", "one"), ("b", "changed"), ("c", "new")}
    assert table.versions() == [1, 2]


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], 32)
    rows = spark.range(2000).selectExpr("concat('d', id) as k", "id as v")
    table.apply(rows.select("k"), rows, 1)
    few = rows.filter("v in (5, 900)")
    table.apply(few.select("k"), few.withColumn("v", F.col("v") + 1), 2)
    near = table.buckets_of(few)
    got = table.read(buckets=near)
    assert len(near) <= 2 and {tuple(r) for r in got.filter("k in ('d5', 'd900')").collect()} == {("d5", 6), ("d900", 901)}
    assert got.count() < 400 and got.join(rows, ["k"], "left_anti").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters" in line and "_bucket" in line.split("PartitionFilters")[1] for line in scans)
    read = [p.split("_bucket=")[1].split("/")[0] for p in table._part("rows", [1, 2], near).select(F.col("_metadata.file_path")).toPandas().iloc[:, 0]]
    assert {int(b) for b in read} == set(near)
    table.compact()
    assert table.read().count() == 2000 and table.read(buckets=near).count() == got.count()


def test_a_version_without_rows_keeps_its_columns(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    rows = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    table.apply(rows.select("k"), rows.limit(0), 1)
    assert table.read().columns == ["k", "v"] and table.read().count() == 0
    table.apply(rows.select("k"), rows, 2)
    table.apply(rows.select("k").filter("k is null"), rows.filter("k is null").withColumn("v", F.lit(3)), 3)
    assert {tuple(r) for r in table.read().collect()} == {("a", 1), (None, 3)}


@pytest.mark.parametrize("keys", [None, ["k"]])
def test_deltas_hold_changes_only(spark, tmp_path, keys):
    table = VersionedTable(spark, str(tmp_path / "t"), keys)
    schema = "k string, v int"

    def change(version, keys, rows):
        table.apply(spark.createDataFrame([(k,) for k in keys], "k string"), spark.createDataFrame(rows, schema), version)

    def content(**options):
        return sorted(map(tuple, table.read(schema, **options).collect()))

    assert content() == []
    change(1, ["a", "b", "c"], [("a", 1), ("a", 2), ("b", 3), ("c", 4)])
    change(2, ["a", "c"], [("a", 5)])
    assert spark.read.parquet(str(tmp_path / "t" / "rows" / "_version=2")).count() == 1
    assert content() == [("a", 5), ("b", 3)] and content(before=2) == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]
    table.compact()
    assert content() == [("a", 5), ("b", 3)]
    change(3, ["b", "d"], [("d", 6)])
    table.drop_before(3)
    assert table.versions() == [2, 3] and content() == [("a", 5), ("d", 6)]
    change(3, ["b"], [("b", 7)])
    assert content() == [("a", 5), ("b", 7)]


@pytest.mark.parametrize("keys", [None, ["module_name", "scope_key"]])
def test_snapshot_job(spark, tmp_path, keys):
    table = VersionedTable(spark, str(tmp_path / "snaps"), keys)
    rows = [("videos", "k", "v1", datetime.datetime(2024, 1, 1)), ("videos", "k", "v2", datetime.datetime(2024, 1, 2))]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], jobs.SNAPSHOT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={i}"))
    stream = spark.readStream.schema(jobs.SNAPSHOT_SCHEMA + ", f int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.start(stream, jobs.snapshot_job(table), str(tmp_path / "ck")).awaitTermination()
    assert [r.payload for r in table.read().collect()] == ["v2"]


def test_upload_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Terms of use.txt").write_text("hello")
    tables = {n: VersionedTable(spark, str(tmp_path / n)) for n in ("raw_files", "catalog", "documents", "items")}
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(tmp_path / "in"))
    job = jobs.upload_job(tables, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    jobs.start(jobs.uploaded_files(stream), job, str(tmp_path / "ck")).awaitTermination()
    got = [r.source_id for r in tables["items"].read().collect()]
    assert got == ["terms_of_use"]


def test_review_job(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "Disclosure of branded content.")], "id string, t string")
    index = V.build_index(K.plain_source(docs, F.col("id"), F.col("id"), F.col("t")))
    users = spark.createDataFrame([], "id long, name string, style_prompt string, few_shot string")
    schema = "request_id long, script string"
    spark.createDataFrame([(1, "the best"), (2, "#ad fine")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    table = VersionedTable(spark, str(tmp_path / "index"))
    table.replace(index)
    job = jobs.review_job(table, users, str(tmp_path / "out"))
    jobs.start(stream, job, str(tmp_path / "ck")).awaitTermination()
    got = {r.request_id: r.overall_status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.request_id: r.overall_status for r in V.review(spark.read.parquet(str(tmp_path / "in")), index, users).collect()}
    assert got == want == {"1": "needs_revision", "2": "approved"}
    # a batch that runs again sees the index of its first run, a later one the newest
    table.replace(index.limit(0))
    job(spark.read.parquet(str(tmp_path / "in")), 0)
    assert {r.request_id: r.overall_status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    job(spark.read.parquet(str(tmp_path / "in")), 1)
    assert {r.evidence_count for r in spark.read.parquet(str(tmp_path / "out" / "batch=1")).collect()} == {0}


def test_review_stream_as_in_batch(spark):
    got = ingest.continuous_review(spark, FOLDER)
    scripts, index, users = ingest.review_inputs(spark, FOLDER)
    want = ingest.review_outcome(V.review(scripts, index, users, embedder=Q.MD5))
    rows = {tuple(r) for r in got.collect()}
    assert len(rows) == 200 and rows == {tuple(r) for r in want.collect()}


def test_document_files_need_a_name(spark, tmp_path):
    docs = spark.createDataFrame([("a/b", "x"), (None, "y")], "source_id string, body string").withColumn("metadata", F.struct("source_id"))
    for row in ("source_id is null", "source_id is not null"):
        with pytest.raises(Exception, match="no file name"):
            writers.document_files(docs.filter(row), str(tmp_path / "files"))
    writers.document_files(docs.filter("false"), str(tmp_path / "files"))


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.md").write_text("---\ntitle: A\n---\nHello world")
    (tmp_path / "kb" / "b.json").write_text('{"source_id": "b", "title": "B"}')
    (tmp_path / "kb" / "manifest.json").write_text('[{"source_id": "b"}]')
    from tidemark.operators import corpus as C

    docs = C.knowledge_documents(readers.knowledge_files(spark, str(tmp_path / "kb"))).collect()
    assert [(d.doc_id, d.source_title, d.tokens) for d in docs] == [("a", "A", ["hello", "world"])]
    assert [r.source_id for r in readers.metadata_files(spark, str(tmp_path / "kb")).collect()] == ["b"]
    rows = E.with_vectors(K.chunk_documents(K.plain_source(spark.createDataFrame([("a", "x")], "i string, t string"), F.col("i"), F.col("i"), F.col("t"))))
    writers.index(rows, str(tmp_path / "index"), "2024-01-01")
    back = writers.read_index(spark, str(tmp_path / "index"))
    assert back.count() == 1 and "source_category" in back.columns


def test_written_files_are_read_by_their_names(spark, tmp_path):
    docs = spark.createDataFrame([("a b", "x"), ("b", None), ("ü", "y\nz")], "source_id string, body string")
    docs = docs.withColumn("metadata", F.struct("source_id", F.concat(F.lit('T "'), "source_id").alias("title")))
    names = writers.document_files(docs, str(tmp_path / "files"))
    assert {r.name for r in names.collect()} == {"a b.md", "a b.json", "b.md", "b.json", "ü.md", "ü.json"}
    texts = readers.markdown_sources(spark, str(tmp_path / "files"), names=names)
    side = readers.metadata_files(spark, str(tmp_path / "files"), names)
    for rows in (texts, side):
        # of the files the driver has listed none
        assert all("/_names/" in f for f in rows.inputFiles())
    listed = readers.markdown_sources(spark, str(tmp_path / "files"))
    assert {tuple(r) for r in texts.select("text", "size").collect()} == {tuple(r) for r in listed.select("text", "size").collect()}
    assert sorted((r.source_id, r.title, r.region) for r in side.collect()) == [("a b", 'T "a b', None), ("b", 'T "b', None), ("ü", 'T "ü', None)]
    found = readers.metadata_files(spark, str(tmp_path / "files"))
    assert {tuple(r) for r in side.select(*readers.METADATA_COLUMNS).collect()} == {tuple(r) for r in found.select(*readers.METADATA_COLUMNS).collect()}


def test_listed_sidecars_of_any_content(spark, tmp_path):
    files = {"o.json": '{"source_id": "o1"}', "l.json": '[{"source_id": "l1"}, {"source_id": "l2"}]', "e.json": "", "n.json": "[]", "x.json": "{broken", "manifest.json": "[]"}
    table = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in files.items()], "name string, content binary")
    names = writers.raw_files(table, str(tmp_path / "files"))
    got = [sorted(r.source_id for r in readers.metadata_files(spark, str(tmp_path / "files"), n).collect()) for n in (names, None)]
    assert got[0] == got[1] == ["l1", "l2", "o1", "x"]


def test_listed_raw_files(spark, tmp_path):
    table = spark.createDataFrame([("a.html", bytearray(b"<p>")), ("b.pdf", bytearray()), ("c.txt", bytearray(b"x"))], "name string, content binary")
    names = writers.raw_files(table, str(tmp_path / "files"))
    got, want = (readers.raw_files(spark, str(tmp_path / "files"), n).select("source_id", "suffix", "content", "size").collect() for n in (names, None))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [("a", ".html", b"<p>", 3)]


def test_vectors_of_an_index_batch_are_not_shuffled(spark, tmp_path, monkeypatch):
    written = []
    plain = VersionedTable.apply
    monkeypatch.setattr(VersionedTable, "apply", lambda self, keys, rows, *a, **k: (written.append(rows), plain(self, keys, rows, *a, **k)))
    docs = spark.createDataFrame([("d1", "One."), ("d2", "Two."), (None, "Three.")], "id string, t string")
    rows = K.plain_source(docs, F.col("id"), F.col("id"), F.col("t")).withColumns({"size": F.lit(4).cast("bigint"), "mtime": F.lit(0)})
    table = VersionedTable(spark, str(tmp_path / "index"), ["doc_id"])
    jobs.index_job(table)(rows, 0)
    assert [(r.doc_id, r.size, r.mtime) for r in table.read().orderBy("doc_id").collect()] == [("d1", 4, 0), ("d2", 4, 0)]
    plan = written[0]._jdf.queryExecution().executedPlan().toString().splitlines()
    vectors = max(i for i, line in enumerate(plan) if "ArrowEvalPython" in line)
    assert vectors < min(i for i, line in enumerate(plan) if "Exchange" in line)
