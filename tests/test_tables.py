"""Keyed operators, creator tables and the document library."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import crm
from tidemark.operators import keyed as O
from tidemark.operators import library as L
from tidemark.operators import trends as R


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key."""
    rows = [(("hot" if i % 3 == 0 else f"k{i % 11}"), i * 7 % 3001, float(i % 5)) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, o long, v double").dropDuplicates(["o"]).cache()


def test_rank_in_slices(hot):
    want = hot.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    got = O.rank_in_key(hot, ["k"], "o")
    assert sorted(map(tuple, got.select("k", "o", "rank").collect())) == sorted(map(tuple, want.select("k", "o", "rank").collect()))


def test_numbers_are_consecutive(hot):
    rows = O.number_rows(hot, "o", "id", 10).orderBy("o").collect()
    assert [r.id for r in rows] == list(range(11, 11 + len(rows)))


def test_a_hot_key_is_numbered_in_ranges(spark):
    ids = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), (F.col("id") * F.col("id")).alias("o"))
    keep = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = ids.repartitionByRange("k", "o").groupBy(F.spark_partition_id()).count().collect()
        got = O.rank_in_key(ids, ["k"], "o")
        want = ids.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("o")))
        assert got.select("k", "o", "rank").exceptAll(want).isEmpty() and got.count() == 40_000
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    # nine tenths of the rows have one key, and no range holds a quarter of them
    assert max(r["count"] for r in ranged) < 10_000


def test_previous_and_running_sum_in_slices(hot):
    sliced = hot.withColumn("s", F.floor(F.col("o") / 100))
    w = Window.partitionBy("k").orderBy("o")
    want = hot.withColumn("prev_v", F.lag("v").over(w)).withColumn("t", F.sum("v").over(w))
    got = O.previous_in_key(sliced, ["k"], "s", ["o"], ["v"])
    got = O.running_sum(got, ["k"], "s", ["o"], F.col("v"), "t")
    names = ["k", "o", "prev_v", "t"]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(map(tuple, want.select(*names).collect()), key=repr)


def test_merge_prefers_the_newest(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "old", 4), (2, "same", 5), (3, "c", 1)], "k int, v string, t int")
    got = {r.k: r.v for r in O.merge_rows(base, new, ["k"], ["t"]).collect()}
    assert got == {1: "a", 2: "same", 3: "c"}


USERS = "id long, name string, style_prompt string, few_shot string"
PROFILES = "id long, user_id long, name string, platform string, email string, recent_video_link string, notes string, collaboration_progress string"


def test_create_update_delete(spark):
    users = spark.createDataFrame([(5, "u", "s", "f")], USERS)
    profiles = spark.createDataFrame([(2, 5, "u", "x", "", "", "s", "待沟通"), (3, 77, "lost", "x", "", "", "", "")], PROFILES)
    new = spark.createDataFrame([(1, " Ann ", "", "", "", "", "")], "n int, name string, platform string, email string, recent_video_link string, notes string, collaboration_progress string")
    profiles, users = crm.create_talents(profiles, users, new, "n")
    made = profiles.filter("id = 4").first()
    assert (made.user_id, made.name, made.platform, made.collaboration_progress) == (6, "Ann", "未设置", "待沟通")
    changes = spark.createDataFrame([(4, "Ann B", "x", "", "", "calm", "签约"), (3, "found", "x", "", "", "", ""), (99, "no", "", "", "", "", "")],
                                    "talent_id long, name string, platform string, email string, recent_video_link string, notes string, collaboration_progress string")
    profiles, users = crm.update_talents(profiles, users, changes)
    got = {r.id: (r.name, r.style_prompt) for r in users.collect()}
    assert got[6] == ("Ann B", "calm") and got[7][0] == "found" and len(got) == 3
    scripts = spark.createDataFrame([(1, 6, "t"), (2, 5, "t"), (3, None, "t")], "id long, user_id long, topic string")
    profiles, users, scripts = crm.delete_talents(profiles, users, scripts, spark.createDataFrame([(4,)], "id long"))
    assert {r.id for r in profiles.collect()} == {2, 3} and {r.id for r in users.collect()} == {5, 7}
    assert {r.id: r.user_id for r in scripts.collect()} == {1: None, 2: 5, 3: None}


def test_backfill_only_when_empty(spark):
    users = spark.createDataFrame([(5, "", " ", "f")], USERS)
    none = spark.createDataFrame([], PROFILES)
    made = crm.backfill_profiles(none, users).first()
    assert (made.id, made.user_id, made.name, made.notes) == (5, 5, "达人 5", "从原 users 表同步，待补充达人备注。")
    some = spark.createDataFrame([(1, 1, "a", "", "", "", "", "")], PROFILES)
    assert [r.id for r in crm.backfill_profiles(some, users).collect()] == [1]


def one_by_one(uploads, taken):
    """Ids given upload by upload, with the files each one leaves behind."""
    raw = {i: set(s) for i, s, *_ in taken}
    text = {i for i, _, md, _ in taken if md}
    known = {i for i, *_ in taken}
    out = {}
    for no, base, suffix in sorted(uploads):
        n = 0
        while True:
            c = base if n == 0 else f"{base}_{n}"
            files = raw.get(c, set())
            if suffix in (".html", ".pdf"):
                ok = (files == {suffix} and c not in text) or (not files and c not in text and c not in known)
            else:
                ok = (c in text and not files) or (not files and c not in text and c not in known)
            if ok:
                break
            n += 1
        out[no] = c
        known.add(c)
        if suffix in (".html", ".pdf"):
            raw.setdefault(c, set()).add(suffix)
        else:
            text.add(c)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_ids_as_one_by_one(spark, seed):
    rnd = random.Random(seed)
    bases = ["a", "b", "c", "b_1", "d"] if seed < 2 else ["a", "a_1", "a_2", "a_1_1", "a_1_1_2", "a_3", "_1", "x_0", "x", "a_1_1_2_1", "a_" + "9" * 20]
    ids = {rnd.choice(bases) + rnd.choice(["", "_1", "_2", "_3", "_10"]) for _ in range(12)}
    taken = []
    for i in sorted(ids):
        md = rnd.random() < 0.4
        taken.append((i, rnd.choice([[], [".html"], [".pdf"], [".html", ".pdf"]]), md, md))
    uploads = [(n, rnd.choice(bases), rnd.choice([".html", ".pdf", ".md", ".txt"])) for n in range(25 if seed < 2 else 60)]
    t = spark.createDataFrame([(*r, True) for r in taken], "id string, raw_suffixes array<string>, has_md boolean, has_json boolean, in_catalog boolean")
    u = spark.createDataFrame(uploads, "upload_no int, base string, suffix string")
    assert {r.upload_no: r.source_id for r in L.allocate_ids(u, t).collect()} == one_by_one(uploads, taken)


def test_import_by_column_types(spark):
    base = spark.createDataFrame([(1, "old", None, 1.5, "{}")], "id long, name string, at timestamp, score double, more string")
    rows = [
        (1, "1", "a", "2024-05-01T10:00:00Z", "2.5", '{"x": 1}'), (2, "2", " ", "2024-05-01 10:00:00+02:00", "", ""), (3, "2", "", "soon", "much", "[1]"),
        (4, "x", "b", None, None, None), (5, None, "c", None, None, None), (6, "3", None, None, "1e2", "{broken"),
    ]
    texts = spark.createDataFrame(rows, "no int, id string, name string, at string, score string, more string")
    merged, problems = crm.import_typed(base, texts, ["id"], "no", {"name": "?", "score": "0"}, json=["more"])
    got = {r.id: (r.name, str(r.at) if r.at else None, r.score, r.more) for r in merged.collect()}
    assert got == {1: ("a", "2024-05-01 10:00:00", 2.5, '{"x": 1}'), 2: ("?", None, 0.0, "{}"), 3: ("?", None, 100.0, "{}")}
    assert sorted(map(tuple, problems.collect()), key=str) == sorted(
        [(3, "at", "soon", "no time"), (3, "score", "much", "no double"), (3, "more", "[1]", "no JSON object"), (4, "id", "x", "no bigint"),
         (5, "id", None, "no bigint"), (6, "more", "{broken", "no JSON object")], key=str)
    merged, _ = crm.import_typed(base, texts.drop("score"), ["id"], "no", json=["more"], strict=True)
    assert {(r.id, r.name, r.score) for r in merged.collect()} == {(1, "a", None), (2, " ", None)}


def test_names_in_the_order_of_a_language(spark):
    names = ["张伟", "Zoe", "Abel", "阿里", "abel", "Äpfel", "李娜", "émile", "eve"]
    rows = [(i, None, n, "", "", "", "", "") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, user_id long, name string, platform string, email string, recent_video_link string, notes string, collaboration_progress string")
    got = [r.talent_name for r in crm.top_todos(df, 9).collect()]
    assert got == ["阿里", "李娜", "张伟", "abel", "Abel", "Äpfel", "émile", "eve", "Zoe"]


def test_ids_of_a_long_row_of_names(spark):
    """A base and its numbered names, all uploaded: settled in two steps, however many there are."""
    rnd = random.Random(11)
    names = ["scan", "scan", "scan", *[f"scan_{i}" for i in range(1, 400)]]
    rnd.shuffle(names)
    uploads = [(n, b, rnd.choice([".html", ".pdf", ".md"])) for n, b in enumerate(names)]
    t = spark.createDataFrame([], "id string, raw_suffixes array<string>, has_md boolean, has_json boolean, in_catalog boolean")
    u = spark.createDataFrame(uploads, "upload_no int, base string, suffix string")
    assert {r.upload_no: r.source_id for r in L.allocate_ids(u, t).collect()} == one_by_one(uploads, [])


def test_registered_ids_as_one_by_one(spark):
    from tidemark.plans.queries import QUERIES, upload_inputs

    uploads, taken = upload_inputs(spark, "/root/testdata/sf0.001")
    rows = sorted((r.upload_no, r.base, r.suffix) for r in uploads.collect())
    used = [(r.id, r.raw_suffixes or [], r.has_md, r.has_md) for r in taken.collect()]
    got = {r.upload_no: r.source_id for r in QUERIES["upload_ids"](spark, "/root/testdata/sf0.001").collect()}
    assert got == one_by_one(rows, used)


def test_uploads_are_checked_and_routed(spark):
    rows = [
        (1, "My File.HTML", b"<p>x</p>", "", "market_law"), (2, "note.md", b"hello", "Note", ""), (3, "empty.txt", b"", "", ""),
        (4, "image.png", b"x", "", ""), (5, "blank.txt", b"  ", "", ""), (6, "latin.txt", b"caf\xe9", "", ""),
    ]
    names = ["market", "region", "platform", "language", "priority", "source_url", "notes"]
    df = spark.createDataFrame([(a, b, bytearray(c), d, e) for a, b, c, d, e in rows], "upload_no int, filename string, content binary, title string, category string")
    for n in names:
        df = df.withColumn(n, F.lit(""))
    taken = spark.createDataFrame([], "id string, raw_suffixes array<string>, has_md boolean, has_json boolean, in_catalog boolean")
    made = L.store_uploads(df, taken, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    assert {r.upload_no for r in made["refused"].collect()} == {3, 4, 5}
    assert [r.source_id for r in made["raw_files"].collect()] == ["my_file"]
    docs = {r.source_id: r for r in made["documents"].collect()}
    assert docs["note"].body == "# Note\n\nhello" and docs["latin"].body == "# latin\n\ncafé"
    entry = made["catalog"].first()
    assert (entry.id, entry.market, entry.crawl_mode, entry.category) == ("my_file", "GLOBAL", "manual_upload", "market_law")
    assert {r.status for r in made["items"].collect()} == {"pending_rebuild"}


def test_crawl_totals(spark):
    rows = [("downloaded",)] * 33 + [("manual_required",)] * 18 + [("failed",)] * 19 + [("blocked",)] * 14
    got = {r.status: r.sources for r in L.crawl_counts(spark.createDataFrame(rows, "status string")).collect()}
    assert got == {"downloaded": 33, "manual_required": 18, "failed": 19, "blocked": 14} and sum(got.values()) == 84


def test_snapshot_matrix(spark):
    rows = [("a", "videos", "k", False), ("b", "videos", "k", True), ("c", "videos", "bad", True), ("d", "videos", "none", False), ("e", "other", "k", None)]
    asked = spark.createDataFrame(rows, "request_id string, module_name string, scope_key string, refresh boolean")
    kept = '{"items": [{"z": 1, "a": [null, 2.5]}], "more": {"x": {"y": "é"}}, "error": "kept"}'
    old = spark.createDataFrame([("videos", "k", kept, 1), ("videos", "bad", kept, 2), ("other", "k", "[1]", 3)], "module_name string, scope_key string, payload string, updated_at int")
    loads = spark.createDataFrame([("videos", "k", '{"items": null}', 9, None), ("videos", "bad", None, None, 'say "boom"')], "module_name string, scope_key string, payload string, loaded_at int, error string")
    served = R.serve_modules(asked, old, loads)
    got = {r.request_id: (json.loads(r.payload), r.error, r.from_cache, r.stale, r.cached_at) for r in served.collect()}
    whole = json.loads(kept)
    assert got == {
        "a": (whole, "kept", True, False, 1), "b": ({"items": None, "error": ""}, "", False, False, 9),
        "c": ({**whole, "error": 'say "boom"'}, 'say "boom"', True, True, 2),
        "d": ({"items": [], "error": "load failed"}, "load failed", False, False, None), "e": ({"error": ""}, "", True, False, 3),
    }
    assert [(r.scope_key, r.payload) for r in R.stored_loads(served).collect()] == [("k", '{"items": null}')]


def test_trend_results_from_requests(spark):
    schema = "request_id string, topic string, target_country string, target_platform string, distribution_mode string, product_category string, target_languages array<string>, refresh_videos boolean, refresh_industry boolean"
    asked = R.module_requests(spark.createDataFrame([("r", 'a "b"', "US", "tiktok", "organic", "toys", ["en", "es"], False, True)], schema))
    filters = {"topic": 'a "b"', "target_country": "US", "target_platform": "tiktok", "distribution_mode": "organic", "product_category": "toys", "target_languages": ["en", "es"]}
    parts = {r.module_name: r for r in asked.collect()}
    assert {m: json.loads(r.scope_key) for m, r in parts.items()} == {m: {**filters, "module": m} for m in ("videos", "industry_categories", "topic_brief")}
    assert [parts[m].refresh for m in ("videos", "industry_categories", "topic_brief")] == [False, True, True]
    old = spark.createDataFrame([("videos", parts["videos"].scope_key, '{"items": [{"n": 1}], "error": "own"}', 1)], "module_name string, scope_key string, payload string, updated_at int")
    loads = spark.createDataFrame([("topic_brief", parts["topic_brief"].scope_key, '{"topic_brief": {"trend_data": "d"}}', 5, None)], "module_name string, scope_key string, payload string, loaded_at int, error string")
    got = R.trend_result(R.serve_modules(asked, old, loads)).first()
    assert json.loads(got.filters) == filters and got.benchmarks == '[{"n":1}]' and got.benchmarks_error == "own"
    assert json.loads(got.trend_hunter) == {"trend_data": "d"} == json.loads(got.industry.topic_brief)
    assert (got.industry.categories, got.industry.error, got.industry.from_cache, got.industry.cached_at) == ("[]", "load failed", False, 5)


def test_platform_fallback_and_first_url(spark):
    rows = [
        ("r", "tiktok", "tiktok", 0, 0, "t", "10 days old 9d ago 2m views", "", "https://tiktok.com/1", 0.9), ("r", "tiktok", "x", 0, 0, "a", "200k views", "", "https://x.com/1", 0.1),
        ("r", "tiktok", "instagram", 0, 0, "b", "300k views", "", "https://x.com/1", 0.1), ("s", "", "tiktok", 0, 0, "c", "no count", "", "https://tiktok.com/2", 0.84),
        ("s", "", "x", 1, 1, "d", "no count", "", "https://x.com/2", 0.86),
    ]
    hits = spark.createDataFrame(rows, "request_id string, wanted string, platform string, query_no int, hit_no int, title string, content string, raw_content string, url string, score double")
    got = {(r.request_id, r.title, r.view_count_label) for r in R.viral_benchmarks(hits, F.lit("2024-02-01").cast("date")).collect()}
    assert got == {("r", "b", "300.0K"), ("s", "d", "实时命中")}
