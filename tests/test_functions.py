import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import meta as M
from tidemark.functions import scope as S
from tidemark.functions import script as X
from tidemark.functions import talent as L
from tidemark.functions import text as T
from tidemark.functions import trend as R
from tidemark.functions import web
from tidemark.functions import workflow as W


@pytest.mark.parametrize(
    "text, want",
    [(" a   b\t　c ", "a b c"), ("", ""), (" x y", "x y")],
)
def test_collapse(one, text, want):
    assert one(T.collapse("t"), t=text) == want


def test_tokens_are_unicode_and_have_no_underscore(one):
    assert one(T.tokens("t"), t="Ärger_x 12 日本語!") == ["ärger", "x", "12", "日本語"]


@pytest.mark.parametrize("text", ["a\nb", "a\r\nb\n", "a\x0bb\x85c ", "", "\n", "a\n\nb"])
def test_split_lines_as_python(one, text):
    assert one(T.split_lines("t"), t=text) == text.splitlines()


@pytest.mark.parametrize(
    "text, want",
    [("  | Footer Text - 12", "footer text -"), ("Page 3", "page"), ("|", ""), ("A  B", "a b")],
)
def test_line_key(one, text, want):
    assert one(T.line_key("t"), t=text) == want


def test_decode_falls_back_to_latin(spark):
    rows = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "b binary")
    assert [r.x for r in rows.select(T.decode_bytes("b").alias("x")).collect()] == ["é", "é"]


@pytest.mark.parametrize("value", [1.25, 0.35, 1.15, 2.5, 437572.15, 65591.35, 0.0, 0.049, 999.95, 12345.67])
def test_fixed_digits_as_python(spark, value):
    got = spark.range(1).select(T.to_fixed(F.lit(value), 1).alias("x")).first().x
    assert got == f"{value:.1f}"


def test_rounded_is_the_double_next_to_the_fixed_decimals(spark):
    rng = random.Random(2)
    values = [None, 0.0, -0.0, 0.05, 0.15, 0.25, -0.25, 0.35, -0.04, 1e-300, 2.5, 1e9 + 0.25, 2.0**31 + 0.75, 1e15, 123456789.65]
    values += [rng.uniform(-500, 500) for _ in range(300)] + [rng.randrange(-9999, 9999) / 20 for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select(T.rounded(F.col("v"), 1).alias("a"), T.to_fixed(F.col("v"), 1).cast("double").alias("b")).collect()
    assert [str(r.a) for r in got] == [str(r.b) for r in got]


def test_collapse_knows_the_same_spaces(spark):
    rows = spark.createDataFrame([(i, f"a{chr(i)}{chr(i)}b") for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "i int, t string")
    got = {r.i for r in rows.filter(T.collapse("t") == "a b").collect()}
    assert got == {ord(c) for c in T.SPACES}


def test_word_edges(one):
    best, percent = (p for p, _ in fixed.ABSOLUTE_PATTERNS[:2])
    for text, hit in [("the best.", True), ("ébest", False), ("BEST", True), ("it is #1", False), ("x#1 ok", True), ("no.1", True)]:
        assert one(T.matches("t", "(?i)" + best), t=text) is hit
    for text, hit in [("100% safe", False), ("100%x", True), ("risk-free", True)]:
        assert one(T.matches("t", "(?i)" + percent), t=text) is hit


@pytest.mark.parametrize(
    "text, want",
    [("", "tiktok"), ("YouTube Shorts", "youtube"), ("Twitch", "twitch"), ("Netflix", "x"), ("Kwai Go", "kwai_go")],
)
def test_platform(one, text, want):
    assert one(S.canonical_platform("t"), t=text) == want


def test_language_variants_lose_their_region(spark):
    row = spark.createDataFrame([("pt-BR/en", ["pt-BR"], ["pt"])], "l string, a array<string>, b array<string>")
    got = row.select(S.language_match(F.col("l"), F.col("a")).alias("a"), S.language_match(F.col("l"), F.col("b")).alias("b")).first()
    assert (got.a, got.b) == (False, True)


@pytest.mark.parametrize(
    "text, want",
    [
        ("1.2M views", 1_200_000), ("850k plays", 850_000), ("3 million views", 3_000_000), ("1,250,000 views", 1_250_000),
        ("over a million views", 1_000_000), ("250000 views", None), ("none", None), ("2.3k Views", 2300),
    ],
)
def test_views(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").withColumn("p", R.view_parts(F.col("t")))
    assert row.select(R.view_count(F.col("p")).alias("x")).first().x == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("5h ago", 0), ("3d ago", 3), ("2w ago", 14), ("on 2024-01-30", 2), ("January 29, 2024", 3), ("2024-13-45 and January 29, 2024", 3),
        ("seen · 1-31", 1), ("2024-02-05", 4), ("nothing", None), ("Smarch 9, 2024", None),
    ],
)
def test_age(spark, text, want):
    row = spark.createDataFrame([(text, datetime.date(2024, 2, 1))], "t string, d date").withColumn("p", R.age_parts(F.col("t")))
    assert row.select(R.age_days(F.col("p"), F.col("d")).alias("x")).first().x == want


def test_view_labels(spark):
    rows = spark.createDataFrame([(1_250_000,), (2500,), (999,)], "n long")
    assert [r.x for r in rows.select(R.view_label("n").alias("x")).collect()] == ["1.2M", "2.5K", "999"]


def test_host_and_platform(one):
    assert one(web.platform_of_url("u"), u="https://www.netflix.com/a") == "x"
    assert one(web.platform_of_url("u", strict=True), u="https://www.netflix.com/a") == ""
    assert one(web.platform_of_url("u", strict=True), u="https://m.twitter.com/a") == "x"
    assert one(web.display_domain("u"), u="no url") == "unknown"


def test_front_matter(one):
    got = one(M.any_header("t"), t="---\ntitle: A: b\nnote\ntitle: C\n---\n\nBody\n")
    assert got.metadata == {"title": "C"} and got.body == "Body"


def test_json_header(one):
    got = one(M.any_header("t"), t='```json\n{"a": "x", "n": 1}\n```\n\n# T\ntext\n')
    assert got.metadata == {"a": "x", "n": "1"} and got.body == "# T\ntext"
    broken = one(M.json_header("t"), t="```json\n{bad}\n```\nrest")
    assert broken.metadata == {} and broken.body.startswith("```json")


@pytest.mark.parametrize("text, want", [("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("x", ""), ("", "")])
def test_times(one, text, want):
    assert one(M.show_time(M.parse_time("t")), t=text) == want


def test_contents_cut(one):
    body = "a\n# Table of contents\nx\ny\n# Who are you?\nz"
    assert one(M.cut_contents(F.lit("law_uk_asa_pdf"), F.col("t")), t=body) == "a\n# Who are you?\nz"
    assert one(M.cut_contents(F.lit("other"), F.col("t")), t=body) == body


def test_script_repair(spark):
    text = (
        "intro\n### S\n| Time | Visual | Audio | Notes |\n|---|---|---|---|\n"
        "| [00:00-00:03] | Scene 1 | INT room | wide | say | more | z |\n| a | b | c | d | e |\n| 1 | 2 |\nend"
    )
    row = spark.createDataFrame([(text,), ("```md\n\n```",), (None,)], "t string")
    got = [r.c for r in X.clean_scripts(row, "t", "c").collect()]
    assert got[0] == (
        "### S\n| Time | Visual | Audio | Notes |\n|---|---|---|---|\n"
        "| [00:00-00:03] | Scene 1 / INT room / wide | say | more | z |\n| a | b / c | d | e |\n| 1 | 2 |\nend"
    )
    assert got[1:] == ["", ""]


def test_stage_order(one):
    for text, want in [("待沟通", "pending"), ("沟通", "contacting"), ("已签约，制作", "signed"), ("交付", "done"), ("?", "pending")]:
        assert one(L.stage("t"), t=text) == want


def test_event_text_round_trip(one):
    got = one(W.decode_event("t"), t='event: progress\ndata: {"a":\ndata: 1}\n\n')
    assert (got.event, got.data) == ("progress", '{"a":\n1}')
    assert one(W.decode_event("t"), t="event: x").data is None


def test_step_errors(one):
    for step, text, want in [
        ("trend_hunter", "x", "search_timeout"), ("rewriter", "Rate limit", "llm_busy"), ("rewriter", "boom", "workflow_error"),
        ("compliance", "429", "compliance_blocked"), ("profiler", "timeout", "workflow_error"),
    ]:
        assert one(W.step_error(F.col("s"), F.col("t")), s=step, t=text).error_type == want


def test_no_number_in_a_hit_stops_the_job(spark):
    texts = [
        "99999999999d ago", "1,000,000,000,000,000,000,000 views", "99999999999999999999m views", "\u0661\u0662d ago",
        "\u0663K views", "9" * 400 + "m plays", "1," + "000," * 30 + "000 plays", "3w ago", "1.5M views",
    ]
    as_of = F.lit("2024-02-01").cast("date")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = rows.withColumns({"v": R.view_parts(F.col("t")), "a": R.age_parts(F.col("t"))})
    got = parsed.select("i", R.view_count(F.col("v")).alias("v"), R.age_days(F.col("a"), as_of).alias("a")).orderBy("i").collect()
    most = 2**63 - 1
    assert [r.v for r in got] == [None, most, most, None, 3000, most, most, None, 1_500_000]
    assert [r.a for r in got] == [R.MOST_AGE, None, None, 12, None, None, None, 21, None]


def test_bad_bytes_are_left_out(spark):
    rows = spark.createDataFrame([(bytearray(b"a\xffb\xc3\xa9"),), (bytearray("x\ufffdy".encode()),), (None,)], "c binary")
    assert [r.t for r in rows.select(M.lenient_utf8(F.col("c")).alias("t")).collect()] == ["ab\u00e9", "x\ufffdy", None]


def test_a_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    from tidemark import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="share"):
        session.ensure_checkpoint_dir(spark)


def test_surplus_cells_stay_whole(spark):
    from tidemark.functions import script as X

    cells = ["[00:00]", "Scene 1", "INT. room", "x", "y", *[f"c{i}" for i in range(40)]]
    row = spark.createDataFrame([(cells,)], "c array<string>").select(X.four_cells(F.col("c")).alias("c")).first().c
    assert row[-1].split(" | ") == cells[5:]
