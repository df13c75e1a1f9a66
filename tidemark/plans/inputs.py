"""Inputs of the registered queries, derived from the given tables.

Every input is a list of select expressions over whole tables, in the part of SQL that
Spark and DuckDB share, so that query and check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.sources.readers import spread, table


def pick(number: str, values: list[str]) -> str:
    """One of the values, by the remainder of a whole number."""
    cases = " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(values))
    return f"CASE ({number}) % {len(values)} {cases} END"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def whole(number: str, by: int) -> str:
    """Whole part of a quotient."""
    return f"CAST(floor(({number}) / {by}) AS BIGINT)"


PHRASES = [
    "This is the best serum ever.",
    "Clinically proven to cure acne overnight | 100%x sure",
    "### always a title",
    "**Guaranteed**",
    "Paid partnership with Acme",
    "| never | El mejor producto |",
    "|---|---|",
    "cura y curar, weight loss instantly",
    "#ad Safe, zero risk and risk-free",
    "Perfect",
    "una parfait toujours, sofort! mejor",
]
PLATFORM_TEXTS = ["TikTok", "YouTube Shorts", "Instagram Reels", "Twitter", "Reddit", "Discord", "Twitch TV", "Kwai Go"]
PLATFORMS = ["tiktok", "youtube", "instagram", "x", "reddit", "discord"]
COUNTRIES = [m[0] for m in fixed.MARKETS] + ["ZZ"]

SCRIPTS = [
    "doc_id",
    "source",
    f"text || chr(10) || {pick('doc_id', PHRASES)} AS final_script",
    f"{pick(whole('doc_id', 2), fixed.DISTRIBUTION_MODES)} AS distribution_mode",
    f"{pick(whole('doc_id', 3), fixed.PRODUCT_CATEGORIES)} AS product_category",
    f"{pick(whole('doc_id', 5), PLATFORMS)} AS target_platform",
]

KNOWLEDGE = [
    "CAST(doc_id AS VARCHAR(20)) AS doc_id",
    "'Doc ' || CAST(doc_id AS VARCHAR(20)) AS source_title",
    "CASE doc_id % 5 WHEN 0 THEN 'law' ELSE 'policy' END AS source_type",
    "CASE doc_id % 4 WHEN 0 THEN '' ELSE 'http://kb/' || CAST(doc_id AS VARCHAR(20)) END AS source_url",
    "'kb/' || CAST(doc_id AS VARCHAR(20)) AS path",
    f"{pick('doc_id', fixed.RELEVANT_CATEGORIES)} AS source_category",
    f"{pick(whole('doc_id', 5), ['all', 'tiktok', 'youtube', 'instagram', 'global'])} AS platform",
    f"{pick(whole('doc_id', 3), ['all', 'organic', 'branded_content', 'paid_ads'])} AS distribution_mode",
    "CASE WHEN doc_id % 6 = 0 THEN 'acme' ELSE 'all' END AS brand_id",
    f"{pick(whole('doc_id', 7), ['GLOBAL', 'US', 'DE', 'FR', 'BR', ''])} AS country_code",
    f"{pick(whole('doc_id', 7), ['GLOBAL', 'AMER', 'EU', 'EU', 'LATAM', 'EU'])} AS region_pack",
    "lang AS language",
    f"{pick(whole('doc_id', 2), ['P0', 'P1', 'P2', 'P3', 'none'])} AS priority",
    f"{whole('doc_id', 7)} % 6 = 0 AS is_global_fallback",
    "'# ' || lang || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS body",
]

REQUESTS = [
    "CAST(item_id AS VARCHAR(20)) AS request_id",
    "text AS query_text",
    f"{pick('item_id', COUNTRIES)} AS target_country",
    f"{pick('item_id', PLATFORMS[:3])} AS target_platform",
    f"{pick(whole('item_id', 2), fixed.DISTRIBUTION_MODES)} AS distribution_mode",
    f"{pick(whole('item_id', 3), fixed.PRODUCT_CATEGORIES)} AS product_category",
    "CASE WHEN item_id % 2 = 0 THEN 'acme' ELSE 'default' END AS brand_id",
    f"{pick('item_id', ['English', 'français', 'Deutsch', 'es'])} AS language_name",
]

NOISE = [
    "Page 3 of 9", "  12  ", "| | |", "[Table of Contents](#toc)", "12 Legal, decent, honest and truthful", "DRAFT",
    "Cookie settings", "[Skip to content](#main)", "table of contents", "toc", "a – b • c 7", "",
]
NOISY = [
    "doc_id",
    "source",
    f"""'Running head 1' || chr(10) || 'Same line 1' || chr(10) || 'same LINE 2' || chr(10) || text || chr(10)
    || {pick('doc_id', NOISE)} || chr(10) || chr(10) || chr(10) || 'Running head 2' || chr(10) || substr(text, 1, 40)
    || chr(10) || '  ' || chr(10) || {pick(whole('doc_id', 2), NOISE)} || chr(10) || 'Running head 3' AS body""",
]

RAW_SCOPES = [
    "c_custkey",
    f"{pick('c_nationkey', COUNTRIES + ['us', 'de', 'br', 'gb', 'fr', 'it', 'sa'])} AS target_country",
    f"{pick('c_custkey', PLATFORM_TEXTS)} AS target_platform",
    f"{pick(whole('c_custkey', 2), ['organic', 'Branded_Content', 'PAID_ADS'])} AS distribution_mode",
    "c_mktsegment AS product_category",
    f"{pick('c_custkey', ['English', 'español', 'Klingon', ' Deutsch '])} AS language_one",
    f"{pick(whole('c_custkey', 4), ['english', 'Português', 'en', 'fr', 'العربية'])} AS language_two",
]

TALENT_PROGRESS = ["待沟通", "跟进中", "正在对接", "推进签约", "已签合同", "制作中", "拍摄", "已合作", "交付完成", "", "unknown"]
TALENTS = [
    "c_custkey AS id",
    "CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_custkey + 100000 END AS user_id",
    "c_name AS name",
    f"{pick('c_nationkey', ['TikTok', 'YouTube', '', 'Instagram'])} AS platform",
    "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name || '@mail' END AS email",
    "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'http://v/' || CAST(c_custkey AS VARCHAR(20)) END AS recent_video_link",
    "CASE WHEN c_custkey % 5 < 2 THEN '' ELSE c_mktsegment END AS notes",
    f"{pick('c_custkey', TALENT_PROGRESS)} AS collaboration_progress",
    "c_nationkey AS nation",
]
USERS = [
    "c_custkey + 100000 AS id",
    "c_name AS name",
    "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS style_prompt",
    "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'shot' END AS few_shot",
]
SCRIPT_ROWS = [
    "o_orderkey AS id",
    "o_custkey + 100000 AS user_id",
    "o_orderpriority AS topic",
    "o_orderstatus AS platform",
    "o_totalprice AS creativity",
]


HIT_TEXTS = [
    "1.2M views 2d ago", "850K views", "3 million plays 1w ago", "1,250,000 views · 5h ago", "million views 3d ago",
    "250000 views", "12 plays", "99k views 1d ago", "120k plays 2024-01-02", "2.5m plays January 29, 2024", "no signal", "• 1-30 seen",
]
HIT_HOSTS = [
    "www.tiktok.com/@a/", "instagram.com/p/", "x.com/s/", "m.twitter.com/s/", "netflix.com/t/", "news.example.org/n/", "www.example.com/",
]
HITS = [
    "event_id",
    "CAST(user_id AS VARCHAR(20)) AS request_id",
    f"{pick('user_id', ['tiktok', 'instagram', 'x', 'youtube'])} AS wanted",
    f"{pick('event_id', fixed.VIRAL_PLATFORMS)} AS platform",
    f"CAST({whole('event_id', 3)} % 2 AS INT) AS query_no",
    f"CAST({whole('event_id', 6)} % 1000 AS INT) AS hit_no",
    f"CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type || ' clip ' || CAST(event_id % 50 AS VARCHAR(20)) END AS title",
    f"{pick('event_id', HIT_TEXTS)} || ' by ' || event_type || ' ' || props AS content",
    f"{pick(whole('event_id', 5), HIT_TEXTS)} || ' ' || props AS raw_content",
    f"CASE WHEN event_id % 23 = 0 THEN '' ELSE 'https://' || {pick('event_id', HIT_HOSTS)} || CAST(event_id % 400 AS VARCHAR(20)) END AS url",
    "CAST(event_id % 100 AS DOUBLE) / 100 AS score",
]
AS_OF = "2024-02-01"

TREND_REQUESTS = [
    "CAST(user_id AS VARCHAR(20)) AS request_id",
    f"{pick('user_id', ['  new phones ', '', 'skin care'])} AS topic",
    f"{pick('user_id', COUNTRIES)} AS target_country",
    f"{pick('user_id', PLATFORM_TEXTS)} AS target_platform",
    f"{pick('user_id', ['organic', 'branded_content', 'paid_ads', 'other'])} AS distribution_mode",
    f"{pick('user_id', fixed.PRODUCT_CATEGORIES + ['home_garden'])} AS product_category",
    "CASE WHEN user_id % 5 = 0 THEN '' ELSE '  Short   answer ' || CAST(user_id AS VARCHAR(20)) END AS answer",
    "CASE WHEN user_id % 7 = 0 THEN 'search timed out' END AS reason",
    f"{pick('user_id', ['English', 'français', 'Deutsch'])} AS language_name",
]

MODULES = ["videos", "industry_categories", "topic_brief"]
def payloads(mark: str) -> str:
    """Payloads of several shapes: nested members, an error of its own, nulls, nothing, no JSON, no object."""
    n = "CAST(event_id AS VARCHAR(20))"
    return f"""CASE event_id % 7
      WHEN 0 THEN '{{"items": [{{"from": "{mark}", "props": ' || props || '}}, ' || {n} || '], "categories": [{{"key": "marketing", "summary": "' || event_type || '"}}], "topic_brief": {{"trend_data": "é ' || {n} || '", "trend_sources": [' || props || ']}}}}'
      WHEN 1 THEN '{{"error": "own ' || {n} || '", "extra": {{"a": {{"b": [1, [2, {{}}]]}}}}, "items": [], "topic_brief": {{"trend_query": "q ' || {n} || '"}}}}'
      WHEN 2 THEN '{{"categories": null, "error": null, "items": null, "topic_brief": null}}'
      WHEN 3 THEN '{{}}'
      WHEN 4 THEN '{mark} ' || props
      WHEN 5 THEN '[' || props || ']'
      ELSE props END"""


SNAPSHOTS = [
    "event_id",
    f"{pick('event_id', MODULES)} AS module_name",
    "'scope ' || CAST(user_id AS VARCHAR(20)) AS scope_key",
    f"{payloads('old')} AS payload",
    "ts AS updated_at",
]
LOADS = [
    f"{pick('event_id', MODULES)} AS module_name",
    "'scope ' || CAST(user_id AS VARCHAR(20)) AS scope_key",
    f"{payloads('fresh')} AS payload",
    "ts AS loaded_at",
    "CASE WHEN event_type = 'error' THEN 'load ' || CAST(event_id % 9 AS VARCHAR(20)) END AS error",
    "event_id",
]
SERVED = [
    "CAST(event_id AS VARCHAR(20)) AS request_id",
    f"{pick('event_id', MODULES)} AS module_name",
    "'scope ' || CAST(user_id + event_id % 40 AS VARCHAR(20)) AS scope_key",
    "event_type IN ('click', 'error') AS refresh",
]

TREND_VISITS = [
    f"CAST({whole('event_id', 3)} AS VARCHAR(20)) AS request_id", *SERVED[1:],
    f"'{{\"topic\": \"t ' || CAST({whole('event_id', 3)} AS VARCHAR(20)) || '\"}}' AS filters",
]

EVENTS = [
    "CAST(user_id AS VARCHAR(20)) AS run_id",
    "event_id AS event_no",
    f"{pick('event_id', fixed.GENERATE_STEPS + ['unknown'])} AS step",
    "CASE event_type WHEN 'view' THEN 'active' WHEN 'signup' THEN 'active' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'skipped' ELSE 'error' END AS status",
    "CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || ' ' || CAST(event_id % 13 AS VARCHAR(20)) END AS message",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS duration_ms",
    "CASE WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'error' WHEN event_id % 97 = 0 THEN 'complete' ELSE 'progress' END AS event",
    "CASE WHEN event_type = 'error' THEN 'workflow_error' END AS error_type",
    "ts",
]

SCRIPT_TEXTS = [
    "conv_id",
    "turn",
    f"""CASE turn % 6
      WHEN 0 THEN '```markdown' || chr(10) || 'Sure, here it is' || chr(10) || '### Scene' || chr(10) || text || chr(10) || '```'
      WHEN 1 THEN '### S' || chr(10) || '| Time | Visual | Audio | Notes |' || chr(10) || '|---|---|---|---|' || chr(10)
        || '| [00:00-00:03] | Scene ' || CAST(turn AS VARCHAR(20)) || ' | INT. room | wide | hello | more | end |' || chr(10)
        || '| [00:03-00:05] | a | b | c | ' || role || ' |' || chr(10) || '|  |' || chr(10) || '| x | y |' || chr(10) || text
      WHEN 2 THEN 'lead in' || chr(10) || '**Title** ' || role || chr(10) || '| [00:01-00:02] | v | a | b | n |' || chr(10) || text
      WHEN 3 THEN '  ' || text || '  '
      WHEN 4 THEN 'Answer: ' || chr(10) || '```json' || chr(10) || '{{"overall_status": "' || role || '", "overall_risk": "HIGH"}}' || chr(10) || '```' || chr(10) || text
      ELSE 'note {{"overall_status": "approved", "n": ' || CAST(turn AS VARCHAR(20)) || CASE WHEN conv_id % 2 = 0 THEN '}}' ELSE '' END || ' end ' || text END AS script""",
]

REVIEWED = [
    *SCRIPTS[:-4],
    f"CASE WHEN doc_id % 19 = 0 THEN ' ' ELSE text || chr(10) || {pick('doc_id', PHRASES)} END AS final_script",
    *SCRIPTS[-3:],
    "CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS topic",
    "doc_id % 7 <> 0 AS has_evidence",
    f"""{pick('doc_id', ['{"overall_status": "approved"}', 'text only', '{"overall_status": "ODD", "overall_risk": "extreme", "issues": []}', '{"overall_status": "needs_revision", "overall_risk": "LOW", "headline": "H"}', 'x {"overall_status": "insufficient_evidence", "issues": [{"excerpt": "Perfect", "issue_type": "local_law", "risk_level": "weird"}, {"risk_level": "HIGH"}]} y', '{"broken": '])} AS raw_text""",
]

CATALOG = [
    "'doc_' || CAST(doc_id AS VARCHAR(20)) AS id",
    "'Title ' || CAST(doc_id AS VARCHAR(20)) AS title",
    f"{pick('doc_id', fixed.RELEVANT_CATEGORIES + ['internal_brand', 'technical_reference'])} AS category",
    f"{pick(whole('doc_id', 3), ['AMER', 'EU', 'GLOBAL'])} AS region",
    f"{pick(whole('doc_id', 2), ['US', 'UK', 'EU', 'GLOBAL', 'INTERNAL', 'DE'])} AS market",
    f"{pick('doc_id', ['TikTok', 'x', 'all', 'kwai'])} AS platform",
    "lang AS language",
    "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://src.example.com/' || CAST(doc_id AS VARCHAR(20)) END AS url",
    f"{pick('doc_id', ['auto', 'auto', 'auto', 'manual'])} AS crawl_mode",
    f"{pick('doc_id', ['P0', 'P1', 'p2'])} AS priority",
    "CASE WHEN doc_id % 4 = 0 THEN 'a|b' ELSE '' END AS notes",
]
FETCHES = [
    "doc_id",
    "CASE WHEN doc_id % 13 = 0 THEN 404 WHEN doc_id % 17 = 0 THEN NULL ELSE 200 END AS http_status",
    "CASE WHEN doc_id % 17 = 0 THEN 'timed out' END AS error",
    f"text || {pick('doc_id', ['', ' Just a moment', ' Please ENABLE JavaScript', '', ' captcha'])} AS content",
    f"{pick(whole('doc_id', 2), ['text/html; charset=utf-8', 'application/pdf', 'text/html', 'application/json', 'weird/type'])} AS content_type",
    f"{pick('doc_id', ['https://a.example.com/x.PDF', 'https://a.example.com/x', 'http://b.example.org/y.html'])} AS fetch_url",
]
STORED = [
    "'doc_' || CAST(doc_id AS VARCHAR(20)) AS source_id",
    "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'Stored ' || CAST(doc_id AS VARCHAR(20)) END AS title",
    f"{pick('doc_id', ['market_law', '', 'platform_policy'])} AS source_category",
    f"{pick('doc_id', ['market_law', 'brand_policy'])} AS document_type",
    "'all' AS platform",
    f"{pick('doc_id', ['US', 'EU'])} AS region",
    "'GLOBAL' AS region_pack",
    "lang AS language",
    "'' AS source_url",
    "source AS notes",
    "'P1' AS priority",
    "CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'raw/doc_' || CAST(doc_id AS VARCHAR(20)) || '.html' END AS raw_file",
    "CASE doc_id % 3 WHEN 0 THEN '2024-01-10T00:00:00Z' WHEN 1 THEN '2024-03-10 08:00:00' ELSE 'bad' END AS processed_at",
    "doc_id % 2 = 0 AS markdown_exists",
]

LAYOUT = [
    "l_orderkey AS doc",
    "CAST(l_linenumber % 2 AS INT) AS page",
    "CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) * 1000 + CAST(l_quantity AS BIGINT) AS element_no",
    "CASE WHEN l_partkey % 9 = 0 THEN 'table' ELSE 'text' END AS kind",
    "50.0 + (l_suppkey % 3) * 200 AS x0",
    "40.0 * l_linenumber AS y0",
    "50.0 + (l_suppkey % 3) * 200 + l_quantity * 4 AS x1",
    "40.0 * l_linenumber + 10 + l_quantity AS y1",
    f"{pick('l_partkey', ['Short title', 'What is an advertising claim?', 'A longer body line that goes on and on without being a heading at all', '12', '- item'])} AS text",
    f"CASE l_partkey % 6 WHEN 0 THEN 22.4 WHEN 1 THEN 16.6 WHEN 2 THEN 14.2 ELSE 11.0 END AS font_size",
]
CELLS = [
    "l_orderkey AS table_id",
    "CAST(l_linenumber AS INT) AS row_no",
    "l_returnflag",
    "l_linestatus",
    "CAST(l_partkey AS VARCHAR(20)) AS part_text",
    "CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE CAST(l_suppkey AS VARCHAR(20)) END AS supplier_text",
]


def rows(spark: SparkSession, folder: str, name: str, exprs: list[str]) -> DataFrame:
    return spread(table(spark, folder, name)).selectExpr(*exprs)


def sql(exprs: list[str], name: str) -> str:
    """The same input as a DuckDB subquery."""
    return f"SELECT {', '.join(exprs)} FROM {name}"


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    return rows(spark, folder, "documents", SCRIPTS)


def knowledge(spark: SparkSession, folder: str) -> DataFrame:
    return rows(spark, folder, "documents", KNOWLEDGE)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    got = rows(spark, folder, "benchmark", REQUESTS)
    return got.withColumn("target_languages", F.array("language_name")).drop("language_name")
