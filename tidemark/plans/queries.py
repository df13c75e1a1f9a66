"""The registered queries: every operator run over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import meta as M
from tidemark.functions import scope as S
from tidemark.functions import script as X
from tidemark.functions import talent as L
from tidemark.functions import text as T
from tidemark.functions import trend as TF
from tidemark.functions import web
from tidemark.functions import workflow as W
from tidemark.operators import chunk as K
from tidemark.operators import corpus as C
from tidemark.operators import crm
from tidemark.operators import embed as E
from tidemark.operators import html as H
from tidemark.operators import layout as LY
from tidemark.operators import library as LB
from tidemark.operators import progress as PR
from tidemark.operators import report as P
from tidemark.operators import retrieve as V
from tidemark.operators import rules as R
from tidemark.operators import trends as TR
from tidemark.operators.keyed import last_per_key, rows_of, top_k
from tidemark.operators.pruned import best_vectors
from tidemark.plans import inputs as I
from tidemark.session import cut_lineage, ensure_checkpoint_dir, ship_package, small_batches
from tidemark.sources import writers
from tidemark.sources.readers import event_texts as decode_events
from tidemark.sources.readers import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(ship_package(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


# --- scripts and rules --------------------------------------------------------------------


def _reviewed(spark: SparkSession, folder: str) -> DataFrame:
    return R.rule_issues(I.scripts(spark, folder))


@query
def script_risk(spark, folder):
    """Risk and number of issues per script."""
    return _reviewed(spark, folder).select(
        "doc_id", F.size("issues").alias("issue_count"), R.highest_risk(F.col("issues")).alias("risk")
    )


@query
def rule_issues(spark, folder):
    """Every rule hit with its first matching line."""
    return R.issue_rows(_reviewed(spark, folder), "doc_id").drop("citations")


@query
def disclosure_gaps(spark, folder):
    """Promotional scripts without a disclosure, per source and mode."""
    s = I.scripts(spark, folder).filter(F.col("distribution_mode").isin(*fixed.DISCLOSURE_MODES))
    return s.groupBy("source", "distribution_mode").agg(
        F.count("*").alias("scripts"),
        F.count(F.when(R.lacks_disclosure(F.lower("final_script")), 1)).alias("undisclosed"),
    )


@query
def sensitive_claims(spark, folder):
    """Hits of the gated rules per product category."""
    rules = [r for r in R.default_rules() if r.products]
    found = R.rule_issues(I.scripts(spark, folder), rules)
    hits = rows_of(found, ["product_category"], F.col("issues"), "issue_no", "i").filter("i.rule_no > 0")
    return hits.groupBy("product_category", "i.rule_no").agg(F.count("*").alias("scripts"))


@query
def checkable_lines(spark, folder):
    """Lines the rules look at."""
    return rows_of(I.scripts(spark, folder), ["doc_id"], X.checkable_lines("final_script"), "line_no", "line")


# --- scope --------------------------------------------------------------------------------


@query
def scope_resolve(spark, folder):
    """Canonical scope per request."""
    raw = I.rows(spark, folder, "customer", I.RAW_SCOPES)
    asked = raw.withColumn("target_languages", F.array("language_one", "language_two"))
    return S.resolve_scope(asked).select(
        "c_custkey",
        "target_country",
        "target_region_pack",
        "target_platform",
        "distribution_mode",
        "product_category",
        "brand_id",
        F.array_join("knowledge_languages", ",").alias("knowledge_languages"),
    )


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return S.resolve_scope(I.requests(spark, folder))


@query
def scope_candidates(spark, folder):
    """Documents each request may search or cite, with the sum of their scope scores."""
    docs = I.knowledge(spark, folder).withColumn("profile", V.profile_key())
    sizes = docs.groupBy("profile", *K.PROFILE).agg(F.count("*").alias("n"))
    pairs = V.request_profiles(_requests(spark, folder), sizes.drop("n"))
    rows = pairs.join(sizes.select("profile", "n"), "profile")
    return rows.groupBy("request_id", "source_category").agg(
        F.sum(F.when(F.col("searched"), F.col("n")).otherwise(0)).alias("searched"),
        F.sum(F.when(F.col("in_scope"), F.col("n")).otherwise(0)).alias("in_scope"),
        F.sum(F.when(F.col("in_scope"), F.col("n") * (F.col("scope_bonus") + F.col("language_bonus"))).otherwise(0)).alias("points"),
    )


# --- corpus -------------------------------------------------------------------------------


def _noisy_documents(spark: SparkSession, folder: str) -> DataFrame:
    return I.rows(spark, folder, "documents", I.NOISY)


@query
def clean_lines(spark, folder):
    """Documents after noise lines, repeats and surplus blank lines are gone."""
    clean = C.clean_documents(_noisy_documents(spark, folder))
    return rows_of(clean, ["doc_id"], T.split_lines("clean"), "line_no", "line")


@query
def repeated_lines(spark, folder):
    """Lines that come back in a document, by key."""
    lines = _noisy_documents(spark, folder).select("doc_id", F.explode(T.split_lines("body")).alias("line"))
    keyed = lines.withColumn("line_key", T.line_key("line")).filter("line_key != ''")
    return keyed.groupBy("doc_id", "line_key").agg(F.count("*").alias("times")).filter("times >= 3")


@query
def noise_lines(spark, folder):
    """Noise lines per document source."""
    lines = _noisy_documents(spark, folder).select("source", F.explode(T.split_lines("body")).alias("line"))
    lines = lines.withColumn("clean", T.clean_line("line"))
    return lines.groupBy("source").agg(
        F.count("*").alias("lines"),
        F.count(F.when(T.is_noise_line("line"), 1)).alias("block_noise"),
        F.count(F.when(C.is_dropped(F.col("clean")), 1)).alias("markdown_noise"),
    )


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return K.chunk_documents(I.knowledge(spark, folder))


@query
def chunk_rows(spark, folder):
    """Chunks of the knowledge documents."""
    return _chunks(spark, folder).select(
        "chunk_id", "point_id", "doc_id", "chunk_index", "heading_path", F.length("text").alias("chars"), F.md5("text").alias("digest")
    )


@query
def chunk_stats(spark, folder):
    """Documents and chunks per category."""
    return _chunks(spark, folder).groupBy("source_category").agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars")
    )


@query
def block_rows(spark, folder):
    """Markdown blocks of the knowledge documents."""
    docs = I.knowledge(spark, folder).select("doc_id", "body")
    return K.block_rows(docs).select("doc_id", "block_no", "kind", F.md5("text").alias("digest"))


# --- retrieval ----------------------------------------------------------------------------

MD5 = E.HashEmbedder(digest="md5")


@query
def hash_embedding(spark, folder):
    """Non-zero entries of the hashed document vectors."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    rows = E.with_vectors(docs, embedder=MD5).select("doc_id", F.inline(E.sparse(F.col("vector"))))
    return rows.select("doc_id", "idx", F.round("val", 6).alias("val"))


def _near_vectors(spark: SparkSession, folder: str, **how: int) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.expr(I.pick("label", [c for c, _ in fixed.CATEGORY_GROUPS])).alias("cell"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    asked = vectors.filter(F.col("chunk_id").cast("bigint") % 100 == 0)
    asked = asked.select(F.col("chunk_id").alias("request_id"), "vector")
    kinds = F.explode(F.array(*[F.lit(c) for c, _ in fixed.CATEGORY_GROUPS]))
    pairs = asked.select("request_id", kinds.alias("cell"))
    pairs = pairs.select("request_id", S.category_group("cell").alias("group"), "cell")
    return best_vectors(vectors, pairs, asked, 24, **how).select(
        F.col("request_id").cast("bigint").alias("vec_id"),
        F.col("group").alias("category_group"),
        F.col("chunk_id").cast("bigint").alias("near_id"),
        F.round("value", 3).alias("cosine"),
        "found_rank",
    )


@query
def vector_topk(spark, folder):
    """Nearest vectors in each category group, of every vector whose id is divisible by 100, among all vectors."""
    return _near_vectors(spark, folder)


@query
def vector_blocks(spark, folder):
    """The same by blocks of like direction, most of which bounds can leave out."""
    return _near_vectors(spark, folder, direct_pairs=0)


def _retrieval(spark: SparkSession, folder: str) -> V.Retrieval:
    """The index is written once, and each stage reads the files and columns of it that it needs."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    with small_batches(spark):
        # an excerpt is the front of its text, and made of it where it is read
        writers.index(_chunks(spark, folder).drop("excerpt"), path, "", lambda rows: E.with_vectors(rows, embedder=MD5))
        asked = cut_lineage(E.with_vectors(_requests(spark, folder), "query_text", MD5))
    return V.Retrieval(asked, writers.read_index(spark, path))


@query
def hybrid_evidence(spark, folder):
    """Balanced evidence per request: vector search, rerank, fallback, quotas."""
    rows = _retrieval(spark, folder).evidence()
    points = F.round(F.col("score") * 10000).cast("bigint")
    return rows.select(
        "request_id", "evidence_rank", "doc_id", "source_category", F.col("chunk_id").alias("block_id"), "country_code",
        points.alias("score_e4"), F.md5("excerpt").alias("digest"),
    )


@query
def fallback_ranking(spark, folder):
    """Lexical ranking of the required categories for every request."""
    r = _retrieval(spark, folder)
    rows = r.fallback()
    order = [F.col("score").desc(), F.col("chunk_id")]
    ranked = top_k(rows, ["request_id", "source_category"], order, max(4, r.limit))
    return ranked.select("request_id", "source_category", "rank", "chunk_id", F.col("score").cast("int").alias("score"))


@query
def lexical_search(spark, folder):
    """The lexical-only path: strict scope, best documents per request."""
    docs = I.knowledge(spark, folder).withColumn("tokens", T.token_set("body"))
    return V.lexical_search(_requests(spark, folder), docs)


@query
def lexical_postings(spark, folder):
    """The same over an inverted index, whatever the size of the tables."""
    docs = I.knowledge(spark, folder).withColumn("tokens", T.token_set("body"))
    return V.lexical_search(_requests(spark, folder), docs, direct_pairs=0)


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as scripts, with their evidence and rule issues."""
    r = _retrieval(spark, folder)
    evidence = V.evidence_per_request(V.evidence_rows(r.evidence()))
    phrase = F.expr(I.pick("CAST(request_id AS BIGINT)", I.PHRASES))
    runs = r.requests.select(
        "request_id", "target_platform", "distribution_mode", "product_category",
        F.concat_ws("\n", "query_text", phrase).alias("final_script"),
    )
    return R.rule_issues(runs.join(evidence, "request_id", "left"))


@query
def citations(spark, folder):
    """Citations of every rule issue."""
    issues = R.issue_rows(_cited(spark, folder), "request_id")
    rows = rows_of(issues, ["request_id", "rule_no"], F.col("citations"), "citation_no", "c")
    return rows.select("request_id", "rule_no", "citation_no", "c.source_title", "c.block_id", "c.country_code")


@query
def evidence_digest(spark, folder):
    """Evidence of each request as one text."""
    rows = V.evidence_rows(_retrieval(spark, folder).evidence())
    per = V.evidence_per_request(rows)
    text = P.evidence_digest(F.col("evidence"))
    return per.select("request_id", "evidence_count", F.length(text).alias("chars"), F.md5(text).alias("digest"))


# --- pages --------------------------------------------------------------------------------


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"))


@query
def page_heads(spark, folder):
    """Title, description, canonical URL, digest and block signal of every page."""
    return H.with_heads(_pages(spark, folder)).select(
        "page_id",
        "html_title",
        "meta_description",
        "canonical_url",
        web.content_digest("html").alias("sha256"),
        F.octet_length("html").alias("file_size"),
        web.host_of("url").alias("domain"),
        web.blocked_signal("html").alias("blocked"),
    )


@query
def page_content(spark, folder):
    """Main content of every page as a markdown body."""
    rows = H.page_markdown(_pages(spark, folder))
    return rows.select("page_id", "root_tag", F.length("markdown").alias("chars"), F.md5("markdown").alias("digest"))


@query
def link_densities(spark, folder):
    """Link density and score of the content candidates of every page."""
    return H.link_densities(_pages(spark, folder))


@query
def page_chunks(spark, folder):
    """Chunks of the main content of every page."""
    body = C.tidy_markdown(H.page_markdown(_pages(spark, folder)), "markdown")
    docs = K.plain_source(body, F.col("page_id"), F.concat(F.lit("Page "), F.col("page_id")), F.col("markdown"))
    return K.chunk_documents(docs).select("chunk_id", "heading_path", F.length("text").alias("chars"))


@query
def url_platforms(spark, folder):
    """Platform and display domain of the URLs of pages and hits."""
    hits = I.rows(spark, folder, "events", I.HITS).select("url")
    urls = _pages(spark, folder).select("url").unionByName(hits)
    return urls.groupBy(
        web.platform_of_url("url").alias("platform"),
        web.platform_of_url("url", strict=True).alias("strict_platform"),
        web.display_domain("url").alias("domain"),
    ).agg(F.count("*").alias("urls"))


# --- trends -------------------------------------------------------------------------------


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return I.rows(spark, folder, "events", I.HITS)


@query
def hit_signals(spark, folder):
    """Age, views and platform read from every hit."""
    read = TR.read_signals(_hits(spark, folder), F.lit(I.AS_OF).cast("date"))
    return read.select(
        "event_id", "age_days", "view_count", "platform_key", TF.view_label("view_count").alias("view_label")
    )


@query
def viral_benchmarks(spark, folder):
    """Top hits per request, with platform fallback and URL deduplication."""
    images = F.transform(F.sequence(F.lit(0), F.col("event_id") % 400), lambda i: F.concat(F.lit("https://img.example.com/"), i.cast("string")))
    hits = _hits(spark, folder).withColumn("images", F.when(F.col("event_id") % 29 != 0, images))
    best = TR.viral_benchmarks(hits, F.lit(I.AS_OF).cast("date"))
    return best.select("request_id", "rank", "title", "url", "platform_key", "view_count", "view_count_label", "score", "image_url")


def _trend_requests(spark: SparkSession, folder: str) -> DataFrame:
    raw = I.rows(spark, folder, "events", I.TREND_REQUESTS).distinct()
    return raw.withColumn("target_languages", F.array("language_name")).drop("language_name")


@query
def trend_queries(spark, folder):
    """Search texts and scope keys of every trend request."""
    r = _trend_requests(spark, folder)
    names = ["topic", "target_country", "target_platform", "distribution_mode", "product_category", "target_languages"]
    fields = {n: F.col(n) for n in names}
    label = S.market_label(F.col("target_country"))
    focus = TF.focus_text(F.col("topic"), F.col("product_category"), F.col("distribution_mode"))
    viral = TF.viral_queries(S.canonical_platform("target_platform"), label, focus, F.lit(3))
    industry = TF.industry_queries(label, F.col("target_platform"), F.col("topic"))
    return r.select(
        "request_id",
        TF.trend_query(fields).alias("trend_query"),
        F.array_join(viral, "\n").alias("viral_queries"),
        F.array_join(F.transform(industry, lambda q: q["query"]), "\n").alias("industry_queries"),
        TF.scope_key(fields, "videos").alias("scope_key"),
    )


def _brief_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hits(spark, folder)
    return hits.withColumn("hit_no", F.col("event_id"))


@query
def module_requests(spark, folder):
    """The module requests of every trend request."""
    r = _trend_requests(spark, folder).withColumns({"refresh_videos": F.col("reason").isNull(), "refresh_industry": F.col("topic") == ""})
    return TR.module_requests(r)


@query
def trend_briefs(spark, folder):
    """Trend brief, its summary and sources per request."""
    r = _trend_requests(spark, folder)
    failures = r.filter("reason is not null").select("request_id", "reason")
    briefs = TR.trend_briefs(r.drop("reason"), _brief_hits(spark, folder), failures)
    return briefs.select(
        "request_id",
        F.md5("trend_data").alias("digest"),
        TF.brief_summary(F.col("trend_data")).alias("summary"),
        F.size("trend_sources").alias("sources"),
        TF.is_live(F.col("trend_sources"), F.col("trend_data")).alias("live"),
    )


@query
def industry_digest(spark, folder):
    """First articles and summary per request and industry category."""
    key = F.expr(I.pick("event_id", [k for k, _, _ in fixed.INDUSTRY_CATEGORIES]))
    articles = _brief_hits(spark, folder).withColumn("category_key", key)
    rows = TR.industry_digest(articles)
    return rows.select(
        "request_id", "category_key", "summary", F.size("articles").alias("articles"),
        F.array_join(F.transform("articles", lambda a: F.concat_ws("~", a["title"], a["source"], a["url"])), "\n").alias("listing"),
    )


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.rows(spark, folder, "events", I.SNAPSHOTS)
    return last_per_key(rows, TR.SNAPSHOT_KEYS, [F.col("updated_at"), F.col("event_id")]).drop("event_id")


def _served(spark: SparkSession, folder: str, asked: list[str] = I.SERVED) -> DataFrame:
    old = _snapshots(spark, folder)
    loads = I.rows(spark, folder, "events", I.LOADS)
    loads = last_per_key(loads, TR.SNAPSHOT_KEYS, [F.col("event_id")]).drop("event_id")
    return TR.serve_modules(I.rows(spark, folder, "events", asked), old, loads)


@query
def snapshot_latest(spark, folder):
    """Newest snapshot per module and scope."""
    rows = _snapshots(spark, folder)
    return rows.select("module_name", "scope_key", "payload", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at_us"))


@query
def snapshot_serve(spark, folder):
    """What every module request gets: cached, fresh, stale or nothing."""
    rows = _served(spark, folder)
    at = F.unix_micros(F.col("cached_at").cast("timestamp"))
    return rows.select("request_id", "module_name", "payload", "error", "from_cache", "stale", "store", "load_payload", at.alias("at_us"))


@query
def module_meta(spark, folder):
    """Roll-up of the module answers per scope."""
    rows = _served(spark, folder).withColumn("no", F.col("request_id").cast("bigint"))
    meta = TR.module_meta(rows, ["scope_key"], "no")
    return meta.withColumn("cached_at", F.unix_micros(F.col("cached_at").cast("timestamp")))


@query
def trend_results(spark, folder):
    """The three modules of a trend request in one row."""
    rows = TR.trend_result(_served(spark, folder, I.TREND_VISITS))
    return rows.select(
        "request_id", "filters", "trend_hunter", "benchmarks", "benchmarks_error", F.col("videos.payload").alias("videos"),
        F.col("industry.error").alias("industry_error"), F.col("industry.from_cache").alias("industry_cached"),
        F.col("industry.stale").alias("industry_stale"), F.col("industry.categories").alias("categories"),
        F.col("industry.topic_brief").alias("topic_brief"),
    )


# --- scripts as markdown ------------------------------------------------------------------


@query
def script_cleanup(spark, folder):
    """Cleaned and repaired scripts."""
    rows = I.rows(spark, folder, "conversations", I.SCRIPT_TEXTS)
    return X.clean_scripts(rows, "script").select("conv_id", "turn", F.col("script"))


@query
def response_checks(spark, folder):
    """Which responses are filled, a script table, or JSON."""
    rows = I.rows(spark, folder, "conversations", I.SCRIPT_TEXTS)
    return rows.groupBy((F.col("turn") % 6).alias("kind")).agg(
        F.count(F.when(X.is_filled("script"), 1)).alias("filled"),
        F.count(F.when(X.is_script_table("script"), 1)).alias("tables"),
        F.count(F.when(X.is_json("script"), 1)).alias("json"),
    )


@query
def report_reconcile(spark, folder):
    """Final reports from rule hits and external reports."""
    scripts = I.rows(spark, folder, "documents", I.REVIEWED).withColumn("evidence", F.array(F.col("has_evidence")))
    runs = R.rule_issues(scripts.drop("evidence")).withColumn(
        "evidence", F.when(F.col("has_evidence"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    )
    reports = P.review_reports(runs)
    route = X.rewrite_route(F.col("final_script"), F.col("overall_status"), F.size("report_issues"))
    listed = F.transform("report_issues", lambda x: F.concat_ws("~", x["issue_type"], x["risk_level"], x["excerpt"]))
    return reports.select(
        "doc_id", "overall_status", "overall_risk", "headline", route.alias("route"), F.md5(F.array_join(listed, "\n")).alias("issues")
    )


# --- creators -----------------------------------------------------------------------------


def _talents(spark: SparkSession, folder: str) -> DataFrame:
    return I.rows(spark, folder, "customer", I.TALENTS)


def _users(spark: SparkSession, folder: str) -> DataFrame:
    return I.rows(spark, folder, "customer", I.USERS)


@query
def talent_board(spark, folder):
    """Creators per stage."""
    return crm.board(_talents(spark, folder))


@query
def talent_totals(spark, folder):
    """Creators, active creators and platforms."""
    return crm.totals(_talents(spark, folder))


@query
def talent_tones(spark, folder):
    """Tone of the progress text per creator group."""
    t = _talents(spark, folder)
    return t.groupBy("collaboration_progress", L.progress_tone("collaboration_progress").alias("tone")).agg(
        F.count("*").alias("talents")
    )


@query
def talent_todos(spark, folder):
    """Next step with every creator."""
    return crm.todos(_talents(spark, folder))


@query
def talent_top_todos(spark, folder):
    """The ten most urgent steps of each nation."""
    rows = crm.recent_todos_by(_talents(spark, folder), "nation")
    return rows.select("nation", "rank", "talent_id", "priority", "text")


@query
def talent_links(spark, folder):
    """Users made for profiles without one."""
    profiles, _ = crm.link_users(_talents(spark, folder), _users(spark, folder))
    return profiles.select("id", "user_id")


@query
def linked_users(spark, folder):
    """All users after every profile got one."""
    return crm.link_users(_talents(spark, folder), _users(spark, folder))[1]


@query
def talent_updates(spark, folder):
    """Users after profile changes."""
    t = _talents(spark, folder)
    changes = t.select(
        (F.col("id") * 2).alias("talent_id"), F.concat(F.lit("New "), "name").alias("name"), "platform", "email", "recent_video_link",
        F.when(F.col("id") % 3 == 0, "").otherwise(F.col("notes")).alias("notes"), F.lit("签约").alias("collaboration_progress"),
    )
    return crm.update_talents(t.drop("nation"), _users(spark, folder), changes)[1]


@query
def talent_deletes(spark, folder):
    """Scripts per user after profiles of one nation group were deleted."""
    t = _talents(spark, folder)
    gone = t.filter(F.col("platform") == "TikTok").select("id")
    scripts = I.rows(spark, folder, "orders", I.SCRIPT_ROWS)
    return crm.delete_talents(t, _users(spark, folder), scripts, gone)[2].select("id", "user_id", "topic")


@query
def talent_creates(spark, folder):
    """Profiles made for suppliers."""
    new = table(spark, folder, "supplier").select(
        "s_suppkey", F.concat(F.lit(" "), "s_name").alias("name"), F.lit("").alias("platform"), F.lit("").alias("email"),
        F.lit("").alias("recent_video_link"), F.lit("").alias("notes"), F.lit("").alias("collaboration_progress"),
    )
    made = crm.create_talents(_talents(spark, folder).drop("nation"), _users(spark, folder), new, "s_suppkey")[0]
    return made.select("id", "user_id", "name", "platform", "collaboration_progress")


@query
def profile_backfill(spark, folder):
    """Profiles made from users when there are none yet."""
    none = spark.createDataFrame([], _talents(spark, folder).drop("nation").schema)
    return crm.backfill_profiles(none, _users(spark, folder))


@query
def style_profiles(spark, folder):
    """Style of the user behind every order, with the default."""
    asked = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") * 2 + 100000).alias("user_id")
    )
    return crm.style_profiles(asked, _users(spark, folder))


@query
def script_history(spark, folder):
    """New script records with the next ids."""
    scripts = I.rows(spark, folder, "orders", I.SCRIPT_ROWS)
    new = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.lit(None).cast("bigint").alias("user_id"),
        F.col("role").alias("topic"), F.lit("x").alias("platform"), F.lit(0.8).alias("creativity"),
    )
    return crm.append_scripts(scripts, new, "at")


@query
def table_import(spark, folder):
    """Customers merged by key with imported supplier rows, defaults filled."""
    base = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("platform"))
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("platform"))
    return crm.import_rows(base, rows, ["id"], {"platform": fixed.PLATFORM_UNSET})


# --- library ------------------------------------------------------------------------------


@query
def catalog_metadata(spark, folder):
    """Metadata of normalised documents from the catalog."""
    c = I.rows(spark, folder, "documents", I.CATALOG)
    e = {n: F.col(n) for n in c.columns}
    path = F.concat(F.lit("raw/"), F.col("id"), F.lit(".html"))
    rows = c.select(M.raw_metadata(e, path, F.col("id"), F.lit("2024-01-01")).alias("m"))
    return rows.select(
        "m.source_id", "m.platform", "m.platform_display", "m.document_type", "m.source_type", "m.country_code", "m.is_global_fallback", "m.raw_file"
    )


@query
def library_listing(spark, folder):
    """Library rows: stored documents and raw files."""
    stored = I.rows(spark, folder, "documents", I.STORED).withColumn("file_time", F.to_timestamp(F.lit("2024-02-02 00:00:00")))
    labelled = table(spark, folder, "labels").select((F.col("doc_id") * 2).alias("n"))
    raw = labelled.select(
        F.concat(F.lit("doc_"), "n").alias("source_id"), F.concat(F.lit("raw/doc_"), "n", F.lit(".pdf")).alias("raw_path"),
        F.lit(".pdf").alias("raw_suffix"), F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("file_time"),
    )
    catalog = I.rows(spark, folder, "documents", I.CATALOG)
    manifest = table(spark, folder, "labels").select(
        F.concat(F.lit("doc_"), "doc_id").alias("source_id"), F.lit("m.md").alias("markdown_path"), F.lit(".txt").alias("raw_suffix")
    )
    rows = LB.listing(stored, raw, catalog, manifest, F.to_timestamp(F.lit("2024-02-15 00:00:00")))
    return rows.withColumn("updated_at", M.show_time("updated_at"))


def _crawl(spark: SparkSession, folder: str) -> DataFrame:
    entries = I.rows(spark, folder, "documents", [*I.CATALOG, "doc_id"])
    fetched = I.rows(spark, folder, "documents", I.FETCHES)
    rows = entries.join(fetched, "doc_id")
    names = ["crawl_mode", "http_status", "error", "content", "content_type"]
    return rows.withColumn("o", web.crawl_outcome({n: F.col(n) for n in names})).withColumns(
        {"status": F.col("o.status"), "reason": F.col("o.reason")}
    )


@query
def crawl_counts(spark, folder):
    """Sources per crawl status."""
    return LB.crawl_counts(_crawl(spark, folder))


@query
def crawl_table(spark, folder):
    """Detail rows of the crawl report, with the stored file name."""
    rows = _crawl(spark, folder)
    name = F.concat(T.file_slug("id"), web.file_extension("fetch_url", "content_type"))
    stored = F.when(F.col("status") == "downloaded", name).otherwise(F.lit(""))
    return LB.crawl_table(rows.withColumn("file_path", stored)).select("id", "status", "note", "file_path", "line")


def upload_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Uploads, a quarter of them under numbered names, and the ids in use."""
    d = table(spark, folder, "documents")
    number = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("_"), (F.col("doc_id") % 5 + 1).cast("string"))).otherwise(F.lit(""))
    uploads = d.select(
        F.col("doc_id").alias("upload_no"),
        F.concat(F.lit("src"), (F.col("doc_id") % 60).cast("string"), number).alias("base"),
        F.expr(I.pick("doc_id", [".html", ".md", ".pdf", ".txt", ".html"])).alias("suffix"),
    )
    n = F.col("doc_id")
    name = F.concat(F.lit("src"), (n % 40).cast("string"), F.when(n % 3 == 0, F.concat(F.lit("_"), (n % 7 + 1).cast("string"))).otherwise(F.lit("")))
    used = d.select(name.alias("id"), F.expr(I.pick("doc_id", [".html", ".pdf", "", ".html"])).alias("suffix"), (n % 5 == 0).alias("text"))
    taken = used.groupBy("id").agg(
        F.collect_set(F.nullif("suffix", F.lit(""))).alias("raw_suffixes"),
        F.bool_or("text").alias("has_md"), F.bool_or("text").alias("has_json"), F.lit(True).alias("in_catalog"),
    )
    return uploads, taken


@query
def upload_ids(spark, folder):
    """Ids given to uploads whose names collide."""
    return LB.allocate_ids(*upload_inputs(spark, folder)).select("upload_no", "base", "suffix", "source_id")


def _indexed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("kb/"), "doc_id").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 100).alias("mtime")
    )


@query
def index_fingerprint(spark, folder):
    """Digest of the indexed documents."""
    return LB.fingerprint(_indexed(spark, folder), "hash-md5-384")


@query
def index_status(spark, folder):
    """Documents, chunks and build time of an index of document lines."""
    d = table(spark, folder, "documents")
    chunks = d.select("doc_id", F.lit("2024-01-01").alias("built_at"), F.explode(F.split("text", "\n")).alias("line"))
    return LB.index_status(chunks)


@query
def changed_documents(spark, folder):
    """Documents that an older index does not hold yet."""
    old = _indexed(spark, folder).withColumn("size", F.when(F.col("mtime") > 50, F.col("size") + 1).otherwise(F.col("size")))
    return LB.changed_documents(_indexed(spark, folder), old).select("doc_id", "size")


# --- workflow progress --------------------------------------------------------------------


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return I.rows(spark, folder, "events", I.EVENTS)


@query
def workflow_steps(spark, folder):
    """Latest state of every step of every run."""
    return PR.step_states(_events(spark, folder), fixed.GENERATE_STEPS)


@query
def failed_runs(spark, folder):
    """Step states of runs that ended in an error."""
    events = _events(spark, folder)
    states = PR.step_states(events, fixed.GENERATE_STEPS)
    ends = PR.terminal_events(events).filter("event = 'error'")
    return PR.mark_failed_runs(states, ends, fixed.GENERATE_STEPS).select("run_id", "step", "status", "error_message")


@query
def completed_steps(spark, folder):
    """Completed steps per run."""
    return PR.completed_steps(PR.step_states(_events(spark, folder), fixed.GENERATE_STEPS))


@query
def terminal_events(spark, folder):
    """The event that ended each run."""
    return PR.terminal_events(_events(spark, folder)).select("run_id", "event", "error_type", "message")


@query
def idle_gaps(spark, folder):
    """Silences of twelve hours or more, with the heartbeats in them."""
    rows = PR.idle_gaps(_events(spark, folder), 43_200)
    return rows.select("run_id", "event_no", F.floor("gap_seconds").alias("gap_seconds"), "heartbeats")


@query
def timed_out_runs(spark, folder):
    """Runs with a silence of more than two days."""
    rows = PR.timed_out_runs(_events(spark, folder), 172_800)
    return rows.select("run_id", F.floor("longest").alias("longest"))


@query
def idle_sessions(spark, folder):
    """Stretches of a run without a silence of twelve hours."""
    rows = PR.sessions(_events(spark, folder), 43_200)
    return rows.select("run_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")


@query
def step_durations(spark, folder):
    """Time from the start of a step to its completion, with its label."""
    rows = PR.step_durations(_events(spark, folder))
    return rows.select("run_id", "step", "event_no", "duration_ms", W.duration_label(F.col("duration_ms")).alias("label"))


@query
def step_errors(spark, folder):
    """Error classes of failed steps."""
    e = _events(spark, folder).filter("status = 'error'")
    text = F.concat("message", F.expr(I.pick("event_no", [" API timeout", " boom", " 429"])))
    rows = e.withColumn("x", W.step_error(F.col("step"), text))
    return rows.groupBy("step", "x.error_type", "x.message").agg(F.count("*").alias("events"))


@query
def event_texts(spark, folder):
    """Events written as event text and read back, per event name and status."""
    e = _events(spark, folder)
    payload = F.to_json(F.struct("run_id", "step", "status", "message"))
    lines = e.select(W.event_text(F.col("event"), payload).alias("value"))
    return decode_events(lines).groupBy("event", "step", "status").agg(F.count("*").alias("events"))


# --- page layout --------------------------------------------------------------------------


def _layout(spark: SparkSession, folder: str) -> DataFrame:
    return I.rows(spark, folder, "lineitem", I.LAYOUT)


@query
def outside_tables(spark, folder):
    """Layout elements that no table covers."""
    return LY.outside_tables(_layout(spark, folder)).select("doc", "page", "element_no", "kind")


@query
def reading_order(spark, folder):
    """Reading order of the layout elements."""
    return LY.reading_order(_layout(spark, folder)).select("doc", "page", "element_no", "column_no", "reading_no")


@query
def body_fonts(spark, folder):
    """Body font size and table pages per document."""
    e = _layout(spark, folder)
    return LY.body_fonts(e).join(LY.table_pages(e), "doc")


@query
def heading_levels(spark, folder):
    """Document lines with their heading level."""
    return LY.document_lines(_layout(spark, folder)).select("doc", "page", "reading_no", "level", "line")


@query
def layout_documents(spark, folder):
    """Cleaned bodies of the layout documents."""
    rows = LY.document_bodies(_layout(spark, folder))
    return rows.select("doc", "pages", "table_pages", F.length("markdown").alias("chars"))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    wide = I.rows(spark, folder, "lineitem", I.CELLS)
    names = ["l_returnflag", "l_linestatus", "part_text", "supplier_text"]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("col_no"), F.col(n).alias("text")) for i, n in enumerate(names)]))
    return wide.select("table_id", (F.col("row_no") - 1).alias("row_no"), cells.alias("c")).select("table_id", "row_no", "c.*")


@query
def real_tables(spark, folder):
    """Tables worth keeping."""
    return LY.real_tables(_cells(spark, folder))


@query
def table_markdown(spark, folder):
    """Markdown text of every table."""
    return LY.table_markdown(_cells(spark, folder))
