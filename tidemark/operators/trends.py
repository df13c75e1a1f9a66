"""Trend mining from search hits, and keyed snapshots that serve it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text as T
from tidemark.functions import trend as R
from tidemark.functions import web
from tidemark.operators.keyed import first_per_key, keep_rows, merge_rows, top_k


def read_signals(hits: DataFrame, as_of: Column) -> DataFrame:
    """Adds age, view count and platform read from each hit."""
    blob = F.array_join(
        F.filter(F.array("title", "content", "raw_content"), lambda p: F.coalesce(p, F.lit("")) != ""), " "
    )
    staged = hits.withColumns({"_blob": blob, "url": T.strip(F.coalesce("url", F.lit("")))})
    # each pattern runs once per hit; the values below only read its result
    found = staged.withColumns({"_age": R.age_parts(F.col("_blob")), "_views": R.view_parts(F.col("_blob"))})
    return found.withColumns(
        {
            "age_days": R.age_days(F.col("_age"), as_of),
            "view_count": R.view_count(F.col("_views")),
            "platform_key": R.hit_platform(F.col("url"), F.col("platform")),
        }
    ).drop("_blob", "_age", "_views")


def viral_hits(hits: DataFrame, as_of: Column, days: int = 3, min_views: int = 100_000) -> DataFrame:
    """Hits with a URL that pass the freshness and reach thresholds."""
    read = read_signals(hits.filter(~T.is_blank("url")), as_of)
    passes = R.passes_viral_filter(F.col("age_days"), F.col("view_count"), F.col("score"), days, min_views)
    return keep_rows(read, passes)


def platform_turn(platform: Column) -> Column:
    out = F.lit(len(fixed.VIRAL_PLATFORMS))
    for i, name in enumerate(fixed.VIRAL_PLATFORMS):
        out = F.when(platform == name, i).otherwise(out)
    return out


def viral_benchmarks(
    hits: DataFrame, as_of: Column, days: int = 3, most: int = 4, min_views: int = 100_000
) -> DataFrame:
    """Top hits per request.

    ``hits``: request_id, wanted (platform asked for), platform (searched), query_no,
    hit_no and the hit fields. A supported platform is searched alone; the others only
    count for a request whose own platform gave nothing. A URL counts once, at its first
    accepted hit. ``images`` are those of the whole answer that a hit came in; a hit's own stands at its ``hit_no``.
    """
    # looked up in the scan, so that no list of images is shuffled
    image = F.get("images", F.col("hit_no")) if "images" in hits.columns else F.lit("")
    hits = hits.withColumn("image_url", F.coalesce(image, F.lit(""))).drop("images")
    good = viral_hits(hits, as_of, days, min_views)
    single = F.col("wanted").isin(*fixed.VIRAL_PLATFORMS)
    good = good.withColumn("_own", ~single | (F.col("platform") == F.col("wanted")))
    turn = [platform_turn(F.col("platform")), F.col("query_no"), F.col("hit_no")]
    views = F.coalesce("view_count", F.lit(0))
    score = F.coalesce("score", F.lit(0.0))
    # own and other platforms are ranked apart, so that only their few best rows are compared
    unique = first_per_key(good, ["request_id", "_own", "url"], turn)
    best = top_k(unique, ["request_id", "_own"], [views.desc(), score.desc(), *turn, F.col("url")], most)
    served = F.max("_own").over(Window.partitionBy("request_id"))
    best = best.withColumn("_served", served).filter(F.col("_own") | ~F.col("_served"))
    title = F.when(F.coalesce("title", F.lit("")) == "", T.lookup(F.col("platform_key"), fixed.PLATFORM_LABELS, F.lit(fixed.VIRAL_TITLE_DEFAULT)))
    return best.select(
        "request_id",
        "rank",
        T.compact(F.coalesce(title, "title"), 88).alias("title"),
        "url",
        R.platform_label(F.col("platform_key")).alias("platform"),
        "platform_key",
        views.alias("view_count"),
        F.when(views > 0, R.view_label(views)).otherwise(F.lit(fixed.VIEW_LABEL_LIVE)).alias("view_count_label"),
        T.compact("content", 140).alias("summary"),
        score.alias("score"),
        "image_url",
        (F.coalesce("favicon", F.lit("")) if "favicon" in hits.columns else F.lit("")).alias("favicon"),
    )


def industry_digest(articles: DataFrame, answers: DataFrame | None = None, most: int = 4) -> DataFrame:
    """Per request and category: the first articles and a summary.

    ``articles``: request_id, category_key, hit_no, title, url, content, score. The
    summary is the search answer, else the texts of the first two articles.
    """
    keys = ["request_id", "category_key"]
    labels = {k: v for k, v, _ in fixed.INDUSTRY_CATEGORIES}
    label = T.lookup(F.col("category_key"), labels, F.col("category_key"))
    first = top_k(articles, keys, [F.col("hit_no")], most)
    shaped = first.select(
        *keys,
        "rank",
        F.coalesce(F.nullif(T.compact("title", 96), F.lit("")), label).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        T.compact("content", 180).alias("summary"),
        web.article_source("url").alias("source"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    row = F.struct("rank", "title", "url", "summary", "source", "score")
    packed = shaped.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("articles"))
    texts = F.filter(F.transform(F.slice("articles", 1, 2), lambda a: a["summary"]), lambda s: s != "")
    fallback = T.strip(F.array_join(texts, " "))
    if answers is None:
        return packed.withColumns({"category_label": label, "summary": fallback})
    joined = packed.join(answers.select(*keys, "answer"), keys, "full_outer")
    answer = T.compact("answer", 340)
    return joined.select(
        *keys,
        F.coalesce("articles", F.array().cast(packed.schema["articles"].dataType)).alias("articles"),
        label.alias("category_label"),
        F.coalesce(F.nullif(answer, F.lit("")), fallback, F.lit("")).alias("summary"),
    )


def trend_sources(hits: DataFrame, most: int = 5) -> DataFrame:
    """The first hits of each request, texts shortened."""
    first = top_k(hits, ["request_id"], [F.col("hit_no")], most)
    return first.select("request_id", "rank", "title", "url", "score", T.compact("content", 240).alias("content"))


def trend_briefs(requests: DataFrame, hits: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Trend brief and sources per request.

    ``requests``: request_id, answer and the request fields; ``failures``: request_id,
    reason of searches that failed, which get the fallback brief.
    """
    names = ["topic", "target_country", "target_platform", "distribution_mode", "product_category", "target_languages"]
    asked = requests.withColumn("trend_query", R.trend_query({n: F.col(n) for n in names}))
    row = F.struct("hit_no", "title", "content", "url", "score")
    first = top_k(hits, ["request_id"], [F.col("hit_no")], 5)
    packed = first.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))
    joined = asked.join(packed, "request_id", "left")
    if failures is None:
        joined = joined.withColumn("reason", F.lit(None).cast("string"))
    else:
        joined = joined.join(failures.select("request_id", "reason"), "request_id", "left")
    live = R.brief_text(
        F.col("trend_query"), F.col("target_country"), F.col("target_platform"), F.col("answer"), F.col("hits")
    )
    gone = R.fallback_brief(
        F.col("topic"), F.col("target_platform"), F.col("distribution_mode"), F.col("trend_query"), F.col("reason")
    )
    sources = F.transform(
        F.coalesce("hits", F.array().cast(packed.schema["hits"].dataType)),
        lambda h: F.struct(h["title"], h["url"], h["score"], T.compact(h["content"], 240).alias("content")),
    )
    ok = F.col("reason").isNull()
    blank = T.is_blank("topic")
    empty = F.array().cast("array<struct<title:string,url:string,score:double,content:string>>")
    return joined.select(
        "request_id",
        F.when(blank, F.lit("")).otherwise(F.col("trend_query")).alias("trend_query"),
        F.when(blank, F.lit(fixed.EMPTY_TOPIC_BRIEF)).when(ok, live).otherwise(gone).alias("trend_data"),
        F.when(blank | ~ok, empty).otherwise(sources).alias("trend_sources"),
    )


SNAPSHOT_KEYS = ["module_name", "scope_key"]


def upsert_snapshots(snapshots: DataFrame, fresh: DataFrame) -> DataFrame:
    """Snapshot table after the fresh rows: per key the newest row."""
    return merge_rows(snapshots, fresh, SNAPSHOT_KEYS, ["updated_at"])


def find_snapshots(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Requests with the snapshot of their key, null where there is none."""
    return requests.join(snapshots, SNAPSHOT_KEYS, "left")


TREND_FILTERS = ["topic", "target_country", "target_platform", "distribution_mode", "product_category", "target_languages"]


def module_requests(requests: DataFrame) -> DataFrame:
    """The three module requests of every trend request, with their scope keys and the filters they echo.

    ``requests``: request_id, the filters (``TREND_FILTERS``), refresh_videos and refresh_industry.
    """
    fields = {n: F.col(n) for n in TREND_FILTERS}
    parts = [
        F.struct(F.lit(m).alias("module_name"), R.scope_key(fields, m).alias("scope_key"), F.col(flag).alias("refresh"))
        for m, flag in (("videos", "refresh_videos"), ("industry_categories", "refresh_industry"), ("topic_brief", "refresh_industry"))
    ]
    return requests.select("request_id", R.scope_key(fields).alias("filters"), F.inline(F.array(*parts)))


def empty_payload(module: Column) -> Column:
    out = F.lit('{"error":""}')
    for name, payload in fixed.EMPTY_PAYLOADS.items():
        out = F.when(module == name, F.lit(payload)).otherwise(out)
    return out


def serve_modules(requests: DataFrame, snapshots: DataFrame, loads: DataFrame) -> DataFrame:
    """What each request gets: its snapshot, a fresh load, the stale snapshot, or nothing.

    ``requests``: request_id, module_name, scope_key, refresh. ``loads``: module_name,
    scope_key, payload, loaded_at, error (null when the load worked). A key without a load
    row counts as a failed load.

    ``payload`` is a JSON object: the module's empty payload, over it the members of the snapshot or load,
    over these the message of a failed load as ``error``. Members are taken whole, whatever lies in them; a payload
    that is no JSON object adds none. ``error`` is that of the payload, its own where nothing failed.
    ``load_payload`` is the load as it came, where it is to be stored.
    """
    old = snapshots.select(*SNAPSHOT_KEYS, F.col("payload").alias("_old"), F.col("updated_at").alias("_old_at"))
    new = loads.select(
        *SNAPSHOT_KEYS,
        F.col("payload").alias("_new"),
        F.col("loaded_at").alias("_new_at"),
        F.col("error").alias("_error"),
        F.lit(True).alias("_loaded"),
    )
    joined = requests.join(old, SNAPSHOT_KEYS, "left").join(new, SNAPSHOT_KEYS, "left")
    cached = F.col("_old_at").isNotNull()
    hit = cached & ~F.coalesce("refresh", F.lit(False))
    fresh = ~hit & F.col("_loaded").isNotNull() & F.col("_error").isNull()
    stale = ~hit & ~fresh & cached
    message = F.to_variant_object(F.create_map(F.lit("error"), F.coalesce("_error", F.lit("load failed"))))
    failed = F.try_variant_get(message, "$", "map<string,variant>")
    laid = R.overlay(R.members(empty_payload(F.col("module_name"))), R.members(F.when(hit | stale, F.col("_old")).when(fresh, F.col("_new"))))
    rows = joined.withColumn("_laid", laid).withColumn(
        "_members", F.when(hit | fresh, F.col("_laid")).otherwise(R.overlay(F.col("_laid"), failed))
    )
    return rows.select(
        *requests.columns,
        R.object_text(F.col("_members")).alias("payload"),
        R.member_string(F.col("_members"), "error").alias("error"),
        (hit | stale).alias("from_cache"),
        stale.alias("stale"),
        F.when(hit | stale, F.col("_old_at")).when(fresh, F.col("_new_at")).alias("cached_at"),
        fresh.alias("store"),
        F.when(fresh, F.col("_new")).alias("load_payload"),
    )


def stored_loads(served: DataFrame) -> DataFrame:
    """The snapshot rows a serving run has to write back, one per key: the loads as they came."""
    rows = served.filter("store").select(*SNAPSHOT_KEYS, F.col("load_payload").alias("payload"), F.col("cached_at").alias("updated_at"))
    return rows.dropDuplicates(SNAPSHOT_KEYS)


def module_meta(modules: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Roll-up of several modules: all cached, any stale, newest time, first error."""
    return modules.groupBy(*keys).agg(
        F.coalesce(F.min_by("error", F.when(F.col("error") != "", F.col(order))), F.lit("")).alias("error"),
        F.bool_and("from_cache").alias("from_cache"),
        F.bool_or("stale").alias("stale"),
        F.max("cached_at").alias("cached_at"),
    )


def trend_result(served: DataFrame) -> DataFrame:
    """One row per request from its three served modules (videos, industry_categories, topic_brief).

    ``filters`` are echoed where the served rows carry them. A module that was not served counts as empty.
    """
    modules = ["videos", "industry_categories", "topic_brief"]
    state = F.struct("payload", "error", "from_cache", "stale", "cached_at")
    echoed = [F.max("filters").alias("filters")] if "filters" in served.columns else []
    wide = served.groupBy("request_id").agg(
        # of several rows of a module the newest counts
        *[F.max_by(state, F.when(F.col("module_name") == m, F.struct("cached_at", "payload", "error"))).alias(m) for m in modules],
        *echoed,
    )
    industry = module_meta(
        served.filter(F.col("module_name").isin("industry_categories", "topic_brief")), ["request_id"], "module_name"
    ).select("request_id", F.struct("error", "from_cache", "stale", "cached_at").alias("_meta"))

    def part(module: str, key: str, empty: str) -> Column:
        return F.coalesce(R.member_text(R.members(F.col(f"{module}.payload")), key), F.lit(empty))

    rows = wide.join(industry, "request_id", "left").withColumns(
        {
            "_categories": part("industry_categories", "categories", "[]"),
            "trend_hunter": part("topic_brief", "topic_brief", fixed.EMPTY_BRIEF),
            "benchmarks": part("videos", "items", "[]"),
        }
    )
    kept = ["error", "from_cache", "stale", "cached_at"]
    return rows.select(
        "request_id",
        *(["filters"] if echoed else []),
        "trend_hunter",
        "benchmarks",
        F.coalesce("videos.error", F.lit("")).alias("benchmarks_error"),
        "videos",
        "industry_categories",
        F.struct(
            *[F.col(f"_meta.{n}").alias(n) for n in kept],
            F.col("_categories").alias("categories"),
            F.col("trend_hunter").alias("topic_brief"),
        ).alias("industry"),
    )
