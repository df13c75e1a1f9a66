"""Signals read from search hits, and the search texts themselves."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import scope as S
from tidemark.functions import text as T
from tidemark.functions import web


#: All decimal digits but the ASCII ones, and their ASCII counterparts.
DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
ASCII_DIGITS = "".join(str(unicodedata.decimal(d)) for d in DIGITS)
MOST_VIEWS = 2**63 - 1
#: Days or weeks of an age at most; larger ones count as this many.
MOST_AGE = (2**31 - 1) // 7


def _group(x: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(x, T.java_pattern(pattern), n)


def ascii_digits(x: Column) -> Column:
    """Digits of any script as ASCII digits."""
    return F.when(x.rlike("[^\\x00-\\x7f]"), F.translate(x, "".join(DIGITS), ASCII_DIGITS)).otherwise(x)


def saturating(digits: Column, most: int) -> Column:
    """A run of digits as a whole number, ``most`` where it is larger, however long it is."""
    number = F.coalesce(ascii_digits(digits).try_cast("decimal(38,0)"), F.lit(most).cast("decimal(38,0)"))
    return F.least(number, F.lit(most).cast("decimal(38,0)")).cast("bigint")


def _scaled(number: Column, unit: Column | int) -> Column:
    """A decimal number times a unit, as whole views."""
    value = ascii_digits(number).try_cast("double") * unit
    return F.when(value >= float(MOST_VIEWS), F.lit(MOST_VIEWS)).otherwise(value.cast("bigint"))


def view_parts(x: Column) -> Column:
    """What the view patterns find in a text, as a struct of texts (blank where nothing is found)."""
    low = F.lower(x)
    named = F.contains(low, F.lit("view")) | F.contains(low, F.lit("play"))
    bare = F.contains(low, F.lit("million views")) | F.contains(low, F.lit("million plays"))
    return F.when(
        named,
        F.struct(
            _group(x, fixed.UNIT_VIEWS_PATTERN, 1).alias("number"),
            F.lower(_group(x, fixed.UNIT_VIEWS_PATTERN, 2)).alias("unit"),
            _group(x, fixed.MILLION_VIEWS_PATTERN, 1).alias("million"),
            _group(x, fixed.COMMA_VIEWS_PATTERN, 1).alias("plain"),
            bare.alias("bare"),
        ),
    )


def view_count(parts: Column) -> Column:
    """Views or plays; a plain number without unit or commas is not read."""
    unit = F.when(parts["unit"] == "m", 1_000_000).otherwise(1_000)
    return (
        F.when(parts["number"] != "", _scaled(parts["number"], unit))
        .when(parts["million"] != "", _scaled(parts["million"], 1_000_000))
        .when(parts["plain"] != "", saturating(F.replace(parts["plain"], F.lit(","), F.lit("")), MOST_VIEWS))
        .when(parts["bare"], F.lit(1_000_000).cast("bigint"))
    )


def age_parts(x: Column) -> Column:
    """What the date patterns find in a text, as a struct of texts (blank where nothing is found)."""

    def all_of(pattern: str) -> Column:
        return F.regexp_extract(x, T.java_pattern(pattern), 0)

    ago = F.contains(F.lower(x), F.lit("ago"))
    longs = [F.regexp_replace(_group(x, p, 1), r",\s*", ", ") for p in fixed.LONG_DATE_PATTERNS]
    return F.struct(
        F.when(ago, _group(x, fixed.RELATIVE_AGE_PATTERN, 1)).otherwise("").alias("number"),
        F.when(ago, F.lower(_group(x, fixed.RELATIVE_AGE_PATTERN, 2))).otherwise("").alias("unit"),
        F.when(F.contains(x, F.lit("-")), all_of(fixed.ISO_DATE_PATTERN)).otherwise("").alias("iso"),
        F.when(F.contains(x, F.lit(", ")), longs[0]).otherwise("").alias("long"),
        F.when(F.contains(x, F.lit(",")), longs[1]).otherwise("").alias("loose"),
        F.when(F.contains(x, F.lit("-")), _group(x, fixed.SHORT_DATE_PATTERN, 1)).otherwise("").alias("month"),
        F.when(F.contains(x, F.lit("-")), _group(x, fixed.SHORT_DATE_PATTERN, 2)).otherwise("").alias("day"),
    )


def age_days(parts: Column, as_of: Column) -> Column:
    """Age in days as seen on the day ``as_of``; an invalid date falls through, future dates count too."""

    def away(found: Column, form: str) -> Column:
        return F.when(found != "", F.abs(F.datediff(as_of, F.try_to_date(ascii_digits(found), form))))

    amount = saturating(F.when(parts["number"] != "", parts["number"]), MOST_AGE).cast("int")
    relative = (
        F.when(parts["unit"] == "h", 0).when(parts["unit"] == "d", amount).when(parts["unit"] == "w", amount * 7)
    )
    short = F.concat_ws("-", F.year(as_of).cast("string"), parts["month"], parts["day"])
    return F.coalesce(
        relative,
        away(parts["iso"], "yyyy-M-d"),
        away(parts["long"], "MMMM d, yyyy"),
        away(parts["loose"], "MMMM d, yyyy"),
        F.when(parts["month"] != "", away(short, "yyyy-M-d")),
    )


def view_label(count: str | Column) -> Column:
    n = T.col(count)
    return (
        F.when(n >= 1_000_000, F.concat(T.to_fixed(n / 1_000_000, 1), F.lit("M")))
        .when(n >= 1_000, F.concat(T.to_fixed(n / 1_000, 1), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def passes_viral_filter(age: Column, views: Column, score: Column, days: int, min_views: int) -> Column:
    """Fresh enough where the age is known, and seen enough, or highly scored where views are unknown."""
    fresh = age.isNull() | (age <= days)
    seen = F.when(views.isNotNull(), views >= min_views).otherwise(F.coalesce(score, F.lit(0.0)) >= 0.85)
    return fresh & seen


def focus_text(topic: Column, product: Column, mode: Column) -> Column:
    product_hint = T.lookup(product, fixed.PRODUCT_HINTS, T.strip(F.replace(product, F.lit("_"), F.lit(" "))))
    mode_hint = T.lookup(mode, fixed.DISTRIBUTION_HINTS, F.lit(""))
    parts = F.filter(
        F.array(T.collapse(F.coalesce(topic, F.lit(""))), F.coalesce(product_hint, F.lit("")), mode_hint),
        lambda p: p != "",
    )
    return F.coalesce(F.nullif(F.array_join(parts, " "), F.lit("")), F.lit(fixed.FOCUS_DEFAULT))


def viral_queries(platform: Column, country: Column, focus: Column, days: Column) -> Column:
    """Search texts for one platform."""
    place = T.default_if_blank(country, "global")

    def texts(templates: tuple[str, ...]) -> Column:
        return F.array(*[T.fill(t, country=place, focus=focus, days=days) for t in templates])

    out = F.when(F.lit(False), texts(fixed.VIRAL_QUERY_DEFAULT))
    for name, templates in fixed.VIRAL_QUERY_HINTS.items():
        out = out.when(platform == name, texts(templates))
    return out.otherwise(texts(fixed.VIRAL_QUERY_DEFAULT))


def trend_query(r: dict[str, Column], most_languages: int = 3) -> Column:
    """Search text of the trend brief for one request; it names the first few languages."""
    country = F.upper(r["target_country"])
    platform = S.canonical_platform(r["target_platform"])
    mode = F.lower(r["distribution_mode"])
    langs = F.transform(
        F.slice(r["target_languages"], 1, most_languages), lambda v: F.coalesce(S.canonical_language(v), F.lower(v))
    )
    return T.fill(
        fixed.TREND_QUERY_TEMPLATE,
        topic=T.strip(r["topic"]),
        country=S.market_label(country),
        platform=platform,
        product=F.replace(F.lower(r["product_category"]), F.lit("_"), F.lit(" ")),
        platform_hint=T.lookup(platform, fixed.TREND_PLATFORM_HINTS, F.lit(fixed.TREND_PLATFORM_HINT_DEFAULT)),
        mode_hint=T.lookup(mode, fixed.TREND_MODE_HINTS, F.lit(fixed.TREND_MODE_HINT_DEFAULT)),
        language=F.coalesce(F.nullif(F.array_join(langs, ", "), F.lit("")), F.lit("en")),
    )


def industry_queries(country: Column, platform: Column, topic: Column) -> Column:
    """One (key, label, query) per industry category, in order."""
    hint = F.when(T.is_blank(topic), F.lit(fixed.INDUSTRY_TOPIC_DEFAULT)).otherwise(T.compact(topic, 80))
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("category_key"),
                F.lit(label).alias("category_label"),
                T.fill(template, country=country, platform=platform, topic=hint).alias("query"),
            )
            for key, label, template in fixed.INDUSTRY_CATEGORIES
        ]
    )


def scope_key(
    filters: dict[str, Column], module: str | None = None, lists: tuple[str, ...] = ("target_languages",)
) -> Column:
    """Canonical JSON text of the filters, keys in alphabetical order."""
    parts = dict(filters)
    if module is not None:
        parts["module"] = F.lit(module)
    pieces = []
    for name in sorted(parts):
        value = parts[name]
        if name in lists:
            value = F.concat(F.lit("["), F.array_join(F.transform(value, _json_value), ", "), F.lit("]"))
        else:
            value = _json_value(value)
        pieces.append(F.concat(F.lit(f'"{name}": '), value))
    return F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}"))


def _json_value(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)


def members(payload: Column) -> Column:
    """Members of a JSON object by key, of any nesting; a text that is no JSON object has none."""
    found = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    return F.coalesce(found, F.create_map().cast("map<string,variant>"))


def overlay(low: Column, high: Column) -> Column:
    """Members of both, key by key: those of ``high`` hide those of ``low`` as a whole, a JSON null too."""
    rest = F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k))
    return F.map_concat(rest, high)


def object_text(found: Column) -> Column:
    """Members as a JSON object, keys in alphabetical order."""
    keys = F.array_sort(F.map_keys(found))
    return F.to_json(F.map_from_entries(F.transform(keys, lambda k: F.struct(k, found[k]))))


def member_text(found: Column, key: str) -> Column:
    """One member as JSON; null where it is missing."""
    return F.to_json(F.element_at(found, F.lit(key)))


def member_string(found: Column, key: str) -> Column:
    """One member as text; blank where it is missing or null."""
    return F.coalesce(F.try_variant_get(F.element_at(found, F.lit(key)), "$", "string"), F.lit(""))


def is_live(trend_sources: Column, trend_data: Column) -> Column:
    return (F.coalesce(F.size(trend_sources), F.lit(0)) > 0) | F.contains(
        F.coalesce(trend_data, F.lit("")), F.lit(fixed.LIVE_TREND_MARK)
    )


def brief_summary(trend_data: Column) -> Column:
    """Summary line of a brief, else its first two content lines."""
    lines = T.split_lines(F.coalesce(trend_data, F.lit("")))
    summaries = F.filter(lines, lambda s: s.startswith("- Summary:"))
    skipped = ["[", "- Market:", "- Platform:", "- Search Query:"]

    def content(s: Column) -> Column:
        keep = T.strip(s) != ""
        for mark in skipped:
            keep = keep & ~T.strip(s).startswith(mark)
        return keep

    body = F.transform(
        F.filter(lines, content), lambda s: T.strip(F.regexp_replace(T.strip(s), r"^[- ]+", ""))
    )
    return F.when(
        F.size(summaries) > 0, T.strip(F.substr(F.get(summaries, F.lit(0)), F.lit(len("- Summary:") + 1)))
    ).otherwise(T.strip(F.array_join(F.slice(body, 1, 2), " ")))


def brief_text(query: Column, country: Column, platform: Column, answer: Column, hits: Column) -> Column:
    """The trend brief: head, optional summary and up to four signals.

    ``hits`` is an array of (title, content, url, score) in rank order.
    """
    short = T.compact(T.strip(F.coalesce(answer, F.lit(""))), 420)

    def signal(h: Column, i: Column) -> Column:
        title = T.compact(h["title"], 110)
        content = T.compact(h["content"], 180)
        number = (i + 1).cast("string")
        return F.concat(
            F.lit("  "),
            number,
            F.lit(". "),
            F.when(title == "", F.concat(F.lit("Signal "), number)).otherwise(title),
            F.when(h["score"].isNull(), F.lit("")).otherwise(F.concat(F.lit(" (score: "), T.to_fixed(h["score"], 2), F.lit(")"))),
            F.when(content == "", F.lit("")).otherwise(F.concat(F.lit(" — "), content)),
            F.when(F.coalesce(h["url"], F.lit("")) == "", F.lit("")).otherwise(
                F.concat(F.lit(" ["), h["url"], F.lit("]"))
            ),
        )

    head = F.array(
        F.lit(fixed.LIVE_TREND_MARK),
        F.concat(F.lit("- Market: "), F.upper(country)),
        F.concat(F.lit("- Platform: "), S.canonical_platform(platform)),
        F.concat(F.lit("- Search Query: "), query),
    )
    none = F.array().cast("array<string>")
    summary = F.when(short == "", none).otherwise(F.array(F.concat(F.lit("- Summary: "), short)))
    signals = F.when(
        F.coalesce(F.size(hits), F.lit(0)) > 0,
        F.concat(F.array(F.lit("- Recent Signals:")), F.transform(F.slice(hits, 1, 4), signal)),
    ).otherwise(F.array(F.lit(fixed.NO_SIGNALS_LINE)))
    return F.array_join(F.concat(head, summary, signals), "\n")


def fallback_brief(topic: Column, platform: Column, mode: Column, query: Column, reason: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.lit(fixed.FALLBACK_TREND_MARK),
        F.concat(F.lit("- Topic: "), T.default_if_blank(topic, "this topic")),
        F.concat(F.lit("- Platform: "), S.canonical_platform(platform)),
        F.concat(F.lit("- Distribution Mode: "), F.lower(mode)),
        F.concat(F.lit("- Search Query Attempted: "), query),
        F.concat(F.lit("- Live Search Status: "), reason),
        F.lit(fixed.FALLBACK_ASSUMPTION),
    )


def platform_label(key: Column) -> Column:
    return T.lookup(key, fixed.PLATFORM_LABELS, F.initcap(key))


def hit_platform(url: Column, requested: Column) -> Column:
    return F.coalesce(F.nullif(web.platform_of_url(url), F.lit("")), requested)
