"""Scope fields: canonical names, matches and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text as T

WILDCARDS = ["all", "global"]
COUNTRY_WILDCARDS = ["GLOBAL", "ALL"]


def markets(spark: SparkSession) -> DataFrame:
    """The fixed market dimension (17 rows, so it is always small enough to broadcast)."""
    return spark.createDataFrame(fixed.MARKETS, "code string, label string, region string, default_language string")


def _market_field(country: Column, position: int, default: Column) -> Column:
    return T.lookup(F.upper(country), {m[0]: m[position] for m in fixed.MARKETS}, default)


def region_of(country: Column) -> Column:
    return _market_field(country, 2, F.lit("GLOBAL"))


def market_language(country: Column) -> Column:
    return _market_field(country, 3, F.lit(None).cast("string"))


def market_label(country: Column) -> Column:
    return _market_field(country, 1, F.upper(country))


def canonical_platform(x: str | Column) -> Column:
    raw = T.col(x)
    low = F.lower(T.strip(raw))
    out = F.when(raw.isNull() | (raw == ""), F.lit("tiktok"))
    for alias, name in fixed.PLATFORM_ALIASES:
        out = out.when(F.contains(low, F.lit(alias)), F.lit(name))
    return out.otherwise(F.replace(low, F.lit(" "), F.lit("_")))


def canonical_language(x: str | Column) -> Column:
    raw = T.col(x)
    low = F.lower(T.strip(raw))
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string")).otherwise(
        T.lookup(low, fixed.LANGUAGE_ALIASES, low)
    )


def knowledge_languages(languages: Column, country: Column) -> Column:
    """Requested languages in order, then the language of the market."""
    asked = F.when(F.coalesce(F.size(languages), F.lit(0)) < 1, F.array(F.lit("English"))).otherwise(languages)
    names = F.filter(F.transform(asked, canonical_language), lambda v: v.isNotNull() & (v != ""))
    market = market_language(country)
    return F.array_distinct(
        F.concat(names, F.when(market.isNull(), F.array().cast("array<string>")).otherwise(F.array(market)))
    )


def resolve_scope(requests: DataFrame) -> DataFrame:
    """Fill and canonicalise the scope fields of review requests (one row in, one row out)."""
    have = set(requests.columns)

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    country = F.upper(field("target_country", "US"))
    langs = F.col("target_languages") if "target_languages" in have else F.array(F.lit("English"))
    return requests.withColumns(
        {
            "target_country": country,
            "target_region_pack": region_of(country),
            "target_platform": canonical_platform(field("target_platform", "tiktok")),
            "distribution_mode": F.lower(field("distribution_mode", "branded_content")),
            "product_category": F.lower(field("product_category", "general")),
            "brand_id": F.lower(field("brand_id", "default")),
            "knowledge_languages": knowledge_languages(langs, country),
        }
    )


def query_text() -> Column:
    """Search text of a request."""
    return F.concat_ws(
        "\n",
        *[F.coalesce(F.col(n), F.lit("")) for n in ("topic", "final_script", "style_prompt", "product_category")],
    )


def relevant_category(x: str | Column) -> Column:
    """Blank categories pass, others must be on the list."""
    return (T.col(x) == "") | T.col(x).isin(*fixed.RELEVANT_CATEGORIES)


def category_group(x: str | Column) -> Column:
    return T.lookup(T.col(x), dict(fixed.CATEGORY_GROUPS), F.lit(None).cast("string"))


def _allowed(value: Column, target: Column, wildcards: list[str], blank_ok: bool = True) -> Column:
    hit = (value == target) | value.isin(*wildcards)
    return (value == "") | hit if blank_ok else hit


def index_filter(chunk: dict[str, Column], scope: dict[str, Column]) -> Column:
    """Filter applied before the vector search (category groups are an equi key of the join)."""
    return (
        _allowed(chunk["platform"], scope["target_platform"], WILDCARDS, False)
        & _allowed(chunk["distribution_mode"], scope["distribution_mode"], WILDCARDS, False)
        & _allowed(chunk["brand_id"], scope["brand_id"], WILDCARDS, False)
    )


def scope_match(chunk: dict[str, Column], scope: dict[str, Column]) -> Column:
    """Full scope match, country or region included."""
    place = F.when(
        chunk["country_code"] != "",
        (chunk["country_code"] == scope["target_country"]) | chunk["country_code"].isin(*COUNTRY_WILDCARDS),
    ).otherwise(_allowed(chunk["region_pack"], scope["target_region_pack"], COUNTRY_WILDCARDS))
    return (
        _allowed(chunk["platform"], scope["target_platform"], WILDCARDS)
        & _allowed(chunk["distribution_mode"], scope["distribution_mode"], WILDCARDS)
        & _allowed(chunk["brand_id"], scope["brand_id"], WILDCARDS)
        & place
    )


def strict_scope_match(doc: dict[str, Column], scope: dict[str, Column]) -> Column:
    """As above, but a law must name the target country, or its region when it names none."""
    brand = (scope["brand_id"] == "") | _allowed(doc["brand_id"], scope["brand_id"], WILDCARDS)
    law = F.when(doc["country_code"] != "", doc["country_code"] == scope["target_country"]).otherwise(
        (doc["region_pack"] != "") & (doc["region_pack"] == scope["target_region_pack"])
    )
    policy = F.when(
        doc["country_code"] != "",
        (doc["country_code"] == scope["target_country"]) | doc["country_code"].isin(*COUNTRY_WILDCARDS),
    ).otherwise(_allowed(doc["region_pack"], scope["target_region_pack"], COUNTRY_WILDCARDS))
    return (
        _allowed(doc["platform"], scope["target_platform"], WILDCARDS)
        & _allowed(doc["distribution_mode"], scope["distribution_mode"], WILDCARDS)
        & brand
        & F.when(F.lower(doc["source_type"]) == "law", law).otherwise(policy)
    )


def priority_weight(x: str | Column) -> Column:
    out = F.lit(0)
    for name, weight in fixed.PRIORITY_WEIGHTS.items():
        out = F.when(F.upper(T.col(x)) == name, F.lit(weight)).otherwise(out)
    return out


def scope_score(chunk: dict[str, Column], scope: dict[str, Column]) -> Column:
    """How closely a chunk fits the target market, platform and mode, plus its priority."""
    place = (
        F.when(chunk["country_code"] == scope["target_country"], 18)
        .when(chunk["region_pack"] == scope["target_region_pack"], 10)
        .when(chunk["is_global_fallback"], 2)
        .otherwise(0)
    )
    return (
        place
        + F.when(chunk["platform"] == scope["target_platform"], 8).otherwise(0)
        + F.when(chunk["distribution_mode"] == scope["distribution_mode"], 6).otherwise(0)
        + priority_weight(chunk["priority"])
    )


def lexical_score(shared: Column, doc: dict[str, Column], scope: dict[str, Column]) -> Column:
    """Score of the lexical-only path, from the number of shared tokens and the scope."""
    return (
        shared * 4
        + F.when(doc["country_code"] == scope["target_country"], 12)
        .when(doc["region_pack"] == scope["target_region_pack"], 6)
        .otherwise(0)
        + F.when(doc["platform"] == scope["target_platform"], 8).otherwise(0)
        + F.when(doc["distribution_mode"] == scope["distribution_mode"], 5).otherwise(0)
        + F.when(F.lower(doc["source_type"]) == "law", 4).otherwise(0)
        - F.when(doc["is_global_fallback"], 2).otherwise(0)
    )


def language_variants(x: str | Column) -> Column:
    parts = F.split(F.lower(T.strip(T.col(x))), r"[/,;|]+|-")
    return F.filter(F.transform(parts, T.strip), lambda p: p != "")


def language_match(chunk_language: Column, targets: Column) -> Column:
    """Targets keep their region suffix, so a target such as pt-br never matches."""
    lowered = F.transform(targets, F.lower)
    return F.coalesce(F.arrays_overlap(language_variants(chunk_language), lowered), F.lit(False))


def fields(names: list[str], prefix: str = "") -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in names}
