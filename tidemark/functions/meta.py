"""Document metadata: header parsing, construction and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text as T

_FENCE = r"(?s)^\s*```json\s*(\{.*?\})\s*```\s*"


def json_header(x: str | Column) -> Column:
    """(metadata map, body) of a text that opens with a fenced JSON object."""
    raw = T.col(x)

    def parsed(found: Column) -> Column:
        return F.when((found != "") & F.try_parse_json(found).isNotNull(), F.from_json(found, "map<string,string>"))

    def header(fields: Column) -> Column:
        return F.struct(
            F.coalesce(fields, _empty_map()).alias("metadata"),
            F.when(fields.isNotNull(), T.strip(F.regexp_replace(raw, _FENCE, ""))).otherwise(raw).alias("body"),
        )

    return T.let(F.regexp_extract(raw, _FENCE, 1), lambda found: T.let(parsed(found), header))


def front_matter(x: str | Column) -> Column:
    """(metadata map, body) of a text that opens with ``---`` and key: value lines."""
    raw = T.col(x)

    def fields(lines: Column, rest: Column, end: Column) -> Column:
        head = F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(rest)
        pairs = F.transform(
            F.filter(head, lambda s: F.contains(s, F.lit(":"))),
            lambda s: F.struct(
                T.strip(F.regexp_extract(s, r"(?s)^([^:]*):(.*)$", 1)).alias("key"),
                T.strip(F.regexp_extract(s, r"(?s)^([^:]*):(.*)$", 2)).alias("value"),
            ),
        )

        def last(pairs: Column) -> Column:
            return F.filter(
                pairs,
                lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]),
            )

        body = F.when(end > 0, F.slice(rest, end + 1, F.greatest(F.size(rest), F.lit(1)))).otherwise(lines)
        return F.struct(F.map_from_entries(T.let(pairs, last)).alias("metadata"), T.strip(F.array_join(body, "\n")).alias("body"))

    def parts(lines: Column) -> Column:
        after = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))

        def ended(rest: Column) -> Column:
            end = F.array_position(F.transform(rest, lambda s: T.strip(s) == "---"), F.lit(True)).cast("int")
            return T.let(end, lambda e: fields(lines, rest, e))

        return T.let(after, ended)

    none = F.struct(_empty_map().alias("metadata"), raw.alias("body"))
    return F.when(raw.startswith("---\n"), T.let(T.split_lines(raw), parts)).otherwise(none)


def any_header(x: str | Column) -> Column:
    """Front matter where it yields a field, else a JSON header."""
    return T.let(front_matter(x), lambda fm: F.when(F.size(fm["metadata"]) > 0, fm).otherwise(json_header(x)))


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def country_code(market: Column) -> Column:
    m = F.upper(F.coalesce(F.nullif(market, F.lit("")), F.lit("GLOBAL")))
    return F.when(m.isin("GLOBAL", "EU", "INTERNAL"), F.lit("")).otherwise(
        T.lookup(m, fixed.COUNTRY_CODE_ALIASES, m)
    )


def source_type(document_type: Column) -> Column:
    return F.when(document_type == "market_law", F.lit("law")).otherwise(F.lit("policy"))


def raw_metadata(e: dict[str, Column], raw_path: Column, stem: Column, processed_at: Column) -> Column:
    """Metadata of a document built from a raw file and its catalog entry.

    ``e`` holds the catalog fields; a null field takes the default of the field.
    """
    platform = F.lower(F.coalesce(e["platform"], F.lit("all")))
    category = F.coalesce(e["category"], F.lit(""))
    kind = T.lookup(category, fixed.DOCUMENT_TYPES, category)
    market = F.coalesce(e["market"], F.lit("GLOBAL"))
    title = F.coalesce(e["title"], stem)
    place = F.when(market.isin("GLOBAL", "EU", "INTERNAL"), F.lit("")).otherwise(
        T.lookup(market, fixed.COUNTRY_CODE_ALIASES, market)
    )
    return _metadata(
        source_id=e["id"],
        title=title,
        platform=platform,
        platform_display=T.lookup(platform, fixed.PLATFORM_DISPLAY, F.initcap(platform)),
        region=market,
        region_pack=F.coalesce(e["region"], F.lit("GLOBAL")),
        document_type=kind,
        source_category=category,
        language=F.coalesce(e["language"], F.lit("")),
        source_url=F.coalesce(e["url"], F.lit("")),
        priority=F.coalesce(e["priority"], F.lit("")),
        notes=F.coalesce(e["notes"], F.lit("")),
        raw_file=raw_path,
        processed_at=processed_at,
        parser_version=F.lit(fixed.PARSER_VERSION_RAW),
        source_type=source_type(kind),
        country_code=place,
        is_global_fallback=market.isin("GLOBAL", "EU"),
    )


def upload_metadata(u: dict[str, Column], source_id: Column, processed_at: Column) -> Column:
    """Metadata of a directly uploaded text; blank fields take the library defaults."""
    d = fixed.LIBRARY_DEFAULTS
    return _metadata(
        source_id=source_id,
        title=u["title"],
        platform=_or_default(F.lower(u["platform"]), d["platform"]),
        platform_display=u["platform"],
        region=_or_default(F.upper(u["market"]), d["market"]),
        region_pack=_or_default(F.upper(u["region"]), d["region"]),
        document_type=u["category"],
        source_category=u["category"],
        language=_or_default(F.lower(u["language"]), d["language"]),
        source_url=u["source_url"],
        priority=_or_default(F.upper(u["priority"]), d["priority"]),
        notes=u["notes"],
        raw_file=F.lit(""),
        processed_at=processed_at,
        parser_version=F.lit(fixed.PARSER_VERSION_UPLOAD),
        source_type=source_type(u["category"]),
        country_code=country_code(u["market"]),
        is_global_fallback=F.upper(u["market"]).isin("GLOBAL", "EU"),
    )


def _or_default(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def _metadata(**f: Column) -> Column:
    f["doc_id"] = f["source_id"]
    f["source_title"] = f["title"]
    f["distribution_mode"] = F.lit("all")
    f["brand_id"] = F.lit("all")
    f["block_id"] = f["source_id"]
    return F.struct(*[f[k].alias(k) for k in f])


def add_title(body: Column, title: Column) -> Column:
    text = T.lstrip(body)
    return F.when(text.startswith("# "), body).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), text))


def cut_contents(source_id: Column, body: Column) -> Column:
    """The contents list of the known sources removed: from its heading up to the first kept one."""
    out = body
    for source, (first, kept) in fixed.CONTENTS_CUT.items():
        lines = T.split_lines(body)
        start = F.array_position(lines, F.lit(first)).cast("int")
        tail = F.slice(lines, F.greatest(start + 1, F.lit(1)), F.greatest(F.size(lines), F.lit(1)))
        offset = F.array_position(F.transform(tail, T.strip), F.lit(kept)).cast("int")
        cut = F.concat(
            F.slice(lines, F.lit(1), F.greatest(start - 1, F.lit(0))),
            F.slice(tail, F.greatest(offset, F.lit(1)), F.greatest(F.size(lines), F.lit(1))),
        )
        out = F.when((source_id == source) & (start > 0) & (offset > 0), F.array_join(cut, "\n")).otherwise(out)
    return out


def document_file(metadata: Column, body: Column) -> Column:
    """Text of a stored document: JSON header and body."""
    return F.concat(F.lit("```json\n"), F.to_json(metadata), F.lit("\n```\n\n"), body)


def parse_time(x: str | Column) -> Column:
    """Timestamp of an ISO text; a text without zone is UTC, an invalid one is null."""
    s = T.strip(T.col(x))
    zoned = F.when(s.rlike(r"(Z|[+\-]\d{2}:?\d{2})$"), s).otherwise(F.concat(s, F.lit("+00:00")))
    return F.try_to_timestamp(F.nullif(F.replace(zoned, F.lit("T"), F.lit(" ")), F.lit("+00:00")))


def show_time(ts: str | Column) -> Column:
    return F.coalesce(F.date_format(T.col(ts), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def json_object_or_empty(x: str | Column) -> Column:
    """The text where it is a JSON object, else an empty object."""
    s = T.col(x)
    ok = F.try_parse_json(s).isNotNull() & F.ltrim(s).startswith("{")
    return F.when(ok, s).otherwise(F.lit("{}"))


def upload_error(size: Column, suffix: Column) -> Column:
    """Why an upload is refused, null when it is accepted."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(fixed.UPLOAD_EMPTY)).when(
        ~F.coalesce(suffix, F.lit("")).isin(*fixed.RAW_SUFFIXES, *fixed.DIRECT_SUFFIXES), F.lit(fixed.UPLOAD_SUFFIX)
    )


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=.)(\.[^.]*)$", 1))


def lenient_utf8(content: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 are left out."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
