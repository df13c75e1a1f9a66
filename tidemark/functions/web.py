"""URLs, page heads and crawl results as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text as T

_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def host_of(url: str | Column) -> Column:
    """Network location of a URL, user info and port included; blank when there is none."""
    return F.regexp_extract(F.coalesce(T.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def platform_of_url(url: str | Column, strict: bool = False) -> Column:
    """Platform whose host part occurs in the host of the URL.

    The default is a plain substring test, so a host that merely ends in ``x.com``
    counts as well; ``strict`` asks for the domain itself or a subdomain of it.
    """
    host = F.lower(host_of(url))
    out = None
    for name, parts in fixed.PLATFORM_HOSTS:
        hit = F.lit(False)
        for part in parts:
            if strict:
                hit = hit | (host == part) | host.endswith("." + part)
            else:
                hit = hit | F.contains(host, F.lit(part))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(""))


def display_domain(url: str | Column) -> Column:
    name = F.replace(host_of(url), F.lit("www."), F.lit(""))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))


def article_source(url: str | Column) -> Column:
    return F.coalesce(F.nullif(host_of(url), F.lit("")), F.lit("web"))


def blocked_signal(content: str | Column, content_type: Column | None = None) -> Column:
    """First anti-bot phrase of a fetched page, blank when there is none."""
    low = F.lower(T.col(content))
    out = F.coalesce(*[F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in fixed.BLOCK_SIGNALS], F.lit(""))
    if content_type is None:
        return out
    return F.when(F.contains(F.lower(content_type), F.lit("html")), out).otherwise(F.lit(""))


def file_extension(url: str | Column, content_type: str | Column) -> Column:
    kind = F.lower(T.col(content_type))
    base = T.strip(F.split_part(kind, F.lit(";"), F.lit(1)))
    return (
        F.when(F.contains(kind, F.lit("pdf")) | F.lower(T.col(url)).endswith(".pdf"), F.lit(".pdf"))
        .when(F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("text/")), F.lit(".html"))
        .otherwise(T.lookup(base, fixed.CONTENT_TYPE_EXTENSIONS, F.lit(".bin")))
    )


def content_digest(content: str | Column) -> Column:
    return F.sha2(T.col(content), 256)


def crawl_outcome(entry: dict[str, Column]) -> Column:
    """Status and reason of one fetch: manual, blocked, failed or downloaded.

    ``entry`` holds crawl_mode, http_status (null when the request failed), error,
    content and content_type.
    """
    manual = F.coalesce(entry["crawl_mode"], F.lit("auto")) != "auto"
    signal = blocked_signal(entry["content"], entry["content_type"])
    status, error = entry["http_status"], entry["error"]
    return (
        F.when(manual, _outcome(F.lit("manual_required"), F.lit("manual_source")))
        .when(status >= 400, _outcome(F.lit("failed"), F.concat(F.lit("http_"), status.cast("string"))))
        .when(error.isNotNull(), _outcome(F.lit("failed"), error))
        .when(signal != "", _outcome(F.lit("blocked"), F.concat(F.lit("anti_bot_or_js:"), signal)))
        .otherwise(_outcome(F.lit("downloaded"), F.lit("")))
    )


def _outcome(status: Column, reason: Column) -> Column:
    return F.struct(status.alias("status"), reason.alias("reason"))
