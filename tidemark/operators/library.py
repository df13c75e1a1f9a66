"""Document library: listing, ids, uploads, catalog, index status and crawl reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import meta as M
from tidemark.functions import text as T
from tidemark.operators.keyed import first_per_key, last_per_key, merge_rows, number_rows, replace_rows, top_k
from tidemark.session import cut_lineage

CATALOG_FIELDS = ["id", "title", "category", "region", "market", "platform", "language", "url", "crawl_mode", "priority", "notes"]


def catalog_by_id(entries: DataFrame, order: str) -> DataFrame:
    """One entry per id, the last one where an id occurs more than once."""
    return last_per_key(entries, ["id"], [F.col(order)])


def upsert_catalog(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Catalog with new entries in the place of old ones of the same id, in id order."""
    return replace_rows(catalog.select(*CATALOG_FIELDS), entries.select(*CATALOG_FIELDS), ["id"]).orderBy("id")


def listing(
    metadata: DataFrame, raw: DataFrame, catalog: DataFrame, manifest: DataFrame, built_at: Column
) -> DataFrame:
    """Library rows: every processed document and every raw file without one.

    ``metadata``: source_id and the stored fields with processed_at (text), file_time,
    markdown_exists. ``raw``: source_id, raw_path, raw_suffix, file_time. A document is
    indexed unless the index is older than it.
    """
    d = fixed.LIBRARY_DEFAULTS
    m = metadata.select("source_id", F.struct(*[c for c in metadata.columns if c != "source_id"]).alias("m"))
    # several raw files may share an id; the listing shows the first one
    r = first_per_key(raw, ["source_id"], [F.col("raw_path")]).select(
        "source_id", F.struct("raw_path", "raw_suffix", "file_time").alias("r")
    )
    c = catalog.select(F.col("id").alias("source_id"), F.struct(*[n for n in CATALOG_FIELDS if n != "id"]).alias("c"))
    f = manifest.select("source_id", F.struct("markdown_path", "raw_suffix").alias("f"))
    rows = m.join(r, "source_id", "full_outer").join(c, "source_id", "left").join(f, "source_id", "left")
    processed = F.col("m").isNotNull()

    def field(name: str, default: str, stored: str | None = None, entry: str | None = None) -> Column:
        return F.when(processed, F.coalesce(F.col(f"m.{stored or name}"), F.lit(default))).otherwise(
            F.coalesce(F.col(f"c.{entry or name}"), F.lit(default))
        )

    at = M.parse_time("m.processed_at")
    category = F.when(
        processed,
        F.coalesce(F.nullif("m.source_category", F.lit("")), F.nullif("m.document_type", F.lit("")), F.lit(d["category"])),
    ).otherwise(F.coalesce("c.category", F.lit(d["category"])))
    stale = built_at.isNull() | (at.isNotNull() & (built_at < at))
    suffix = F.coalesce(F.col("f.raw_suffix"), F.nullif(M.file_suffix(F.coalesce("m.raw_file", F.lit(""))), F.lit("")), F.col("r.raw_suffix"))
    return rows.select(
        "source_id",
        F.when(processed, F.coalesce("m.title", "source_id")).otherwise(F.coalesce("c.title", "source_id")).alias("title"),
        category.alias("category"),
        field("platform", d["platform"]).alias("platform"),
        field("market", d["market"], "region", "market").alias("market"),
        field("region", d["region"], "region_pack", "region").alias("region"),
        field("language", d["language"]).alias("language"),
        field("source_url", "", "source_url", "url").alias("source_url"),
        field("notes", "").alias("notes"),
        field("priority", d["priority"]).alias("priority"),
        F.when(processed & ~stale, F.lit("indexed")).otherwise(F.lit("pending_rebuild")).alias("status"),
        F.coalesce(at, F.col("m.file_time"), F.col("r.file_time")).alias("updated_at"),
        F.coalesce("r.raw_path", F.lit("")).alias("raw_path"),
        F.when(
            processed,
            F.when(F.col("m.markdown_exists"), F.concat(F.lit("processed/"), F.col("source_id"), F.lit(".md"))).otherwise(
                F.coalesce("f.markdown_path", F.lit(""))
            ),
        )
        .otherwise(F.lit(""))
        .alias("markdown_path"),
        F.coalesce(suffix, F.lit("")).alias("raw_suffix"),
        F.when(processed, F.lit("processed")).otherwise(F.lit("raw")).alias("file_origin"),
    )


def newest_first(rows: DataFrame) -> DataFrame:
    """Rows (source_id, updated_at) with their ``place`` from the newest down; rows without a time come last."""
    down = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**63 - 1))
    at = F.struct(down.alias("down"), "source_id")
    return number_rows(rows.withColumn("_at", at), "_at", "place").drop("_at")


# --- ids ----------------------------------------------------------------------------------


NUMBERED = r"^(.+)_([1-9]\d{0,17})$"
ALWAYS = -(2**63)


def split_id(x: Column) -> Column:
    """The (base, n) readings of an id: itself with n = 0, and base_n for a number suffix.

    The first free number of a base is at most the count of ids in use under it, plus three. So a suffix of more
    than 18 digits is never reached, and reading it as a part of the name changes nothing.
    """
    own = F.struct(x.alias("base"), F.lit(0).cast("bigint").alias("n"))
    cut = F.struct(
        F.regexp_extract(x, NUMBERED, 1).alias("base"), F.regexp_extract(x, NUMBERED, 2).cast("bigint").alias("n")
    )
    return F.when(x.rlike(NUMBERED), F.array(own, cut)).otherwise(F.array(own))


def allocate_ids(uploads: DataFrame, taken: DataFrame) -> DataFrame:
    """Adds ``source_id``: the id an upload is stored under, as if uploads came one by one.

    ``uploads``: upload_no, base, suffix. ``taken``: id, raw_suffixes (array), has_md,
    has_json, in_catalog, one row per id in use. A raw file may replace a raw file of its
    own kind, a text may replace a stored text; otherwise the first free number is used.
    Uploads of one kind under one base share an id, so at most three ids per base are
    handed out.

    Only a base ``a`` and an uploaded base ``a_5`` can want the same id. For ``a``, ``a_5`` is in use from the first
    upload of that base on, whatever else that base does; for ``a_5``, its own name is in use where ``a`` took it
    before. So bases are settled by the number of uploaded bases they stand behind (``a``, then ``a_5``, then
    ``a_5_2``), all bases of one depth at once and no base twice. Each claim sees the ids in use before it.
    """
    raw = F.col("suffix").isin(*fixed.RAW_SUFFIXES)
    kinds = uploads.withColumn("kind", F.when(raw, F.col("suffix")).otherwise(F.lit("text")))
    claims = cut_lineage(kinds.groupBy("base", "kind").agg(F.min("upload_no").cast("bigint").alias("first_no")))
    bases = claims.groupBy("base").agg(F.min("first_no").alias("at"), F.min_by("kind", "first_no").alias("kind"))
    claims = cut_lineage(claims.join(_depths(bases.select("base")), "base"))
    deepest = claims.agg(F.max("depth")).first()[0] or 0
    in_use = _ids_in_use(taken).unionByName(
        # a base uses its own name, which is a number of another base
        bases.filter(F.col("base").rlike(NUMBERED)).select(
            F.element_at(split_id(F.col("base")), 2).alias("p"), "at", F.array("kind").alias("suits")
        ).select("p.base", "p.n", "at", "suits")
    )
    in_use = cut_lineage(in_use.join(bases.select("base"), "base", "left_semi"))
    given = None
    for depth in range(deepest + 1):
        settled = cut_lineage(_settle(claims.filter(F.col("depth") == depth).drop("depth"), in_use))
        given = settled if given is None else given.unionByName(settled)
        took = settled.filter("new and n > 0")
        in_use = in_use.unionByName(
            took.select(F.col("source_id").alias("base"), F.lit(0).cast("bigint").alias("n"), F.col("first_no").alias("at"), F.array("kind").alias("suits"))
        )
    return kinds.join(given.select("base", "kind", "source_id"), ["base", "kind"]).drop("kind")


def _depths(bases: DataFrame) -> DataFrame:
    """(base, depth): how many uploaded bases stand before a base, each one number suffix shorter than the next."""
    tail = F.regexp_extract("base", r"^.+?((?:_[1-9]\d{0,17})+)$", 1)
    numbers = F.filter(F.split(tail, "_"), lambda x: x != "")
    named = bases.withColumn("_numbers", numbers)
    # the name without its last j numbers
    shorter = F.transform(
        F.when(F.size("_numbers") > 0, F.sequence(F.lit(1), F.size("_numbers"))).otherwise(F.array().cast("array<int>")),
        lambda j: F.struct(
            j.alias("j"),
            F.expr("base").substr(F.lit(1), F.length("base") - F.length(F.array_join(F.slice("_numbers", -j, j), "_")) - 1).alias("ancestor"),
        ),
    )
    rows = named.select("base", F.explode(shorter).alias("s")).select("base", "s.j", "s.ancestor")
    known = rows.join(bases.select(F.col("base").alias("ancestor")), "ancestor", "left_semi")
    found = known.groupBy("base").agg(F.array_sort(F.collect_set("j")).alias("js"))
    depth = F.size(F.filter("js", lambda x, i: x == i + 1))
    return bases.join(found, "base", "left").select("base", F.coalesce(F.when(F.col("js").isNotNull(), depth), F.lit(0)).alias("depth"))


def _ids_in_use(taken: DataFrame) -> DataFrame:
    """(base, n, at, suits): both readings of each id in use, and the kinds that may be stored under it."""
    size = F.coalesce(F.size("raw_suffixes"), F.lit(0))
    options = F.array(
        *[F.when((size == 1) & F.array_contains("raw_suffixes", s) & ~F.col("has_md"), F.lit(s)) for s in fixed.RAW_SUFFIXES],
        F.when(F.col("has_md") & F.col("has_json") & (size <= 0), F.lit("text")),
    )
    suits = F.filter(options, lambda o: o.isNotNull())
    named = taken.select(F.explode(split_id(F.col("id"))).alias("p"), suits.alias("suits"))
    return named.select("p.base", "p.n", F.lit(ALWAYS).cast("bigint").alias("at"), "suits")


def _settle(claims: DataFrame, in_use: DataFrame) -> DataFrame:
    """(base, kind, first_no, n, new, source_id): the number each claim gets, by what was in use before it.

    Only the first free numbers are looked for: the successors of numbers in use, less the numbers in use. A base
    takes two numbers at most before its last claim, so three candidates of each sort are enough.
    """
    first = in_use.groupBy("base", "n").agg(F.min("at").alias("at"), F.min_by("suits", "at").alias("suits"))
    met = claims.join(first, "base").filter(F.col("at") < F.col("first_no"))
    key = ["base", "kind"]

    def lowest(rows: DataFrame, name: str) -> DataFrame:
        return top_k(rows, key, [F.col("n")], 3, "_r").groupBy(*key).agg(F.array_sort(F.collect_list("n")).alias(name))

    reuse = lowest(met.filter(F.array_contains("suits", F.col("kind"))).select(*key, "n"), "reuse")
    after = met.select(*key, F.explode(F.array(*[F.col("n") + i for i in (1, 2, 3)])).alias("n"))
    start = claims.select(*key, F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])).alias("n"))
    free = start.unionByName(after).distinct().join(met.select(*key, "n"), [*key, "n"], "left_anti")
    asked = claims.join(lowest(free, "free"), key).join(reuse, key, "left")
    none = F.array().cast("array<bigint>")
    plan = asked.groupBy("base").agg(
        F.array_sort(F.collect_list(F.struct("first_no", "kind", "free", F.coalesce("reuse", none).alias("reuse")))).alias("asked")
    )
    out = F.array().cast("array<struct<kind:string,first_no:bigint,n:bigint,new:boolean>>")

    def give(state: Column, k: Column) -> Column:
        def left(x: Column) -> Column:
            return F.get(F.filter(x, lambda n: ~F.array_contains(state["mine"], n)), F.lit(0))

        new, old = left(k["free"]), left(k["reuse"])
        is_new = F.coalesce(new < old, F.lit(True))
        got = F.struct(k["kind"].alias("kind"), k["first_no"].alias("first_no"), F.when(is_new, new).otherwise(old).alias("n"), is_new.alias("new"))
        return F.struct(
            F.when(is_new, F.array_append(state["mine"], new)).otherwise(state["mine"]).alias("mine"), F.array_append(state["out"], got).alias("out")
        )

    folded = F.aggregate("asked", F.struct(none.alias("mine"), out.alias("out")), give, lambda state: state["out"])
    given = plan.select("base", F.inline(folded))
    source_id = F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string")))
    return given.withColumn("source_id", source_id)


# --- uploads ------------------------------------------------------------------------------


def check_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) uploads (upload_no, filename, content, ...); refused rows say why."""
    suffix = M.file_suffix(F.col("filename"))
    text = T.decode_bytes("content")
    checked = uploads.withColumns({"suffix": suffix, "stem": M.file_stem(F.col("filename"))}).withColumn(
        "error",
        F.coalesce(
            M.upload_error(F.octet_length("content"), F.col("suffix")),
            F.when(F.col("suffix").isin(*fixed.DIRECT_SUFFIXES) & T.is_blank(text), F.lit(fixed.UPLOAD_BLANK)),
        ),
    )
    refused = checked.filter(F.col("error").isNotNull()).select("upload_no", "filename", "error")
    return checked.filter(F.col("error").isNull()).drop("error"), refused


def store_uploads(uploads: DataFrame, taken: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Accepted uploads routed to their tables.

    Returns ``refused``, ``raw_files`` (source_id, suffix, content), ``catalog`` entries of
    raw files, ``documents`` (source_id, metadata, body) of direct texts, and ``items``, the
    library rows. A later upload under the same id replaces an earlier one.
    """
    accepted, refused = check_uploads(uploads)
    d = fixed.LIBRARY_DEFAULTS
    stamp = F.date_format(now, "yyyyMMdd_HHmmss")
    shaped = accepted.withColumns(
        {
            "base": T.source_slug("stem", stamp),
            "title": T.default_if_blank("title", F.col("stem")),
            "category": T.default_if_blank("category", d["category"]),
            "market": F.upper(T.default_if_blank("market", d["market"])),
            "region": F.upper(T.default_if_blank("region", d["region"])),
            "platform": F.lower(T.default_if_blank("platform", d["platform"])),
            "language": F.lower(T.default_if_blank("language", d["language"])),
            "priority": F.upper(T.default_if_blank("priority", d["priority"])),
            "source_url": T.strip(F.coalesce("source_url", F.lit(""))),
            "notes": T.strip(F.coalesce("notes", F.lit(""))),
        }
    )
    placed = allocate_ids(shaped, taken)
    stored = last_per_key(placed, ["source_id"], [F.col("upload_no")])
    is_raw = F.col("suffix").isin(*fixed.RAW_SUFFIXES)
    raw, texts = stored.filter(is_raw), stored.filter(~is_raw)
    names = ["title", "category", "market", "region", "platform", "language", "source_url", "priority", "notes"]
    at = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    meta = M.upload_metadata({n: F.col(n) for n in names}, F.col("source_id"), at)
    body = T.strip(T.decode_bytes("content"))
    documents = texts.select("source_id", meta.alias("metadata"), M.add_title(body, T.strip("title")).alias("body"))
    catalog = raw.select(
        F.col("source_id").alias("id"),
        "title",
        "category",
        "region",
        "market",
        "platform",
        "language",
        F.col("source_url").alias("url"),
        F.lit("manual_upload").alias("crawl_mode"),
        "priority",
        "notes",
    )
    items = stored.select(
        "source_id",
        *names,
        F.lit("pending_rebuild").alias("status"),
        at.alias("updated_at"),
        F.col("suffix").alias("raw_suffix"),
        F.when(is_raw, F.lit("raw")).otherwise(F.lit("processed")).alias("file_origin"),
    )
    return {
        "refused": refused,
        "raw_files": raw.select("source_id", "suffix", "content"),
        "catalog": catalog,
        "documents": documents,
        "items": items,
    }


# --- index --------------------------------------------------------------------------------


def fingerprint(documents: DataFrame, embedder: str) -> DataFrame:
    """One row: a digest of the documents (doc_id, path, size, mtime) and the embedder.

    The digest is built from sums of document digests, which do not depend on the order
    of the documents and are combined on the map side, so no task sees the whole list.
    """
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in ("doc_id", "path", "size", "mtime")])
    d = F.md5(line)
    parts = [F.sum(F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"p{i}") for i in range(4)]
    sums = documents.agg(F.count("*").alias("documents"), *parts)
    text = F.concat_ws(
        "|", F.lit(embedder), F.col("documents").cast("string"), *[F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("string") for i in range(4)]
    )
    return sums.select("documents", F.sha2(text, 256).alias("fingerprint"))


def index_status(chunks: DataFrame, built_at: str = "built_at") -> DataFrame:
    """One row: documents, chunks and build time of the index; status missing when it is empty."""
    return chunks.agg(
        F.countDistinct("doc_id").alias("documents"),
        F.count("*").alias("chunks"),
        F.max(built_at).alias("built_at"),
    ).withColumn("status", F.when(F.col("chunks") > 0, F.lit("ready")).otherwise(F.lit("missing")))


def changed_documents(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents whose (doc_id, size, mtime) is not in the index yet."""
    keys = ["doc_id", "size", "mtime"]
    return documents.join(indexed.select(*keys).distinct(), keys, "left_anti")


# --- crawl --------------------------------------------------------------------------------


def crawl_counts(results: DataFrame) -> DataFrame:
    """Sources per status, and in total."""
    return results.groupBy("status").agg(F.count("*").alias("sources"))


def crawl_table(results: DataFrame) -> DataFrame:
    """The detail rows of the crawl report; bars in notes are replaced, as they delimit cells."""
    note = F.coalesce(F.nullif("reason", F.lit("")), F.nullif("notes", F.lit("")), F.lit(""))
    note = F.replace(note, F.lit("|"), F.lit("/"))
    path = F.coalesce("file_path", F.lit("")) if "file_path" in results.columns else F.lit("")
    cells = [F.col(c) for c in ("id", "category", "market", "platform", "status")] + [note, path]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))
    return results.select("id", "category", "market", "platform", "status", note.alias("note"), path.alias("file_path"), line.alias("line"))


def upsert_rows(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed merge by age, newest first."""
    return merge_rows(base, changes, keys, order)
