"""Line clean-up and document normalisation.

A document stays one row: its lines are an array inside the row, so cleaning needs
no shuffle whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import meta as M
from tidemark.functions import scope as S
from tidemark.functions import text as T


_DROPPED = "|".join(
    f"(?:{p.removeprefix('(?i)')})"
    for p in (
        fixed.PAGE_NUMBER_PATTERN,
        fixed.EMPTY_TABLE_ROW_PATTERN,
        fixed.CONTENTS_LINK_PATTERN,
        fixed.FOOTER_SLOGAN_PATTERN,
    )
)


def is_dropped(clean: Column) -> Column:
    """Cleaned lines that carry no content: page numbers, empty table rows, contents links, footers, marks."""
    out = F.lower(clean).isin("table of contents", *fixed.WATERMARKS) | T.matches(clean, "(?i)" + _DROPPED)
    for prefix in fixed.DROPPED_PREFIXES:
        out = out | clean.startswith(prefix)
    return out & (clean != "")


def drop_noise_lines(lines: Column) -> Column:
    """Noise dropped, line ends trimmed; a line without content becomes an empty string."""
    pairs = F.transform(lines, lambda s: F.struct(s.alias("line"), T.clean_line(s).alias("clean")))
    return F.transform(
        F.filter(pairs, lambda p: ~is_dropped(p["clean"])),
        lambda p: F.when(p["clean"] == "", F.lit("")).otherwise(T.rstrip(F.translate(T.rstrip(p["line"]), "\t", " "))),
    )


def collapse_blanks(lines: Column) -> Column:
    """Runs of empty lines cut to one."""
    pairs = F.filter(T.with_previous(lines), lambda p: ~((p["now"] == "") & (F.coalesce(p["before"], F.lit("x")) == "")))
    return F.transform(pairs, lambda p: p["now"])


def keyed_lines(lines: Column) -> Column:
    return F.transform(lines, lambda s: F.struct(s.alias("line"), T.line_key(s).alias("key")))


def drop_repeats_in_a_row(keyed: Column) -> Column:
    """A line with the key of the line before it is dropped; empty lines stay."""
    pairs = F.filter(
        T.with_previous(keyed),
        lambda p: p["before"].isNull() | (p["now"]["line"] == "") | (p["now"]["key"] != p["before"]["key"]),
    )
    return F.transform(pairs, lambda p: p["now"]["line"])


def tidy_markdown(docs: DataFrame, body: str, name: str | None = None) -> DataFrame:
    """Adds the clean body: noise lines, repeats and surplus blank lines removed, one final line end.

    Each stage is a column of its own that the next one uses more than once, so Spark
    keeps it as a projection instead of evaluating it again for every line.
    """
    staged = docs.withColumn("_l", drop_noise_lines(T.split_lines(F.col(body))))
    staged = staged.withColumn("_l", collapse_blanks(F.col("_l"))).withColumn("_l", keyed_lines(F.col("_l")))
    text = F.array_join(drop_repeats_in_a_row(F.col("_l")), "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{2,}(\| --- )", "\n$1")
    return staged.withColumn(name or body, F.concat(T.strip(text), F.lit("\n"))).drop("_l")


def repeated_keys(lines: Column, page_count: Column) -> Column:
    """Keys of lines that come back again and again: running heads, footers.

    In the sorted keys, a key occurs n times where the entry n - 1 places ahead is
    the same, which takes one sort instead of counting every key against every line.
    """
    return repeated_of(F.transform(lines, T.line_key), page_count)


def repeated_of(keys: Column, page_count: Column) -> Column:
    """As :func:`repeated_keys`, from the keys of the lines."""
    need = F.greatest(F.lit(3), F.floor(page_count / 4)).cast("int")

    def ahead(keys: Column) -> Column:
        return F.arrays_zip(keys.alias("a"), F.slice(keys, need, F.greatest(F.size(keys), F.lit(1))).alias("b"))

    # named twice and more, but made and sorted once
    pairs = T.let(F.array_sort(F.filter(keys, lambda k: k != "")), ahead)
    hits = F.filter(
        pairs,
        lambda p: (p["a"] == p["b"]) & ((F.length(p["a"]) < 80) | T.matches(p["a"], fixed.PAGE_NUMBER_PATTERN)),
    )
    return F.array_distinct(F.transform(hits, lambda p: p["a"]))


def drop_repeated(lines: Column, repeated: Column) -> Column:
    """Lines without those whose key is repeated (long lines only go when they are page numbers)."""
    return F.transform(drop_repeated_keyed(keyed_lines(lines), repeated), lambda p: p["line"])


def drop_repeated_keyed(keyed: Column, repeated: Column) -> Column:
    """As :func:`drop_repeated`, on lines with their keys."""
    return F.filter(
        keyed,
        lambda p: ~(
            F.array_contains(repeated, p["key"])
            & (T.matches(T.strip(p["line"]), fixed.PAGE_NUMBER_PATTERN) | (F.length(p["key"]) < 80))
        ),
    )


def clean_documents(docs: DataFrame, body: str = "body", page_count: str | None = None) -> DataFrame:
    """Adds ``clean``: the body without repeated and noise lines."""
    pages = F.col(page_count) if page_count else F.lit(1)
    # the key of a line is costly; it is built once and goes along
    staged = docs.withColumn("_keyed", keyed_lines(T.split_lines(F.col(body))))
    staged = staged.withColumn("_repeated", repeated_of(F.transform("_keyed", lambda p: p["key"]), pages))
    kept = F.when(F.size("_repeated") == 0, F.col("_keyed")).otherwise(drop_repeated_keyed(F.col("_keyed"), F.col("_repeated")))
    lines = F.transform(kept, lambda p: p["line"])
    staged = staged.withColumn("clean", F.array_join(lines, "\n")).drop("_keyed", "_repeated")
    return tidy_markdown(staged, "clean")


def source_documents(files: DataFrame) -> DataFrame:
    """Stored files (path, text) to normalised source documents.

    Files without body and documents of foreign categories are dropped; a blank
    country falls back to the region, as retrieval expects.
    """
    stem = M.file_stem(F.col("path"))
    parsed = files.filter(~F.lower(stem).isin("readme", "manifest")).select(
        "path", M.json_header("text").alias("h"), stem.alias("stem")
    )
    m = F.col("h.metadata")

    def get(*names: str) -> Column:
        return F.coalesce(*[m[n] for n in names])

    def filled(*names: str) -> Column:
        return F.coalesce(*[F.nullif(m[n], F.lit("")) for n in names])

    category = F.lower(F.coalesce(filled("source_category", "document_type", "source_type"), F.lit("")))
    docs = parsed.filter(~T.is_blank(F.col("h.body"))).withColumn("category", category)
    docs = docs.filter(S.relevant_category("category"))
    return docs.select(
        F.coalesce(get("doc_id", "source_id"), F.col("stem")).alias("doc_id"),
        F.coalesce(get("source_title", "title"), F.col("stem")).alias("source_title"),
        F.lower(F.coalesce(get("source_type", "document_type"), F.lit("policy"))).alias("source_type"),
        F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("platform_policy")).alias("source_category"),
        F.coalesce(m["source_url"], F.lit("")).alias("source_url"),
        F.lower(F.coalesce(filled("platform"), F.lit("all"))).alias("platform"),
        F.upper(F.coalesce(filled("country_code", "region"), F.lit("GLOBAL"))).alias("country_code"),
        F.upper(F.coalesce(filled("region_pack"), F.lit("GLOBAL"))).alias("region_pack"),
        F.lower(F.coalesce(m["language"], F.lit(""))).alias("language"),
        F.lower(F.coalesce(filled("distribution_mode"), F.lit("all"))).alias("distribution_mode"),
        F.lower(F.coalesce(filled("brand_id"), F.lit("all"))).alias("brand_id"),
        F.upper(F.coalesce(m["priority"], F.lit("P2"))).alias("priority"),
        F.coalesce(T.is_true_text(m["is_global_fallback"]), F.lit(False)).alias("is_global_fallback"),
        T.strip(F.col("h.body")).alias("body"),
        "path",
    )


def knowledge_documents(files: DataFrame) -> DataFrame:
    """Stored md, markdown and txt files (path, text) with the token set of the lexical-only path."""
    stem = M.file_stem(F.col("path"))
    parsed = files.filter(F.lower(stem) != "readme").select("path", M.any_header("text").alias("h"), stem.alias("stem"))
    m = F.col("h.metadata")

    def get(default: Column, *names: str) -> Column:
        return F.coalesce(*[m[n] for n in names], default)

    blank = F.lit("")
    title = F.initcap(F.replace(F.col("stem"), F.lit("_"), F.lit(" ")))
    return parsed.filter(F.col("h.body") != "").select(
        get(F.col("stem"), "doc_id", "source_id").alias("doc_id"),
        get(title, "source_title", "title").alias("source_title"),
        get(F.lit("policy"), "source_type", "document_type").alias("source_type"),
        get(blank, "source_url").alias("source_url"),
        F.lower(get(blank, "platform")).alias("platform"),
        F.lower(get(blank, "distribution_mode")).alias("distribution_mode"),
        F.upper(get(blank, "country_code", "region")).alias("country_code"),
        F.upper(get(blank, "region_pack")).alias("region_pack"),
        F.lower(get(blank, "language")).alias("language"),
        F.lower(get(blank, "brand_id")).alias("brand_id"),
        get(blank, "effective_from").alias("effective_from"),
        get(blank, "effective_to").alias("effective_to"),
        get(blank, "page_num").alias("page_num"),
        get(blank, "heading_path").alias("heading_path"),
        get(F.col("stem"), "block_id").alias("block_id"),
        T.is_true_text(get(F.lit("false"), "is_global_fallback")).alias("is_global_fallback"),
        F.col("h.body").alias("body"),
        "path",
        T.token_set("h.body").alias("tokens"),
    )


def normalise_raw(raw: DataFrame, catalog: DataFrame, processed_at: Column) -> tuple[DataFrame, DataFrame]:
    """Raw documents (path, markdown, extra map) with their catalog entry: (documents, errors).

    A raw file without catalog entry is an error row; it never stops the batch.
    """
    keyed = raw.withColumn("source_id", M.file_stem(F.col("path")))
    names = ["title", "category", "region", "market", "platform", "language", "url", "priority", "notes"]
    entries = catalog.select(F.col("id").alias("source_id"), *[F.col(n).alias(f"c_{n}") for n in names])
    joined = keyed.join(entries.withColumn("_found", F.lit(True)), "source_id", "left")
    errors = joined.filter(F.col("_found").isNull()).select(
        "path", "source_id", F.concat(F.lit(fixed.NO_CATALOG_ENTRY), F.col("source_id")).alias("error")
    )
    e = {n: F.col(f"c_{n}") for n in names} | {"id": F.col("source_id")}
    found = joined.filter(F.col("_found"))
    docs = found.withColumn("metadata", M.raw_metadata(e, F.col("path"), F.col("source_id"), processed_at))
    titled = M.add_title(F.col("markdown"), F.col("metadata.title"))
    docs = tidy_markdown(docs.withColumn("body", M.cut_contents(F.col("source_id"), titled)), "body")
    return docs.select("source_id", "path", "metadata", "extra", "body"), errors


def manifest(docs: DataFrame) -> DataFrame:
    """One manifest row per normalised document."""
    m = "metadata."
    return docs.select(
        "source_id",
        F.concat(F.lit("processed/"), F.col("source_id"), F.lit(".md")).alias("markdown_path"),
        F.concat(F.lit("processed/"), F.col("source_id"), F.lit(".json")).alias("metadata_path"),
        F.col(m + "title").alias("title"),
        F.col(m + "platform").alias("platform"),
        F.col(m + "region").alias("region"),
        F.col(m + "document_type").alias("document_type"),
        M.file_suffix(F.col("path")).alias("raw_suffix"),
    )
