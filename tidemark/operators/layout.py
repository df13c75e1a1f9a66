"""Page layout rows to reading order, headings and document lines.

``elements``: doc, page, element_no, kind (text or table), x0, y0, x1, y1, text,
font_size. Windows are partitioned by page or document part, never by more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text as T
from tidemark.operators import corpus as C

PAGE = ["doc", "page"]
GAP = 72.0


def outside_tables(elements: DataFrame) -> DataFrame:
    """Tables, and text blocks that overlap no table of their page by more than 10 on both axes."""
    texts, tables = elements.filter("kind = 'text'"), elements.filter("kind = 'table'")
    t = tables.select(*PAGE, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    same_page = [texts[c] == t[c] for c in PAGE]
    wide = F.least(texts.x1, t.t_x1) - F.greatest(texts.x0, t.t_x0) > 10
    high = F.least(texts.y1, t.t_y1) - F.greatest(texts.y0, t.t_y0) > 10
    clear = texts.join(t, [*same_page, wide, high], "left_anti")
    return clear.unionByName(tables)


def real_tables(cells: DataFrame) -> DataFrame:
    """Tables worth keeping, from their cells (table_id, row_no, col_no, text)."""
    clean = cells.withColumn("clean", T.clean_line(F.coalesce("text", F.lit(""))))
    filled = F.col("clean") != ""
    rows = clean.groupBy("table_id", "row_no").agg(
        F.count("*").alias("width"),
        F.count(F.when(filled, 1)).alias("filled"),
        F.max(F.when(filled, F.length("clean"))).alias("longest"),
    )
    tables = rows.groupBy("table_id").agg(
        F.count("*").alias("rows"),
        F.max("width").alias("width"),
        F.sum("filled").alias("filled"),
        F.max("longest").alias("longest"),
        F.max(F.when(F.col("row_no") <= 1, F.col("filled"))).alias("header"),
    )
    # distinct cells in two steps, so that a large table is counted by many tasks
    unique = (
        clean.filter(filled).select("table_id", F.lower("clean").alias("cell")).distinct().groupBy("table_id").agg(F.count("*").alias("unique_cells"))
    )
    per_row = F.col("filled") / F.col("rows")
    dense = (F.col("width") < 6) | (F.col("filled") / (F.col("rows") * F.col("width")) >= 0.5)
    return (
        tables.join(unique, "table_id")
        .filter((F.col("rows") >= 2) & (F.col("width") >= 2) & (F.col("filled") >= 4) & (F.col("unique_cells") >= 4))
        .filter((F.col("longest") <= 500) & (F.col("header") >= 2) & (per_row >= 1.8) & dense)
        .select("table_id", "rows", "width")
    )


def table_markdown(cells: DataFrame) -> DataFrame:
    """Markdown text per table (table_id, row_no, col_no, text); short rows are padded."""
    clean = cells.withColumn("clean", T.clean_line(F.coalesce("text", F.lit(""))))
    rows = clean.groupBy("table_id", "row_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_no", "clean"))), lambda x: x["clean"]).alias("cells")
    )
    tables = rows.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("rows"), F.max(F.size("cells")).alias("width")
    )

    def line(values: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))

    padded = F.transform(
        "rows",
        lambda r: line(F.concat(r["cells"], F.array_repeat(F.lit(""), F.col("width").cast("int") - F.size(r["cells"])))),
    )
    rule = line(F.array_repeat(F.lit("---"), F.col("width").cast("int")))
    body = F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, F.lit(2), F.greatest(F.size(padded), F.lit(1))))
    return tables.select("table_id", F.array_join(body, "\n").alias("markdown"))


def columns_of(elements: DataFrame, gap: float = GAP) -> DataFrame:
    """Adds ``cluster``: x positions of a page that lie within ``gap`` of each other."""
    w = Window.partitionBy(*PAGE).orderBy("x0", "element_no")
    jump = (F.col("x0") - F.lag("x0").over(w) > gap).cast("int")
    stepped = elements.withColumn("_jump", F.coalesce(jump, F.lit(0)))
    return stepped.withColumn("cluster", F.sum("_jump").over(w)).drop("_jump")


def reading_order(elements: DataFrame, gap: float = GAP) -> DataFrame:
    """Adds ``reading_no``: the position of an element on its page.

    Pages with one column read by y, then x; others column by column, where an element
    belongs to the column with the nearest centre.
    """
    clustered = columns_of(elements, gap)
    centres = clustered.groupBy(*PAGE, "cluster").agg(F.avg("x0").alias("centre"))
    per_page = centres.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("centres"))
    joined = clustered.join(per_page, PAGE)
    nearest = F.array_min(
        F.transform("centres", lambda c: F.struct(F.abs(F.col("x0") - c["centre"]).alias("d"), c["cluster"].alias("i")))
    )["i"]
    one = F.size("centres") <= 1
    # by the exact binary value, as a tie in the shortest decimal form need not be one
    y, x = (T.rounded(F.col(c), 1) for c in ("y0", "x0"))
    # text blocks come before tables where the places are equal
    turn = [(F.col("kind") == "table").cast("int"), F.col("element_no")]
    w = Window.partitionBy(*PAGE).orderBy(
        F.when(one, F.lit(0)).otherwise(nearest), y, F.when(one, x).otherwise(F.lit(0.0)), *turn
    )
    placed = joined.withColumn("_column", F.when(one, F.lit(0)).otherwise(nearest))
    return placed.withColumn("reading_no", F.row_number().over(w)).withColumnRenamed("_column", "column_no").drop(
        "centres", "cluster"
    )


def body_fonts(elements: DataFrame) -> DataFrame:
    """Most frequent rounded text size of 6 or more per document, 11 where there is none."""
    texts = elements.filter("kind = 'text'").withColumn("size", F.bround("font_size", 0))
    counts = texts.filter("size >= 6").groupBy("doc", "size").agg(
        F.count("*").alias("n"), F.min(F.struct("page", "element_no")).alias("first")
    )
    best = counts.groupBy("doc").agg(F.min_by("size", F.struct(-F.col("n"), "first")).alias("body_font"))
    return elements.select("doc").distinct().join(best, "doc", "left").select(
        "doc", F.coalesce("body_font", F.lit(11.0)).alias("body_font")
    )


def table_pages(elements: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """Pages per document, and pages with a table.

    ``page_counts`` (doc, page_count) knows pages without elements; without it only pages with elements count.
    """
    found = elements.groupBy("doc").agg(
        F.countDistinct("page").alias("pages"),
        F.countDistinct(F.when(F.col("kind") == "table", F.col("page"))).alias("table_pages"),
    )
    if page_counts is None:
        return found
    known = found.join(page_counts.select("doc", "page_count"), "doc", "left")
    return known.withColumn("pages", F.coalesce(F.col("page_count").cast("long"), F.col("pages"))).drop("page_count")


def heading_level(text: Column, size: Column, body: Column) -> Column:
    """Heading level from size, length and question mark, null for body text."""
    return plain_level(T.clean_line(text), size, body)


def plain_level(plain: Column, size: Column, body: Column) -> Column:
    """As :func:`heading_level`, from the clean text."""
    words = F.size(F.split(plain, " "))
    level = (
        F.when((size >= body + 11) | ((F.length(plain) <= 36) & (size >= body + 6)), 1)
        .when(size >= body + 5, 2)
        .when((size >= body + 3) & (words <= 12), 3)
        .when(plain.endswith("?") & (words <= 12), 2)
    )
    return F.when((plain != "") & ~plain.startswith("#") & (words <= 20), level)


def merged_paragraph(lines: Column) -> Column:
    """Lines of a text block joined; a list mark starts a new line, a hyphen at the end is closed up."""
    clean = F.filter(F.transform(lines, T.clean_line), lambda s: s != "")

    def fresh(x: Column) -> Column:
        return x.isNull() | T.matches(x, fixed.LIST_MARK_PATTERN)

    def part(x: Column) -> Column:
        before, now, after = x["before"], x["now"], x["after"]
        glue = F.when(before.isNull(), F.lit("")).when(fresh(now), F.lit("\n")).when(before.rlike(r"[/(\[\-]$"), F.lit(""))
        closed = F.when(fresh(after), now).otherwise(F.regexp_replace(now, "-+$", ""))
        return F.concat(glue.otherwise(F.lit(" ")), closed)

    # each line next to its neighbours; the pair behind the last line joins to nothing
    none = F.array(F.lit(None).cast("string"))
    rest = F.slice(clean, F.lit(2), F.greatest(F.size(clean), F.lit(1)))
    near = F.arrays_zip(F.concat(none, clean).alias("before"), clean.alias("now"), rest.alias("after"))
    return F.array_join(F.transform(near, part), "")


def document_lines(elements: DataFrame) -> DataFrame:
    """Lines of each document in reading order: headings marked, page numbers dropped.

    The line number orders pages, then elements; an empty line follows every element.
    """
    ordered = reading_order(outside_tables(elements))
    sized = ordered.join(body_fonts(outside_tables(elements)), "doc")
    is_text = F.col("kind") == "text"
    # columns of their own, as both are named many times below
    staged = sized.withColumn("_plain", T.clean_line("text"))
    level = plain_level(F.col("_plain"), F.coalesce("font_size", F.col("body_font")), F.col("body_font"))
    staged = staged.withColumn("level", level)
    kept = staged.filter(~(is_text & T.matches("_plain", fixed.PAGE_NUMBER_PATTERN)))
    marked = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("_plain"))
    line = F.when(is_text & F.col("level").isNotNull(), marked).otherwise(F.col("text"))
    return kept.select("doc", "page", "reading_no", "kind", "level", line.alias("line"))


def document_bodies(elements: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """Cleaned markdown body per document; see :func:`table_pages` for ``page_counts``."""
    lines = document_lines(elements)
    pages = table_pages(elements, page_counts)
    row = F.struct("page", "reading_no", "line")
    packed = lines.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("_rows")).join(pages, "doc")
    text = F.flatten(F.transform("_rows", lambda r: F.array(r["line"], F.lit(""))))
    # the key of a line is made once, for the count of repeats and for the lines that go
    staged = packed.withColumn("_keyed", C.keyed_lines(text))
    staged = staged.withColumn("_repeated", C.repeated_of(F.transform("_keyed", lambda p: p["key"]), F.col("pages")))
    kept = F.transform(C.drop_repeated_keyed(F.col("_keyed"), F.col("_repeated")), lambda p: p["line"])
    kept = F.filter(kept, lambda s: ~F.lower(T.strip(s)).isin(*fixed.WATERMARKS))
    kept = F.transform(kept, lambda s: F.when(T.is_blank(s), F.lit("")).otherwise(T.rstrip(s)))
    staged = staged.withColumn("_kept", kept)
    staged = staged.withColumn("markdown", F.array_join(C.collapse_blanks(F.col("_kept")), "\n"))
    return C.tidy_markdown(staged, "markdown").select("doc", "pages", "table_pages", "markdown")
