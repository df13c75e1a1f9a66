"""Page HTML to nodes, and the main content of pages by array functions over them.

A small tag scan turns each page into an array of nodes in document order; ``last_no`` is
the last number inside an element, so "inside" is an interval test, and each node carries
the running sums of what a subtree is measured by. A page stays one row: no node is shuffled.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text as T
from tidemark.operators.keyed import rows_of
from tidemark.operators.pieces import in_pieces

NODE_TYPE = (
    "array<struct<node_no int, last_no int, parent_no int, block_no int, cell_no int, table_no int, tag string, attrs string, role string, "
    "testid string, classes string, aria_hidden boolean, link_depth int, filled boolean, text_len int, "
    "link_len int, parent_last int, parent_len int, text string, sums array<int>>>"
)

# void elements, elements closed by a following sibling of the same kind, and block elements
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSED_BY_PEER = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section",
    "table", "td", "th", "tr", "ul",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_DROPPED = set(fixed.DROPPED_TAGS)


class _Scan(HTMLParser):
    """Elements and text pieces of one page in document order; dropped tags leave no rows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.dropped: list[str] = []
        self.text_total = self.link_total = 0

    def _push(self, tag: str, attrs: dict, text: str | None) -> dict:
        parent = self.open[-1] if self.open else None
        row = {
            "node_no": len(self.rows),
            "last_no": len(self.rows),
            "parent_no": parent["node_no"] if parent else -1,
            "block_no": parent["block_no"] if parent else 0,
            "cell_no": parent["cell_no"] if parent else -1,
            "table_no": parent["table_no"] if parent else -1,
            "tag": tag,
            "attrs": " ".join(
                " ".join(attrs[k].split()) for k in ("id", "class", "role", "aria-label", "data-testid") if attrs.get(k)
            ).lower(),
            "role": attrs.get("role") or "",
            "testid": attrs.get("data-testid") or "",
            "classes": " ".join((attrs.get("class") or "").split()),
            "aria_hidden": attrs.get("aria-hidden") == "true",
            "link_depth": parent["link_depth"] + (parent["tag"] == "a") if parent else 0,
            "filled": False,
            "text_len": self.text_total,
            "link_len": self.link_total,
            "parent_last": 0,
            "parent_len": 0,
            "text": text,
        }
        # a table row is one block, whatever its cells hold
        if tag == "table":
            row["table_no"], row["cell_no"] = row["node_no"], -1
        if tag in ("td", "th"):
            row["cell_no"] = row["node_no"]
        elif tag in _BLOCKS and row["cell_no"] < 0:
            row["block_no"] = row["node_no"]
        self.rows.append(row)
        return row

    def _pop_to(self, index: int) -> None:
        for row in reversed(self.open[index:]):
            row["last_no"] = len(self.rows) - 1
            row["text_len"] = max(self.text_total - row["text_len"] - 1, 0)
            row["link_len"] = self.link_total - row["link_len"]
            row["filled"] = row["text_len"] > 0
            if row["tag"] == "a":
                self.link_total += row["text_len"]
        del self.open[index:]

    def _find(self, tags: set[str], stop: set[str]) -> int | None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] in tags:
                return i
            if self.open[i]["tag"] in stop:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            if tag == self.dropped[0]:
                self.dropped.append(tag)
            return
        if tag in _DROPPED:
            if tag not in _VOID:
                self.dropped.append(tag)
            return
        if tag in _CLOSED_BY_PEER:
            peer = self._find({tag} | ({"td", "th"} & {tag, "td"} if tag in ("td", "th") else set()), _CLOSED_BY_PEER[tag])
        else:
            peer = self._find({"p"}, _BLOCKS - {"p"}) if tag in _BLOCKS else None
        if peer is not None:
            self._pop_to(peer)
        self.open.append(self._push(tag, {k: v or "" for k, v in attrs}, None))
        if tag in _VOID:
            self._pop_to(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        before = len(self.rows)
        self.handle_starttag(tag, attrs)
        if len(self.rows) > before and tag not in _VOID:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropped[0]:
                self.dropped.pop()
            return
        at = self._find({tag}, set())
        if at:
            self._pop_to(at)

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not self.dropped:
            row = self._push("#text", {}, text)
            row["text_len"], row["link_len"] = len(text), 0
            self.text_total += len(text) + 1


def scan_nodes(html: str) -> list[dict]:
    """Rows of one page; row 0 stands for the whole document, so every page has a row."""
    scan = _Scan()
    scan.open.append(scan._push("#document", {}, None))
    scan.feed(html)
    scan.close()
    scan._pop_to(0)
    sums = [0] * 7
    for row in scan.rows:
        parent, tag = scan.rows[max(row["parent_no"], 0)], row["tag"]
        if row["node_no"]:
            row["parent_last"], row["parent_len"] = parent["last_no"], parent["text_len"]
        piece = len(row["text"]) + 1 if tag == "#text" else 0
        own = (piece, piece * row["link_depth"], tag == "a" and row["filled"], tag in _HEADINGS, tag == "p", tag == "li", tag == "table")
        sums = row["sums"] = [a + b for a, b in zip(sums, own, strict=True)]
    return scan.rows


def page_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their nodes as one array in document order; the other page columns are kept."""
    rest = [c for c in pages.columns if c != html]

    def nodes(texts: pd.Series) -> pd.Series:
        return pd.Series([scan_nodes(t or "") for t in texts])

    return pages.select(*rest, in_pieces(nodes, NODE_TYPE)(F.col(html)).alias("nodes"))


def html_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per element and text piece; the other page columns are kept."""
    scanned = page_nodes(pages, html)
    return scanned.select(*[c for c in scanned.columns if c != "nodes"], F.inline("nodes"))


def _keyword(attrs: Column) -> Column:
    return T.first_word_of(attrs, fixed.NOISE_ATTR_KEYWORDS)


def _is_text(n: Column) -> Column:
    return n["tag"] == "#text"


def _is_heading(tag: Column) -> Column:
    return tag.rlike("^h[1-6]$")


def link_density(n: Column) -> Column:
    """Share of link text in the text of an element; an element without text counts as all links."""
    return F.when(n["text_len"] == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), n["link_len"] / F.greatest(F.lit(1), n["text_len"])))


def is_noise(n: Column) -> Column:
    """First pass: boilerplate by attribute words, short or link-heavy, and hidden elements."""
    worded = (n["attrs"] != "") & _keyword(n["attrs"])
    weak = n["tag"].isin(*fixed.BOILERPLATE_TAGS) | (n["text_len"] < 1600) | (link_density(n) > 0.45)
    return ~_is_text(n) & ((worded & weak) | n["aria_hidden"])


def is_section_noise(n: Column) -> Column:
    """Second pass, inside the content root."""
    worded = (n["attrs"] != "") & _keyword(n["attrs"])
    weak = (link_density(n) > 0.35) | (n["text_len"] < 1200)
    return ~_is_text(n) & (n["tag"].isin(*fixed.BOILERPLATE_TAGS) | (worded & weak))


def content_score(n: Column) -> Column:
    score = (
        n["text_len"]
        + n["n_heading"] * 550
        + n["n_p"] * 100
        + n["n_li"] * 40
        + n["n_table"] * 260
        - link_density(n) * 2200
        + F.when(n["tag"].isin("article", "main"), 1500).otherwise(0)
        + F.when(T.first_word_of(n["attrs"], fixed.CONTENT_ATTR_KEYWORDS), 800).otherwise(0)
        - F.when(_keyword(n["attrs"]), 2400).otherwise(0)
    )
    return F.when(n["text_len"] < 300, F.lit(-1.0)).otherwise(score.cast("double"))


def outermost(df: DataFrame, noisy: Column, name: str) -> DataFrame:
    """Adds ``name``: the intervals (node_no, last_no) of the marked elements that lie in no other, in order.

    Intervals nest, so one that opens before the end of an earlier one lies inside it. The furthest end so far is a
    running maximum over the marked elements only.
    """
    marked = F.transform(noisy, lambda n: F.struct(n["node_no"].alias("first"), n["last_no"].alias("last")))
    none = F.array().cast("array<struct<first:int,last:int>>")

    def add(state: Column, x: Column) -> Column:
        return F.when(x["first"] > F.coalesce(F.try_element_at(state, F.lit(-1))["last"], F.lit(-1)), F.concat(state, F.array(x))).otherwise(state)

    return df.withColumn(name, F.aggregate(marked, none, add))


def once(name: str) -> Column:
    """An array column for use inside a lambda.

    An expression that is named once may be moved into the lambda and worked out per element; one that is named
    twice stays a column of its own.
    """
    return F.when(F.size(name) >= 0, F.col(name))


#: Counts that a subtree is measured by: text, link text, links, headings, paragraphs, list items, tables.
SUMS = 7


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def without_noise(pages: DataFrame) -> DataFrame:
    """Takes the noise of the first pass out of ``nodes`` and measures what is left of every element.

    Each node knows the sums of all nodes up to itself. The stretches between noise elements are slices of the array;
    in a slice the sums lose what the noise before it held, and inside noise they stand still. The totals of a
    subtree are then the difference of the sums at its end and at its start, without a look at the nodes between.
    """
    cut = outermost(pages, F.filter("nodes", is_noise), "_noise")
    held = F.transform("_noise", lambda x: _minus(F.get("nodes", x["last"])["sums"], F.get("nodes", x["first"] - 1)["sums"]))
    cut = cut.withColumn("_held", held)
    zero = F.array(*[F.lit(0)] * SUMS)
    more = F.array_append("_noise", F.struct(F.size("nodes").alias("first"), F.size("nodes").alias("last")))
    cut = cut.withColumn("_ends", more)

    def stretch(x: Column, i: Column) -> Column:
        start = F.when(i > 0, F.get("_ends", i - 1)["last"] + 1).otherwise(F.lit(0))
        gone = F.aggregate(F.slice(once("_held"), F.lit(1), i), zero, lambda s, h: F.zip_with(s, h, lambda a, b: a + b))
        return F.struct(start.alias("start"), (x["first"] - start).alias("size"), (F.least(x["last"] + 1, F.size("nodes")) - x["first"]).alias("noise"), gone.alias("gone"))

    cut = cut.withColumn("_stretches", F.transform("_ends", stretch))

    def sums(s: Column) -> Column:
        own = F.transform(F.slice("nodes", s["start"] + 1, s["size"]), lambda n: _minus(n["sums"], s["gone"]))
        still = F.array_repeat(_minus(F.get("nodes", F.greatest(s["start"] + s["size"] - 1, F.lit(0)))["sums"], s["gone"]), s["noise"])
        return F.concat(own, still)

    cut = cut.withColumn("_sums", F.flatten(F.transform("_stretches", sums)))
    kept = F.flatten(F.transform("_stretches", lambda s: F.slice("nodes", s["start"] + 1, s["size"])))
    cut = cut.withColumn("_kept", kept)
    within = F.transform("_kept", lambda n: F.struct(n.alias("n"), _minus(F.get("_sums", n["last_no"]), F.get("_sums", n["node_no"])).alias("d")))
    cut = cut.withColumn("_within", within)
    fields = ["node_no", "last_no", "parent_no", "block_no", "cell_no", "table_no", "tag", "attrs", "role", "testid", "classes", "parent_last", "parent_len", "text"]

    def measured(x: Column) -> Column:
        n, d = x["n"], x["d"]
        # text below k open links was counted k times; links above the element or the element itself do not count
        below = d[1] - d[0] * (n["link_depth"] + (n["tag"] == "a").cast("int"))
        own = F.when(_is_text(n), F.length(n["text"])).otherwise(F.greatest(d[0] - 1, F.lit(0)))
        return F.struct(
            *[n[f].alias(f) for f in fields],
            own.alias("text_len"),
            F.greatest(below - d[2], F.lit(0)).alias("link_len"),
            *[d[i].alias(f"n_{k}") for i, k in enumerate(("heading", "p", "li", "table"), 3)],
        )

    spent = ["_noise", "_held", "_ends", "_stretches", "_sums", "_kept", "_within"]
    done = cut.withColumn("nodes", F.transform("_within", measured)).drop(*spent)
    scored = F.transform("nodes", lambda n: n.withField("score", F.when(~_is_text(n), content_score(n))))
    return done.withColumn("nodes", scored)


def with_root(pages: DataFrame) -> DataFrame:
    """Adds ``root``, the element that holds the main content of the page.

    Known readme containers with enough text come first, by selector; otherwise the
    highest score wins, and the earlier candidate on a tie; a page without a candidate
    falls back to its body, or to the document.
    """

    def has_class(n: Column, name: str) -> Column:
        return F.array_contains(F.split(n["classes"], " "), name)

    def is_readme(n: Column) -> Column:
        return (n["testid"] == "readme") & (n["tag"] == "div")

    rows = pages.withColumn("_readmes", F.filter("nodes", is_readme))

    def in_readme(n: Column) -> Column:
        return F.exists(once("_readmes"), lambda r: (r["node_no"] < n["node_no"]) & (n["node_no"] <= r["last_no"]))

    selectors = [
        lambda n: (n["tag"] == "article") & has_class(n, "markdown-body"),
        lambda n: (n["tag"] == "article") & in_readme(n),
        is_readme,
        lambda n: (n["tag"] == "div") & has_class(n, "markdown-body"),
        lambda n: (n["tag"] == "article") & (n["testid"] == "readme"),
    ]

    def root(n: Column) -> Column:
        return F.struct(*[n[f].alias(f) for f in ("node_no", "last_no", "tag", "score")])

    rows = rows.withColumns({f"_s{i}": F.get(F.filter("nodes", s), F.lit(0)) for i, s in enumerate(selectors)})
    # only the first element of a selector is looked at
    chosen = [F.when(F.col(f"_s{i}.text_len") > 400, root(F.col(f"_s{i}"))) for i in range(len(selectors))]

    def order(n: Column) -> Column:
        tag = n["tag"]
        return F.when(tag == "article", 1).when(tag == "main", 2).when(n["role"] == "main", 3).when(tag.isin("section", "div", "body"), 4)

    able = F.filter("nodes", lambda n: order(n).isNotNull() & (n["score"] > -1.0))
    best = F.array_min(F.transform(able, lambda n: F.struct((-n["score"]).alias("down"), order(n).alias("turn"), n["node_no"].alias("no"), root(n).alias("root"))))["root"]

    def first_of(tag: str) -> Column:
        return F.get(F.filter("nodes", lambda n: n["tag"] == tag), F.lit(0))

    rows = rows.withColumns({"_best": best, "_body": first_of("body"), "_document": first_of("#document")})
    rest = [F.when(F.col(c).isNotNull(), root(F.col(c))) for c in ("_body", "_document")]
    found = rows.withColumn("root", F.coalesce(*chosen, F.col("_best"), *rest))
    return found.drop("_readmes", "_best", "_body", "_document", *[f"_s{i}" for i in range(len(selectors))])


def content_nodes(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html) as page_id, ``nodes`` after the first noise pass, with scores, and ``root``.

    A page stays one row: it is scanned once, and everything after the scan is array work inside the row.
    """
    return with_root(without_noise(page_nodes(pages.select("page_id", "html"))))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.filter(F.transform(pieces, lambda x: x["text"]), lambda t: t != ""), " ")


def row_cells(pieces: Column) -> Column:
    """Texts of the cells of a table row, in order."""
    cells = F.array_distinct(F.transform(pieces, lambda x: x["cell_no"]))
    return F.transform(cells, lambda c: F.replace(_joined(F.filter(pieces, lambda x: x["cell_no"] == c)), F.lit("|"), F.lit("\\|")))


def content_blocks(pages: DataFrame) -> DataFrame:
    """Adds ``_blocks``, the blocks of the content: the block element and, in order, the pieces that belong to it.

    Nodes sorted by (block, place) put a block's element and pieces next to each other; where the block changes, a
    slice begins. A table cell is an empty piece of its row.
    """

    def in_root(n: Column) -> Column:
        return (n["node_no"] > F.col("root.node_no")) & (n["node_no"] <= F.col("root.last_no"))

    rows = outermost(pages, F.filter("nodes", lambda n: in_root(n) & is_section_noise(n)), "_gone")
    clear = F.filter("nodes", lambda n: ~F.exists(once("_gone"), lambda g: n["node_no"].between(g["first"], g["last"])))
    # text outside the root has no line; the block elements themselves stay
    wanted = F.filter(clear, lambda n: in_root(n) & (_is_text(n) | n["tag"].isin("td", "th")) | (n["node_no"] == n["block_no"]))
    rows = rows.withColumn("_wanted", F.array_sort(F.transform(wanted, lambda n: F.struct(n["block_no"].alias("block"), n["node_no"].alias("no"), n.alias("n")))))
    changes = F.filter(F.sequence(F.lit(0), F.size("_wanted") - 1), lambda i: (i == 0) | (F.get("_wanted", i)["block"] != F.get("_wanted", F.greatest(i - 1, F.lit(0)))["block"]))
    rows = rows.withColumn("_starts", F.when(F.size("_wanted") > 0, changes).otherwise(F.array().cast("array<int>")))

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_wanted"))
        own = F.transform(F.slice("_wanted", start + 1, end - start), lambda x: x["n"])
        element = F.get("_wanted", start)
        return F.struct(F.when(element["no"] == element["block"], element["n"]).alias("b"), own.alias("own"))

    rows = rows.withColumn("_raw", F.transform("_starts", block))

    def shaped(x: Column) -> Column:
        pieces = F.filter(x["own"], lambda n: in_root(n) & (_is_text(n) | n["tag"].isin("td", "th")))
        slim = F.transform(pieces, lambda n: F.struct(n["cell_no"].alias("cell_no"), F.when(_is_text(n), n["text"]).otherwise(F.lit("")).alias("text")))
        line = F.coalesce(F.get(F.filter(x["own"], lambda n: in_root(n) & _is_text(n)), F.lit(0))["node_no"], F.lit(0))
        return F.struct(x["b"].alias("b"), line.alias("line_no"), slim.alias("pieces"), _joined(slim).alias("text"))

    blocks = F.filter(F.transform("_raw", shaped), lambda x: (x["line_no"] > 0) | x["b"].isNotNull())
    return rows.withColumn("_blocks", blocks).drop("_gone", "_wanted", "_starts", "_raw", "nodes")


def page_markdown(pages: DataFrame) -> DataFrame:
    """Main content of each page as a markdown body; a page without content has an empty one.

    Headings and list items are marked, table rows get bars. Headings with a boilerplate title go, together with a
    short parent below the root.
    """
    rows = content_blocks(content_nodes(pages))

    def is_head(x: Column) -> Column:
        return F.coalesce(_is_heading(x["b"]["tag"]), F.lit(False))

    bad = F.filter("_blocks", lambda x: (x["line_no"] > 0) & is_head(x) & F.lower(x["text"]).isin(*fixed.NOISE_HEADINGS))
    rows = rows.withColumn("_bad", bad)

    def span(x: Column) -> Column:
        b = x["b"]
        # the parent's length after the first noise pass, where it is a block around headings
        around = F.filter("_blocks", lambda y: (y["b"]["node_no"] == b["parent_no"]) & ~is_head(y) & (y["b"]["n_heading"] > 0))
        length = F.coalesce(F.get(around, F.lit(0))["b"]["text_len"], b["parent_len"])
        up = (b["parent_no"] != F.col("root.node_no")) & (length < 1800)
        return F.struct(
            F.when(up, b["parent_no"]).otherwise(b["node_no"]).alias("first"), F.when(up, b["parent_last"]).otherwise(b["last_no"]).alias("last")
        )

    def is_row(x: Column) -> Column:
        return F.coalesce(x["b"]["tag"] == "tr", F.lit(False))

    lined = F.filter("_blocks", lambda x: x["line_no"] > 0)
    rows = rows.withColumns({"_cut": F.transform("_bad", span), "_lined": lined})
    of_tables = F.array_sort(
        F.transform(F.filter("_lined", is_row), lambda x: F.struct(x["b"]["table_no"].alias("table_no"), x["line_no"].alias("line_no")))
    )
    rows = rows.withColumn("_rows", of_tables)
    heads = F.filter("_rows", lambda r, i: (i == 0) | (F.get("_rows", F.greatest(i - 1, F.lit(0)))["table_no"] != r["table_no"]))
    rows = rows.withColumn("_heads", F.transform(heads, lambda r: r["line_no"]))

    def line(x: Column) -> Column:
        tag = x["b"]["tag"]
        mark = F.when(is_head(x), F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" ")))
        mark = F.coalesce(mark.when(tag == "li", F.lit("- ")), F.lit(""))
        cells = row_cells(x["pieces"])
        rule = F.concat(F.lit("\n| "), F.array_join(F.transform(cells, lambda _: F.lit("---")), " | "), F.lit(" |"))
        first = F.array_contains(once("_heads"), x["line_no"])
        bars = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"), F.when(first, rule).otherwise(F.lit("")))
        follows = F.when(is_row(x), F.concat(F.lit("table "), x["b"]["table_no"])).when(tag == "li", F.lit("list"))
        return F.struct(
            x["line_no"].alias("line_no"),
            F.coalesce(follows, F.lit("")).alias("follows"),
            F.when(is_row(x), bars).otherwise(F.concat(mark, x["text"])).alias("line"),
        )

    kept = F.filter("_lined", lambda x: ~F.exists(once("_cut"), lambda c: x["line_no"].between(c["first"], c["last"])))
    rows = rows.withColumn("_lines", F.array_sort(F.transform(kept, line)))
    # list items and rows of a table follow each other, other blocks are set apart by an empty line
    spaced = F.transform(
        T.with_previous(F.col("_lines")),
        lambda p: F.concat(
            F.when(p["before"].isNull(), F.lit(""))
            .when((p["now"]["follows"] != "") & (p["before"]["follows"] == p["now"]["follows"]), F.lit("\n"))
            .otherwise(F.lit("\n\n")),
            p["now"]["line"],
        ),
    )
    return rows.select(
        "page_id",
        F.col("root.tag").alias("root_tag"),
        F.coalesce(F.col("root.score"), F.lit(-1.0)).alias("root_score"),
        F.array_join(spaced, "").alias("markdown"),
    )


def link_densities(pages: DataFrame) -> DataFrame:
    """Text length, link density and score of the content candidates of each page."""
    rows = content_nodes(pages)
    shown = F.filter("nodes", lambda n: n["tag"].isin("article", "main", "section", "div", "body") | (n["role"] == "main"))
    shape = F.transform(
        shown,
        lambda n: F.struct(
            n["node_no"].alias("node_no"), n["tag"].alias("tag"), n["text_len"].alias("text_len"),
            F.round(link_density(n), 4).alias("link_density"), F.round(n["score"], 3).alias("score"),
        ),
    )
    return rows_of(rows, ["page_id"], shape, "_at", "n").select("page_id", "n.*")


HEAD_TYPE = "struct<html_title string, meta_description string, canonical_url string>"


class _Heads(HTMLParser):
    """First title, description and canonical link of a page; entities are read, comments are not."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, str] = {}
        self.title: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "title" and "html_title" not in self.found and self.title is None:
            self.title = []
            return
        named = {k: v or "" for k, v in attrs}
        if tag == "meta" and named.get("name", "").strip().lower() == "description":
            self.found.setdefault("meta_description", named.get("content", ""))
        elif tag == "link" and "canonical" in named.get("rel", "").lower().split():
            self.found.setdefault("canonical_url", named.get("href", ""))

    def handle_endtag(self, tag):
        if tag == "title" and self.title is not None:
            self.found["html_title"], self.title = "".join(self.title), None

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)


def scan_heads(html: str) -> dict[str, str]:
    """Head fields of one page, blank where it has none."""
    scan = _Heads()
    scan.feed(html)
    scan.close()
    if scan.title is not None:  # a title that is never closed
        scan.handle_endtag("title")
    return {k: scan.found.get(k, "") for k in ("html_title", "meta_description", "canonical_url")}


def head_fields(html: str | Column) -> Column:
    """Title, description and canonical URL of a page, from one scan."""

    def heads(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan_heads(t or "") for t in texts], columns=["html_title", "meta_description", "canonical_url"])

    return F.pandas_udf(heads, HEAD_TYPE)(T.col(html))


def with_heads(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds html_title, meta_description and canonical_url."""
    read = pages.withColumn("_head", head_fields(html))
    h = F.col("_head")
    return read.withColumns(
        {
            "html_title": T.collapse(h["html_title"]),
            "meta_description": T.collapse(h["meta_description"]),
            "canonical_url": T.strip(h["canonical_url"]),
        }
    ).drop("_head")


def page_heads(pages: DataFrame) -> DataFrame:
    """Title, description and canonical URL of each page."""
    return with_heads(pages).select("page_id", "html_title", "meta_description", "canonical_url")
