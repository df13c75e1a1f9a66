"""Blocks, chunks, page trees and page layout."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import chunk as K
from tidemark.operators import corpus as C
from tidemark.operators import html as H
from tidemark.operators import layout as Y

LINES = st.lists(
    st.sampled_from(["", "  ", "text here.", "more text", "# H", "### Deep", "## Two", "- item", "  deeper", "1. one", "| a | b |", "| c |", "page 3 of 9", "Draft", "x" * 700, "s. " * 500]),
    max_size=25,
)


def test_blocks():
    body = "Intro\nPage 1\nmore\n\ndraft\n# A\n- x\n  y\n1. z\ntail\n| a |\n| b |\n### B  \n\npage 2"
    assert K.markdown_blocks(body) == [
        ("paragraph", "Intro Page 1 more"), ("heading", "# A"), ("list", "- x\n  y\n1. z"), ("paragraph", "tail"), ("table", "| a |\n| b |"), ("heading", "### B"),
    ]


def test_heading_trail_goes_by_depth():
    got = [p for p, _ in K.document_chunks("T", "### first\na\n## second\nb\n# third\nc")]
    assert got == ["T > first", "T > first > second", "T > third"]


def test_heading_without_text_is_a_chunk():
    assert list(K.document_chunks("T", "# A\n# B\nx")) == [("T > A", "Section: T > A"), ("T > B", "Section: T > B\n\nx")]


def test_long_sentence_stays_whole():
    assert K.sentence_parts("a. " + "b" * 50 + ". c.", 20) == ["a.", "b" * 50 + ".", "c."]


@settings(max_examples=200, deadline=None)
@given(LINES)
def test_chunks_cover_all_blocks(lines):
    body = "\n".join(lines)
    blocks, chunks = K.markdown_blocks(body), list(K.document_chunks("T", body))
    text = " ".join(" ".join(t.split()) for _, t in chunks)
    for kind, block in blocks:
        if kind != "heading":
            for part in K.sentence_parts(block, fixed.CHUNK_CHARS) if kind == "paragraph" else [block]:
                assert " ".join(part.split()) in text
    for path, chunk in chunks:
        parts = chunk.split("\n\n")
        body_parts = [p for p in parts if not p.startswith("Section: ")]
        assert len(chunk) <= fixed.CHUNK_CHARS or len(body_parts) <= 1


def test_chunk_ids_are_unique(spark):
    docs = spark.createDataFrame([("a", "# H\n" + "word. " * 900), ("b", "plain")], "id string, t string")
    rows = K.chunk_documents(K.plain_source(docs, F.col("id"), F.lit("My Title"), F.col("t"))).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) > 4
    assert rows[0].chunk_id == "a::000::my_title_h"


def test_sql_table_function(spark):
    K.register_sql(spark)
    got = spark.sql("SELECT * FROM chunk_document('T', '# A\n\ntext')").collect()
    assert [tuple(r) for r in got] == [(0, "T > A", "Section: T > A\n\ntext")]


def test_source_documents(spark):
    files = [
        ("kb/a.md", '```json\n{"source_id": "a", "title": "A", "document_type": "market_law", "region": "EU", "country_code": "", "priority": "p1"}\n```\nBody'),
        ("kb/readme.md", "x"), ("kb/b.md", "plain body"), ("kb/c.md", '```json\n{"source_category": "internal_brand_reference"}\n```\nBody'), ("kb/d.md", '```json\n{}\n```\n  '),
    ]
    got = {r.doc_id: r for r in C.source_documents(spark.createDataFrame(files, "path string, text string")).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].country_code, got["a"].priority, got["a"].source_category) == ("EU", "P1", "market_law")
    assert (got["b"].source_category, got["b"].source_title, got["b"].country_code) == ("platform_policy", "b", "GLOBAL")


# --- page trees: a plain walk over the same nodes, element by element -------------------------


def brute_force(html):
    nodes = H.scan_nodes(html)
    gone = set()

    def inside(n):
        return [m for m in nodes if n["node_no"] < m["node_no"] <= n["last_no"] and m["node_no"] not in gone]

    def text(n):
        return " ".join(m["text"] for m in inside(n) if m["tag"] == "#text")

    def density(n):
        links = sum(len(text(m)) for m in inside(n) if m["tag"] == "a")
        return min(1.0, links / max(1, len(text(n)))) if text(n) else 1.0

    def worded(n):
        return bool(n["attrs"]) and any(k in n["attrs"] for k in fixed.NOISE_ATTR_KEYWORDS)

    def drop(n):
        gone.update(m["node_no"] for m in nodes if n["node_no"] <= m["node_no"] <= n["last_no"])

    def live(n):
        return n["node_no"] not in gone and n["tag"] != "#text"

    for n in nodes:
        if live(n) and worded(n) and (n["tag"] in fixed.BOILERPLATE_TAGS or len(text(n)) < 1600 or density(n) > 0.45):
            drop(n)
        elif live(n) and n["aria_hidden"]:
            drop(n)

    def score(n):
        t = text(n)
        if len(t) < 300:
            return -1.0
        tags = [m["tag"] for m in inside(n)]
        s = len(t) + 550 * sum(x in ("h1", "h2", "h3", "h4", "h5", "h6") for x in tags) + 100 * tags.count("p")
        s += 40 * tags.count("li") + 260 * tags.count("table") - density(n) * 2200 + 1500 * (n["tag"] in ("article", "main"))
        s += 800 * any(k in n["attrs"] for k in fixed.CONTENT_ATTR_KEYWORDS) - 2400 * any(k in n["attrs"] for k in fixed.NOISE_ATTR_KEYWORDS)
        return s

    alive = [n for n in nodes if live(n)]
    wanted = [n for n in alive if n["tag"] == "article"] + [n for n in alive if n["tag"] == "main"] + [n for n in alive if n["role"] == "main"]
    wanted += [n for n in alive if n["tag"] in ("section", "div", "body")]
    best, best_score = None, -1.0
    for n in wanted:
        if score(n) > best_score:
            best, best_score = n, score(n)
    root = best or next((n for n in alive if n["tag"] == "body"), nodes[0])
    for n in nodes:
        if root["node_no"] < n["node_no"] <= root["last_no"] and live(n):
            if n["tag"] in fixed.BOILERPLATE_TAGS or (worded(n) and (density(n) > 0.35 or len(text(n)) < 1200)):
                drop(n)
    return root["tag"], round(best_score, 3), text(root)


PAGES = [
    "<body><nav class='nav'><a>home</a></nav><div class='sidebar'>x</div><article class='content'><h1>T</h1><p>" + "w " * 300 + "<a href=x>link <b>in</b></a><p>next<ul><li>a<li>b</ul><div class='share'>s</div></article></body>",
    "<body><div id=a><p>" + "long text " * 100 + "</p><div class='related'><a>" + "link " * 200 + "</a></div></div><div role=main><table><tr><td>" + "cell " * 90 + "</td></tr></table></div></body>",
    "<p>tiny", "", "<body><main><header>h</header><section><p>" + "word " * 200 + "</section></main><p aria-hidden=true>" + "gone " * 200 + "</body>",
    "<body><div><div><div class='menu'>" + "keep me " * 300 + "</div></div><a></a></div></body>",
]


def without_marks(markdown):
    """The words of a body: no marks of headings and list items, no bars and rules of tables."""
    lines = [line for line in markdown.split("\n") if not re.fullmatch(r"\|( --- \|)+", line)]
    lines = [re.sub(r"(?<!\\)\|", " ", line).replace("\\|", "|") if line.startswith("| ") else line for line in lines]
    return " ".join(" ".join(re.sub("^(#+|-) ", "", line) for line in lines).split())


@pytest.fixture(scope="module")
def page_results(spark):
    rows = spark.createDataFrame(list(enumerate(PAGES)), "page_id int, html string")
    return {r.page_id: r for r in H.page_markdown(rows).collect()}


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_content_root(page_results, i):
    tag, score, text = brute_force(PAGES[i])
    got = page_results[i]
    assert (got.root_tag, round(got.root_score, 3)) == (tag, score)
    assert without_marks(got.markdown) == text


def test_registered_pages_match_the_walk(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.root_tag, round(r.root_score, 3)) for r in H.page_markdown(rows).collect()}
    want = {r.page_id: brute_force(r.html)[:2] for r in rows.collect()}
    assert got == want


def test_boilerplate_heading_takes_its_short_parent(spark):
    html = "<article><p>" + "w " * 400 + "</p><div><h2>Contact us</h2><p>mail</p></div><h2>Menu</h2><p>kept</p></article>"
    got = H.page_markdown(spark.createDataFrame([(1, html)], "page_id int, html string")).first().markdown
    assert "Contact" not in got and "mail" not in got and "Menu" not in got and got.endswith("kept")


# --- layout -----------------------------------------------------------------------------------


def test_two_columns_and_tables(spark):
    rows = [
        ("d", 1, 1, "text", 50.0, 100.0, 200.0, 120.0, "left low", 11.0), ("d", 1, 2, "text", 300.0, 50.0, 400.0, 70.0, "right", 11.0),
        ("d", 1, 3, "text", 60.0, 40.0, 200.0, 60.0, "Title", 24.0), ("d", 1, 4, "text", 300.0, 210.0, 400.0, 260.0, "in table", 11.0),
        ("d", 1, 5, "table", 290.0, 200.0, 420.0, 300.0, "| a | b |\n| --- | --- |", None), ("d", 2, 1, "text", 50.0, 10.0, 90.0, 20.0, "12", 11.0),
    ]
    e = spark.createDataFrame(rows, "doc string, page int, element_no int, kind string, x0 double, y0 double, x1 double, y1 double, text string, font_size double")
    assert [(r.page, r.line) for r in Y.document_lines(e).orderBy("page", "reading_no").collect()] == [
        (1, "# Title"), (1, "left low"), (1, "right"), (1, "| a | b |\n| --- | --- |"),
    ]
    body = Y.document_bodies(e).first()
    assert (body.pages, body.table_pages) == (2, 1)
    assert body.markdown == "# Title\n\nleft low\n\nright\n\n| a | b |\n| --- | --- |\n"


def test_paragraph_lines(spark):
    row = spark.createDataFrame([(["An ex-", "ample (", "here", "• one", "two", ""],)], "l array<string>")
    assert row.select(Y.merged_paragraph(F.col("l")).alias("x")).first().x == "An example (here\n• one two"
    cases = [
        (["--", ""], "--"),
        (["f--", "(", None, "-", "a", "f--"], "f(a f--"),
        (["abc", "--", "next"], "abc next"),
        (["a/", "b", "- c-", "d"], "a/b\n- cd"),
        ([], ""),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, l array<string>")
    got = got.select("i", Y.merged_paragraph(F.col("l")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [c[1] for c in cases]


def test_small_tables_are_not_real(spark):
    cells = [("t", r, c, t) for r, row in enumerate([["a", "b"], ["c", "d"]]) for c, t in enumerate(row)]
    cells += [("u", r, c, t) for r, row in enumerate([["a", "b"], ["a", "b"]]) for c, t in enumerate(row)]
    df = spark.createDataFrame(cells, "table_id string, row_no int, col_no int, text string")
    assert [r.table_id for r in Y.real_tables(df).collect()] == ["t"]
    got = {r.table_id: r.markdown for r in Y.table_markdown(df).collect()}
    assert got["t"] == "| a | b |\n| --- | --- |\n| c | d |"


def test_heads_of_common_pages():
    page = (
        "<html><head><!-- <title>old</title> --><title>Caf&eacute; &ndash; it&#8217;s\n open</title>"
        "<meta content='a > b &amp; c' NAME=Description><link href=' http://x/ ' rel='alternate canonical'></head>"
        "<body><title>second</title></body></html>"
    )
    got = H.scan_heads(page)
    assert got == {"html_title": "Caf\u00e9 \u2013 it\u2019s\n open", "meta_description": "a > b & c", "canonical_url": " http://x/ "}
    assert H.scan_heads("") == {"html_title": "", "meta_description": "", "canonical_url": ""}
    assert H.scan_heads("<title>never closed")["html_title"] == "never closed"


def test_parent_is_measured_after_the_noise_is_gone(spark):
    """Text of the parent that the first pass drops does not keep it above the limit."""
    noise = "<div class='cookie-banner'>" + "noise " * 250 + "</div>"
    body = f"<article><h1>Main</h1><p>{'word ' * 200}</p><div><h2>Back to top</h2><p>{'short ' * 20}</p>{noise}</div></article>"
    pages = spark.createDataFrame([(1, f"<html><body>{body}</body></html>")], "page_id long, html string")
    text = H.page_markdown(pages).first().markdown
    assert "Main" in text and "short" not in text and "noise" not in text


def test_tables_become_rows(spark):
    table = "<table><tr><th>Name</th><th>Rule | <b>text</b></th></tr><tr><td><p>a</p><p>b</p></td><td>c</td></tr><tr><td></td><td>d</td></tr></table>"
    body = f"<article><h1>Main</h1><p>{'word ' * 200}</p>{table}<ul><li>one<li>two</ul></article>"
    pages = spark.createDataFrame([(1, f"<html><body>{body}</body></html>")], "page_id long, html string")
    text = H.page_markdown(pages).first().markdown
    assert "\n\n| Name | Rule \\| text |\n| --- | --- |\n| a b | c |\n|  | d |\n\n- one\n- two" in text


def test_key_of_a_line_is_made_once_a_stage(spark, capsys):
    """Of the regular expressions that a line goes through most are for its key: one for repeats, one for the tidy text."""
    kinds = "doc long, page int, element_no long, kind string, x0 double, y0 double, x1 double, y1 double, text string, font_size double"
    rows = [(1, p, p * 10 + i, "text", 50.0, 40.0 * i, 90.0, 40.0 * i + 9, t, 11.0) for p in range(4) for i, t in enumerate(["Head 7", "body", f"x{p}"])]
    bodies = Y.document_bodies(spark.createDataFrame(rows, kinds))
    assert "Head" not in bodies.first().markdown
    bodies.explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count(r"\p{Nd}+$") <= 2
