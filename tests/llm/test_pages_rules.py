"""Main texts, web archives and quality rules."""

from __future__ import annotations

import hashlib
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from common import documents, empty, odd_rows, prose

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle_check import connect, difference, spark_bag, sql_bag

from probelens.llm import html_extract, quality_rules, store, warc
from probelens.llm.queries import ORACLES, QUERIES

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>x";</script></head><body class="home">
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies, many of them</div>
<div id="wrap"><div class="sidebar"><p>Links, and more links, of all kinds, to read</p></div>
<div class="post-content" id="post-{n}"><h2>Head &amp; line</h2><p>First   paragraph,&nbsp;with {n} words of text, and more.<p>Second <b>para</b>graph
is here, after a line<br>break. 1 &lt; 2<ul><li>Item one<li>Item two</ul><div class="ad-box">Buy now, buy it here</div><form><input>Mail me</form>
<!-- <p>hidden</p> --><p>Last one, of them all, in this article.</p><section class="comments"><p>A reader says, hello, to all of you here</p></section></div></div>
<footer>All rights</footer></body></html>"""
TEXT = "Head & line\nFirst paragraph, with {n} words of text, and more.\nSecond paragraph is here, after a line break. 1 < 2\nItem one\nItem two\nLast one, of them all, in this article."


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id BIGINT, url STRING, html STRING, text STRING, host STRING")


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_main_text_by_consensus(spark, monkeypatch, small):
    monkeypatch.setattr(html_extract, "SMALL", small)
    rows = [(i, f"https://a.test/{i}", PAGE.format(n=i)) for i in range(5)]
    short = "<html><body><div id='wrap'><div class='sidebar'><p>A long sidebar text, much longer, than the text, of the page, is here</p></div><div class='post-content' id='post-9'><p>Tiny</p></div></div></body></html>"
    rows += [(10, "https://a.test/9", short.replace("<body>", '<body class="home">')), (11, "https://b.test/", "plain text &amp; <no tag"), (12, None, None), (13, "", ""), (14, "x", "<p>only"), (0, "https://a.test/0", PAGE.format(n=0))]
    found = sorted((r.page_id, r.text) for r in html_extract.extract(pages(spark, rows)).collect())
    assert [t for i, t in found if i < 10] == [TEXT.format(n=n) for n in (0, 0, 1, 2, 3, 4)]
    assert dict(found)[10] == "Tiny" and dict(found)[12] == dict(found)[13] == "" and dict(found)[14] == "only" and dict(found)[11].startswith("plain text &")
    assert html_extract.extract(pages(spark, rows).limit(0)).isEmpty()


@pytest.mark.parametrize("small", [8 << 20, 0])
def test_every_layout_of_a_host_is_searched_for(spark, monkeypatch, small):
    monkeypatch.setattr(html_extract, "SMALL", small)
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    page = "<html><body><div class='box{0}'><div class='l{0}'><p>{1}</p></div><div class='r{0}'><p>{2}</p></div></div></body></html>"
    long, short = "A text of some length, with commas, of the article of the page, and more, of it", "Tiny"
    rows = [(100 * k + i, "https://many.test/x", page.format(name(k), f"{long} {k} {i}", short)) for k in range(30) for i in range(3)]
    rows += [(100 * k + 50, "https://many.test/y", page.format(name(k), short, "A text beside, longer, than that of the page, is here")) for k in range(30)]
    found = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert len(found) == len(rows) and all(found[100 * k + 50] == "Tiny" for k in range(30))


def test_an_article_keeps_its_own_heading():
    html = "<body><header>Site, of many things</header><article><header><h1>Title</h1><span>by me</span></header><p>Some text, long enough, to be the article of this page.</p><aside>More</aside></article></body>"
    assert html_extract.main_text(html, []) == "Title\nSome text, long enough, to be the article of this page."


def test_names_of_wrappers_and_parts_of_an_article():
    html = """<body><div class="layout has-sidebar"><div class="post-header"><h1>Title</h1></div><main><p>Some text, long enough, to be the article of this page.</p>
    <div class="share-post">Share</div></main><div class="sidebar"><p>Side text, that is long enough, to be seen as one</p></div></div></body>"""
    assert html_extract.main_text(html, []) == "Some text, long enough, to be the article of this page."
    inside = html.replace('<div class="post-header"><h1>Title</h1></div><main>', '<main><div class="post-header"><h1>Title</h1></div>')
    assert html_extract.main_text(inside, []).split("\n")[0] == "Title"


def test_broken_markup_does_not_loop():
    for html in ("<" * 2000, "<p" * 2000, "<a href='" * 2000, "<!--" * 500, "</div>" * 500, "<b>" * 3000 + "deep text that is long enough, really", "<p>x<foot", "a < b <3 c"):
        html_extract.main_text(html, [])


def payload_rows():
    return [(1, "http://a/1", "x" * 200), (2, "http://a/2 b\n", "x" * 200), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", "é" * 5000), (8, "u", "é" * 5000), (8, "u", "é" * 5000), (None, "u", "z" * 150), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 300)]


@pytest.mark.parametrize("chunk,archive", [(1 << 20, 1 << 30), (700, 2000)])
def test_archives_round_trip(spark, chunk, archive):
    rows = payload_rows()
    manifest = warc.write_archives(pages(spark, rows), store.new_dir(spark, "warc"), chunk_bytes=chunk, archive_bytes=archive)
    chunks = warc.read_archives(manifest, chunk_bytes=chunk).collect()
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and all(len(r.data or b"") <= chunk for r in chunks)
    first = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= 100 and i is not None:
            first[t] = min(i, first.get(t, i))
    expected = sorted(str((i, len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest(), *(("revisit", first[t]) if first.get(t, i) != i else ("response", None)))) for i, _, t in rows)
    lasts = [r for r in chunks if r.last]
    assert sorted(str((r.page_id, r.total, r.digest, r.record_type, r.refers_to)) for r in lasts) == expected
    joined = {}
    for r in sorted((r for r in chunks if r.record_type == "response" and r.page_id in (7, 9)), key=lambda r: r.chunk):
        joined[r.page_id] = joined.get(r.page_id, b"") + r.data
        assert r.digest == hashlib.sha256(joined[r.page_id]).hexdigest() and r.bytes == len(joined[r.page_id])
    assert joined == {i: t.encode() for i, _, t in rows if i in (7, 9)}
    assert [r.records for r in warc.write_archives(pages(spark, rows).limit(0), store.new_dir(spark, "warc")).collect()] == []


def test_quality_rules(spark):
    line, rows = "Shared   line 12 of many words here", []
    for i in range(70):
        own = "\n".join(prose(1000 * i + k, 12) for k in range(6))
        rows.append((i, (line if i % 2 else "shared line 7 of many words here").upper() + "\n" + own))
    rows += [(100, "\n".join([line] * 20)), (101, prose(3, 60)), (102, "a b c " * 40), *[(d + 200 if d is not None else None, t) for d, t in odd_rows()]]
    found = quality_rules.quality(documents(spark, rows), most_documents=50)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by_id.values())) == len(rows)
    assert all(by_id[i][0].kept and by_id[i][0].n_lost == 7 for i in range(70))
    assert by_id[100][0].n_dup_lines == 19 and not by_id[100][0].kept and by_id[101][0].kept and by_id[102][0].base_failed and by_id[102][0].n_repeat_words == 120
    assert all(r.base_failed and not r.kept and r.n_words == 0 for i in (203, 204, 205) for r in by_id[i])
    assert quality_rules.quality(empty(spark)).isEmpty()


def test_boilerplate_lines_are_removed_from_texts(spark):
    rows = [(i, f"own line of {prose(i, 3)}\n\n  SHARED line {i}\nlast {prose(500 + i, 2)}\n") for i in range(8)]
    rows += [(20, "shared line 1"), (20, "shared line 1"), (21, None), (22, ""), (23, "shared line 1\nshared line 2"), (24, "no such\nlines"), (None, "x\nshared line 3\ny")]
    found = quality_rules.quality(documents(spark, rows), most_documents=3).collect()
    expected = {d: t if t is None else "\n".join(x for x in t.split("\n") if not x.strip().lower().startswith("shared line")) for d, t in rows}
    assert len(found) == len(rows) and {r.doc_id: r.cleaned for r in found} == expected


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    left = spark_bag(QUERIES[name](spark, sf))
    assert difference(left, sql_bag(connect(sf), ORACLES[name])) is None and left[1]


def test_deep_pages_take_time_by_their_length():
    text = "A sentence of the page, long enough to be scored, with commas, and an end. " * 3
    for page in ("<div>" * 50_000 + f"<p>{text}</p>", "<div class='sidebar'>" * 20_000 + f"<article><p>{text}</p></article>", "<article>" + "<div class='w-1/2'><section>" * 10_000 + f"<h1>T</h1><p>{text}</p>"):
        started = time.perf_counter()
        path = html_extract.main_path(page)
        found = html_extract.main_text(page, [path] if path else [])
        assert time.perf_counter() - started < 8 and "A sentence of the page" in found


def test_a_share_of_a_host_gives_one_verdict_at_every_size(spark):
    """Twenty documents of a host share a line; so do two hundred. Another line is in two of them, and in twenty."""
    def host(name, n, first):
        rows = []
        for i in range(n):
            lines = [prose(first + i, 60), "All rights reserved 2024", "Rare line" if i % 100 == 0 else f"own {i}"]
            rows.append((first + i, "\n".join(lines), "en", name))
        return rows

    rows = host("small", 20, 0) + host("large", 200, 1000) + host("tenfold", 2000, 10_000)
    bad = quality_rules.boilerplate(documents(spark, rows), "text", "source", quality_rules.MOST_DOCUMENTS, quality_rules.MOST_PERCENT)
    shared = quality_rules.line_hash(F.lit("All rights reserved 1999"))
    own = quality_rules.line_hash(F.lit("own 5"))
    found = bad.select("__host", (F.col("__hash") == shared).alias("shared"), (F.col("__hash") == own).alias("own")).collect()
    assert {r["__host"] for r in found if r.shared} == {"small", "large", "tenfold"}
    assert all(r.shared or r.own for r in found)  # the rare line is in one percent, not more
