"""Operators on pages, vectors and graphs, and the pipeline."""

import random

import numpy as np
import pandas as pd
import pytest

from ledgerlight.llm import archives, main_text, plans, topk, url_filter
from ledgerlight.llm.components import connected_components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(40)] + [(200, 201), (201, 200), (5, 5), (None, 3)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    neighbours = {}
    for u, v in edges:
        if u is not None and u != v:
            neighbours.setdefault(u, set()).add(v)
            neighbours.setdefault(v, set()).add(u)
    want = {}
    for start in sorted(neighbours):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += neighbours[x]
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.example.com/en/x", "<p>"),
            (2, "http://q.org/a/b?x=1#f", '<link rel="canonical" href="//B.net/es/1">'),
            (3, "https://z.org", '<meta http-equiv=refresh content="0; url=http://q.org/a/b?x=1">'),
            (4, "http://www.example.com/en/1", '<link href="http://a.example.com/en/x" rel=canonical>'),
            (5, "http://k.org/p", '<!-- <link rel=canonical href="http://b.net/es/1"> -->'),
            (6, None, None), (7, "nothing", "x"), (7, "nothing", "x"),
            (8, "HTTP://Y.NET/fr/1", ""), (9, "http://notnet/fr/", ""), (10, "http://m.org/", '<link rel="canonical" href="http://www.example.com/en/1">'),
        ],
        "page_id long, url string, html string",
    ).selectExpr("*", "'x' AS host", "1 AS verdict", "'z' AS address")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, plans.URL_RULES).collect()}
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"),
        2: ("q.org", "/a/b", None, "block"),
        3: ("z.org", "", None, "block"),
        4: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        5: ("k.org", "/p", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("y.net", "/fr/1", "net/fr/", "block"),
        9: ("notnet", "/fr/", None, "allow"),
        10: ("m.org", "/", None, "allow"),
    }
    extra = spark.createDataFrame([("http://k.org/p", "http://b.net/es/")], "src string, dst string")
    got = {r.page_id: (r.verdict, r.source) for r in url_filter.judge_urls(pages, plans.URL_RULES, extra).collect()}
    assert got[5] == ("block", "alias") and got[7] == ("allow", "default")
    assert url_filter.judge_urls(pages.limit(0), plans.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_every_spelling_of_an_address_counts(spark):
    from ledgerlight.llm.plans import URL_RULES

    pages = spark.createDataFrame(
        [(1, "http://a.com", '<link rel="canonical" href="http://b.net/es/1">'), (2, "http://a.com/", '<link rel="canonical" href="http://c.org/x">')],
        "page_id long, url string, html string",
    )
    got = {r.page_id: (r.verdict, r.source) for r in url_filter.judge_urls(pages, URL_RULES).collect()}
    assert got == {1: ("allow", "alias"), 2: ("allow", "rule")}


def test_long_and_broken_tags_are_read_without_recursion(spark):
    pages = [
        (1, "http://a.net/fr/1", f"<link rel=canonical data-x={'y' * 300_000} href='http://a.org/1'>"),
        (2, "http://a.org/1", "<link " + "a='b' " * 100_000 + ">"),
        (3, "http://b.org/1", "<link rel=canonical href='http://a.org/1" + "z" * 300_000),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(frame, plans.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_a_component_with_half_of_the_vertices(spark):
    rows = [(i, f"http://h.org/{i}", "<link rel=canonical href='http://x.net/fr/0'>" if i % 2 else "") for i in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(frame, plans.URL_RULES).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i in range(400)}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(300)]
    vectors += [(400, vectors[0][1]), (420, None), (440, [float("nan")] * 12), (460, [None] + [0.1] * 11), (480, [float("inf")] * 12), (None, [0.1] * 12), (500, [0.5, -0.5])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS part")
    good = {i: np.floor(64 * np.pad(v, (0, 12 - len(v)))) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 20 == 0:
            best = sorted((-int(good[q] @ x), i) for i, x in good.items() if i != q)[:7]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(frame, every=20, k=7).collect())) == sorted(want)
    assert len(topk.top_k(frame.where("vec_id in (0, 1, 2)"), k=20).collect()) == 2
    assert topk.top_k(frame.limit(0)).count() == 0


def best_by_hand(vectors, every, k):
    rows = [(i, np.array(v)) for i, v in vectors]
    want = []
    for q, x in rows:
        if q % every == 0:
            best = sorted((-int(np.floor(64 * x) @ np.floor(64 * y)), i) for i, y in rows if i != q)[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(want)


def test_top_k_over_many_blocks_slices_and_groups(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 8), ("SLICE_BLOCKS", 2), ("PIECE_ROWS", 3), ("GROUP_PIECES", 2), ("CHUNK_BLOCKS", 4), ("FIRST_PARTS", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    vectors = [(i, np.round(rng.normal(0, 0.4, 3), 1).tolist()) for i in range(200)]  # many equal scores
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(6)
    for k in (5, 20):  # of 20, no block alone has as many other rows
        assert sorted(map(tuple, topk.top_k(frame, every=5, k=k).collect())) == best_by_hand(vectors, 5, k)
    # A third of the rows under one ID that is also a query, and vectors without components.
    same = [(10, [0.1 * (i % 7), 0.2]) for i in range(100)] + vectors
    got = topk.top_k(spark.createDataFrame(same, frame.schema), every=100, k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == best_by_hand([(i, (v + [0.0])[:3]) for i, v in same], 100, 3)
    bare = spark.createDataFrame([(0, []), (1, []), (2, [])], frame.schema)
    assert sorted(map(tuple, topk.top_k(bare, every=2, k=1).collect())) == [(0, 1, 1, 0), (2, 1, 0, 0)]


def test_blocks_go_only_where_a_bound_reaches_the_floor(monkeypatch):
    limits = lambda rows: np.concatenate(topk.term_bounds(rows)).tobytes()
    blocks = [np.full((4, 2), x, np.int64) for x in (9, 5, 1)]
    summaries = pd.DataFrame({"part": [0, 0, 1], "block": [0, 1, 0], "width": [2] * 3, "limits": [limits(b) for b in blocks]})
    piece = {"part": [0], "block": [0], "n": [2], "width": [2], "ids": [np.array([20, 40]).tobytes()], "cells": [np.array([[1, 1], [2, 1]]).tobytes()], "asker": [7]}
    first = topk._first_blocks(pd.DataFrame(piece), summaries)
    assert first[["at", "bound", "d_part", "d_block"]].values.tolist() == [[0, 18, 0, 0], [1, 27, 0, 0]]
    known = lambda *floors: pd.DataFrame(piece | {"floors": [[{"at": i, "floor": f} for i, f in enumerate(floors) if f is not None]]})
    live = lambda *floors: topk._live_blocks(known(*floors), summaries)[["asker", "part", "block"]].values.tolist()
    assert live(18, 27) == [[7, 0, 0]] and live(18, 15) == [[7, 0, 0], [7, 0, 1]]  # an equal bound can hold a smaller ID
    assert len(live(18, None)) == 3  # without a floor every block may hold an answer


def test_bounds_skip_blocks():
    rows = np.vstack([np.full((50, 4), 9), np.full((50, 4), 1)]).astype(np.int64)
    blocks = [(np.arange(50), rows[:50]), (np.arange(50, 100), rows[50:])]
    at, found, score, scored = topk.search_blocks(np.ones((1, 4), np.int64), np.array([-1]), blocks, 5)
    assert found.tolist() == [0, 1, 2, 3, 4] and scored == 1


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="with-sidebar"><header>Site</header>
<nav><a href=/>Home</a></nav><div class="content no-sidebar"><div class="cookie-notice">We use cookies on this site</div><article><header><h1>Head &amp; line</h1></header>
<p>First  <b>bold</b>
words<br>here &eacute;.<div class="ad">Buy now and save money</div><p>Second one</p><form><label>Name</label></form><ul><li>Item</li></ul>
<section class="comments"><p>Great article, thanks a lot for it</p></section></article></div><aside>Side text here</aside><footer>&copy; foot</footer></body></html>"""


def test_main_text(spark):
    weights = {t: -0.02 for t in ("p", "/p", "h1", "/h1", "br", "b", "/b", "ul", "/ul", "li", "/li", "article", "header", "/header")}
    assert main_text.main_text(PAGE, weights) == "Head & line\nFirst bold words here é.\nSecond one\nItem"
    assert main_text.best_stretch([1, -5, 2, -1, 2, -9, 3]) == (2, 5) and main_text.best_stretch([-1.0]) == (0, 0)
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<nav>only</nav>"), (5, "u", "plain words"), (5, "u", "plain words"), (6, "u", "<p>cut <b>off"), (7, "u", "<" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    got = sorted((r.page_id, r.text, r.n_chars) for r in main_text.extract_main_text(pages).collect())
    assert [x[0] for x in got] == [1, 2, 3, 4, 5, 5, 6, 7]
    texts = {i: t for i, t, _ in got}
    assert texts[2] == texts[3] == texts[4] == "" and texts[5] == "plain words" and texts[6] == "cut off" and "cookies" not in texts[1]
    assert all(n == len(t) for _, t, n in got)
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


WEIGHTS = {t: -0.02 for x in ("p", "h1", "h2", "section", "div", "a", "article", "form") for t in (x, f"/{x}")}


@pytest.mark.parametrize(
    "part",
    [
        '<section id="discussion"><p>kept words here now</p></section>', '<h2 id="related-work">kept words here now</h2>', '<h2 id="legal-status">kept words here now</h2>',
        '<h2 id="search-algorithms">kept words here now</h2>', '<h2 id="form-of-government">kept words here now</h2>', '<p><a class="social-link">kept words here now</a></p>',
        "<p><label>kept words here now</label></p>", "<p>kept <math><mi>words</mi> <mtext>here</mtext></math> now</p>",
    ],
)
def test_names_inside_an_article_remove_no_text(part):
    page = f"<body><article><p>Some words that come before it</p>{part}<p>and more words after</p></article></body>"
    assert main_text.main_text(page, WEIGHTS) == "Some words that come before it\nkept words here now\nand more words after"


@pytest.mark.parametrize("name", ['class="no-sidebar"', 'id="page-with-sidebar"', 'class="sidebar"'])
def test_a_wrapper_with_most_words_stays(name):
    page = f'<body><nav>Home</nav><div {name}><p>All the text of the page</p><div class="cookie-notice">We use cookies</div></div><div class="sidebar"><p>Aside it</p></div></body>'
    assert main_text.main_text(page, WEIGHTS) == "All the text of the page"


@pytest.mark.parametrize("name", ["form", "fieldset", "search", "label", "dialog"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_a_container_around_the_page_stays(name, inner):
    page = f"<body><{name}><nav>Home</nav><{inner}><p>All the text of the page</p></{inner}><fieldset>Your name <input><button>Send</button></fieldset></{name}></body>"
    assert main_text.main_text(page, WEIGHTS) == "All the text of the page"
    assert main_text.main_text("<body><p>All the text of the page</p><form>Your name</form></body>", WEIGHTS) == "All the text of the page"


@pytest.mark.parametrize("page, text", [
    ("<article><p data-x=it's>Main text that doesn't end here, it's long.</p></article>", "Main text that doesn't end here, it's long."),
    ('<article><p>See <a href="x>link</a> and more of the text</p></article>', "See link and more of the text"),
    ('<article><p title="a > b">Words of the first block</p><p class=x\'y>and of the second</p></article>', "Words of the first block\nand of the second"),
    ("<article><p>One two three</p></b></div></i><p>four five six</p></article>", "One two three\nfour five six"),
])
def test_odd_quotes_and_stray_closers_lose_nothing(page, text):
    assert main_text.main_text(page, {}) == text


def test_time_is_linear_in_a_broken_page():
    import time

    for page in ("<div>" * 30_000 + "</x>" * 200_000, "<p a='" * 200_000, "<a b=" + "c" * 1_000_000 + ">x", "<a " + "b='c' " * 200_000 + ">x", "<script>" + "</scrip" * 200_000):
        began = time.time()
        main_text.main_text(page, {})
        assert time.time() - began < 20


def test_every_tag_of_the_labelled_pages_gets_a_weight(spark):
    name = "x" + "y" * 100
    pages = spark.createDataFrame([(i, f"<nav><{name}>menu</{name}></nav><article><p>text {i}</p><{name}a>b</{name}a></article>") for i in range(20)], "page_id long, html string")
    weights = main_text.learn_weights(pages)
    assert f"{name}a" in weights and "p" in weights


def test_given_pages_give_their_articles(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in plans.op8_main_text(spark, sf).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b)


def test_archives(spark):
    rows = [(5, "http://a b/%", "same é"), (9, "http://x/", "same é"), (7, None, "same é"), (1, "u", None), (2, "u", ""), (3, "u", "line\r\n\r\nWARC/1.0\r\n\n"), (4, "u", "x" * 5000), (-8, "u", "negative")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS item", "'q' AS payload")
    got = {r.item: r for r in archives.archive_pages(pages).collect()}
    assert len(got) == len(rows)
    assert [(got[i].record_type, got[i].refers_to) for i in (5, 7, 9, 1, 2, 3)] == [("revisit", 9), ("revisit", 9), ("response", None), ("revisit", 2), ("response", None), ("response", None)]
    for i, url, text in rows:
        data = (text or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].url) == (len(data), archives.digest_of(data), url)
        assert got[i].payload is None if got[i].record_type == "revisit" else bytes(got[i].payload) == data
    assert {r.record_type for r in archives.archive_pages(pages, min_bytes=10_000).collect()} == {"response"}
    assert archives.archive_pages(pages.limit(0)).count() == 0


def test_archive_files_hold_a_stated_number_of_bytes(spark):
    pages = spark.range(40).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "repeat(cast(id AS string), 300) AS html").coalesce(1)
    arc = archives.write_arc(pages, file_bytes=2_000, codec="none")
    files = [bytes(r.content) for r in archives._files(spark, arc).collect()]
    assert len(files) > 10 and max(map(len, files)) < 2_000 + 200
    assert sorted(r[0] for f in files for r in archives.parse_arc(f)) == list(range(40))
    warc = archives.convert(spark, arc, file_bytes=2_000, codec="none")
    files = [bytes(r.content) for r in archives._files(spark, warc).collect()]
    assert len(files) > 10 and max(map(len, files)) < 2_000 + 450  # a warcinfo record more
    assert sorted(r[0] for f in files for r in archives.parse_warc(f)) == list(range(40))


@pytest.mark.parametrize("version", [1, 2])
def test_foreign_archives_keep_headers_addresses_and_codes(spark, tmp_path, version):
    more = [b"404 - - 0 f.arc", b"302 - - 0 f.arc", b"410 - - 0 f.arc"] if version == 2 else [b"", b"", b""]
    blocks = [
        (b"http://a/1", b"10.0.0.1", b"HTTP/1.0 404 Not Found\r\nServer: old\r\nContent-Type: text/html\r\n\r\ngone \xff\xfe"),
        (b"http://a/2", b"0.0.0.0", b"HTTP/1.1 302 Found\nLocation: /x\n\nmoved"),
        (b"dns:a", b"10.0.0.2", b"no header at all\r\n\r\nHTTP/ later"),
    ]
    content = archives.arc_version_block(version, "f.arc").encode()
    for (url, ip, block), m in zip(blocks, more):
        content += b"\n" + b" ".join(x for x in (url, ip, b"19990102030405", b"text/plain", m, str(len(block)).encode()) if x) + b"\n" + block
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.arc").write_bytes(content + b"\n")
    warc = archives.convert(spark, f"file://{tmp_path}/in", codec="none")
    got = {r.url: r for r in archives.read_warc(spark, warc).collect()}
    assert bytes(got["http://a/1"].head) == b"HTTP/1.0 404 Not Found\r\nServer: old\r\nContent-Type: text/html"
    assert (bytes(got["http://a/1"].payload), got["http://a/1"].ip, got["http://a/1"].warc_date) == (b"gone \xff\xfe", "10.0.0.1", "1999-01-02T03:04:05Z")
    assert (bytes(got["http://a/2"].head), bytes(got["http://a/2"].payload), got["http://a/2"].ip) == (b"HTTP/1.1 302 Found\r\nLocation: /x", b"moved", None)
    code = b"410" if version == 2 else b"200"
    assert bytes(got["dns:a"].head).startswith(b"HTTP/1.1 " + code) and bytes(got["dns:a"].payload) == blocks[2][2]
    assert {r.item for r in got.values()} == {None} and len({r.record_id for r in got.values()}) == 3
    for r in archives._files(spark, warc).collect():
        assert bytes(r.content).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_archived_pages_without_an_id(spark):
    rows = [(None, "u1", "same"), (3, "u2", "same"), (None, "u3", "other"), (None, "u4", "other"), (-5, "u5", "same")]
    got = {r.url: r for r in archives.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {u: r.item for u, r in got.items()} == {u: i for i, u, _ in rows}
    assert [(got[u].record_type, got[u].refers_to) for u in ("u1", "u2", "u5")] == [("revisit", 3), ("response", None), ("revisit", 3)]
    assert sorted(got[u].record_type for u in ("u3", "u4")) == ["response", "revisit"] and got["u3"].refers_to is got["u4"].refers_to is None


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    text = archives.arc_version_block(version, "f") + "\n" + archives.arc_record(version, 7, "http://u/", "body\nhttp://x 1 2 3 9\n", "20010203", "f") + "\n"
    assert [(r[0], r[1], r[2], r[6]) for r in archives.parse_arc(text.encode())] == [(7, "http://u/", "20010203", b"body\nhttp://x 1 2 3 9\n")]
    assert archives.warc_date("20010203") == "2001-02-03T00:00:00Z"
    for bad in (text[:-9], text + "no length here\n", text + "a 1\n"):
        with pytest.raises(ValueError):
            list(archives.parse_arc(bad.encode()))
    assert all(archives.item_of(f"<urn:uuid:{archives.record_uuid(i)}>") == i for i in (0, 1, -1, 2**62, -(2**63), 2**63 - 1))


def test_queries_equal_their_sql(spark, sf):
    from check_queries import compare, connect

    connection = connect(sf)
    for name in plans.ORACLES:
        assert compare(spark, connection, sf, name) == "", name


def test_large_products_stay_exact():
    big = np.array([[2**30, 3]])
    _, _, score, _ = topk.search_blocks(big, np.array([9]), [(np.arange(1), big)], 1)
    assert score.tolist() == [2**60 + 9]
