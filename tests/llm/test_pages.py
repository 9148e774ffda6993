import gzip
import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwerk.llm import queries as Q
from fernwerk.llm.html_extract import extract_main_text, host_paths, main_text, read
from fernwerk.llm.vp_search import VPTree, Best, nearest
from fernwerk.llm.warc import parse, read_warc, resolve_revisits, write_warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="content-12"><h1>Head &amp; line</h1><p>One<br>two&nbsp;three.<p>Four <b>bold</b>  &lt;x&gt;
 more.</p><form><p>Sign up</p></form><ul><li>item a<li>item b</ul><!-- no --><div class="ad">Buy</div></div>
<aside><p>Other things to read in the sidebar</p></aside><div id="comments"><p>A comment that is rather long, longer than the text.</p></div></div>
<footer>&copy; x</footer></body>"""
TEXT = "Head & line\nOne two three.\nFour bold <x> more.\nitem a\nitem b"


def test_article_without_its_frame():
    assert main_text(PAGE) == TEXT
    assert main_text(PAGE, "nowhere") == TEXT
    assert main_text(None) == main_text("") == main_text("<html></html>") == ""
    assert main_text("plain &eacute; text") == "plain é text"
    assert main_text("<p>open <b>never closed") == "open never closed"
    assert read("<a<b>>").pieces is not None


WORDS = "word " * 60
LAYOUTS = [f"<div class='{c}'><p>{WORDS}</p></div>" for c in ("content with-sidebar", "has-header", "post social-news", "no-comments", "entry footer-style")]
LAYOUTS += [f"<section class='share-holders'><p>{WORDS}</p></section>", f"<div id='main-content' class='no-comments'><p>{WORDS}", f"<form action='/x'><p>{WORDS}</p><label>Name</label><input><button>Go</button></form>"]


@pytest.mark.parametrize("body", LAYOUTS)
def test_no_name_and_no_form_empties_a_page(body):
    page = f"<html><body><nav>menu</nav>{body}<div class='sidebar'>beside</div><footer>end</footer></body></html>"
    assert main_text(page) == WORDS.strip()


def test_what_stands_beside_goes_even_if_it_is_long():
    for c in ("comments", "sidebar", "comment-list", "site-footer"):
        long = "x " * (200 if c in ("comments", "sidebar") else 20)
        assert main_text(f"<body><article><p>{WORDS}</p><div class='{c}'>{long}</div></article></body>") == WORDS.strip()
    assert main_text("<body><div><p>text of it</p></div><form><p>Sign up here</p></form></body>") == "text of it"


def test_an_article_in_containers_side_by_side_is_whole():
    parts = [f"<div class='{c}'><p>{c} {WORDS}</p></div>" for c in ("one", "two", "three")]
    for around in ("<div class='w'>{}</div>", "{}"):
        assert main_text(f"<body>{around.format(''.join(parts))}</body>").split("\n") == [f"{c} {WORDS}".strip() for c in ("one", "two", "three")]


HUGE = {"divs": "<div>" * 200_000, "nested": "<div class='a b'>x" * 55_000, "quotes": '<a "' * 250_000, "closed quotes": '<a ">" ' * 160_000, "signs": "<" * 1_000_000, "data": "<![CDATA[" * 110_000, "bang": "<!" * 500_000, "ends": "<b>" * 100_000 + "</i>" * 150_000, "items": "<li><ul>" + "<div>" * 80_000 + "<li></li>" * 60_000, "lists": "<ul>" * 250_000, "paragraphs": "<b>" * 100_000 + "<p>x" * 100_000, "attributes": "<a " + "x = " * 250_000 + ">", "rows": "<table>" + "<tr><td>" * 100_000, "doubts": "<div class='site-footer'>x" * 40_000}


@pytest.mark.parametrize("name", HUGE)
def test_any_page_takes_linear_time(name):
    import time

    begin = time.process_time()
    main_text(HUGE[name])
    assert time.process_time() - begin < 4  # a second or less on an idle machine


def test_planted_articles(spark):
    """The paragraphs of each page's article, cut from its html by a plain search, are the text."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: r["text"] for r in Q.op1_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for i, page in rows:
        body = re.search("<article>(.*)</article>", page or "", re.S)
        if body:
            blocks = re.split(r"</?(?:p|h1|ul|li|div|blockquote|pre|table|tr|td)\b[^>]*>", body[1])
            want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
            assert got[i] == "\n".join(x for x in want if x)


def test_paths_are_generalised_and_voted(spark):
    link = "<div class='content-{i}'><p>" + "word " * 30 + "</p></div><div class='list'><p>" + "item " * {0: 5}[0] + "</p></div>"
    pages = [(i, f"http://a.example/{i}", f"<html><body>{link.replace('{i}', str(i))}</body></html>") for i in range(5)]
    odd = "<html><body><div class='content-9'><p>short</p></div><div class='list'><p>" + "item " * 50 + "</p></div></body></html>"
    pages += [(9, "http://a.example/odd", odd), (10, None, None), (11, "not a url", "<p>x</p>"), (11, "not a url", "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit("clash"))
    paths = {r["host"]: r["path"] for r in host_paths(df).collect()}
    assert paths["a.example"].endswith("div.content-#")
    rows = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract_main_text(df).collect())
    assert len(rows) == len(pages)
    assert dict((a, b) for a, b, _ in rows)[9] == "short"  # the host's path outvotes the page's own
    assert rows[-1] == (11, "x", 1) and (10, "", 0) in rows


def test_extraction_of_nothing(spark):
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1))


def test_warc_round_trip(spark, tmp_path):
    big, other = "ü" * 600, "y" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "u\r\nEvil: 1", "small"), (4, None, "small"), (5, "x", None), (6, "x", ""), (7, "z", other), (8, "z", "y" * 999), (9, "z", "y" * 999), (2, "http://a/2", big), (10, "e", "a\r\n\r\nb" * 300)]
    df = pages_frame(spark, rows)
    folder, manifest = write_warc(df, f"file://{tmp_path}/w", archive_bytes=2000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 1
    got = read_warc(folder, manifest).collect()
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=str)
    two = (2, "response", None, 1200)
    alone = [(3, 5), (4, 5), (5, 0), (6, 0), (7, 1000), (8, 999), (9, 999), (10, 1800)]
    assert kinds == sorted([(1, "revisit", 2, 1200), two, two, *((i, "response", None, n) for i, n in alone)], key=str)
    payload = {r["page_id"]: r["payload"] for r in got}
    assert bytes(payload[2]).decode() == big and bytes(payload[10]).decode() == rows[-1][2] and payload[1] is None
    assert {r["url"] for r in got if r["page_id"] == 3} == {"uEvil: 1"}
    heads = []
    for name in (f for f in os.listdir(tmp_path / "w") if f.endswith(".gz")):
        with gzip.open(tmp_path / "w" / name) as f:
            records = list(parse(f))
        assert records[0][0]["warc-type"] == "warcinfo" and records[0][0]["warc-filename"] == name
        heads += [h for h, _ in records[1:]]
    again = [h for h in heads if h["warc-type"] == "revisit"]
    assert [(h["warc-refers-to-target-uri"], h["content-length"]) for h in again] == [("http://a/2", "0")] and all("warc-block-digest" in h for h in heads)


def test_revisits_by_join_equal_those_by_broadcast(spark):
    rows = [(i % 40, f"u{i % 40}", "y" * (1000 + i % 7)) for i in range(60)] + [(None, "n", "y" * 1000)]
    one, many = (sorted((tuple(r) for r in resolve_revisits(pages_frame(spark, rows), broadcast_rows=n).collect()), key=str) for n in (1000, 3))
    assert one == many and sum(r[5] == "revisit" for r in one) > 30
    assert all((r[2] is None) == (r[5] == "revisit") and r[4] >= 1000 for r in one)


def test_of_rows_with_one_id_the_least_vector_counts(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    for part in (1, 3):
        got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(part), "id = 0", 1).collect()
        assert [r["vec_id"] for r in got] == [2]


def test_cut_records_are_an_error():
    with pytest.raises(ValueError):
        list(parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))


def test_revisits_of_nothing(spark):
    df = pages_frame(spark, [(1, "a", "b")]).limit(0)
    assert resolve_revisits(df).collect() == []
    assert read_warc(*write_warc(df)).collect() == []


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = c.execute(Q.ORACLES[name])
    names = [d[0] for d in out.description]
    got = Q.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(out.fetchall())


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
    out = {}
    for q in good:
        if q % 50:
            continue
        found = [(-float((v * good[q]).sum() / (np.sqrt((v * v).sum()) * np.sqrt((good[q] ** 2).sum()))), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
        out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("shard", [60, 20_000])
def test_nearest_is_exact_at_factor_one(spark, shard):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + rng.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(500)]
    rows += [(600 + i, rows[100][1]) for i in range(40)]  # copies: ties go to the smaller id
    rows += [(700, None), (750, [0.0] * 8), (800, [1.0, float("nan")] + [0.0] * 6), (850, [None] + [1.0] * 7), (900, [1.0, 2.0]), (950, [2.0, 1.0]), (None, [1.0] * 8), (1000, [float("inf")] * 8), (1050, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("cell", F.lit(1))
    got = {}
    for r in nearest(df, "id % 50 = 0", 5, shard_rows=shard, query_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    want = brute(rows, 5)
    assert got.keys() == {q for q, v in want.items() if v}
    for q, v in got.items():
        assert [i for _, i in v] == [i for _, i in want[q]], q
        assert [s for s, _ in v] == [s for s, _ in want[q]]


def test_relaxed_search_keeps_its_recall(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16))
    rows = [(i, (centers[i % 40] + rng.normal(size=16) * 0.25).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 5)
    got = nearest(df, "id % 50 = 0", 5, factor=1.5).collect()
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_nearest_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert nearest(df, "id % 50 = 0").collect() == []
    assert nearest(df.limit(0), "id % 50 = 0").collect() == []


def test_a_tree_of_copies_ends():
    x = np.ones((1000, 4))
    best = Best(1, 3, np.array([np.inf]))
    VPTree(np.arange(1000), x).search(np.array([5]), x[:1], best, 1.0)
    assert best.id[0].tolist() == [0, 1, 2]
