"""Page texts, archives and search by inner product."""

import base64
import hashlib
import html
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from verdictframe.llm import pages, topk, warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType()), T.StructField("digest", T.StringType())])
ODD = [
    (1, "http://a.example/x", None, "h", "d"),
    (2, None, "", "h", "d"),
    (3, "http://a.example/y?q=1#f", "<p>one", None, "d"),
    (4, "https://user@B.example:8080", "<p>one", "h", None),
    (4, "https://user@B.example:8080", "<p>one", "h", None),
    (None, "http://a.example/x", "<p>lone</p>", "h", "d"),
    (5, "http://a.example/x", "<div>" * 3000 + "deep é🙂\r\n\r\ntext", "h", "d"),
    (6, "not a url", "a < b & c &lt; d", "h", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, PAGES).repartition(3)


def test_main_text_of_given_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in pages.extract(table).collect()}
    for r in table.collect():
        article = re.sub(r'<div class="ad">.*?</div>', "", re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1])
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(filter(None, parts))
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


SITE = """<html><body class="has-sidebar"><header class="site"><h1>Site</h1></header><ul class="menu"><li><a>a</a><li>b</ul>
<div id="main"><div class="post-{n} entry"><h1>Title &amp; {n}</h1><p>First <b>para</b>
 text, long enough to be the best.<p>Second&nbsp;para<br>line <script>if (a<b) "</p>"</script>more</p>
<div class="share-buttons">Share</div><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><form>Name <input></form></div>
<div class="comments"><p>I disagree</p></div></div><div class="sidebar">x</div><div class="cookie-notice">We use</div><p hidden>hid</p><!-- no --></body>"""
TEXT = "Title & {n}\nFirst para text, long enough to be the best.\nSecond para line more\none\ntwo\nc1\nc2"


def test_furniture_and_consensus(spark):
    rows = [(n, f"http://h.example/{n}", SITE.format(n=n)) for n in range(6)]
    # a page whose longest text is elsewhere follows the other pages of its host
    rows.append((9, "http://h.example/9", SITE.format(n=9).replace('<div class="sidebar">x</div>', "<section><p>" + "Elsewhere there is much. " * 60 + "</p></section>")))
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in (0, 3, 9):
        assert got[n].text == TEXT.format(n=n)
    assert got[0].path == "html/body/div/div.entry.post-#"


def test_pages_odd_rows(spark, odd):
    rows = pages.extract(odd).collect()
    assert len(rows) == len(ODD)
    got = {r.page_id: r.text for r in rows}
    assert got[1] == got[2] == "" and got[3] == got[4] == "one" and got[5] == "deep é🙂 text" and got[6] == "a < b & c < d"
    assert pages.extract(odd.limit(0)).count() == 0


def test_broken_markup():
    text = lambda page: pages.main_text(page, [])[0]
    assert text('<p>one <a href="x>two</a> three</p><p title="a>b">four</p>') == "one two three\nfour"
    assert text("<p>one</p><div class=") == "one" and text("<p>one<!-- two") == "one"
    assert text("<ul><li>a<li>b</ul></ul></p>c") == "a\nb\nc"
    assert text("<article><h1>t</h1><ul><li>" + "long " * 50 + "</ul></article>").startswith("t\nlong")
    assert text('<p title="1 < 2">x</p>') in ("x", '2">x')
    assert text("<p>" + '<b title="' * 2000 + "end") is not None


def test_all_parts_of_the_main_text_are_kept():
    def text(page, paths=()):
        return pages.main_text(page, list(paths))[0]

    body = "<p>" + "Body text. " * 40 + "</p>"
    assert text(f"<body><article><header><h1>Title</h1></header><div class=entry-content>{body}</div></article>").startswith("Title\nBody")
    assert text(f"<body><div><div class=lead><p>{'Lead text. ' * 15}</div><div class=body>{body}</div></div>").startswith("Lead text.")
    assert "Second" in text(f"<body><main><section class=a>{body}</section><section class=b><p>{'Second. ' * 30}</section></main>")
    assert text(f"<body><div class=intro>{'Beside. ' * 30}</div><article>{body}</article>").startswith("Beside.")
    # pages without a lead decide for the host, and the lead of the others stays
    assert text(f"<body><div><div class=lead><p>Lead.</div><div class=body>{body}</div></div>", ["body/div/div.body"]).startswith("Lead.\nBody")


def test_rare_templates_and_pages_without_host_use_their_own_path(spark):
    often = "<body><div><p>" + "Common text. " * 30 + "</p></div></body>"
    rare = "<body><div><p>A caption.</p></div><article><h1>Own</h1><p>" + "Rare article. " * 60 + "</p></article></body>"
    rows = [(n, f"http://h.example/{n}", often) for n in range(20)] + [(20, "http://h.example/20", rare)]
    rows += [(n, None, often) for n in range(30, 50)] + [(50, None, rare), (51, "no url", rare)]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in (20, 50, 51):
        assert got[n].text.startswith("A caption.\nOwn\nRare article.")
    assert got[3].text.startswith("Common text.") and got[3].path == "body/div"
    assert {r.host for r in pages.votes(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"h.example"}


def test_names_of_subjects_are_not_furniture():
    def text(page):
        return pages.main_text(page, [])[0]

    long = "Words of the text that are no links at all. " * 5
    for part in (f"<h2 id=related-work>Kept</h2><p>{long}", f"<section id=search><p>Kept {long}</section>", f"<div class='social-history'><p>Kept {long}</div>", "<p class=notice>Kept", "<div class=commentary><p>Kept</div>"):
        assert "Kept" in text(f"<body><article><h1>Title</h1><p>{long}</p>{part}</article></body>")
        assert "Kept" in text(f"<body><div><h1>Title</h1><p>{long}</p>{part}</div></body>") or "id=search" in part
    for part in ("<div class=comments><p>Gone</div>", "<div class=share><a>Gone</a> <a>Gone</a></div>", f"<div class=related>{'<a>Gone and more</a> ' * 20}</div>", "<form><label>Gone</label><input></form>", "<nav>Gone</nav>"):
        assert text(f"<body><article><h1>Title</h1><p>{long}</p>{part}</article></body>") == f"Title\n{long.strip()}"
    page = f"<body><form id=aspnetForm><div id=page><h1>Title</h1><p>{long}</p><select><option>Gone</select><button>Gone</button></div></form></body>"
    assert text(page) == f"Title\n{long.strip()}"


MARKS = ("id=comments", "class=comments-area", "class=comment-list", "class=related-posts", "class=share-buttons", "class=ad-slot", "class=ad-banner", "class=cookie-notice", "class=newsletter-signup",
         "class=sidebar-right", "id=sidebar", "class=notice", "class=replies", "id=share-buttons-2", 'class="box advert"')


@pytest.mark.parametrize("wrap", ["article", "main", "div role=main"])
@pytest.mark.parametrize("mark", MARKS)
def test_furniture_inside_articles(wrap, mark):
    """Comments, adverts, notices and bars go whatever their length; what is around them stays."""
    long = "<p>" + "Words of the text that are no links at all. " * 12 + "</p>"
    gone = "<p>" + "Gone is this sentence of many words. " * 4 + "</p>"
    page = f"<body><{wrap}><h1>Title</h1>{long}<div {mark}>{gone}</div>{long}</{wrap.split()[0]}></body>"
    assert pages.main_text(page, [])[0] == "\n".join(["Title", *[re.sub("<.*?>", "", long).strip()] * 2])


def test_names_that_only_hold_a_word_of_furniture_stay():
    long = "Words of the text that are no links at all. " * 12
    for mark in ("class=ad-hoc-methods", "class=cookie-recipe", "id=notice", "class=social-history", "id=search", "class=related-work", "class=has-sidebar"):
        assert "Kept" in pages.main_text(f"<body><article><p>{long}</p><div {mark}><p>Kept sentence.</p></div></article></body>", [])[0]
    # what holds most of an article is its text
    assert "Kept" in pages.main_text(f"<body><article><h1>Title</h1><div class=notice><p>Kept {long}</p></div></article></body>", [])[0]


def test_teasers_under_the_path_of_the_host_do_not_hide_the_story():
    story = "<p>" + "The story goes on and on. " * 60 + "</p>"
    teasers = "".join(f"<div class=entry><p>Teaser number {k} of three for other pages.</p></div>" for k in range(3))
    text, path = pages.main_text(f"<body><div class=wrap>{teasers}</div><div class=story>{story}</div></body>", ["body/div.wrap/div.entry"])
    assert "The story goes on" in text and path == "body"


def test_unclosed_containers_take_time_in_proportion():
    import time

    for page in ("<div>t" * 5000, "<div class=notice>t" * 5000, "<article><div class=share>t" * 2500, "<div><p>t</div>" * 5000):
        start = time.perf_counter()
        pages.main_text(page, ["div/div/div"])
        assert time.perf_counter() - start < 1.5


def expected(rows):
    groups = defaultdict(list)
    for page_id, _, page, *_ in rows:
        groups[page or ""].append(page_id)
    out = []
    for page_id, _, page, *_ in rows:
        data, top = (page or "").encode(), max((i for i in groups[page or ""] if i is not None), default=None)
        first = page_id == top
        out.append((str(page_id), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def test_archive_round_trip(spark, odd):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for table in (odd, given):
        rows = [tuple(r) for r in table.collect()]
        got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(table).collect()]
        assert sorted(got, key=str) == expected(rows)
    assert warc.round_trip(odd.limit(0)).count() == 0


def test_small_payloads_are_never_revisits(spark):
    table = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://a/", "x"), (3, "http://b/", "long"), (4, "http://b/", "long")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(table, least=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_index_over_many_blocks(spark, monkeypatch):
    """Lookups find keys at the borders of blocks and files, and none that are not there."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    table = spark.createDataFrame([(i, f"http://h{i % 5}.example/p{i % 11}", f"<p>{i}") for i in range(200)], "page_id long, url string, html string")
    folder = warc.scratch_path(spark, "test-warc")
    captures = warc.materialize(warc.write(table, folder), "captures")
    root = warc.build_index(captures, folder)
    missing = spark.createDataFrame([("zzz", 1), ("", 5), ("example,h1)/p1", 999)], "url_key string, page_id long")
    lines = warc.materialize(warc.look_up(spark, warc.keys_of(table).union(missing), root), "lines")
    assert sorted(r.id for r in lines.collect()) == list(range(200))
    assert {r.page_id: r.payload.decode() for r in warc.fetch(lines).collect()} == {i: f"<p>{i}" for i in range(200)}


def test_url_keys():
    assert warc.url_key("https://user@www.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"
    assert warc.url_key("http://example.com:80") == "com,example)/" and warc.url_key(None) == ""


def brute(rows, k):
    vectors = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i: v for i, v in vectors if i % 50 == 0}.items():
        found = sorted((-int(np.dot(q[1][: len(v)], v[: len(q[1])])), i) for i, v in vectors if i != q[0])[:k]
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_search_odd_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=9).round(1).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 9) for i in range(300, 380)]  # ties
    rows += [(400, None), (450, [1.0, None]), (None, [1.0] * 9), (500, [float("nan")] * 9), (550, [float("inf")] * 9), (600, []), (650, [2.0, -3.0]), (7, [0.5] * 9), (700, [0.0, 0.0, 9.5] + [0.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS score", "3 AS rank", "4 AS matrix").repartition(5)
    for k in (5, 500):
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, table["vec_id"] % 50 == 0, k).collect()]
        assert sorted(got) == brute(rows, k)
    assert topk.top_k(table.limit(0), table["vec_id"] % 50 == 0, 5).count() == 0


def test_scores_of_large_numbers():
    draw = np.random.default_rng(4)
    for most in (100, 1 << 20, 1 << 28):
        q, c = draw.integers(-most, most, (7, 20)), draw.integers(-most, most, (30, 20))
        c[:, 3] = 0
        assert (topk.scores(q, c).astype(np.int64) == q @ c.T).all()


def test_search_sends_no_blocks_through_the_driver(spark):
    """However many shuffle partitions there are, queries are not copied for each and broadcast."""
    draw = np.random.default_rng(6)
    table = spark.createDataFrame([(i, draw.normal(size=16).round(2).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        found = topk.top_k(table, table["vec_id"] % 50 == 0, 5)
        assert found.count() == 8 * 5
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows) == brute(table.collect(), 5)


def test_search_in_many_parts_and_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_BYTES", 1500)
    monkeypatch.setattr(topk, "TASK_WORK", 100)
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(size=9).round(1).tolist()) for i in range(900)] + [(i, [0.5] * 9) for i in range(900, 980)] + [(1000, [900.0, -3.0])]
    rows += [(i, draw.normal(size=9).round(1).tolist()) for i in range(7)] * 2  # ids 0 to 6 come again, with other vectors, twice
    parts, groups = topk.shares(20, len(rows), 9, 5, spark.sparkContext.defaultParallelism)
    assert parts > 2 and groups > 10
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, (table["vec_id"] % 50 == 0) & (table["vec_id"] > 0), 5).collect())
    assert got == [r for r in brute(rows, 5) if r[0]]


def test_best_of_many_blocks_equal_those_of_all(monkeypatch):
    """Ties go to the smaller id whatever block it comes in; own rows are no candidates; blocks differ in width and kind."""
    for name, size in (("QUERY_ROWS", 7), ("CANDIDATE_ROWS", 16), ("AT_ONCE", 4)):
        monkeypatch.setattr(topk, name, size)
    draw = np.random.default_rng(8)
    for most in (2, 100, 1 << 20, 1 << 28):
        pieces = [(draw.integers(0, 60, n), draw.integers(-most, most, (n, width)).astype(kind)) for n, width, kind in ((30, 5, np.int64), (1, 5, np.int32), (9, 3, np.int64), (40, 5, np.int64), (12, 0, np.int8))]
        asking = [(np.arange(n, n + 10), draw.integers(-most, most, (10, 5))) for n in (50, 0)]
        for k in (1, 3, 200):
            blocks = topk.search([(False, *a) for a in asking] + [(True, *p) for p in pieces], k)
            got = sorted((int(q), int(i), int(s)) for b in blocks for q, i, s in zip(b.names[b.row], b.name, b.score, strict=True))
            found = []
            for q, left in ((q, left) for names, matrix in asking for q, left in zip(names, matrix, strict=True)):
                every = sorted((-int(left[: m.shape[1]] @ right[:5]), int(i)) for ids, m in pieces for i, right in zip(ids, m.astype(np.int64), strict=True) if i != q)
                found += [(int(q), i, -s) for s, i in every[:k]]
            assert got == sorted(found)
    assert not [b for b in topk.search([], 3)]


def test_parts_fit_and_copies_are_bounded():
    for asked, there, width, k in ((0, 0, 1, 5), (1, 10**7, 64, 5), (1026, 51_282, 64, 5), (308_000, 15_400_000, 64, 5), (10**6, 10**6, 768, 100)):
        parts, groups = topk.shares(asked, there, width, k, 6)
        assert asked * 4 * width <= parts * topk.PART_BYTES
        assert there * width <= groups * topk.GROUP_SIZE
        # queries go to each group, candidates to each part
        assert asked * groups <= max(2 * there * parts, 4 * 6 * asked + asked * (1 + there * width / topk.GROUP_SIZE))
    assert topk.shares(40, 2000, 64, 5, 6) == (1, 1)


def test_scores_of_sparse_vectors():
    draw = np.random.default_rng(9)
    for share in (0.01, 0.1, 0.9):
        q, c = (draw.integers(-50, 50, (n, 30)) * (draw.random((n, 30)) < share) for n in (11, 200))
        assert (topk.scores(q, c).astype(np.int64) == q @ c.T).all()
        assert (topk.scores(q[:, :4], c).astype(np.int64) == q[:, :4] @ c[:, :4].T).all()
