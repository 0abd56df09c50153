import hashlib
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from quillspan.functions import html, urls
from quillspan.operators import crawl
from quillspan.plans import fixtures
from quillspan.sources import writers
from quillspan.streaming import ingest


def plain_normal(url):
    p = urlsplit(url)
    path = p.path[:-1] if p.path.endswith("/") and p.path != "/" else p.path
    return f"{p.scheme.lower()}://{p.netloc.lower()}{path}" + (f"?{p.query}" if p.query else "")


def test_urls(spark):
    cases = ["HTTP://A.Example.com/X/", "http://a.com/", "http://a.com", "http://a.com/x//", "http://a.com/x?q=A#f", "http://a.com/x/?", "https://B.com/p/?utm_source=x#y"]
    df = spark.createDataFrame([(c,) for c in cases], "u string")
    for r in df.select("u", urls.normalize_url("u").alias("n"), urls.url_hash("u").alias("h")).collect():
        assert r["n"] == plain_normal(r["u"])
        assert r["h"] == hashlib.md5(r["n"].encode()).hexdigest()


def test_block_pages(spark):
    rows = [(403, "x"), (200, "Please solve the CAPTCHA"), (200, "captcha" + "x" * 5000), (200, "fine"), (None, None), (404, "Доступ Ограничен")]
    df = spark.createDataFrame(rows, "status int, html string")
    assert [r[0] for r in df.select(crawl.blocked(F.col("status"), F.col("html"))).collect()] == [True, True, False, False, False, True]


def test_article_rules():
    for source, page, want in fixtures.ARTICLES:
        assert html.extract_article(page, html.ARTICLE_RULES.get(source)) == want
    assert html.extract_article(None, html.ARTICLE_RULES["consultant"]) is None


def test_listing(spark):
    page = "<div class='news'><a class='t' href='/a'>A</a><a class='t' href='b'>B</a></div><a class='next' href='?p=2'>n</a><a href='/c'>C</a>"
    df = spark.createDataFrame([(page, "http://h/x/"), (None, "http://h/")], "html string, url string")
    got = [r[0] for r in df.select(html.parse_listing(F.col("html"), F.col("url"), ".news a.t", "a.next")).collect()]
    assert (list(got[0]["urls"]), got[0]["next_url"]) == (["http://h/a", "http://h/x/b"], "http://h/x/?p=2")
    assert (list(got[1]["urls"]), got[1]["next_url"]) == ([], None)


def test_clean_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><nav>menu</nav><p>a &amp; b</p><!-- c --><script>x('<p>')</script><footer>f</footer> d</html>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    assert [r[0] for r in df.select(html.clean_html()).collect()] == ["T a & b d", "", ""]


def test_report_and_export(spark):
    raw = spark.createDataFrame([(1, "consultant_x", "<p>ab</p>"), (2, "other", "<p></p>"), (3, None, None)], "id long, s string, html string")
    stats = crawl.corpus_stats(raw, "s", "html", "consultant")
    row = stats.first()
    assert (row["docs"], row["docs_a"], row["docs_b"], row["raw_bytes"], row["text_bytes"]) == (3, 1, 2, 16, 2)
    assert "Documents: 3 (1 / 2)" in writers.corpus_report(stats)
    assert crawl.corpus_stats(raw.limit(0), "s", "html", "x").first()["text_percent"] is None
    assert "0 (0 / 0)" in writers.corpus_report(crawl.corpus_stats(raw.limit(0), "s", "html", "x"))
    kept, counts = crawl.export_corpus(raw, html.clean_html())
    assert [r["id"] for r in kept.collect()] == [1]
    assert counts.first()[:] == (1, 2)


def test_ingest_adds_each_url_once(spark, tmp_path):
    landing, store, ck = (str(tmp_path / n) for n in ("landing", "store", "ck"))
    page = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    page([(1, "http://a.com/x/", "1"), (2, "http://A.com/x", "2"), (3, "http://a.com/y", "3")]).write.mode("append").parquet(landing)
    run = lambda at: ingest.start_ingest(spark, landing, store, at).awaitTermination(60)
    ids = lambda: sorted(r["page_id"] for r in spark.read.parquet(store).collect())
    run(ck)
    assert ids() == [1, 3]
    page([(4, "http://a.com/y#f", "4"), (5, "http://a.com/z", "5")]).write.mode("append").parquet(landing)
    run(ck)
    assert ids() == [1, 3, 5]
    run(ck)
    run(str(tmp_path / "fresh"))
    assert ids() == [1, 3, 5]


def test_counters(spark):
    log = spark.createDataFrame([(1, 200, "ok", False), (1, 200, "ok", True), (1, 403, "", False), (2, 404, "", False)], "page_no int, status int, html string, known boolean")
    got = {r["page_no"]: r[1:] for r in crawl.crawl_counters(log, ["page_no"]).collect()}
    assert got == {1: (3, 1, 1, 1, 0), 2: (1, 0, 0, 0, 1)}


def test_retries(spark):
    from quillspan.streaming import crawl_loop

    answers = [{"a": (None, None), "b": (403, "no"), "c": (500, "x"), "d": (200, "D")}, {"a": (200, "A"), "b": (403, "no")}, {"b": (200, "B")}]
    asked, paused = [], []

    def fetch(urls):
        asked.append(sorted(r["url"] for r in urls.collect()))
        return spark.createDataFrame([(u, *answers[len(asked) - 1][u]) for u in asked[-1]], "url string, status int, html string")

    got = crawl_loop.fetch_patiently(fetch, spark.createDataFrame([(u,) for u in "abcd"], "url string"), 1.0, paused.append)
    assert {r["url"]: r["html"] for r in got.collect()} == {"a": "A", "b": "B", "c": "x", "d": "D"}
    assert asked == [["a", "b", "c", "d"], ["a", "b"], ["b"]] and paused == [60.0, 60.0]
    lost = lambda urls: urls.selectExpr("url", "cast(null as int) as status", "cast(null as string) as html")
    paused.clear()
    assert [tuple(r) for r in crawl_loop.fetch_patiently(lost, spark.createDataFrame([("a",)], "url string"), 1.0, paused.append).collect()] == [("a", None, None)]
    assert [round(p, 3) for p in paused] == [2.1, 4.1]


def test_deep_pages():
    page = "<div class='news-page__text'><p>a</p>" + "<div>" * 20_000 + "x" + "</div>" * 20_000 + "<p>b</p></div>"
    assert html.extract_article(page, html.ARTICLE_RULES["consultant"]) == "\na\nb"


def test_crawl_loop(spark, tmp_path):
    from quillspan.sources.readers import CrawlSource
    from quillspan.streaming import crawl_loop

    listing = lambda links, after: "".join(f"<a class='t' href='{u}'>x</a>" for u in links) + (f"<a class='n' href='{after}'>n</a>" if after else "")
    web = {
        "http://h/1": (200, listing(["/a", "/b/", "/gone"], "/2")),
        "http://h/2": (200, listing(["/b", "/bad"], "/2")),
        "http://h/a": (200, "A"),
        "http://h/b/": (200, "B"),
        "http://h/bad": (403, "no"),
        "http://h/gone": (404, None),
    }
    pages = spark.createDataFrame([(u, *v) for u, v in web.items()], "url string, status int, html string").cache()
    fetch = lambda urls: urls.join(pages, "url")
    store = str(tmp_path / "store")
    source = CrawlSource("s", "http://h/1", "a.t", "a.n", 5)
    paused = []
    counts = crawl_loop.crawl(spark, [source], fetch, store, 1700000000, pause=paused.append)
    assert paused == [60.0, 60.0]
    assert [(c.page, c.listed, c.known, c.saved, c.refused) for c in counts] == [(1, 3, 0, 2, 1), (2, 2, 1, 0, 1)]
    assert sorted(r["raw_html"] for r in spark.read.parquet(store).collect()) == ["A", "B"]
    again = crawl_loop.crawl(spark, [source], fetch, store, 1700000001, pause=paused.append)
    assert [c.saved for c in again] == [0, 0] and spark.read.parquet(store).count() == 2
    assert crawl_loop.crawl(spark, [CrawlSource("x", "http://h/none", "a", "b", 3)], fetch, store, 0) == []
    assert (crawl_loop.delay(1.0, 2, jitter=0.0), crawl_loop.delay(1.0, 1, True)) == (4.0, 60.0)


def test_numbered_listings_are_asked_for_together(spark, tmp_path):
    from quillspan.sources.readers import CrawlSource
    from quillspan.streaming import crawl_loop

    numbers = [n for n in range(1, 61) if n != 40]  # a gap, after which the chain goes on
    listing = lambda n, after: f"<a class='t' href='/a{n}'>x</a><a class='t' href='/a{n - 1}'>x</a><a class='t' href='/gone{n // 10}'>x</a>" + (f"<a class='n' href='/l/{after}'>n</a>" if after else "")
    web = [(f"http://h/l/{n}", 200, listing(n, after)) for n, after in zip(numbers, [*numbers[1:], None])] + [(f"http://h/a{n}", 200, f"A{n}") for n in range(61)]
    pages = spark.createDataFrame(web, "url string, status int, html string").cache()
    asked = []

    def fetch(urls):
        asked.append(urls.count())
        return urls.join(pages, "url")

    store = str(tmp_path / "store")
    counts = crawl_loop.crawl_source(spark, CrawlSource("s", "http://h/l/1", "a.t", "a.n", 1000), fetch, store, 0)
    assert [c.page for c in counts] == list(range(1, 60)) and [c.url for c in counts] == [f"http://h/l/{n}" for n in numbers]
    assert [(c.listed, c.known, c.saved, c.refused) for c in counts] == [(3, 0, 2, 1) if n in (1, 41) else (3, 1, 1, 1) for n in numbers]
    assert sorted(r["raw_html"] for r in spark.read.parquet(store).collect()) == sorted(f"A{n}" for n in range(61))
    assert len(asked) <= 8  # before: one fetch of a listing and one of its articles for each of 59 pages
    assert crawl_loop.following("http://h/p009?x", 2) == "http://h/p011?x" and crawl_loop.following("http://h/x", 1) is None
    assert len(crawl_loop.crawl_source(spark, CrawlSource("s", "http://h/l/1", "a.t", "a.n", 12), fetch, store, 1)) == 12


def test_batches_of_pages_are_bounded_by_bytes(spark):
    from quillspan.functions.text import BATCH_BYTES

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "256m")
    pages = spark.createDataFrame([(source, page) for source, page, _ in fixtures.ARTICLES], "source string, html string")
    got = pages.select(html.article_text("source", "html").alias("t")).collect()
    assert [r["t"] for r in got] == [want for *_, want in fixtures.ARTICLES]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == BATCH_BYTES  # before: 256m, batches bounded by rows alone
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_counted_ingest_lands_in_many_files(spark, tmp_path, monkeypatch):
    from quillspan.plans import catalog

    rows = [(k, f"http://a.com/{k % 20}", "x") for k in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    landed, start = [], ingest.start_ingest
    monkeypatch.setattr(catalog.ingest, "start_ingest", lambda s, landing, *a, **k: landed.append(len(s.read.parquet(landing).inputFiles())) or start(s, landing, *a, **k))
    monkeypatch.setattr(catalog, "_pages", lambda s, d: spark.read.parquet(f"{d}/pages.parquet").repartition(3))
    got = [tuple(r) for r in catalog.ingest_counters(spark, str(tmp_path)).collect()]
    assert got == [(30, 10, 0, 20), (30, 10, 20, 0)]
    assert landed == [3, 3]  # before: one file, written by one task
