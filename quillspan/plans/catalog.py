"""Registry of the named queries over the driver's tables, and of their DuckDB counterparts."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..functions import urls as U
from ..functions.stemmer import stem_word, with_stem
from ..functions.text import fold
from ..operators import crawl, index, search, zipf
from ..sources import readers
from ..sources.readers import table
from ..sources.schemas import PAGES
from ..sources.writers import corpus_report, results_json, write_corpus, write_frequencies
from ..streaming import crawl_loop, ingest, recrawl
from . import fixtures, sql
from .query_language import rpn_text
from .registry import ORACLES, QUERIES, register  # noqa: F401

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _searcher(spark: SparkSession, sf_dir: str) -> search.Searcher:
    return search.Searcher(_docs(spark, sf_dir))


_P = f"WITH p AS ({sql.POSTINGS}) "


# Sources and titles


@register("scan_documents", "SELECT doc_id, strlen(text)::BIGINT AS n_bytes FROM documents")
def scan_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@register("doc_title", f"SELECT doc_id, {sql.TITLE} AS title FROM documents")
def doc_title(spark, sf_dir):
    return index.titles(_docs(spark, sf_dir))


@register("doc_by_id", "SELECT doc_id, text FROM documents WHERE doc_id = 17")
def doc_by_id(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("doc_id") == 17)


# Tokens and stems


@register("tokenize", sql.PLACED)
def tokenize(spark, sf_dir):
    return index.positioned_tokens(_docs(spark, sf_dir))


@register("doc_token_counts", f"SELECT doc_id, token, count(*) AS n FROM ({sql.TOKENS}) GROUP BY ALL")
def doc_token_counts(spark, sf_dir):
    return index.tokens(_docs(spark, sf_dir)).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@register(
    "token_stats",
    f"""WITH f AS ({sql.FREQUENCIES})
    SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(strlen(text))::BIGINT FROM documents) AS n_bytes,
           sum(frequency)::BIGINT AS n_tokens, count(*) AS n_terms, sum(frequency * strlen(term))::DOUBLE / sum(frequency) AS mean_token_bytes FROM f""",
)
def token_stats(spark, sf_dir):
    return index.token_stats(_docs(spark, sf_dir))


@register(
    "stem_vocabulary",
    f"""WITH v AS (SELECT translate(token, '{fixtures.LETTERS[0]}', '{fixtures.LETTERS[1]}') AS token, count(*) AS frequency FROM ({sql.TOKENS}) GROUP BY 1)
    SELECT v.token, v.frequency, s.term FROM v JOIN ({sql.stems('SELECT token FROM v')}) s USING (token)""",
)
def stem_vocabulary(spark, sf_dir):
    letters = index.tokens(_docs(spark, sf_dir)).select(F.translate("token", *fixtures.LETTERS).alias("token"))
    return index.vocabulary(letters)


_HEADS = f"SELECT DISTINCT left(translate(token, '{fixtures.LETTERS[0]}', '{fixtures.LETTERS[1]}'), 5) AS head FROM ({sql.TOKENS})"
_FORMS = f"SELECT DISTINCT head || ending AS word FROM ({_HEADS}), (VALUES {', '.join(f'({sql.quoted(e)})' for e in fixtures.ENDINGS)}) e(ending)"


@register("stem_vectors", f"SELECT token AS word, term AS stem, term AS scalar FROM ({sql.stems(f'SELECT word AS token FROM ({_FORMS})')})")
def stem_vectors(spark, sf_dir):
    """The documents' words, transliterated and put into Russian forms: stems by the columns and by the scalar twin."""
    heads = index.tokens(_docs(spark, sf_dir)).select(F.substring(F.translate("token", *fixtures.LETTERS), 1, 5).alias("head")).distinct()
    words = heads.select(F.explode(F.array(*[F.concat("head", F.lit(e)) for e in fixtures.ENDINGS])).alias("word")).distinct()

    @F.pandas_udf("string")
    def scalar(column: pd.Series) -> pd.Series:
        return column.map(stem_word)

    return with_stem(words, "word", "stem").withColumn("scalar", scalar("word"))


_CAPITALS = f"SELECT DISTINCT upper(translate(token, '{fixtures.LETTERS[0]}', '{fixtures.LETTERS[1]}')) AS word FROM ({sql.TOKENS})"


@register("fold_vectors", f"SELECT word, {sql.fold('word')} AS folded, {sql.fold('word', 'cyrillic')} AS cyrillic FROM ({_CAPITALS})")
def fold_vectors(spark, sf_dir):
    """The documents' words in Cyrillic capitals, folded in both modes."""
    words = index.tokens(_docs(spark, sf_dir)).select(F.upper(F.translate("token", *fixtures.LETTERS)).alias("word")).distinct()
    return words.select("word", fold("word").alias("folded"), fold("word", "cyrillic").alias("cyrillic"))


# Frequencies


@register("term_freq", sql.FREQUENCIES)
def term_freq(spark, sf_dir):
    return index.term_frequencies(_docs(spark, sf_dir))


@register("term_freq_lookup", f"WITH f AS ({sql.FREQUENCIES}) SELECT a.term, coalesce(f.frequency, 0) AS frequency FROM (VALUES ('the'), ('der'), ('zzz')) a(term) LEFT JOIN f USING (term)")
def term_freq_lookup(spark, sf_dir):
    return index.frequency_of(term_freq(spark, sf_dir), ["the", "der", "zzz"])


_RANKED = f"SELECT term, frequency, row_number() OVER (ORDER BY frequency DESC, term) AS rank FROM ({sql.FREQUENCIES})"


@register("zipf_rank", _RANKED)
def zipf_rank(spark, sf_dir):
    return zipf.ranked(term_freq(spark, sf_dir))


@register("zipf_expected", f"SELECT term, frequency, rank, (max(frequency) OVER ())::DOUBLE / rank AS zipf_expected, round(log10(rank), 9) AS log_rank, round(log10(frequency), 9) AS log_frequency FROM ({_RANKED})")
def zipf_expected(spark, sf_dir):
    logs = [F.round(c, 9).alias(c) for c in ("log_rank", "log_frequency")]
    return zipf.with_expected(zipf_rank(spark, sf_dir)).select("term", "frequency", "rank", "zipf_expected", *logs)


@register("top_terms", f"SELECT term, frequency FROM ({sql.FREQUENCIES}) ORDER BY frequency DESC, term LIMIT 10")
def top_terms(spark, sf_dir):
    return zipf.top_terms(term_freq(spark, sf_dir))


@register("freq_of_freq", f"SELECT frequency, count(*) AS n_terms FROM ({sql.FREQUENCIES}) GROUP BY frequency")
def freq_of_freq(spark, sf_dir):
    return zipf.frequency_of_frequencies(term_freq(spark, sf_dir))


@register("mandelbrot")
def mandelbrot(spark, sf_dir):
    """The Zipf-Mandelbrot law fitted to the documents' terms."""
    fitted = zipf.mandelbrot(zipf.rank_classes(term_freq(spark, sf_dir)))
    return spark.createDataFrame([(fitted.scale, fitted.shift, fitted.exponent, fitted.error)], "scale double, shift double, exponent double, error double")


# Index


@register("postings_flat", sql.POSTINGS)
def postings_flat(spark, sf_dir):
    return index.postings_flat(_docs(spark, sf_dir))


@register("inverted_index", _P + "SELECT term, doc_id // 65536 AS block, count(*) AS doc_freq, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS postings FROM p GROUP BY ALL")
def inverted_index(spark, sf_dir):
    built = index.inverted_index(postings_flat(spark, sf_dir))
    return built.select("term", "block", "doc_freq", F.array_join(F.col("postings").cast("array<string>"), ",").alias("postings"))


@register("index_stats", _P + "SELECT count(*) AS n_terms, avg(strlen(term)) AS mean_term_bytes FROM (SELECT DISTINCT term FROM p)")
def index_stats(spark, sf_dir):
    return index.index_stats(postings_flat(spark, sf_dir))


@register("doc_freq", _P + "SELECT term, count(*) AS doc_freq FROM p GROUP BY term")
def doc_freq(spark, sf_dir):
    return index.document_frequencies(postings_flat(spark, sf_dir))


# Boolean search


@register("term_lookup", _P + "SELECT doc_id FROM p WHERE term = 'the'")
def term_lookup(spark, sf_dir):
    return _searcher(spark, sf_dir).lookup([search.normalize_term("The")]).select("doc_id")


_ALL = "SELECT doc_id FROM documents WHERE "


@register("bool_and", _P + _ALL + f"doc_id IN {sql.docs_with('the')} AND doc_id IN {sql.docs_with('of')}")
def bool_and(spark, sf_dir):
    return _searcher(spark, sf_dir).search_sets("the && of")


@register("bool_or", _P + _ALL + f"doc_id IN {sql.docs_with('the')} OR doc_id IN {sql.docs_with('der')}")
def bool_or(spark, sf_dir):
    return _searcher(spark, sf_dir).search_sets("the || der")


@register("bool_not", _P + _ALL + f"doc_id NOT IN {sql.docs_with('the')}")
def bool_not(spark, sf_dir):
    return _searcher(spark, sf_dir).search_sets("!the")


@register("bool_and_not", _P + f"SELECT doc_id FROM p WHERE term = 'the' EXCEPT SELECT doc_id FROM p WHERE term = 'of'")
def bool_and_not(spark, sf_dir):
    s = _searcher(spark, sf_dir)
    return search.difference(s.lookup(["the"]).select("doc_id"), s.lookup(["of"]).select("doc_id"))


_NESTED = f"(doc_id IN {sql.docs_with('the')} OR doc_id IN {sql.docs_with('der')}) AND doc_id NOT IN {sql.docs_with('and')}"
NESTED = "(the || der) && !and"


@register("bool_nested", _P + _ALL + _NESTED)
def bool_nested(spark, sf_dir):
    return _searcher(spark, sf_dir).search(NESTED)


@register("search_titles", _P + f"SELECT doc_id, {sql.TITLE} AS title FROM documents WHERE {_NESTED}")
def search_titles(spark, sf_dir):
    s = _searcher(spark, sf_dir)
    return s.with_titles(s.search(NESTED))


@register("search_count", _P + f"SELECT count(*) AS n_hits, ceil(count(*) / 20.0)::BIGINT AS n_pages FROM documents WHERE {_NESTED}")
def search_count(spark, sf_dir):
    return search.page_count(_searcher(spark, sf_dir).search(NESTED))


@register("search_top10", _P + f"SELECT doc_id, {sql.TITLE} AS title FROM documents WHERE {_NESTED} ORDER BY doc_id LIMIT 10")
def search_top10(spark, sf_dir):
    s = _searcher(spark, sf_dir)
    return s.with_titles(search.first_hits(s.search(NESTED)))


@register("search_page", _P + f"SELECT doc_id FROM documents WHERE {_NESTED} ORDER BY doc_id LIMIT 20 OFFSET 20")
def search_page(spark, sf_dir):
    return search.page(_searcher(spark, sf_dir).search(NESTED), 1)


@register("search_json", _P + f"""SELECT '{{"count":' || count(*) || ',"results":[' || string_agg('{{"id":' || doc_id || ',"title":' || to_json(title) || '}}', ',' ORDER BY doc_id) || ']}}' AS json
    FROM (SELECT doc_id, {sql.TITLE} AS title FROM documents WHERE {_NESTED})""")  # fmt: skip
def search_json(spark, sf_dir):
    return results_json(search_titles(spark, sf_dir))


_TERMS = ("the", "of", "in", "der", "and", "zzz", "de", "la")
_FLAGS = ", ".join(f"coalesce(bool_or(term = '{t}'), FALSE) AS {t if t not in ('of', 'in', 'and') else t + '_'}" for t in _TERMS)


@register(
    "search_batch",
    _P
    + f", f AS (SELECT d.doc_id, {_FLAGS} FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id AND p.term IN ({', '.join(map(sql.quoted, _TERMS))}) GROUP BY d.doc_id) "
    + " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, doc_id FROM f WHERE {c}" for i, c in fixtures.BATCH_SQL.items()),
)
def search_batch(spark, sf_dir):
    return _searcher(spark, sf_dir).search_batch(fixtures.BATCH)


@register("total_docs", "SELECT count(*) AS n_docs FROM documents")
def total_docs(spark, sf_dir):
    return _searcher(spark, sf_dir).total_docs()


_FIRST = f"SELECT doc_id, max(token) FILTER (place = 0) AS a, max(token) FILTER (place = 1) AS b, max(token) FILTER (place = 2) AS c FROM ({sql.PLACED}) WHERE place < 3 GROUP BY doc_id HAVING count(*) = 3"


@register("parse_rpn", " UNION ALL ".join(f"SELECT doc_id, {k} AS form, {rpn} AS rpn FROM ({_FIRST})" for k, (_, rpn) in enumerate(fixtures.FORMS)))
def parse_rpn(spark, sf_dir):
    """Queries of several forms, malformed ones too, made of each document's first three tokens, in reverse Polish form."""
    first = index.positioned_tokens(_docs(spark, sf_dir)).where("place < 3").groupBy("doc_id").agg(*[F.max(F.when(F.col("place") == k, F.col("token"))).alias(n) for k, n in enumerate("abc")])

    @F.pandas_udf("string")
    def rpn(queries: pd.Series) -> pd.Series:
        return queries.map(rpn_text)

    made = [F.struct(F.lit(k).alias("form"), F.format_string(form.format(a="%1$s", b="%2$s", c="%3$s"), "a", "b", "c").alias("query")) for k, (form, _) in enumerate(fixtures.FORMS)]
    return first.where("c IS NOT NULL").select("doc_id", F.explode(F.array(*made)).alias("q")).select("doc_id", "q.form", rpn("q.query").alias("rpn"))


# Search in Cyrillic: the documents transliterated, so that different tokens share a stem


def _cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin capitals become small Cyrillic letters in the same pass; all others are folded when the text is cut into tokens."""
    letters, cyrillic = fixtures.LETTERS
    latin = letters[:26]
    return _docs(spark, sf_dir).select("doc_id", F.translate("text", letters + latin.upper(), cyrillic + cyrillic[:26]).alias("text"))


_CYRILLIC = f"SELECT doc_id, translate(token, '{fixtures.LETTERS[0]}', '{fixtures.LETTERS[1]}') AS token FROM ({sql.TOKENS})"
_PC = f"WITH v AS ({_CYRILLIC}), p AS (SELECT DISTINCT s.term, v.doc_id FROM v JOIN ({sql.stems('SELECT token FROM v')}) s USING (token)) "


@register("cyrillic_lookup", _PC + "SELECT term, doc_id FROM p WHERE term IN ('тхе', 'еин', 'ерх')")
def cyrillic_lookup(spark, sf_dir):
    return search.Searcher(_cyrillic(spark, sf_dir)).lookup(["тхе", "еин", "ерх"])


@register("cyrillic_and_not", _PC + "SELECT doc_id FROM p WHERE term = 'тхе' EXCEPT SELECT doc_id FROM p WHERE term = 'ерх'")
def cyrillic_and_not(spark, sf_dir):
    s = search.Searcher(_cyrillic(spark, sf_dir))
    return search.difference(s.lookup(["тхе"]).select("doc_id"), s.lookup(["ерх"]).select("doc_id"))


@register("cyrillic_nested", _PC + _ALL + f"(doc_id IN {sql.docs_with('тхх')} OR doc_id IN {sql.docs_with('еин')}) AND doc_id NOT IN {sql.docs_with('анд')}")
def cyrillic_nested(spark, sf_dir):
    return search.Searcher(_cyrillic(spark, sf_dir)).search("(тхх || Еин) && !анд")


@register("cyrillic_postings", _PC + "SELECT term, doc_id FROM p")
def cyrillic_postings(spark, sf_dir):
    return index.postings_flat(_cyrillic(spark, sf_dir))


# Crawl, corpus and HTML


@register("normalize_url", f"SELECT page_id, {sql.normalize_url('url')} AS normalized_url FROM pages")
def normalize_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.normalize_url("url").alias("normalized_url"))


@register("url_hash", f"SELECT page_id, md5({sql.normalize_url('url')}) AS url_hash FROM pages")
def url_hash(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.url_hash("url").alias("url_hash"))


_LINKS = """SELECT page_id, h.href AS href, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*') AS head, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS w FROM pages) p, LATERAL (SELECT unnest(['/' || w, w, '../' || w, '//h.example.org/' || w, '?q=' || w, 'https://h.example.org/' || w]) AS href) h"""


@register(
    "url_join",
    f"""SELECT page_id, href, CASE WHEN href LIKE 'https:%' THEN href WHEN href LIKE '//%' THEN scheme || ':' || href WHEN href LIKE '/%' THEN head || href WHEN href LIKE '?%' THEN head || path || href
    WHEN href LIKE '../%' THEN head || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || substr(href, 4) ELSE head || regexp_replace(path, '[^/]*$', '') || href END AS url FROM ({_LINKS})""",
)
def url_join(spark, sf_dir):
    """Every link of the pages, in six ways to write one, as an absolute URL."""
    words = _pages(spark, sf_dir).select("page_id", F.col("url").alias("page"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("w"))
    forms = F.array(*[F.concat(F.lit(before), "w") for before in ("/", "", "../", "//h.example.org/", "?q=", "https://h.example.org/")])
    links = words.select("page_id", "page", F.explode(forms).alias("href"))
    return links.select("page_id", "href", U.join_url("page", "href").alias("url"))


_HASHED = f"SELECT page_id, url, md5({sql.normalize_url('url')}) AS url_hash FROM pages"
_STORED = "url LIKE '%/de/%' OR url LIKE '%/en/%'"


@register("dedup_urls", f"SELECT url_hash, min(page_id) AS page_id FROM ({_HASHED}) GROUP BY url_hash")
def dedup_urls(spark, sf_dir):
    return crawl.first_by_hash(crawl.with_identity(_pages(spark, sf_dir).select("page_id", "url")), ["page_id"]).select("url_hash", "page_id")


@register("crawl_new_urls", f"SELECT url_hash, min(page_id) AS page_id FROM ({_HASHED}) WHERE url_hash NOT IN (SELECT url_hash FROM ({_HASHED}) WHERE {_STORED}) GROUP BY url_hash")
def crawl_new_urls(spark, sf_dir):
    known = crawl.with_identity(_pages(spark, sf_dir).select("page_id", "url"))
    stored = known.where(F.col("url").contains("/de/") | F.col("url").contains("/en/"))
    return crawl.new_pages(known, stored, ["page_id"]).select("url_hash", "page_id")


_LOG = "SELECT page_id, html, CASE WHEN url LIKE '%page=2%' THEN 403 WHEN url LIKE '%/es/%' THEN 404 ELSE 200 END AS status, url LIKE '%/de/%' AS known FROM pages"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch log made of the pages: the status follows from the URL."""
    status = F.when(F.col("url").contains("page=2"), 403).when(F.col("url").contains("/es/"), 404).otherwise(200)
    return _pages(spark, sf_dir).select("page_id", "html", status.alias("status"), F.col("url").contains("/de/").alias("known"))


@register("blocked_pages", f"SELECT page_id, status FROM ({_LOG}) WHERE {sql.blocked('status', 'html')}")
def blocked_pages(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.where(crawl.blocked(F.col("status"), F.col("html"))).select("page_id", "status")


@register("status_routing", f"SELECT page_id, CASE WHEN status = 200 THEN strlen(html)::BIGINT END AS body_bytes FROM ({_LOG})")
def status_routing(spark, sf_dir):
    return _log(spark, sf_dir).select("page_id", F.octet_length(crawl.body_of(F.col("status"), F.col("html"))).cast("long").alias("body_bytes"))


_BAD = sql.blocked("status", "html")


@register(
    "crawl_counters",
    f"""SELECT count(*) AS seen, count(*) FILTER (known) AS skipped, count(*) FILTER (NOT known AND status = 200 AND NOT {_BAD}) AS downloaded,
    count(*) FILTER (NOT known AND {_BAD}) AS blocked, count(*) FILTER (NOT known AND status <> 200 AND NOT {_BAD}) AS errors FROM ({_LOG})""",
)
def crawl_counters(spark, sf_dir):
    return crawl.crawl_counters(_log(spark, sf_dir))


@register(
    "crawl_page_counters",
    f"""SELECT page_id // 25 AS listing, count(*) AS seen, count(*) FILTER (known) AS skipped, count(*) FILTER (NOT known AND status = 200 AND NOT {_BAD}) AS downloaded,
    count(*) FILTER (NOT known AND {_BAD}) AS blocked, count(*) FILTER (NOT known AND status <> 200 AND NOT {_BAD}) AS errors FROM ({_LOG}) GROUP BY listing""",
)
def crawl_page_counters(spark, sf_dir):
    """The counters of a fetch log by listing page of 25 links."""
    return crawl.crawl_counters(_log(spark, sf_dir).withColumn("listing", F.floor(F.col("page_id") / 25)), ["listing"])


@register("clean_html", f"SELECT page_id, {sql.clean_html('html')} AS text FROM pages")
def clean_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", H.clean_html("html").alias("text"))


@register("page_article", f"SELECT page_id, {sql.page_article('html')} AS text FROM pages")
def page_article(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", H.page_article("html").alias("text"))


_LINES = "SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\n\\f\\v\\x1c-\\x1f\\x85\\xa0]+|[ \\t\\r\\n\\f\\v\\x1c-\\x1f\\x85\\xa0]+$', '', 'g')), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL"


def _escaped(spark, sf_dir, before: str, after: str):
    """(doc_id, body): the lines of each document as mark-up between two tags."""
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.concat(F.lit(before), F.replace(text, F.lit("\n"), F.lit(after + before)), F.lit(after)).alias("body"))


@register("article_documents", f"SELECT doc_id, 'x' || chr(10) || array_to_string(t, chr(10)) AS text FROM ({_LINES}) WHERE len(t) > 0")
def article_documents(spark, sf_dir):
    """The documents put into the first source's layout and extracted again."""
    body = F.concat(F.lit("<h1 class='news-page__title'>x</h1><div class='news-page__text'>"), "body", F.lit("</div>"))
    made = _escaped(spark, sf_dir, "<p>", "</p>").select("doc_id", H.article_text(F.lit("consultant"), body).alias("text"))
    return made.where(F.col("text") != "x")


@register(
    "article_rules",
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T' || chr(10) || array_to_string(t || ['x', ''], chr(10)) WHEN 1 THEN 'U' || CASE WHEN len(t) > 0 THEN chr(10) ELSE '' END || array_to_string(t, chr(10))
    WHEN 2 THEN '' || CASE WHEN len(t) > 0 THEN chr(10) ELSE '' END || array_to_string(t, chr(10)) END AS text FROM ({_LINES})""",
)
def article_rules(spark, sf_dir):
    """The documents in the layouts of both sources - with lists, nested blocks and excluded parts, without title, or of no known source - extracted by each source's rules."""
    kind = F.col("doc_id") % 4
    source = F.when(kind == 0, "consultant").when(kind == 1, "business_ru").when(kind == 2, "consultant").otherwise("elsewhere")
    first = F.concat(F.lit("<h1 class='news-page__title'>T</h1><div class='news-page__text'>"), "body", F.lit("<p> </p><ul><li>x</li><li></li></ul><div><p>deep</p></div></div>"))
    second = F.concat(F.lit("<h1 class='page__title'>U</h1><div class='contentSchema' itemprop='articleBody'><noindex><p>ad</p></noindex><div>"), "body", F.lit("</div></div>"))
    bare = F.concat(F.lit("<div class='news-page__text'>"), "body", F.lit("</div>"))
    made = F.when(kind == 0, first).when(kind == 1, second).otherwise(bare)
    return _escaped(spark, sf_dir, "<p>", "</p>").select("doc_id", H.article_text(source, made).alias("text"))


@register("stream_ingest", f"SELECT url_hash, min(page_id) AS page_id FROM ({_HASHED}) GROUP BY url_hash")
def stream_ingest(spark, sf_dir):
    """The pages landed as files, ingested by a stream, twice: the second run adds nothing."""
    home = f"{readers.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    _pages(spark, sf_dir).write.parquet(f"{home}/landing")
    for run in range(2):
        ingest.start_ingest(spark, f"{home}/landing", f"{home}/store", f"{home}/progress-{run}").awaitTermination()
    return spark.read.parquet(f"{home}/store").select("url_hash", "page_id")


_ANSWERED = f"status = 200 AND NOT {sql.blocked('status', 'html')}"


@register("crawl_pages", f"SELECT DISTINCT md5({sql.normalize_url('l.url')}) AS url_hash, 'site' AS source_name FROM ({_LOG}) g JOIN pages l USING (page_id) WHERE {_ANSWERED.replace('html', 'g.html')}")
def crawl_pages(spark, sf_dir):
    """The pages crawled through listings of 250 links each, twice: statuses follow from the URLs, block pages are asked for again, the second run finds nothing new."""
    home = f"{readers.shared_folder(spark)}/crawl-{uuid.uuid4().hex}"
    pages = _pages(spark, sf_dir)
    log = _log(spark, sf_dir).join(pages.select("page_id", "url"), "page_id").select("url", "status", "html")
    number = F.floor(F.col("page_id") / 250)
    address = lambda k: F.concat(F.lit("https://site.example.org/list/"), k.cast("string"))
    link = F.concat(F.lit("<a class='item' href='"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("'>x</a>"))
    lists = pages.where("page_id IS NOT NULL").groupBy(number.alias("k")).agg(F.array_join(F.sort_array(F.collect_list(link)), "\n").alias("links"))
    # One short row for each listing.
    chain = lists.select("k", F.lead("k").over(W.orderBy("k")).alias("after")).cache()
    after = F.coalesce(F.concat(F.lit("<a class='next' href='"), address(F.col("after")), F.lit("'>next</a>")), F.lit(""))
    listing = F.concat("links", after)
    log.unionAll(lists.join(chain, "k").select(address(F.col("k")), F.lit(200), listing)).write.parquet(f"{home}/web")
    start = chain.agg(F.min("k")).first()[0]
    chain.unpersist()
    web = spark.read.parquet(f"{home}/web")
    source = readers.CrawlSource("site", f"https://site.example.org/list/{start or 0}", "a.item", "a.next", 1 << 30)
    fetch = lambda urls: urls.join(web, "url")
    for run in range(2):
        crawl_loop.crawl_source(spark, source, fetch, f"{home}/store", run, pause=lambda seconds: None)
    return spark.read.parquet(f"{home}/store").select("url_hash", "source_name")


@register(
    "ingest_counters",
    f"""WITH h AS ({_HASHED}), f AS (SELECT count(*) AS n, count(DISTINCT url_hash) AS d FROM h)
    SELECT n AS seen, n - d AS repeated, 0::BIGINT AS known, d AS added FROM f UNION ALL SELECT n, n - d, d, 0 FROM f""",
)
def ingest_counters(spark, sf_dir):
    """What a stream counted while it wrote the pages into a store, and when the same came again from the start."""
    home = f"{readers.shared_folder(spark)}/counted-{uuid.uuid4().hex}"
    _pages(spark, sf_dir).write.parquet(f"{home}/landing")
    counted: list[dict] = []
    for run in range(2):
        ingest.start_ingest(spark, f"{home}/landing", f"{home}/store", f"{home}/progress-{run}", counted=counted).awaitTermination()
    readers.remove_folder(spark, home)
    return spark.createDataFrame([(c["seen"], c["repeated"], c["known"], c["added"]) for c in counted], "seen long, repeated long, known long, added long")


_LAST = f"SELECT url_hash, max(page_id) AS page_id FROM ({_HASHED}) GROUP BY url_hash"


@register(
    "recrawl_pages",
    f"""SELECT l.url_hash, page_id, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS version, sha256(html || CASE WHEN page_id % 3 = 0 THEN '<!-- changed -->' ELSE '' END) AS content
    FROM ({_LAST}) l JOIN pages USING (page_id)""",
)
def recrawl_pages(spark, sf_dir):
    """Two crawls of the pages, every third one changed between them, as a stream of files into a store of versions; then all files once more, one by one, from a lost checkpoint."""
    home = f"{readers.shared_folder(spark)}/recrawl-{uuid.uuid4().hex}"
    schema = T.StructType([*PAGES.fields, T.StructField("crawled_at", T.LongType())])
    run = lambda progress, files=None: recrawl.start_recrawl(spark, f"{home}/landing", f"{home}/store", f"{home}/{progress}", schema, ("page_id",), files).awaitTermination()
    pages = _pages(spark, sf_dir).select("page_id", "url", "html")
    for crawl_, html in ((1, F.col("html")), (2, F.concat("html", F.when(F.col("page_id") % 3 == 0, "<!-- changed -->").otherwise("")))):
        pages.select("page_id", "url", html.alias("html"), F.lit(crawl_).cast("long").alias("crawled_at")).write.mode("append").parquet(f"{home}/landing")
        run("progress")
    run("lost", 1)
    return recrawl.PageStore(spark, f"{home}/store", schema, ("page_id",)).current().select("url_hash", "page_id", "version", F.lower(F.hex("content_hash")).alias("content"))


@register("export_kept_skipped", f"SELECT count(*) FILTER (t <> '') AS kept, count(*) FILTER (t IS NULL OR t = '') AS skipped FROM (SELECT {sql.page_article('html')} AS t FROM pages)")
def export_kept_skipped(spark, sf_dir):
    return crawl.export_corpus(_pages(spark, sf_dir), H.page_article("html"))[1]


@register("export_corpus", f"SELECT page_id, text FROM (SELECT page_id, {sql.page_article('html')} AS text FROM pages) WHERE text <> ''")
def export_corpus(spark, sf_dir):
    """The articles of all pages written as a corpus and read back."""
    home = f"{readers.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    write_corpus(crawl.export_corpus(_pages(spark, sf_dir), H.page_article("html"))[0].select("page_id", "text"), home)
    return spark.read.parquet(home)


@register("frequency_file", f"SELECT term AS word, frequency FROM ({sql.FREQUENCIES})")
def frequency_file(spark, sf_dir):
    """Term frequencies written as CSV and read back."""
    home = f"{readers.shared_folder(spark)}/frequencies-{uuid.uuid4().hex}"
    write_frequencies(term_freq(spark, sf_dir).withColumnRenamed("term", "word"), home)
    return readers.frequency_csv(spark, home)


@register(
    "corpus_stats",
    f"""SELECT count(*) AS docs, count(*) FILTER (contains(s, '/en/')) AS docs_a, count(*) FILTER (NOT contains(s, '/en/')) AS docs_b,
    sum(raw)::BIGINT AS raw_bytes, sum(txt)::BIGINT AS text_bytes, avg(raw) AS mean_raw_bytes, avg(txt) AS mean_text_bytes, 100.0::DOUBLE * sum(txt)::DOUBLE / sum(raw)::DOUBLE AS text_percent
    FROM (SELECT url AS s, strlen(html) AS raw, strlen({sql.clean_html('html')}) AS txt FROM pages)""",
)
def corpus_stats(spark, sf_dir):
    return crawl.corpus_stats(_pages(spark, sf_dir), "url", "html", "/en/")


_SIZES = f"SELECT count(*) AS docs, count(*) FILTER (contains(url, '/en/')) AS a, sum(strlen(html))::DOUBLE AS raw, sum(strlen({sql.clean_html('html')}))::DOUBLE AS txt FROM pages"


@register(
    "corpus_report",
    f"""SELECT unnest(['Documents: ' || docs || ' (' || a || ' / ' || (docs - a) || ')', printf('Raw size: %.2f MB, mean %.2f KB', raw / 1048576, raw / docs / 1024),
    printf('Text size: %.2f MB, mean %.2f KB', txt / 1048576, txt / docs / 1024), printf('Text share: %.2f %%', 100 * txt / raw)]) AS line FROM ({_SIZES})""",
)
def corpus_report_(spark, sf_dir):
    """The readable report of the pages, line by line."""
    return spark.createDataFrame([(line,) for line in corpus_report(corpus_stats(spark, sf_dir)).split("\n")], "line string")


@register("source_examples", "SELECT source, min(doc_id) AS doc_id, left(arg_min(text, doc_id), 1000) AS example FROM documents GROUP BY source")
def source_examples(spark, sf_dir):
    return crawl.source_examples(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "source", "doc_id", "text")


from . import retrieval  # noqa: E402, F401
