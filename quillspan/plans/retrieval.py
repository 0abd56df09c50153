"""Queries on a stored index: boolean, ranked, phrases, patterns, fuzzy terms, and the index's own upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary, index, search
from ..operators.lookup import IndexSearcher
from ..operators.ranking import Ranker
from ..operators.segments import SegmentIndex
from ..sources import readers
from ..sources.readers import table
from ..sources.writers import results_json, results_pages
from . import catalog, fixtures, sql  # noqa: F401  (the catalogue registers the SQL that is shared here)
from .registry import ORACLES, register

NESTED = "(the || der) && !and"
_P = f"WITH p AS ({sql.POSTINGS}) "
_T = f"WITH t AS ({sql.PLACED})"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


#: Folder of the stored index of a corpus, and the state of the files that it was brought up to.
_INDEXES: dict[tuple[str, str], tuple[str, str]] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> SegmentIndex:
    """The index of the documents: built once for a session, then brought up to date whenever the table's files have changed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    files = readers.fingerprint(spark, f"{sf_dir}/documents.parquet")
    path, known = _INDEXES.get(key) or (f"{readers.shared_folder(spark)}/index-{uuid.uuid4().hex}", "")
    found = SegmentIndex(spark, path)
    if known != files:
        found.refresh(_docs(spark, sf_dir))
        _INDEXES[key] = path, files
    return found


def _searcher(spark: SparkSession, sf_dir: str) -> search.Searcher:
    found = stored_index(spark, sf_dir)
    return search.Searcher(found.docs(), found.postings())


@register("index_postings", sql.POSTINGS)
def index_postings(spark, sf_dir):
    return stored_index(spark, sf_dir).postings()


@register("index_forward", f"SELECT doc_id, {sql.TITLE} AS title FROM documents")
def index_forward(spark, sf_dir):
    return stored_index(spark, sf_dir).docs().select("doc_id", "title")


@register("index_lookup", _P + "SELECT doc_id FROM p WHERE term = 'the'")
def index_lookup(spark, sf_dir):
    return _searcher(spark, sf_dir).lookup([search.normalize_term("The")]).select("doc_id")


@register("index_search", ORACLES["search_titles"])
def index_search(spark, sf_dir):
    s = _searcher(spark, sf_dir)
    return s.with_titles(s.search(NESTED))


@register("index_search_top10", ORACLES["search_top10"])
def index_search_top10(spark, sf_dir):
    s = _searcher(spark, sf_dir)
    return s.with_titles(search.first_hits(s.search(NESTED)))


@register("index_search_json", ORACLES["search_json"])
def index_search_json(spark, sf_dir):
    return results_json(index_search(spark, sf_dir))


@register("index_search_batch", ORACLES["search_batch"])
def index_search_batch(spark, sf_dir):
    return _searcher(spark, sf_dir).search_batch(fixtures.BATCH)


_NESTED = f"(doc_id IN {sql.docs_with('the')} OR doc_id IN {sql.docs_with('der')}) AND doc_id NOT IN {sql.docs_with('and')}"


@register(
    "index_search_pages",
    _P + f"""SELECT page, '{{"count":' || count(*) || ',"results":[' || string_agg('{{"id":' || doc_id || ',"title":' || to_json(title) || '}}', ',' ORDER BY doc_id) || ']}}' AS json
    FROM (SELECT doc_id, {sql.TITLE} AS title, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS page FROM documents WHERE {_NESTED}) GROUP BY page""",
)
def index_search_pages(spark, sf_dir):
    """All hits as one JSON object for each page of twenty."""
    s = _searcher(spark, sf_dir)
    return results_pages(search.numbered(s.with_titles(s.search(NESTED))))


# Upkeep


@register(
    "index_build",
    f"""{_T}, f AS (SELECT s.term, t.doc_id, count(*) AS tf FROM t JOIN ({sql.stems("SELECT token FROM t")}) s USING (token) GROUP BY ALL)
    SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM t) AS n_tokens, count(DISTINCT term) AS n_terms, count(*) AS n_postings, max(tf) AS max_tf FROM f""",
)
def index_build(spark, sf_dir):
    """A new index of all documents: its size, read back from what was written."""
    built = SegmentIndex(spark, f"{readers.shared_folder(spark)}/build-{uuid.uuid4().hex}")
    built.apply(_docs(spark, sf_dir))
    size = built.blocks().agg(F.sum("n").alias("n_postings"), F.max("max_tf").cast("long").alias("max_tf")).first()
    row = (built.n_docs, built.n_tokens, built.dictionary().count(), size["n_postings"], size["max_tf"])
    readers.remove_folder(spark, built.commits.path)
    return spark.createDataFrame([row], "n_docs long, n_tokens long, n_terms long, n_postings long, max_tf long")


@register("index_incremental", f"{_T} SELECT s.term, t.doc_id, count(*) AS tf FROM t JOIN ({sql.stems('SELECT token FROM t')}) s USING (token) GROUP BY ALL")
def index_incremental(spark, sf_dir):
    """An index made in three batches - half of the documents with other texts, the other half with removals, then the corpus as it is - and merged in part."""
    docs = _docs(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    built = SegmentIndex(spark, f"{readers.shared_folder(spark)}/batches-{uuid.uuid4().hex}")
    built.apply(docs.where(even).select("doc_id", F.concat(F.lit("earlier "), F.substring("text", 1, 200)).alias("text")), batch=("documents", 0))
    built.apply(docs.where(~even), docs.where("doc_id % 10 = 4").select("doc_id"), batch=("documents", 1))
    built.apply(docs.where(~even).limit(0), batch=("documents", 1))
    built.refresh(docs)
    built.merge(built.state["segments"][:2])
    return built.matches(built.blocks(), "tf").select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


# Ranking

RANKED = {1: "the of and", 2: "ther theron therhean", 3: "de la que de", 4: "tion zzz"}
_RANKED = ", ".join(f"({q}, '{w}')" for q, text in RANKED.items() for w in dict.fromkeys(text.split()))


def _ranked_sql(values: str, where: str) -> str:
    return f"""{_T}, p AS ({sql.POSTINGS}), q AS (SELECT * FROM (VALUES {values}) v(query_id, token)), n AS (SELECT count(*)::DOUBLE AS n, (SELECT count(*) FROM t)::DOUBLE / count(*)::DOUBLE AS mean FROM documents),
    l AS (SELECT doc_id, count(*) AS length FROM t GROUP BY doc_id), f AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE token IN (SELECT token FROM q) GROUP BY ALL),
    d AS (SELECT token, ln(1 + (n - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM f, n GROUP BY token, n),
    s AS (SELECT query_id, doc_id, sum(floor(1000000 * idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / mean)) + 0.5e0)::BIGINT)::BIGINT AS score FROM q JOIN f USING (token) JOIN d USING (token) JOIN l USING (doc_id), n WHERE {where} GROUP BY ALL)
    SELECT query_id::BIGINT AS query_id, rank::INTEGER AS rank, doc_id, score / 1000000e0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


@register("search_ranked", _ranked_sql(_RANKED, "TRUE"))
def search_ranked(spark, sf_dir):
    return Ranker(stored_index(spark, sf_dir)).search_batch(RANKED)


@register("search_ranked_within", _ranked_sql(_RANKED, _NESTED))
def search_ranked_within(spark, sf_dir):
    """The best of a boolean query's hits."""
    found = stored_index(spark, sf_dir)
    return Ranker(found).search_batch(RANKED, within=IndexSearcher(found).search(NESTED))


# Phrases and proximity


def _follow(*words: str) -> str:
    """Documents with the words one after another."""
    joins = "".join(f" JOIN t t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.place = t0.place + {k} AND t{k}.token = '{w}'" for k, w in enumerate(words) if k)
    return f"SELECT t0.doc_id FROM t t0{joins} WHERE t0.token = '{words[0]}'"


@register("phrase_search", f"{_T} SELECT doc_id FROM documents WHERE doc_id IN ({_follow('the', 'of')}) AND doc_id NOT IN ({_follow('of', 'the')})")
def phrase_search(spark, sf_dir):
    return IndexSearcher(stored_index(spark, sf_dir)).search('"The of" && !"of the"')


@register("phrase_repeated", f"{_T} SELECT doc_id FROM documents WHERE doc_id IN ({_follow('the', 'the', 'the')}) OR doc_id IN ({_follow('de', 'de', 'la')})")
def phrase_repeated(spark, sf_dir):
    return IndexSearcher(stored_index(spark, sf_dir)).search('"the the the" || "de de la"')


_NEAR = """SELECT a.doc_id FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.place BETWEEN a.place AND a.place + 5
    WHERE a.token IN ('the', 'is') AND b.token IN ('the', 'is') GROUP BY a.doc_id, a.place HAVING count(*) FILTER (b.token = 'the') >= 2 AND count(*) FILTER (b.token = 'is') >= 1"""


@register("near_search", f"{_T} SELECT doc_id FROM documents WHERE doc_id IN ({_NEAR}) AND doc_id NOT IN ({_follow('the', 'is')})")
def near_search(spark, sf_dir):
    return IndexSearcher(stored_index(spark, sf_dir)).search('"the is the"~3 && !"the is"')


@register(
    "title_search",
    f"""WITH h AS (SELECT doc_id, list_filter(regexp_split_to_array(split_part({sql.fold("text")}, chr(10), 1), '[ \\t\\n\\r.,!?:;"''()\\[\\]{{}}<>/|\\\\*&^%$#@~`=-]+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id FROM h WHERE list_contains(w, 'the') AND NOT list_contains(w, 'and')""",
)
def title_search(spark, sf_dir):
    return IndexSearcher(stored_index(spark, sf_dir)).search("title:The && !title:and")


# Patterns and fuzzy terms


@register("pattern_search", f"{_T} SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM t WHERE token LIKE 'therh%' OR token LIKE '%ntionha') AND doc_id NOT IN (SELECT doc_id FROM t WHERE token LIKE 'on%an%st')")
def pattern_search(spark, sf_dir):
    return IndexSearcher(stored_index(spark, sf_dir)).search("(therh* || *ntionha) && !on*an*st")


@register("pattern_terms", f"WITH f AS (SELECT DISTINCT token, doc_id FROM ({sql.PLACED})) SELECT token AS term, count(*) AS doc_freq FROM f WHERE token LIKE '%tion%ver%' OR token LIKE 'the%st' GROUP BY token")
def pattern_terms(spark, sf_dir):
    """Terms of two patterns with their document frequencies: one by its grams, one by its range of the dictionary."""
    found = stored_index(spark, sf_dir)
    terms = dictionary.pattern_terms(found, "*tion*ver*").unionAll(dictionary.pattern_terms(found, "the*st")).distinct()
    return found.dictionary().join(terms, "term", "left_semi")


# The oracle's distance counts bytes. Folded tokens hold no capital letters of ASCII, so these stand for the letters of two bytes.
_ONE_BYTE = "translate(token, 'ÄÇÈÉÊÍÑÓÖÜßáâäçèéêíîñóöúü', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"


@register("fuzzy_search", f"{_T} SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM t WHERE levenshtein({_ONE_BYTE}, 'thion') <= 1) AND doc_id NOT IN (SELECT doc_id FROM t WHERE levenshtein({_ONE_BYTE}, 'therle') <= 2)")
def fuzzy_search(spark, sf_dir):
    return IndexSearcher(stored_index(spark, sf_dir)).search("thion~1 && !therle~2")


_ASKED = sql.PLACED.replace("doc_id", "item_id").replace("documents", "benchmark")


@register(
    "fuzzy_terms",
    f"""WITH d AS (SELECT DISTINCT token AS term, {_ONE_BYTE} AS t, length(token) AS n FROM ({sql.PLACED})), q AS (SELECT DISTINCT token AS word, {_ONE_BYTE} AS w, length(token) AS n FROM ({_ASKED}))
    SELECT word, term, levenshtein(w, t)::INTEGER AS distance FROM q JOIN d ON abs(d.n - q.n) <= 1 WHERE levenshtein(w, t) <= 1""",
)
def fuzzy_terms(spark, sf_dir):
    """For every word of the benchmark, the dictionary's terms within one edit."""
    words = index.tokens(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select(F.col("token").alias("word")).distinct()
    return dictionary.fuzzy_join(words, stored_index(spark, sf_dir).dictionary().select("term"), 1)


# Facets and highlighting


@register(
    "search_facets",
    _P + f"""SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'all' END AS facet, coalesce(source, lang) AS value, count(*) AS n_hits
    FROM (SELECT doc_id, source, lang FROM documents WHERE {_NESTED}) GROUP BY GROUPING SETS ((source), (lang), ())""",
)
def search_facets(spark, sf_dir):
    s = search.Searcher(table(spark, sf_dir, "documents", "doc_id", "source", "lang"), stored_index(spark, sf_dir).postings())
    return s.facets(NESTED, ["source", "lang"])


@register(
    "highlight_page",
    f"""{_T}, h AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM t WHERE token = 'the') AND doc_id IN (SELECT doc_id FROM t WHERE token = 'of') ORDER BY doc_id LIMIT 20),
    e AS (SELECT doc_id, place, token FROM t WHERE token IN ('the', 'of') AND doc_id IN (SELECT doc_id FROM h)),
    w AS (SELECT a.doc_id, a.place, count(DISTINCT b.token) AS d, count(*) AS n FROM e a JOIN e b ON b.doc_id = a.doc_id AND b.place BETWEEN a.place AND a.place + 11 GROUP BY ALL),
    b AS (SELECT doc_id, place AS begin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d DESC, n DESC, place) AS r FROM w) WHERE r = 1)
    SELECT b.doc_id, b.begin, string_agg(t.token, ' ' ORDER BY t.place) AS snippet FROM b JOIN t ON t.doc_id = b.doc_id AND t.place BETWEEN b.begin AND b.begin + 11 GROUP BY ALL""",
)
def highlight_page(spark, sf_dir):
    """The first page of hits, each with its best twelve tokens."""
    s = IndexSearcher(stored_index(spark, sf_dir))
    page = [r["doc_id"] for r in search.page(s.search("the of"), 0).collect()]
    return s.highlight(page, "the of", _docs(spark, sf_dir))
