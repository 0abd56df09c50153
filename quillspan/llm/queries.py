"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, lexical, line_dedup, near_dedup, packing, secrets, sharding, topk_search, toxicity, vector_dedup, whitening
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: pattern spans, and spans that the randomness battery adds."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of 1024 tokens."""
    import public_tokenizers as P

    files = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(table(spark, sf_dir, "documents"), *files, P.PATTERN)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows by integer inner product for every embedding whose id is divisible by 50."""
    vectors = topk_search.quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the multilingual 50k rank file."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 or more among all embeddings, and their components."""
    return vector_dedup.threshold_links(vector_dedup.parse_vectors(table(spark, sf_dir, "embeddings")))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 Hilbert runs of equal row count."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels outside the held-out rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of 50 words or more that an earlier place has."""
    return line_dedup.drop_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first 16 whitened components."""
    points = whitening.quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return whitening.whiten(points, whitening.fit(points))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark, in windows of ten words."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_packing": op2_packing,
    "op3_html_extract": op3_html_extract,
    "op4_near_dedup": op4_near_dedup,
    "op5_topk_search": op5_topk_search,
    "op6_bpe": op6_bpe,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_hilbert_sharding": op8_hilbert_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_lexical_search": op13_lexical_search,
}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES: dict[str, str] = {
    "op5_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_decontamination": f"""
        WITH i AS (
            SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0
        ), g AS (
            SELECT DISTINCT item_id, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM i)
        ), d AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS}, []) AS w FROM documents
        ), h AS (
            SELECT d.row, p, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS gram
            FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM i)) d
        ), f AS (
            SELECT row, p, h.m, item_id FROM h JOIN g ON h.gram = g.gram AND h.m = g.m
        ), n AS (
            SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(p, p + m)) AS place FROM f) GROUP BY row
        ), t AS (
            SELECT row, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT row, coalesce(item_id::VARCHAR, '') AS x FROM f) GROUP BY row
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)
    """,
    "op13_lexical_search": f"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL
        ), s AS (
            SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0
        ), i AS (
            SELECT DISTINCT item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL)
        ), tf AS (
            SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL
        ), df AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, n_docs
        ), sc AS (
            SELECT i.item, i.item_id, tf.row, tf.doc_id, sum(df.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::BIGINT AS score
            FROM i JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL
        ), r AS (
            SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM sc WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
}
