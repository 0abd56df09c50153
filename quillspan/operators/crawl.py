"""Crawl side: URL identity, block pages, corpus export and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import clean_html
from ..functions.urls import normalize_url, url_hash

# Phrases of pages that refuse service, and the size below which they count.
BLOCK_MARKERS = (
    "captcha",
    "recaptcha",
    "g-recaptcha",
    "доступ ограничен",
    "security check",
    "подтвердите, что вы не робот",
    "403 forbidden",
    "waf",
)
BLOCK_PAGE_CHARS = 5000


def blocked(status: Column, html: Column, markers: tuple[str, ...] = BLOCK_MARKERS, size: int = BLOCK_PAGE_CHARS) -> Column:
    """Status 403, or a short page with one of the markers (case does not matter)."""
    low = F.lower(F.coalesce(html, F.lit("")))
    marked = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))
    return F.coalesce(status == 403, F.lit(False)) | ((F.char_length(low) < size) & marked)


def body_of(status: Column, html: Column) -> Column:
    """Only status 200 has a body."""
    return F.when(status == 200, html)


def with_identity(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add normalized_url and url_hash."""
    return pages.withColumns({"normalized_url": normalize_url(url), "url_hash": url_hash(url)})


def first_by_hash(pages: DataFrame, order: list[str]) -> DataFrame:
    """One row per url_hash: the first in the given order. Map-side combined, so a hot URL is no hot task."""
    rest = [c for c in pages.columns if c not in ("url_hash", *order)]
    least = pages.groupBy("url_hash").agg(F.min(F.struct(*order, *rest)).alias("row"))
    return least.select("url_hash", "row.*").select(*pages.columns)


def new_pages(pages: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """First row of every hash that the store does not have."""
    return first_by_hash(pages, order).join(stored.select("url_hash"), "url_hash", "left_anti").select(*pages.columns)


def export_corpus(raw: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows with ``text``, one row of counts): empty and missing texts are skipped and counted."""
    parsed = raw.withColumn("text", text)
    full = F.col("text").isNotNull() & (F.col("text") != "")
    counts = parsed.agg(F.count_if(full).alias("kept"), F.count_if(~F.coalesce(full, F.lit(False))).alias("skipped"))
    return parsed.where(full), counts


def corpus_stats(raw: DataFrame, source: str, html: str, needle: str) -> DataFrame:
    """One row: documents in all and by class of source, raw and text bytes, means and their ratio in percent."""
    data = raw.select(F.col(source).alias("s"), F.octet_length(html).cast("long").alias("raw"), F.octet_length(clean_html(html)).cast("long").alias("txt"))
    return data.agg(
        F.count("*").alias("docs"),
        F.count_if(F.contains("s", F.lit(needle))).alias("docs_a"),
        F.count_if(~F.coalesce(F.contains("s", F.lit(needle)), F.lit(False))).alias("docs_b"),
        F.sum("raw").alias("raw_bytes"),
        F.sum("txt").alias("text_bytes"),
        F.avg("raw").alias("mean_raw_bytes"),
        F.avg("txt").alias("mean_text_bytes"),
        F.try_divide(F.lit(100.0) * F.sum("txt"), F.sum("raw")).alias("text_percent"),
    )


def source_examples(docs: DataFrame, source: str, id_col: str, text: str, chars: int = 1000) -> DataFrame:
    """First document (smallest id) of every source, and the beginning of its text."""
    first = docs.groupBy(source).agg(F.min_by(F.struct(id_col, F.substring(text, 1, chars).alias("example")), id_col).alias("r"))
    return first.select(source, f"r.{id_col}", "r.example")


def crawl_counters(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Downloaded, skipped, error and block-page counts of a fetch log (status, html, known), in all or by listing page."""
    bad = blocked(F.col("status"), F.col("html"))
    counts = [
        F.count("*").alias("seen"),
        F.count_if("known").alias("skipped"),
        F.count_if(~F.col("known") & (F.col("status") == 200) & ~bad).alias("downloaded"),
        F.count_if(~F.col("known") & bad).alias("blocked"),
        F.count_if(~F.col("known") & (F.col("status") != 200) & ~bad).alias("errors"),
    ]
    return (log.groupBy(*by) if by else log.groupBy()).agg(*counts)

