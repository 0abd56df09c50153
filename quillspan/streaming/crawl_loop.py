"""The crawl as bounded batches: the driver follows the addresses of listing pages, their links and articles are DataFrames.

Fetching is a parameter: ``fetch`` takes a DataFrame with ``url`` and returns ``url, status, html`` (a table of
stored pages, a Python data source, a service); a null status is a network error. Network errors and block
pages are asked for again, ``ATTEMPTS`` times in all, after the pause that ``delay`` gives.

A listing page names the next one, so a chain is followed link by link. Where the link was the page's own address with its last number
increased by one, the addresses that would follow are asked for together, more of them each time that they were right; only those
that the chain reaches count. So a numbered chain takes a handful of fetches, any other one fetch for each page.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import parse_listing
from ..operators.crawl import blocked, body_of, new_pages, with_identity
from ..sources.readers import CrawlSource
from .ingest import stored_hashes

Fetch = Callable[[DataFrame], DataFrame]

# Tries per page, growth of the pause after a network error, pause after a block page.
ATTEMPTS = 3
BACKOFF = 2
BLOCK_PAUSE = 60.0
#: Listing pages whose addresses are asked for at once, the growth of that number, and the fetches of listings that one batch of articles may span.
AHEAD, GROWTH, ROUNDS = 4096, 8, 16


def delay(base: float, attempt: int, was_blocked: bool = False, jitter: float = 0.1) -> float:
    """Seconds to wait after a failed try (from 1): linear in the attempt, fixed after a block page."""
    return BLOCK_PAUSE if was_blocked else base * BACKOFF * attempt + jitter


def fetch_patiently(fetch: Fetch, urls: DataFrame, base: float = 1.0, pause: Callable[[float], None] = time.sleep, held: list[DataFrame] | None = None) -> DataFrame:
    """``fetch`` with retries: one row per answered URL, its last answer. Any other status than a block page's is final.

    Answers are cached, so that no page is asked for more often; ``held`` gathers what the caller may unpersist.
    """
    final, pending = None, urls
    for attempt in range(1, ATTEMPTS + 1):
        got = fetch(pending).select("url", "status", "html").cache()
        if held is not None:
            held.append(got)
        bad = blocked(F.col("status"), F.col("html"))
        again = F.col("status").isNull() | bad
        counts = got.agg(F.count_if(again).alias("again"), F.count_if(bad).alias("bad")).first()
        if not counts["again"] or attempt == ATTEMPTS:
            return got if final is None else final.unionAll(got)
        pause(delay(base, attempt, counts["bad"] > 0))
        settled = got.where(~again)
        final = settled if final is None else final.unionAll(settled)
        pending = got.where(again).select("url").distinct()
    raise AssertionError("the last attempt returns")


@dataclass
class PageCount:
    """What one listing page gave."""

    source: str
    page: int
    url: str
    listed: int
    known: int
    saved: int
    refused: int


def following(url: str, steps: int) -> str | None:
    """The address ``steps`` pages after a numbered one, by its last number; None without a number."""
    last = re.search(r"[0-9]+(?=[^0-9]*$)", url)
    return url[: last.start()] + str(int(last[0]) + steps).zfill(len(last[0])) + url[last.end() :] if last else None


def _listings(spark: SparkSession, fetch: Fetch, source: CrawlSource, urls: list[str], held: list[DataFrame]) -> tuple[DataFrame, dict[str, str | None]]:
    """(url, urls) of the listing pages that could be had, and the address after each of them."""
    got = fetch(spark.createDataFrame([(u,) for u in urls], "url string"), held=held).where((F.col("status") == 200) & ~blocked(F.col("status"), F.col("html"))).dropDuplicates(["url"])
    parsed = got.select("url", parse_listing(F.col("html"), F.col("url"), source.link_selector, source.next_selector).alias("p")).select("url", "p.urls", "p.next_url").cache()
    held.append(parsed)
    return parsed.select("url", "urls"), {r["url"]: r["next_url"] for r in parsed.select("url", "next_url").collect()}


def _save(spark: SparkSession, source: CrawlSource, fetch: Fetch, store: str, crawled_at: int, links: DataFrame, pages: list[tuple[int, str]], held: list[DataFrame]) -> list[PageCount]:
    """Fetch the articles of some listing pages - ``links`` has number, place, url - and append the new ones; what each page gave."""
    named = with_identity(links)
    fresh = new_pages(named, stored_hashes(spark, store), ["number", "place"]).cache()
    held.append(fresh)
    bad = blocked(F.col("status"), F.col("html"))
    answers = fetch(fresh.select("url"), held=held).select("url", body_of(F.col("status"), F.col("html")).alias("raw_html"), bad.alias("bad"))
    kept = fresh.join(answers.where(F.col("raw_html").isNotNull() & ~F.col("bad")).dropDuplicates(["url"]), "url")
    had = kept.select("url_hash", F.lit(True).alias("had"))
    # A page that an earlier listing of the batch gave is known to a later one; one that was refused is refused to both.
    met = named.groupBy("number", "url_hash").agg(F.count("*").alias("n")).join(fresh.select("url_hash", F.col("number").alias("at")), "url_hash", "left").join(had, "url_hash", "left")
    saved = F.coalesce("had", F.lit(False)) & (F.col("at") == F.col("number"))
    gave = met.groupBy("number").agg(F.sum("n").alias("listed"), F.count_if(saved).alias("saved"), F.count_if(F.col("at").isNotNull() & F.col("had").isNull()).alias("refused"))
    by_page = {r["number"]: r for r in gave.collect()}  # one row for each listing page
    if any(r["saved"] for r in by_page.values()):
        kept.select("url", "url_hash", F.lit(source.name).alias("source_name"), "raw_html", F.lit(crawled_at).cast("long").alias("crawled_at")).write.mode("append").parquet(store)
    counts = []
    for number, url in pages:
        listed, saved_, refused = (by_page[number][c] for c in ("listed", "saved", "refused")) if number in by_page else (0, 0, 0)
        counts.append(PageCount(source.name, number, url, listed, listed - saved_ - refused, saved_, refused))
    return counts


def crawl_source(
    spark: SparkSession, source: CrawlSource, fetch: Fetch, store: str, crawled_at: int, base_delay: float = 1.0, pause: Callable[[float], None] = time.sleep
) -> list[PageCount]:
    """Follow one source's listing pages and append its new articles to ``store``.

    Ends after ``max_pages`` pages, at a page without a next one or whose next is itself, or when a
    listing cannot be had. The store's hashes are all the state: a second run skips what it has.
    Articles are fetched and appended for many listing pages at once, up to ``AHEAD`` or what ``ROUNDS`` fetches of listings gave.
    """
    fetch = partial(fetch_patiently, fetch, base=base_delay, pause=pause)
    counts, url, number, ahead = [], source.start_url, 0, 1
    while url and number < source.max_pages:
        held: list[DataFrame] = []
        links: list[DataFrame] = []
        pages: list[tuple[int, str]] = []
        while url and number < source.max_pages and len(pages) < AHEAD and len(links) < ROUNDS:
            asked = [url, *(u for k in range(1, min(ahead, source.max_pages - number)) if (u := following(url, k)))]
            parsed, after = _listings(spark, fetch, source, asked, held)
            walked, guessed = [], False
            while url in after and number < source.max_pages:
                number += 1
                walked.append((number, url))
                link = after.pop(url)  # a page that comes again is asked for again
                guessed = link is not None and link == following(url, 1)
                url = None if link == url else link
            if not walked:
                url = None
                break
            if url in asked and url not in {u for _, u in walked}:
                url = None  # it was asked for and could not be had
            ahead = min(AHEAD, GROWTH * len(walked)) if guessed else 1
            at = spark.createDataFrame(walked, "number int, url string")
            links.append(parsed.join(F.broadcast(at), "url").select("number", F.posexplode("urls").alias("place", "url")))  # at most AHEAD rows
            pages += walked
        if pages:
            counts += _save(spark, source, fetch, store, crawled_at, reduce(DataFrame.unionAll, links), pages, held)
        for frame in held:
            frame.unpersist()
    return counts


def crawl(
    spark: SparkSession, sources: list[CrawlSource], fetch: Fetch, store: str, crawled_at: int, base_delay: float = 1.0, pause: Callable[[float], None] = time.sleep
) -> list[PageCount]:
    """All sources in sequence."""
    return [c for s in sources for c in crawl_source(spark, s, fetch, store, crawled_at, base_delay, pause)]
