"""Incremental ingest: a file stream of pages into a store without duplicate URLs.

State is the store itself: each micro-batch keeps the first row per URL hash that the store lacks
and appends it, so replaying a batch, or all of them after a lost checkpoint, adds nothing. A
streaming ``dropDuplicates`` would need state for every URL ever seen.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.crawl import with_identity
from ..sources.schemas import PAGES


def stored_hashes(spark: SparkSession, store: str) -> DataFrame:
    """Hashes in the store; none before the first batch."""
    try:
        return spark.read.parquet(store).select("url_hash")
    except AnalysisException:
        return spark.createDataFrame([], "url_hash string")


def append_new(batch: DataFrame, store: str, order: list[str]) -> dict[str, int]:
    """Insert where the hash is new; the first row in ``order`` wins. Rows without URL are not stored. One writer at a time.

    Returns what came (``seen``), how many rows had an earlier twin in the batch, how many URLs the store had and how many were
    added, observed on the way to the write and not in a pass of their own.
    """
    told = Observation()
    known = stored_hashes(batch.sparkSession, store).withColumn("_known", F.lit(True))
    met = counted_first(with_identity(batch), order).join(known, "url_hash", "left")
    # Observed above the join: nothing there can be optimised away when a side is empty.
    met = met.observe(told, F.sum("_rows").alias("seen"), F.count("url_hash").alias("urls"), F.count_if("_known").alias("known"), F.sum(F.when(F.col("url_hash").isNull(), F.col("_rows"))).alias("no_url"))
    met.where("url_hash IS NOT NULL AND _known IS NULL").drop("_known", "_rows").write.mode("append").parquet(store)
    n = {k: v or 0 for k, v in told.get.items()}
    return {"seen": n["seen"], "no_url": n["no_url"], "repeated": n["seen"] - n["no_url"] - n["urls"], "known": n["known"], "added": n["urls"] - n["known"]}


def counted_first(pages: DataFrame, order: list[str]) -> DataFrame:
    """``first_by_hash`` with the number of rows of each hash, ``_rows``."""
    rest = [c for c in pages.columns if c not in ("url_hash", *order)]
    least = pages.groupBy("url_hash").agg(F.min(F.struct(*order, *rest)).alias("row"), F.count(F.lit(1)).alias("_rows"))
    return least.select("url_hash", "row.*", "_rows").select(*pages.columns, "_rows")


def start_ingest(
    spark: SparkSession, landing: str, store: str, checkpoint: str, schema: T.StructType = PAGES, order: tuple[str, ...] = ("page_id",), files_per_batch: int | None = None, counted: list[dict] | None = None
) -> StreamingQuery:
    """Ingest all files that have landed, then stop; call again for later ones. ``counted`` gathers the counts of each batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take(batch: DataFrame, number: int) -> None:
        counts = append_new(batch, store, list(order))
        if counted is not None:
            counted.append({"batch": number, **counts})

    return (
        reader.parquet(landing)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
