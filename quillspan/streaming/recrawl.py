"""Re-crawl: a store of pages that keeps the newest content of every URL, and the contents before it.

A page is known by its normalised URL and judged by the digest of its content. A new page is version 1, a page whose content has
changed gets the next version; of one that has not changed only the crawl is noted, without its content. Each batch adds one part with
its rows and a list of what they supersede, and both are published at once (``sources.commits``); nothing written before is touched, so
readers see the store before or after a batch. ``compact`` rewrites the present pages as one part.

Replays add nothing, whatever their batches: a row takes effect only if it was crawled after the last crawl of its URL, by crawled_at and
then by the columns ``order``; late rows from between have no effect. Of several rows of one URL in a batch the last counts.
Rows without URL are not stored; a missing content is a content of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.crawl import with_identity
from ..sources.commits import Commits

#: What the store adds to the columns of a page.
_ADDED = [T.StructField("url_hash", T.StringType()), T.StructField("content_hash", T.BinaryType()), T.StructField("version", T.IntegerType())]


def _shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the store and that each batch meets anew: sorted and merged, so that it does not pass through the driver with every batch."""
    return df.hint("merge")


class PageStore:
    """Pages under a folder; ``schema`` has url, html and crawled_at (a number or a time), the columns ``order``, and whatever else is kept."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, order: tuple[str, ...] = ()):
        self.spark, self.schema, self.key = spark, schema, ("crawled_at", *order)
        self.full = T.StructType([*schema.fields, *_ADDED])
        self.commits = Commits(spark, path)
        self.reload()

    def reload(self) -> PageStore:
        self.version, self.state = self.commits.latest()
        return self

    def _rows(self) -> DataFrame:
        """Versions, and crawls without a change, which have no version."""
        parts = [self.spark.read.schema(self.full).parquet(f"{self.commits.folder(p)}/pages").withColumn("part", F.lit(p)) for p in self.state.get("parts", [])]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], T.StructType([*self.full.fields, T.StructField("part", T.StringType())]))

    def history(self) -> DataFrame:
        """All versions of all pages, with the part that holds them."""
        return self._rows().where("version IS NOT NULL")

    def _crawls(self) -> DataFrame:
        """(url_hash, last): the last crawl of every page that was noted after its version."""
        return self._rows().where("version IS NULL").groupBy("url_hash").agg(F.max(F.struct(*self.key)).alias("last"))

    def current(self) -> DataFrame:
        """The newest version of every page."""
        return self._current().drop("part")

    def _current(self) -> DataFrame:
        names = self.state.get("superseded", [])
        if not names:
            return self.history()
        old = [self.spark.read.schema("part string, url_hash string").parquet(f"{self.commits.folder(n)}/superseded") for n in names]
        return self.history().join(_shuffled(reduce(DataFrame.unionAll, old)), ["part", "url_hash"], "left_anti")

    def upsert(self, batch: DataFrame, compact_at: int | None = 16) -> dict[str, int]:
        """Take in a batch of crawled pages; returns counts of what happened, taken while the rows are written."""
        self.reload()
        rest = [c for c in self.schema.names if c not in self.key]
        known = with_identity(batch.select(*self.schema.names)).drop("normalized_url")
        newest = known.groupBy("url_hash").agg(F.max(F.struct(*self.key, *rest)).alias("r"), F.count(F.lit(1)).alias("_rows")).select("r.*", "url_hash", "_rows")
        newest = newest.withColumn("content_hash", F.coalesce(F.unhex(F.sha2("html", 256)), F.lit(b"")))
        stored = self._current().select("url_hash", F.col("content_hash").alias("_hash"), F.col("version").alias("_version"), F.struct(*self.key).alias("_at"), F.col("part").alias("_part"))
        stored = stored.join(_shuffled(self._crawls()), "url_hash", "left").withColumn("_at", F.greatest("_at", "last")).drop("last")
        met = newest.join(_shuffled(stored), "url_hash", "left")
        named = F.col("url_hash").isNotNull()
        fresh, later = named & F.col("_hash").isNull(), F.col("_hash").isNotNull() & (F.struct(*self.key) > F.col("_at"))
        changed = later & (F.col("content_hash") != F.col("_hash"))
        told = Observation()
        # Observed above the join: nothing there can be optimised away when a side is empty.
        met = met.observe(
            told, F.sum("_rows").alias("seen"), F.sum(F.when(~named, F.col("_rows"))).alias("no_url"), F.count("url_hash").alias("pages"),
            F.count_if(fresh).alias("new"), F.count_if(changed).alias("changed"), F.count_if(later & ~changed).alias("unchanged"),
        )
        part = self.commits.new_name("part")
        home = self.commits.folder(part)
        same = later & ~changed
        kept = met.where(fresh | later).withColumns({"version": F.when(~same, F.coalesce("_version", F.lit(0)) + 1), "_part": F.when(changed, F.col("_part")), "html": F.when(~same, F.col("html"))})
        kept.select(*self.full.names, "_part").write.parquet(f"{home}/pages")
        counts = {k: v or 0 for k, v in told.get.items()}
        counts["repeated"] = counts["seen"] - counts["no_url"] - counts["pages"]
        counts["late"] = counts["pages"] - counts["new"] - counts["changed"] - counts["unchanged"]
        if counts["new"] + counts["changed"] + counts["unchanged"]:
            state = {"parts": [], "superseded": [], "n_superseded": 0} | self.state
            state |= {"parts": [*state["parts"], part]}
            if counts["changed"]:
                written = self.spark.read.schema("url_hash string, _part string").parquet(f"{home}/pages").where("_part IS NOT NULL")
                written.select(F.col("_part").alias("part"), "url_hash").write.parquet(f"{home}/superseded")
                state |= {"superseded": [*state["superseded"], part], "n_superseded": state["n_superseded"] + counts["changed"]}
            self.version = self.commits.publish(self.version, state)
            self.state = state
            if compact_at and len(state["parts"]) >= compact_at:
                self.compact()
        return counts

    def compact(self, keep_history: bool = True) -> None:
        """Rewrite the present pages as one part, and what they superseded as another, or drop that."""
        self.reload()
        if len(self.state.get("parts", [])) < 2:
            return
        part = self.commits.new_name("part")
        now = self._current().drop("part")
        crawls = now.select(*self.full.names).join(self._crawls(), "url_hash").withColumns({"html": F.lit(None).cast("string"), "version": F.lit(None).cast("int")} | {c: F.col(f"last.{c}") for c in self.key})
        now.select(*self.full.names).unionByName(crawls.select(*self.full.names)).write.parquet(f"{self.commits.folder(part)}/pages")
        state = self.state | {"parts": [part], "superseded": [], "n_superseded": 0}
        if keep_history and self.state["superseded"]:
            past = self.commits.new_name("past")
            home = self.commits.folder(past)
            now = self.spark.read.schema(self.full).parquet(f"{self.commits.folder(part)}/pages").where("version IS NOT NULL").select("url_hash", "version")
            self.history().drop("part").join(now, ["url_hash", "version"], "left_anti").select(*self.full.names).write.parquet(f"{home}/pages")
            old = self.spark.read.schema(self.full).parquet(f"{home}/pages").select(F.lit(past).alias("part"), "url_hash").distinct()
            old.write.parquet(f"{home}/superseded")
            n = self.spark.read.schema("url_hash string").parquet(f"{home}/superseded").count()
            state |= {"parts": [part, past], "superseded": [past], "n_superseded": n}
        self.version = self.commits.publish(self.version, state)
        self.state = state

    def vacuum(self) -> list[str]:
        """Delete the parts that the last state does not name."""
        return self.commits.vacuum({*self.state.get("parts", []), *self.state.get("superseded", [])})


def start_recrawl(
    spark: SparkSession, landing: str, store: str, checkpoint: str, schema: T.StructType, order: tuple[str, ...] = (), files_per_batch: int | None = None, counted: list[dict] | None = None
) -> StreamingQuery:
    """Take in all crawled files that have landed, then stop; call again for later ones. ``counted`` gathers the counts of each batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take(batch: DataFrame, number: int) -> None:
        counts = PageStore(batch.sparkSession, store, schema, order).upsert(batch)
        if counted is not None:
            counted.append({"batch": number, **counts})

    return reader.parquet(landing).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
