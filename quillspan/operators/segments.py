"""An index that follows its corpus: segments, tombstones, merges.

Every batch of new, changed and removed documents adds one segment for the new texts and a list of tombstones for
what they replace, and publishes both at once (``sources.commits``). Nothing that was written before is
touched, so the cost of a batch follows the batch. ``merge`` rewrites small or worn segments as one.

Tables of a segment:

* ``postings``: one row per term and block of ``width`` consecutive ids, range-partitioned and sorted by (term, block): how many
  documents, the greatest frequency and the least document length in the block, and parallel arrays by document: id,
  occurrences, document length, whether the term is in the title, places. A row holds at most ``width`` documents; a term that every
  document has spreads over as many rows and files as there are blocks. A search reads only the columns it needs.
* ``docs``: id, title, length in tokens, digest of the text, distinct terms.
* ``terms``: the segment's dictionary, term and documents that hold it, sorted; ``grams``: its terms by three-letter gram, sorted.

Tombstones are (segment, doc_id); ``minus`` counts by term how many dead documents the dictionaries still count, so document
frequencies, the number of documents and their mean length are always those of the live documents.

A null or empty text is a document without terms. Rows without id are not indexed. Of several rows with one id in a
batch the last by ``order`` counts, then the one of greatest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stemmer import stem_word
from ..functions.text import TASK_BYTES, bounded_batches, plan_bytes, spread, title, token_array
from ..sources.commits import Commits
from ..sources.readers import remove_folder

#: Ids of one block of postings.
WIDTH = 256
#: Segments from which on a batch merges all of them.
MERGE_AT = 16
#: Counted rows up to which a table is broadcast: each is an id and the name of a segment.
FEW_ROWS = 100_000

_PLACED = "term string, doc_id long, tf int, length int, title boolean, places array<int>"
_POSTINGS = (
    "term string, block long, n int, max_tf int, min_length int, ids array<long>, tfs array<int>, lengths array<int>, titles array<boolean>, places array<array<int>>"
)
_DOCS = "doc_id long, title string, length int, digest binary, terms array<string>"
_FORWARD = f"{_DOCS}, tfs array<int>, titles array<boolean>, places array<array<int>>"
_PART = "term string, block long, ids array<long>, tfs array<int>, lengths array<int>, titles array<boolean>, places array<int>"
_CUT = f"{_DOCS}, part struct<{', '.join(c.replace(' ', ':', 1) for c in _PART.split(', '))}>"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def forward(docs: DataFrame, mode: str = "reference") -> DataFrame:
    """One row for each document, without any shuffle: id, title, length in tokens, digest, and by distinct term parallel arrays of the
    term, its occurrences, whether one is in the first line, and their places (token numbers from 0).

    A batch of documents is grouped at once: its distinct tokens are stemmed, and one sort of the occurrences makes all lists.
    """
    schema = _arrow(_FORWARD)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, titles, digests, tokens, heads = batch.columns
            sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = tokens.flatten().dictionary_encode()
            stems = pa.array([stem_word(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
            term = stems.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(term)) - (np.cumsum(sizes) - sizes)[doc]
            cell = doc * max(len(stems.dictionary), 1) + term
            order = np.argsort(cell, kind="stable")  # places stay in order
            place, cell = place[order], cell[order]
            start = np.flatnonzero(np.diff(cell, prepend=-1))
            d, t = doc[order][start], term[order][start]
            by_doc = pa.array(np.searchsorted(d, np.arange(len(sizes) + 1)), pa.int32())
            places = pa.ListArray.from_arrays(pa.array(np.append(start, len(cell)), pa.int32()), pa.array(place, pa.int32()))
            values = (stems.dictionary.take(pa.array(t)), pa.array(np.diff(np.append(start, len(cell))), pa.int32()), pa.array(place[start] < heads.to_numpy(zero_copy_only=False)[d]), places)
            columns = [ids, titles, pa.array(sizes, pa.int32()), digests, *(pa.ListArray.from_arrays(by_doc, v) for v in values)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    head = F.size(token_array(F.substring_index("text", "\n", 1), mode))
    bounded_batches(docs.sparkSession)
    rows = spread(docs.select("doc_id", "text")).select("doc_id", title("text").alias("title"), digest().alias("digest"), token_array("text", mode).alias("tokens"), head.alias("head"))
    return rows.mapInArrow(group, _FORWARD)


def cut(docs: DataFrame, width: int, mode: str = "reference") -> DataFrame:
    """Documents in ascending id, cut once: a row for each document (doc_id, title, length, digest, terms), and rows with a ``part`` of the postings only.

    A part holds a term's documents in one block as far as one batch has them: what is shuffled has a row for each term and block instead of one for
    each term and document. Its places lie one after another, as many for each document as ``tfs`` tells. A batch is bounded by bytes.
    """
    schema = _arrow(_CUT)
    kinds = {f.name: f.type for f in _arrow(_PART)}

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, titles, digests, tokens, heads = batch.columns
            sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = tokens.flatten().dictionary_encode()
            stems = pa.array([stem_word(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
            term = stems.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(term), dtype=np.int32) - (np.cumsum(sizes) - sizes).astype(np.int32)[doc]
            cell = doc * max(len(stems.dictionary), 1) + term
            order = np.argsort(cell, kind="stable")  # places stay in order
            place, cell = place[order], cell[order]
            start = np.flatnonzero(np.diff(cell, prepend=-1))
            d, t = doc[order][start], term[order][start]
            n = np.diff(np.append(start, len(cell)))
            by_doc = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(len(sizes) + 1)), pa.int32()), stems.dictionary.take(pa.array(t)))
            columns = [ids, titles, pa.array(sizes, pa.int32()), digests, by_doc]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, schema)), pa.nulls(len(sizes), schema.field("part").type)], schema=schema)

            block = np.floor_divide(ids.to_numpy(), width)
            key = np.unique(block, return_inverse=True)[1][d] * max(len(stems.dictionary), 1) + t
            order = np.argsort(key, kind="stable")  # documents stay in order
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            bounds = pa.array(np.append(first, len(key)), pa.int32())
            at = d[order]
            places = pa.ListArray.from_arrays(pa.array(np.append(start, len(cell)), pa.int32()), pa.array(place)).take(pa.array(order))
            ends = np.append(0, np.cumsum(n[order]))
            heads_ = heads.to_numpy(zero_copy_only=False)
            lists = (ids.take(pa.array(at)), pa.array(n[order], pa.int32()), pa.array(sizes[at], pa.int32()), pa.array((place[start] < heads_[d])[order]))
            made = [stems.dictionary.take(pa.array(t[order][first])), pa.array(block[at[first]]), *(pa.ListArray.from_arrays(bounds, v) for v in lists)]
            made.append(pa.ListArray.from_arrays(pa.array(ends[np.append(first, len(key))], pa.int32()), places.flatten()))
            part = pa.StructArray.from_arrays([c.cast(kinds[k]) for c, k in zip(made, kinds)], fields=list(schema.field("part").type))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), f.type) for f in list(schema)[:-1]), part], schema=schema)

    head = F.size(token_array(F.substring_index("text", "\n", 1), mode))
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", title("text").alias("title"), digest().alias("digest"), token_array("text", mode).alias("tokens"), head.alias("head")).mapInArrow(group, _CUT)


def joined(parts: DataFrame) -> DataFrame:
    """Parts as rows of the ``postings`` table, range-partitioned and sorted by (term, block)."""
    schema = _arrow(_POSTINGS)

    def whole(rows: pa.RecordBatch, start: np.ndarray) -> pa.RecordBatch:
        term, block, ids, tfs, lengths, titles, places = rows.columns
        firsts = np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))
        bounds = firsts[np.append(start, rows.num_rows)]
        tf, length, first = tfs.flatten(), lengths.flatten(), pa.array(start)
        inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf.to_numpy())), pa.int32()), places.flatten())
        most, least = np.maximum.reduceat(tf.to_numpy(), bounds[:-1]), np.minimum.reduceat(length.to_numpy(), bounds[:-1])
        lists = (pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), c) for c in (ids.flatten(), tf, length, titles.flatten(), inner))
        columns = [term.take(first), block.take(first), pa.array(np.diff(bounds)), pa.array(most), pa.array(least), *lists]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    bounded_batches(parts.sparkSession)
    # The parts of a block hold ranges of ids one after another.
    dealt = parts.repartitionByRange("term", "block").sortWithinPartitions("term", "block", F.element_at("ids", 1))
    return dealt.mapInArrow(_runs(whole), _POSTINGS)


def _runs(made: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``made`` of rows sorted by their first two columns, (term, block), and of the first row of each block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last block, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            term, block = rows.column(0), rows.column(1).to_numpy()
            other = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False) | (np.diff(block) != 0)
            start = np.append(0, np.flatnonzero(other) + 1)
            if len(start) > 1:
                yield made(rows.slice(0, int(start[-1])), start[:-1])
            held = rows.slice(int(start[-1]))
        if held is not None:
            yield made(held, np.zeros(1, dtype=np.int64))

    return pack


def placed_terms(rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf, length, title, places): a row for every document and term of ``forward``."""
    zipped = F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"), F.col("titles").alias("title"), "places")
    return rows.select("doc_id", "length", F.explode(zipped).alias("t")).select("t.term", "doc_id", "t.tf", "length", "t.title", "t.places")


def blocked(placed: DataFrame, width: int) -> DataFrame:
    """Rows of ``placed_terms`` as rows of the ``postings`` table, range-partitioned and sorted by (term, block).

    Sorted by document too, the rows of a block follow one another, and runs of them become rows with arrays.
    """
    schema = _arrow(_POSTINGS)
    dealt = placed.withColumn("block", F.floor(F.col("doc_id") / F.lit(width)).cast("long")).repartitionByRange("term", "block").sortWithinPartitions("term", "block", "doc_id")

    def packed(rows: pa.RecordBatch, start: np.ndarray) -> pa.RecordBatch:
        term, block, ids, tfs, lengths, titles, places = rows.columns
        bounds = pa.array(np.append(start, rows.num_rows), pa.int32())
        first = pa.array(start)
        n = np.diff(np.append(start, rows.num_rows))
        most, least = np.maximum.reduceat(tfs.to_numpy(), start), np.minimum.reduceat(lengths.to_numpy(), start)
        columns = [term.take(first), block.take(first), pa.array(n), pa.array(most), pa.array(least), *(pa.ListArray.from_arrays(bounds, c) for c in (ids, tfs, lengths, titles, places))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    bounded_batches(placed.sparkSession)
    return dealt.select("term", "block", "doc_id", "tf", "length", "title", "places").mapInArrow(_runs(packed), _POSTINGS)


def digest(text: str = "text") -> Column:
    """Digest of a text; a null one differs from an empty one."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


#: Letters of a gram, and marks for the ends of a word; no token holds the marks.
GRAM, BEGIN, END = 3, "<", ">"


def grams(terms: DataFrame) -> DataFrame:
    """(gram, term): the grams of every term with its ends."""
    marked = terms.select("term", F.concat(F.lit(BEGIN), F.col("term"), F.lit(END)).alias("m"))
    places = marked.select("term", "m", F.explode(F.sequence(F.lit(1), F.greatest(F.char_length("m") - (GRAM - 1), F.lit(1)))).alias("k"))
    return places.select(F.substring("m", F.col("k"), F.lit(GRAM)).alias("gram"), "term")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


#: Bytes of a table, as the planner knows them, for each task that cuts its texts.
CUT_BYTES = 16 << 20


def _tasks(df: DataFrame) -> int | None:
    """Tasks that cut the texts of a table: as many as there are cores, more for larger tables; None if its size is not known."""
    size = plan_bytes(df)
    return None if size >= 1 << 50 else int(max(1, min(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES), size // CUT_BYTES))


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` hinted for broadcast if it has at most ``FEW_ROWS`` rows; they are counted up to that bound unless ``rows`` tells them."""
    return F.broadcast(df) if (df.limit(FEW_ROWS + 1).count() if rows is None else rows) <= FEW_ROWS else df


class SegmentIndex:
    """A stored index. Each object reads the state that was the last when it was opened or ``reload``-ed."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "reference", width: int = WIDTH):
        self.spark, self.mode = spark, mode
        self.commits = Commits(spark, path)
        self.reload()
        self.width = self.state.get("width", width)
        self.mode = self.state.get("mode", mode)

    def reload(self) -> SegmentIndex:
        self.version, self.state = self.commits.latest()
        return self

    # Reading

    def _table(self, name: str, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.commits.folder(name)}/{kind}")

    def _segments(self, kind: str, schema: str) -> DataFrame:
        """One table of all segments, with the segment's name."""
        parts = [self._table(s, kind, schema).withColumn("segment", F.lit(s)) for s in self.state.get("segments", [])]
        return _union(parts) if parts else self.spark.createDataFrame([], f"{schema}, segment string")

    def _dead(self) -> DataFrame | None:
        names = self.state.get("tombstones", [])
        return few(_union([self._table(n, "dead", "segment string, doc_id long") for n in names]), self.state["n_dead"]) if names else None

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, doc_id, ...) without those of tombstones."""
        dead = self._dead()
        return rows if dead is None else rows.join(dead, ["segment", "doc_id"], "left_anti")

    def docs(self) -> DataFrame:
        """(doc_id, title, length, digest) of the live documents."""
        return self._live(self._segments("docs", _DOCS).drop("terms")).drop("segment")

    def blocks(self) -> DataFrame:
        """Rows of all ``postings`` tables, dead documents included: for bounds and for reading parts of lists."""
        return self._segments("postings", _POSTINGS)

    def matches(self, blocks: DataFrame, *columns: str) -> DataFrame:
        """(term, block, doc_id, columns...) of the live documents in some rows of ``blocks``; columns are among tf, length, title, places."""
        source = {"doc_id": "ids", "tf": "tfs", "length": "lengths", "title": "titles", "places": "places"}
        zipped = F.arrays_zip(*[F.col(source[c]).alias(c) for c in ("doc_id", *columns)])
        rows = blocks.select("segment", "term", "block", F.explode(zipped).alias("m")).select("segment", "term", "block", "m.*")
        return self._live(rows).drop("segment")

    def postings(self) -> DataFrame:
        """(term, doc_id) of the live documents; filters on term reach the scan."""
        return self.matches(self.blocks()).select("term", "doc_id")

    def dictionary(self, terms: Column | None = None) -> DataFrame:
        """(term, doc_freq) of the live documents. ``terms`` is a condition on term that reaches the scans."""
        held = self._segments("terms", "term string, doc_freq long").drop("segment")
        lost = [self._table(n, "minus", "term string, doc_freq long") for n in self.state.get("tombstones", [])]
        both = _union([held, *(m.select("term", (-F.col("doc_freq")).alias("doc_freq")) for m in lost)])
        both = both if terms is None else both.where(terms)
        return both.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq")).where(F.col("doc_freq") > 0)

    def terms_with_grams(self, asked: list[str]) -> DataFrame:
        """(term, doc_freq) of the dictionary's terms that have all of some grams."""
        rows = self._segments("grams", "gram string, term string").where(F.col("gram").isin(asked)).select("gram", "term").distinct()
        found = rows.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("term")
        return found.join(self.dictionary(), "term")

    @property
    def n_docs(self) -> int:
        return self.state.get("n_docs", 0)

    @property
    def n_tokens(self) -> int:
        return self.state.get("n_tokens", 0)

    # Writing

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, batch: tuple[str, int] | None = None, order: tuple[str, ...] = (), merge_at: int | None = MERGE_AT) -> bool:
        """Index new and changed documents (doc_id, text) and drop the ids of ``deletes`` that are not among them.

        A document whose text is already indexed is left alone. ``batch`` names the source of a stream and its batch number: one that is not
        later than the last one published from that source is a replay and does nothing. Returns whether a state was published.
        """
        self.reload()
        if batch and self.state.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return False
        state = {"segments": [], "tombstones": [], "n_dead": 0, "n_docs": 0, "n_tokens": 0, "batches": {}, "width": self.width, "mode": self.mode} | self.state
        before = state
        state = dict(state)
        if batch:
            state["batches"] = {**state["batches"], batch[0]: batch[1]}
        new = self.commits.new_name("segment")
        gone = self.commits.new_name("tombstones")
        touched: list[DataFrame] = []
        added = False
        if upserts is not None:
            added = self._write(self._fresh(upserts, order), new)
            if added:
                touched.append(self._table(new, "docs", _DOCS).select("doc_id"))
        if deletes is not None:
            dropped = deletes.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
            touched.append(dropped if upserts is None else dropped.join(upserts.select("doc_id"), "doc_id", "left_anti"))
        if touched and state["segments"]:
            self._bury(_union(touched).distinct(), gone)
            lost = self._table(gone, "dead", "segment string, doc_id long, length int").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
            if lost["n"]:
                state["tombstones"] = [*state["tombstones"], gone]
                state["n_dead"] += lost["n"]
                state["n_docs"], state["n_tokens"] = state["n_docs"] - lost["n"], state["n_tokens"] - lost["t"]
        if added:
            made = self._table(new, "docs", _DOCS).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
            state["segments"] = [*state["segments"], new]
            state["n_docs"], state["n_tokens"] = state["n_docs"] + made["n"], state["n_tokens"] + made["t"]
        if state == before:
            return False
        self.version = self.commits.publish(self.version, state)
        self.state = state
        if merge_at and len(state["segments"]) >= merge_at:
            self.merge()
        return True

    def refresh(self, docs: DataFrame) -> bool:
        """Make the index that of ``docs``: what is new or changed is indexed, what is no longer there is dropped."""
        gone = self.docs().select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti")
        return self.apply(docs, gone)

    def merge(self, names: list[str] | None = None) -> None:
        """Rewrite segments, all unless some are named, as one without dead documents."""
        self.reload()
        chosen = [s for s in self.state.get("segments", []) if names is None or s in names]
        if not chosen or len(chosen) == 1 and not self.state["tombstones"]:
            return
        new = self.commits.new_name("segment")
        home = self.commits.folder(new)
        some = F.col("segment").isin(chosen)
        placed = self.matches(self.blocks().where(some), "tf", "length", "title", "places").drop("block")
        blocked(placed, self.width).write.parquet(f"{home}/postings")
        self._live(self._segments("docs", _DOCS).where(some)).drop("segment").write.parquet(f"{home}/docs")
        self._write_terms(new)
        left = [s for s in self.state["segments"] if s not in chosen]
        state = self.state | {"segments": [*left, new]}
        if not left:
            state |= {"tombstones": [], "n_dead": 0}
        elif self.state["tombstones"]:
            # What stays dead, and what the dictionaries of the other segments still count.
            gone = self.commits.new_name("tombstones")
            dead = _union([self._table(n, "dead", "segment string, doc_id long, length int") for n in self.state["tombstones"]]).where(F.col("segment").isin(left))
            self._write_dead(dead, gone, left)
            state |= {"tombstones": [gone], "n_dead": self._table(gone, "dead", "doc_id long").count()}
        self.version = self.commits.publish(self.version, state)
        self.state = state

    def vacuum(self) -> list[str]:
        """Delete the tables that the last state does not name; readers of earlier states lose them."""
        return self.commits.vacuum({*self.state.get("segments", []), *self.state.get("tombstones", [])})

    def _fresh(self, upserts: DataFrame, order: tuple[str, ...]) -> DataFrame:
        """One (doc_id, text) for each id whose text the index does not have."""
        rows = upserts.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*order, "text").alias("row")).where("doc_id IS NOT NULL")
        tasks = _tasks(upserts)
        dealt = lambda df: df.repartitionByRange(*([tasks] if tasks else []), "doc_id")
        first = not self.state.get("segments")
        rows = dealt(rows) if first else rows  # ranges of ids bring the rows of one id together, too
        last = rows.groupBy("doc_id").agg(F.max("row").alias("row")).select("doc_id", "row.text")
        if not first:
            known = self.docs().select("doc_id", F.col("digest").alias("old"))
            last = dealt(last.withColumn("digest", digest()).join(known, "doc_id", "left").where(~F.col("digest").eqNullSafe(F.col("old"))).select("doc_id", "text"))
        return last.sortWithinPartitions("doc_id")

    def _write(self, docs: DataFrame, name: str) -> bool:
        """Write the tables of a segment from documents in ranges of ascending ids; without documents there is none."""
        home = self.commits.folder(name)
        cut(docs, self.width, self.mode).write.parquet(f"{home}/cut")  # texts are read and cut once; the tables are made from this
        rows = self.spark.read.schema(_CUT).parquet(f"{home}/cut")
        if rows.isEmpty():
            return False
        joined(rows.where("part IS NOT NULL").select("part.*")).write.parquet(f"{home}/postings")
        rows.where("doc_id IS NOT NULL").select("doc_id", "title", "length", "digest", "terms").write.parquet(f"{home}/docs")
        self._write_terms(name)
        remove_folder(self.spark, f"{home}/cut")
        return True

    def _write_terms(self, name: str) -> None:
        counts = self._table(name, "postings", _POSTINGS).groupBy("term").agg(F.sum("n").alias("doc_freq"))
        counts.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.commits.folder(name)}/terms")
        words = grams(self._table(name, "terms", "term string, doc_freq long"))
        words.repartitionByRange("gram", "term").sortWithinPartitions("gram", "term").write.parquet(f"{self.commits.folder(name)}/grams")

    def _bury(self, ids: DataFrame, name: str) -> None:
        """Tombstones for the live rows of ``ids`` in the segments of the present state."""
        live = self._live(self._segments("docs", _DOCS).select("segment", "doc_id", "length"))
        self._write_dead(live.join(few(ids), "doc_id", "left_semi"), name, self.state["segments"])

    def _write_dead(self, dead: DataFrame, name: str, segments: list[str]) -> None:
        home = self.commits.folder(name)
        dead.select("segment", "doc_id", "length").write.parquet(f"{home}/dead")
        written = few(self._table(name, "dead", "segment string, doc_id long"))
        terms = self._segments("docs", _DOCS).where(F.col("segment").isin(segments)).join(written, ["segment", "doc_id"], "left_semi")
        lost = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("doc_freq"))
        lost.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{home}/minus")
