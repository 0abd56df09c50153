"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items are put into one automaton: a state stands for a class of word sequences
that occur at the same places of the items. Training words stream through it; the state and the
matching length are those of the longest sequence that ends at the word and occurs in an item. A
window is ``window`` consecutive words of an item, or a whole item of fewer words; the windows that end at a
word are suffixes of its longest match, so they lie on the state's chain of suffix links and are
listed for it beforehand, with the items that have them.

Only runs of words whose neighbours also stand side by side in an item (the automaton's transitions of
depth two) and that are as long as the shortest window stream through it; any other word cannot lie in
a window. That test works on whole batches and is exact, and so is the comparison of words.

Items are taken in blocks of ``BLOCK_WORDS`` words; a block's automaton travels to the workers. One
block is one map over the documents; of several blocks, each makes its own pass and the hits of a text
meet by (doc_id, digest of the text). Documents are never joined with items.

Null and empty texts have no words and no hits; an item without words has no window. Texts of any length are
read whole. Repeated rows get equal results. Several rows of one item_id are one item with several texts; items without id take part
and are named by an empty string. Without items nothing is hit; an empty table gives no rows. Other columns
are not read by ``contaminated`` and pass through ``decontaminate`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, give_back, prepare, to_arrow
from .words import batches_of, ids_of, item_blocks, split_words

WINDOW = 10
BLOCK_WORDS = 1 << 18
#: Share of a document's words from which on it is dropped whole.
COVERAGE = 0.5


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows of the items at its states."""

    def __init__(self, items: Sequence[tuple[Any, list[bytes]]], window: int = WINDOW):
        known = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.vocabulary = pa.array(list(known), pa.large_binary())
        self.width = max(len(known), 1)
        self.step: dict[int, int] = {}  # state * width + word -> state
        self.length, self.link = [0], [-1]
        self._out: list[list[int]] = [[]]  # words that lead out of a state, while it is built
        texts = [(i, [known[w] for w in words]) for i, words in items if words]
        for _, ids in texts:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        del self._out
        self.shortest = min((min(len(ids), window) for _, ids in texts), default=window)
        codes = np.unique(np.array([a * self.width + b for _, ids in texts for a, b in zip(ids, ids[1:])], dtype=np.int64))
        self.pairs = codes
        self._place_windows(texts, window)

    def _new(self, length: int, link: int, out: list[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append(out)
        return len(self.length) - 1

    def _copy(self, p: int, w: int, q: int) -> int:
        """Split off the part of ``q`` that continues ``p`` by ``w``."""
        step, width = self.step, self.width
        twin = self._new(self.length[p] + 1, self.link[q], self._out[q][:])
        for x in self._out[q]:
            step[twin * width + x] = step[q * width + x]
        self.link[q] = twin
        while p >= 0 and step.get(p * width + w) == q:
            step[p * width + w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        """State of the sequence of ``last`` continued by ``w``."""
        step, width = self.step, self.width
        q = step.get(last * width + w)
        if q is not None:  # an earlier item went on the same way
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, w, q)
        made, p = self._new(self.length[last] + 1, 0, []), last
        while p >= 0 and p * width + w not in step:
            step[p * width + w] = made
            self._out[p].append(w)
            p = self.link[p]
        if p >= 0:
            q = step[p * width + w]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._copy(p, w, q)
        return made

    def _place_windows(self, texts: list[tuple[Any, list[int]]], window: int) -> None:
        """``chain[state]``: (length, number) of the windows that are suffixes of its sequences; ``items[number]``: who has them."""
        order = np.argsort(self.length, kind="stable").tolist()
        at = [0] * len(self.length)  # the state of a long sequence's last ``window`` words
        for v in order:
            at[v] = v if self.length[v] < window or self.length[self.link[v]] < window else at[self.link[v]]
        own: dict[int, dict[int, int]] = {}
        self.items: list[set] = []
        for item, ids in texts:
            size, v = min(len(ids), window), 0
            for k, w in enumerate(ids, 1):
                v = self.step[v * self.width + w]
                if k >= size:
                    t = at[v] if size == window else v
                    while self.length[self.link[t]] >= size:
                        t = self.link[t]
                    number = own.setdefault(t, {}).setdefault(size, len(self.items))
                    if number == len(self.items):
                        self.items.append(set())
                    self.items[number].add("" if item is None else str(item))
        none: tuple[tuple[int, int], ...] = ()
        self.chain = [none] * len(self.length)
        for v in order[1:]:
            here = tuple(sorted(own[v].items())) if v in own else none
            self.chain[v] = self.chain[self.link[v]] + here if here else self.chain[self.link[v]]

    def runs(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words, as (begin, end), that may hold a window; they do not cross texts."""
        known = ids >= 0
        linked = np.zeros(len(ids) + 1, dtype=bool)
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(both) and len(self.pairs):
            code = ids[both - 1] * self.width + ids[both]
            near = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            linked[both[self.pairs[near] == code]] = True
        linked[first] = False
        begin = np.flatnonzero(known & ~linked[:-1])
        end = np.flatnonzero(known & ~linked[1:]) + 1
        long = end - begin >= self.shortest
        return begin[long], end[long]

    def windows(self, ids: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(end, matching length, window length, window number) of every window in a run of known words."""
        step, length, link, chain, width = self.step, self.length, self.link, self.chain, self.width
        v, matched = 0, 0
        for k, w in enumerate(ids, 1):
            to = step.get(v * width + w)
            while to is None and v:
                v = link[v]
                matched = length[v]
                to = step.get(v * width + w)
            if to is None:
                continue
            v, matched = to, matched + 1
            for size, number in chain[v]:
                if size > matched:
                    break
                yield k, matched, size, number


def _hits(automaton: Automaton, words) -> tuple[np.ndarray, dict[int, set], dict[int, int]]:
    """Which words of a batch are hit, and by text with hits: numbers of its windows, longest match."""
    edge = np.zeros(len(words.words) + 1, dtype=np.int64)
    found: dict[int, set] = {}
    longest: dict[int, int] = {}
    ids = ids_of(words.words, automaton.vocabulary)
    begin, end = automaton.runs(ids, words.first[:-1])
    texts = np.searchsorted(words.first, begin, side="right") - 1
    for b, e, text in zip(begin.tolist(), end.tolist(), texts.tolist()):
        for k, matched, size, number in automaton.windows(ids[b:e].tolist()):
            edge[b + k - size] += 1
            edge[b + k] -= 1
            found.setdefault(text, set()).add(number)
            longest[text] = max(longest.get(text, 0), matched)
    return np.cumsum(edge[:-1]) > 0, found, longest


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_FOUND = "n_words long, n_hit long, longest long, items array<string>, hits array<long>"


def _scan(docs: DataFrame, automaton: Automaton, whole: bool) -> DataFrame:
    """doc_id, digest of the text, perhaps the whole ``row``, and what one block of items hits."""
    sent = docs.sparkSession.sparkContext.broadcast(automaton)
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), *[F.struct("*").alias("row")] * whole, "text")
    schema = T.StructType([*rows.drop("text").schema, *T._parse_datatype_string(_FOUND)])
    arrow = to_arrow(schema)
    passed = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch, words in batches_of("text", batches):
            hit, found, longest = _hits(machine, words)
            counted = np.concatenate([[0], np.cumsum(hit)])
            spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for text, numbers in found.items():
                spans[text] = np.stack(_spans(hit[words.first[text] : words.first[text + 1]]), 1).ravel().tolist()
                items[text] = sorted(set().union(*(machine.items[n] for n in numbers)))
            made = [np.diff(words.first), np.diff(counted[words.first]), [longest.get(t, 0) for t in range(batch.num_rows)], items, spans]
            columns = [batch.column(k).cast(arrow.field(k).type) for k in range(passed)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, arrow.field(passed + k).type) for k, c in enumerate(made))], schema=arrow)
        give_back()

    return rows.mapInArrow(run, schema)


def _merged(hits: F.Column) -> F.Column:
    """Lists begin, end, begin, end, ... of several blocks as one such list of disjoint spans."""
    pairs = lambda h: F.transform(F.filter(F.transform(h, lambda x, k: F.struct(x.alias("b"), F.get(h, k + 1).alias("e"), k.alias("k"))), lambda s: s.k % 2 == 0), lambda s: F.struct(s.b, s.e))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return F.aggregate(
        F.sort_array(F.flatten(F.transform(hits, pairs))),
        F.array().cast("array<bigint>"),
        lambda a, s: F.when(last(a) >= s.b, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.greatest(last(a), s.e)))).otherwise(F.concat(a, F.array(s.b, s.e))),
    )


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, digest, n_words, n_hit, longest, items (ids, sorted as strings), hits.

    ``longest`` is the longest match of a window or more, 0 without one; ``hits`` are word places begin, end, begin, end, ...
    With ``whole`` the document's columns are there too, as a struct ``row``.
    """
    prepare(docs.sparkSession)
    parts = [_scan(docs, Automaton(block, window), whole) for block in item_blocks(items, "item_id", "text", block_words)] or [_scan(docs, Automaton([], window), whole)]
    if len(parts) == 1:
        return parts[0]
    found = [p.where(F.size("hits") > 0).select("doc_id", "digest", "longest", "items", "hits").distinct() for p in parts]
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionAll(part)
    lists = rows.groupBy("doc_id", "digest").agg(F.max("longest").alias("longest"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.collect_list("hits").alias("hits"))
    united = durable(lists.withColumn("hits", _merged(F.col("hits"))))
    base, met = parts[0].drop("n_hit", "longest", "items", "hits").alias("a"), united.alias("b")
    both = base.join(met, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    hits = F.coalesce("b.hits", F.array().cast("array<bigint>"))
    n_hit = F.aggregate(F.transform(hits, lambda x, k: F.when(k % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    columns = [F.col(f"a.{c}") for c in base.columns]
    return both.select(*columns, n_hit.alias("n_hit"), F.coalesce("b.longest", F.lit(0).cast("long")).alias("longest"), F.coalesce("b.items", F.array().cast("array<string>")).alias("items"), hits.alias("hits"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without what items hit: spans of hit words go, and documents with a share of ``coverage`` or more of their words.

    All columns stay; a text loses the bytes from the first to the last letter of each span. Documents without hits stay as they are.
    """
    found = contaminated(docs, items, window, block_words, whole=True)
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < coverage * F.col("n_words")))
    schema = docs.schema
    arrow = to_arrow(schema)
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.cast(f.type) for c, f in zip(batch.column(0).flatten(), arrow)]
            texts, hits = columns[at], batch.column(1)
            cut: dict[int, str] = {}
            for row in np.flatnonzero(hits.value_lengths().to_numpy(zero_copy_only=False)).tolist():
                words, spans = split_words(texts.slice(row, 1)), hits[row].as_py()
                edges = [0, *(int(words.end[p - 1] if k % 2 else words.start[p]) for k, p in enumerate(spans)), len(words.raw)]
                cut[row] = b"".join(words.raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "replace")
            if cut:
                columns[at] = pa.array([cut.get(row, t) for row, t in enumerate(texts.to_pylist())], texts.type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return kept.select("row", "hits").mapInArrow(run, schema)
