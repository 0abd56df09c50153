"""Removal of repeated runs by winnowing.

What is hashed is a running line: every ``GRAM`` consecutive words, over line ends. (Hashes of
whole lines cannot see a passage that begins or ends inside a line, and most repeated passages
do.) In every window of ``WINDOW`` consecutive hashes the smallest is a fingerprint, so any run of
GRAM + WINDOW - 1 = 50 words has at least one, at the same place in each of its copies. The
earliest position of a fingerprint - by doc_id, then by place - is joined to all its later
positions; each match is extended both ways word by word, and where at least 50 words agree the
run is deleted from the later place. The earliest place of a word always stays, because every
deleted word was matched with an equal word at an earlier place. Later places may share more with
each other than with the first place of their fingerprint, whether that shares 50 words or fewer.
Then they differ from it at the same word and go on alike; agreements that end so are grouped once
more by the whole 50-word windows across their ends, and every window that an earlier place has is
deleted.

Whole copies collapse first: a copy of 50 words or more loses all its text, shorter documents are
left alone. A run that repeats within one document at a distance below 50 words keeps its first
50 words.

Null texts stay null; empty texts stay empty; texts are read whole. Repeated rows of one document are
one document: all keep or lose the same words. An id that comes with several different texts stands for
one of them (that of smallest digest among those it is the smallest id of); its other texts lose
nothing, unless they are whole copies of another id's text, and are no one's earlier place. Rows without id lose nothing and are no one's earlier place. An empty table gives no rows. Further columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, durable, hinted, map_batches, scratch, small_side
from .near_dedup import _mix, left_out

GRAM = 25
WINDOW = 26
RUN = GRAM + WINDOW - 1
#: Numbers of words beyond an agreement by which other places may share its continuation.
BEYOND = (1, 2, 4, 8, 16)
#: Places from which on a fingerprint counts as hot, and later texts that share one copy of their source.
HOT = 1000
SHARE = 256
#: By the last of ``BEYOND`` that is shared: words that a window with a gram in the agreement may hold beyond it.
_MOST = [*(k - 1 for k in BEYOND[1:]), RUN - GRAM]

_U = np.uint64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.steps = base, pow(base, -1, 1 << 64)
        self.tables = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) < n:
            for k, (table, step) in enumerate(zip(self.tables, self.steps)):
                ahead = _U(pow(step, len(table), 1 << 64))
                self.tables[k] = np.concatenate([table, table * ahead])
        return self.tables[0][:n], self.tables[1][:n]


_ROLLING = [_Powers(base) for base in _BASES]


def rolling(h: np.ndarray, size: int, which: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words, from prefix sums of a polynomial."""
    n = len(h) - size + 1
    up, down = _ROLLING[which].upto(len(h) + 1)
    prefix = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(h * up[: len(h)], out=prefix[1:])
    return _mix((prefix[size:] - prefix[:-size]) * down[:n])


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = best(x[:-reach], x[reach:])
        reach *= 2
    return best(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes hashed at once; longer texts are cut at white space.
CHUNK = 1 << 20


def _hash_words(raw: bytes) -> np.ndarray:
    """Hashes of the words of one piece, from prefix sums of a polynomial over its bytes."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    edge = np.ones(len(codes) + 2, dtype=bool)
    edge[1:-1] = _SPACE[codes]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = at[::2], at[1::2]
    up, down = _ROLLING[0].upto(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum(_BYTE[codes] * up[: len(codes)], out=prefix[1:])
    return _mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= CHUNK:
        return _hash_words(raw)
    out, at = [], 0
    while at < len(raw):
        to = len(raw)
        if at + CHUNK < len(raw):
            gap = _GAP.search(raw, at + CHUNK)
            to = gap.start() if gap else len(raw)
        out.append(_hash_words(raw[at:to]))
        at = to
    return np.concatenate(out)


def fingerprints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the window minima of a document of at least ``RUN`` words.

    Of equal neighbours less than a window apart only the first is kept, so monotonous text
    does not make every position a fingerprint.
    """
    n = len(h) - GRAM + 1
    if n < WINDOW:
        return np.empty(0, dtype=_U), np.empty(0, dtype=np.int64)
    grams = rolling(h, GRAM, 0)
    least = sliding(grams, WINDOW, np.minimum)
    # A gram is a minimum of some window that holds it if the largest of those windows' minima is it.
    around = np.zeros(n + WINDOW - 1, dtype=_U)
    around[WINDOW - 1 : n] = least
    at = np.flatnonzero(sliding(around, WINDOW, np.maximum) == grams)
    found = grams[at]
    if not (found[1:] == found[:-1]).any():
        return found, at
    kept = [0]
    for i in range(1, len(at)):
        if found[i] != found[kept[-1]] or at[i] - at[kept[-1]] >= WINDOW:
            kept.append(i)
    return found[kept], at[kept]


def agreements(source: np.ndarray, target: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """Word ranges of ``target`` that agree with ``source`` moved by ``shift``, as far as they reach, at least GRAM long."""
    low = max(0, -shift)
    n = min(len(source), len(target) - shift) - low
    if n < GRAM:
        return []
    equal = np.zeros(n + 2, dtype=np.int8)
    equal[1:-1] = source[low : low + n] == target[low + shift : low + shift + n]
    edge = np.flatnonzero(np.diff(equal))
    long = edge[1::2] - edge[::2] >= GRAM
    return [(int(s) + low + shift, int(e) + low + shift) for s, e in zip(edge[::2][long], edge[1::2][long])]


def ends_of(words: np.ndarray, s: int, e: int, src: int, shift: int) -> tuple[list[int], list[int]]:
    """Hashes of the ``BEYOND`` words before and after an agreement, with the place in ``src`` where it ends on that side."""
    import xxhash

    def key(side: int, at: int, beyond: np.ndarray) -> int:
        value = xxhash.xxh3_64_intdigest(np.array([side, src, at], dtype=np.int64).tobytes() + beyond.tobytes())
        return value - (1 << 64) if value >> 63 else value

    left = [key(0, s - shift, words[s - k : s]) for k in BEYOND if k <= s]
    right = [key(1, e - shift, words[e : e + k]) for k in BEYOND if e + k <= len(words)]
    return left, right


def merge_packed(spans: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ascending ranges of overlapping or touching ones, each packed as start * 2**32 + end."""
    start, end = np.divmod(np.sort(spans), 1 << 32)
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return list(zip(start[first].tolist(), reach[np.append(first[1:], len(start)) - 1].tolist()))


def delete_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word ranges. Where a range goes, one separator stays, a line end if there was one."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    out, done = [], 0
    for s, e in spans:
        if e <= s:
            continue
        before = at[s - 1][1] if s else 0
        after = at[e][0] if e < len(at) else len(raw)
        out.append(raw[done:before])
        if s and e < len(at):
            left, right = raw[before : at[s][0]], raw[at[e - 1][1] : after]
            out.append(right if b"\n" in right and b"\n" not in left else left)
        done = after
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def _windows(texts: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, start): 128-bit hashes of the 50-word windows across the ``ends`` of agreements."""

    def run(cols):
        out = {"w1": [], "w2": [], "doc_id": [], "start": []}
        for doc, text, ends, runs in zip(cols["doc_id"], cols["text"], cols["ends"], cols["runs"]):
            h = word_hashes(text)
            crossing = []
            for r in ends:
                starts = np.arange(r["low"] - (0 if r["left"] is None else _MOST[r["left"]]), r["high"] + (0 if r["right"] is None else _MOST[r["right"]]) - RUN + 1)
                crossing.append(starts[(starts < r["low"]) | (starts + RUN > r["high"])])
            starts = np.unique(np.concatenate(crossing))
            starts = starts[(starts >= 0) & (starts + RUN <= len(h))]
            for r in runs or ():
                # Within one run every window has an earlier place, and that place is here too.
                starts = starts[(starts < r["s"]) | (starts + RUN > r["e"])]
            for k, name in ((1, "w1"), (2, "w2")):
                out[name] += rolling(h, RUN, k)[starts].view(np.int64).tolist() if len(starts) else []
            out["doc_id"] += [doc] * len(starts)
            out["start"] += starts.tolist()
        return out

    return map_batches(texts, run, "w1 long, w2 long, doc_id long, start int", rows=512)


def _across(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, s, e) of repeated windows that hold a fingerprint and go beyond its agreement with the first place.

    Two places with such a window differ from the first place at the same word of it, and share the words
    of the window beyond. So only ends of agreements that have this in common are looked at.
    """
    keys = [found.select("doc_id", "low", "high", F.lit(side).alias("side"), F.posexplode(side).alias("shared", "key")) for side in ("left", "right")]
    keys = keys[0].unionAll(keys[1])
    common = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    kept = keys.join(small_side(common), "key", "left_semi")
    sides = [F.max(F.when(F.col("side") == side, F.col("shared"))).alias(side) for side in ("left", "right")]
    ends = kept.groupBy("doc_id", "low", "high").agg(*sides).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high", "left", "right")).alias("ends"))
    covered = found.where("s < e").groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("runs"))
    ends = small_side(ends.join(covered, "doc_id", "left"))
    texts = docs.join(ends, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "ends", "runs")
    windows = durable(_windows(texts))
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(first.select("w1", "w2", F.col("f.doc_id").alias("f_doc"), F.col("f.start").alias("f_start")), ["w1", "w2"])
    later = later.where((F.col("doc_id") != F.col("f_doc")) | (F.col("start") - F.col("f_start") >= RUN))
    return later.select("doc_id", F.col("start").alias("s"), (F.col("start") + RUN).alias("e"))


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n (words), digest of the word sequence, fingerprints and their positions."""

    def run(cols):
        import xxhash

        out = {k: [] for k in ("n", "h1", "h2", "prints", "places")}
        for text in cols["text"]:
            h = word_hashes(text)
            digest = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=np.int64)
            prints, places = fingerprints(h)
            for name, value in zip(out, (len(h), int(digest[0]), int(digest[1]), prints.view(np.int64), places.astype(np.int32))):
                out[name].append(value)
        return {"doc_id": cols["doc_id"], "t": cols["t"], **out}

    schema = "doc_id long, t long, n int, h1 long, h2 long, prints array<long>, places array<int>"
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("t"), "text"), run, schema, rows=2048)


def _first_places(marks: DataFrame) -> DataFrame:
    """(doc_id, place, src, src_place): the marks whose fingerprint an earlier place has, with the first such place.

    Fingerprints of many places are few; where they are few enough to be sent to every task, their marks
    never gather in one. The rest, and all where they are not, is joined by fingerprint.
    """
    first = durable(marks.groupBy("print").agg(F.min("doc_id").alias("src"), F.count("*").alias("n")).where("n > 1"))
    hot = small_side(first.where(F.col("n") > HOT).select("print", "src"))
    if hot.isEmpty():
        met = durable(marks.join(first.select("print", "src"), "print"))
        places = met.where("doc_id = src").groupBy("print").agg(F.min("place").alias("src_place"))
        return met.join(places, "print").where("doc_id <> src or place <> src_place").select("doc_id", "place", "src", "src_place")
    cold = marks.join(hot.select("print"), "print", "left_anti").join(first.where(F.col("n") <= HOT).select("print", "src"), "print")
    met = durable(marks.join(hot, "print").unionAll(cold.select("print", "doc_id", "place", "src")))
    places = met.where("doc_id = src").groupBy("print").agg(F.min("place").alias("src_place"))
    busy = small_side(places.join(hot.select("print"), "print", "left_semi"))
    quiet = met.join(hot.select("print"), "print", "left_anti").join(places, "print")
    matched = met.join(busy, "print").unionAll(quiet.select("print", "doc_id", "place", "src", "src_place"))
    return matched.where("doc_id <> src or place <> src_place").select("doc_id", "place", "src", "src_place")


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, t, spans, n_removed): the word ranges to delete from each text that has any; reads one checkpoint, the others are gone."""
    docs = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        every = durable(_prints(docs).where("doc_id is not null"))
        printed = every.where(F.col("n") >= RUN)
        heads = printed.groupBy("h1", "h2").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")).where("copies > 1")
        copies = printed.select("doc_id", "t", "h1", "h2", "n").join(heads, ["h1", "h2"]).where("doc_id <> head")
        copied = durable(copies.select("doc_id", "t", F.concat(F.lit("0:"), F.col("n")).alias("spans"), F.col("n").cast("long").alias("n_removed")).distinct())
        gone, odd = copied.select("doc_id", "t"), left_out(every, RUN)
        if odd is not None:
            gone = gone.unionAll(odd)
        gone = small_side(gone)
        if odd is not None:
            docs = docs.withColumn("t", F.xxhash64("text")).join(gone, ["doc_id", "t"], "left_anti").drop("t")
        sole = printed.join(gone, ["doc_id", "t"], "left_anti")
        marks = sole.select("doc_id", F.explode(F.arrays_zip("prints", "places")).alias("m")).select(F.col("m.prints").alias("print"), "doc_id", F.col("m.places").alias("place"))
        pairs = _first_places(marks).select("src", "doc_id", (F.col("place") - F.col("src_place")).alias("shift")).distinct()
        pairs = durable(pairs.groupBy("src", "doc_id").agg(F.sort_array(F.collect_list("shift")).alias("shifts")))
        collect_garbage(docs.sparkSession)
        found = durable(_extended(pairs, docs))
        collect_garbage(docs.sparkSession)
        runs = found.where("s < e").select("doc_id", "s", "e").unionAll(_across(found, docs))
        packed = (F.col("s").cast("long") * (1 << 32) + F.col("e")).alias("span")
        runs = runs.select("doc_id", packed).groupBy("doc_id").agg(F.collect_set("span").alias("all"))

        def join_up(cols):
            merged = [merge_packed(np.array(spans, dtype=np.int64)) for spans in cols["all"]]
            return {"doc_id": cols["doc_id"], "spans": [",".join(f"{s}:{e}" for s, e in m) for m in merged], "n_removed": [sum(e - s for s, e in m) for m in merged]}

        merged = small_side(map_batches(runs, join_up, "doc_id long, spans string, n_removed long"))
        # Rows of one id and one word sequence may differ in white space: each gets the ranges.
        own = sole.select("doc_id", "t").join(merged, "doc_id").distinct()
        return keep(own.select("doc_id", "t", "spans", "n_removed").unionAll(copied))


def _extended(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, s, e, low, high, left, right): agreements of later texts with first ones, and what is to go of each.

    A source that many texts repeat is sent once for every ``SHARE`` of them, so neither it nor they gather in one task.
    """
    cells = pairs.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16))).groupBy("src", "cell").agg(F.count("*").alias("c"))
    parts = cells.groupBy("src").agg(F.ceil(F.sum("c") / SHARE).alias("parts"))
    placed = cells.join(parts, "src").select("src", "cell", F.pmod("cell", "parts").alias("part"))
    dealt = pairs.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16))).join(placed, ["src", "cell"])
    ids = pairs.select("doc_id").unionAll(pairs.select("src")).distinct()
    texts = docs.join(small_side(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sources = placed.select("src", "part").distinct().join(texts.toDF("src", "src_text"), "src")
    both = dealt.join(texts, "doc_id").join(sources, ["src", "part"])

    def extend(cols):
        names = ("doc_id", "s", "e", "low", "high", "left", "right")
        sets, out = OrderedDict(), {name: [] for name in names}
        for src, doc, shifts, src_text, text in zip(*(cols[k] for k in ("src", "doc_id", "shifts", "src_text", "text"))):
            if src not in sets:
                sets[src] = word_hashes(src_text)
                if len(sets) > 32:
                    sets.popitem(last=False)
            own = word_hashes(text)
            for shift in shifts:
                for low, high in agreements(sets[src], own, shift):
                    # Below RUN words, or where nothing is left of it, s is not below e.
                    s = max(low, low - shift + RUN) if src == doc else low
                    e = high if high - low >= RUN else s
                    for name, value in zip(names, (doc, s, e, low, high, *ends_of(own, low, high, src, shift))):
                        out[name].append(value)
        return out

    schema = "doc_id long, s int, e int, low int, high int, left array<long>, right array<long>"
    return map_batches(both.select("src", "doc_id", "shifts", "src_text", "text"), extend, schema, rows=1024)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, n_removed): the word ranges to delete from each document that has any. Ranges are disjoint and ascending."""
    return _repeated(docs).select("doc_id", "spans", "n_removed")


def drop_repeats(docs: DataFrame, report: bool = True, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``.

    With ``report``, ``spans`` (word ranges that went) and ``n_removed`` are added, in place of columns of
    that name. With ``drop_emptied``, documents that lose all their words go.
    """
    found = hinted(_repeated(docs)).toDF("_id", "_t", "_spans", "_removed").alias("f")
    d = docs.alias("d")
    joined = d.join(found, (F.col("d.doc_id") == F.col("f._id")) & (F.xxhash64("d.text") == F.col("f._t")), "left")
    hit = F.col("f._spans").isNotNull()

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        one = lambda t, s: t if t is None or s is None else delete_words(t, [tuple(map(int, x.split(":"))) for x in s.split(",")])
        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    # Texts that nothing is deleted from do not travel to Python.
    text = F.when(hit, cut(F.when(hit, F.col("d.text")), F.col("f._spans"))).otherwise(F.col("d.text"))
    columns = [text.alias(n) if n == "text" else F.col(f"d.`{n}`") for n in docs.columns if not report or n not in ("spans", "n_removed")]
    if report:
        columns += [F.coalesce("f._spans", F.lit("")).alias("spans"), F.coalesce("f._removed", F.lit(0)).cast("long").alias("n_removed")]
    if not drop_emptied:
        return joined.select(*columns)
    hit_column = "_hit_" + "_".join(docs.columns)
    out = joined.select(*columns, hit.alias(hit_column))
    return out.where(~F.col(hit_column) | F.col("text").isNull() | F.col("text").rlike(r"[^ \t\n\r\x0B\f]")).drop(hit_column)
