"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct five-word shingles (64-bit hashes). One hash serves all buckets:
its top bits choose one of 128 buckets, the smallest remainder of a bucket is kept as leading-zero
count plus ten mantissa bits, a 16-bit register. Empty buckets borrow the register of the first
non-empty bucket in a fixed random order of their own, so short documents work like long ones.
Bands of four compressed registers give bucket keys; a pair at similarity 0.75 shares none of the
32 bands with probability 5e-6, one at 0.8 with 5e-8.

Equal sets collapse first. Within a band bucket every member meets only the smallest id, so a
bucket of n documents gives n - 1 pairs however large it is. A pair goes on if its Jaccard
estimate, corrected for register collisions, is within five standard errors of the limit or above,
and is then confirmed on full shingle sets. Where the members of a bucket still lie in different
components, the sets across components are compared in blocks of bounded size and what reaches the
limit is confirmed the same way, so no link that a bucket holds is lost and no other pair is a row.

Null or empty texts, and texts without words, have an empty set and link with nothing. Texts of
fewer than five words have their whole word sequence as one shingle. Repeated rows are equal
sets and get the same answer, so both stay or both go. An id that comes with several different sets
stands for one of them (that of smallest digest among those it is the smallest id of); its other texts
are copies of other ids or stand alone.
Rows without id are never heads and never go. Further columns, whatever their names, pass through. An
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, durable, fitted, give_back, hinted, map_batches, release, scratch, small_side
from .graph import components

WORDS = 5
#: Similarity limit as a fraction.
LIMIT = (75, 100)
BUCKETS = 128
MANTISSA = 10
ROWS, BANDS = 4, 32
#: Rows and bytes of one side of a block in which sets across components are compared.
BLOCK = 512
BLOCK_BYTES = 8 << 20
#: Pairs of one head that share one copy of its text.
HEAD = 256
#: Links of one block and pair of components that are taken before the components are joined anew.
FIRST = 2

_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered; ``trim`` bounds what is remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > 300_000:
            self.clear()


def shingles(text: str | None, words: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased, words cut at ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, dtype=_U)
    h = np.fromiter(map(words.__getitem__, parts), dtype=_U, count=n)
    words.trim()
    if n < size:
        total = _U(n)
        for k in range(n):
            total = _mix(np.array([total], dtype=_U) + h[k : k + 1] * _MULT[k % 5])[0]
        return np.array([total], dtype=_U)
    total = np.zeros(n - size + 1, dtype=_U)
    for k in range(size):
        total += h[k : n - size + 1 + k] * (_MULT[k % 5] + _U(2 * (k // 5)))
    return np.unique(_mix(total))


_ORDER = np.argsort(np.random.default_rng(20240229).random((BUCKETS, BUCKETS)), axis=1)
_EDGES = np.arange(BUCKETS, dtype=_U) << _U(57)


def registers(sorted_hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a set (uint16, 0 only for the empty set)."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    if not len(sorted_hashes):
        return out
    at = np.searchsorted(sorted_hashes, _EDGES)
    full = at < np.append(at[1:], len(sorted_hashes))
    least = (sorted_hashes[at[full]] >> _U(9)) & _U((1 << 48) - 1)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.where(least == 0, 48, 48 - exponent)
    mantissa = np.where(least == 0, 0, ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64))
    out[full] = (zeros << MANTISSA) + mantissa + 1
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Bucket keys of each row of registers: rows x BANDS, signed 64-bit."""
    cells = regs[:, : ROWS * BANDS].astype(_U).reshape(len(regs), BANDS, ROWS)
    total = (np.arange(BANDS, dtype=_U) * _U(0xE7037ED1A0B428DB))[None, :]
    for k in range(ROWS):
        total = _mix(total + (cells[:, :, k] + _U(1)) * _MULT[k])
    return total.view(np.int64)


def _zeros_law(n: np.ndarray) -> np.ndarray:
    """Probability of each leading-zero count of a bucket's minimum for sets of size n."""
    load = np.maximum(n.astype(np.float64) / BUCKETS, 1.0)[:, None]
    # At least z leading zeros: the minimum is below 2**-z, that is, not all values are above it.
    at_least = 1 - (1 - 2.0 ** -np.arange(50)[None, :]) ** load
    return at_least[:, :-1] - at_least[:, 1:]


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of different minima agree."""
    return (_zeros_law(n_a) * _zeros_law(n_b)).sum(axis=1) / (1 << MANTISSA)


def may_link(matches: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the collision-corrected Jaccard estimate leaves a pair within reach of the limit."""
    c = collision_rate(n_a, n_b)
    estimate = (matches / BUCKETS - c) / (1 - c)
    limit = LIMIT[0] / LIMIT[1]
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    error = np.sqrt(limit * (1 - limit) / np.minimum(BUCKETS, np.maximum(small, 1)))
    return (estimate >= limit - 5 * error) & (small * LIMIT[1] >= large * LIMIT[0])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n, h1, h2 (digest of the set), regs for every row."""

    def run(cols):
        import xxhash

        words, out = WordHashes(), {k: [] for k in ("n", "h1", "h2", "regs")}
        for text in cols["text"]:
            s = shingles(text, words)
            digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
            for name, value in zip(out, (len(s), int(digest[0]), int(digest[1]), registers(s).tobytes() if len(s) else b"")):
                out[name].append(value)
        return {"doc_id": cols["doc_id"], "t": cols["t"], **out}

    named = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return map_batches(named, run, "doc_id long, t long, n long, h1 long, h2 long, regs binary", rows=4096)


def _bands(reps: DataFrame) -> DataFrame:
    """(key, node) for every band of every representative."""
    arrow = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
                node = np.repeat(part.column("node").to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).ravel()), pa.array(node)], schema=arrow)

    return reps.select("node", "regs").mapInArrow(run, "key long, node long")


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate leaves them within reach of the limit."""
    one = pairs.join(reps.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b")), "b")
    two = one.join(reps.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a")), "a")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(part.column(k).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS) for k in ("regs_a", "regs_b"))
                n_a, n_b = (part.column(k).to_numpy() for k in ("n_a", "n_b"))
                keep = pa.array(may_link((a == b).sum(axis=1), n_a, n_b))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], schema=arrow)

    return two.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with ``part``, distinct (a, part)): a head of many pairs is cut into parts of about ``HEAD`` pairs.

    The parts are made of cells of (a, hash of b), so no step has all pairs of a head in one task.
    """
    celled = pairs.withColumn("cell", F.pmod(F.xxhash64("b"), F.lit(1 << 16)))
    cells = celled.groupBy("a", "cell").agg(F.count("*").alias("c"))
    parts = cells.groupBy("a").agg(F.ceil(F.sum("c") / HEAD).alias("parts"))
    placed = cells.join(parts, "a").select("a", "cell", F.pmod("cell", "parts").alias("part"))
    return celled.join(placed, ["a", "cell"]).select("a", "b", "part"), placed.select("a", "part").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the limit."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
    texts = docs.select("doc_id", "text").join(small_side(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    dealt, heads = _dealt(pairs)
    heads = heads.join(texts.toDF("a", "text_a"), "a")
    both = dealt.join(texts.toDF("b", "text_b"), "b").join(heads, ["a", "part"])

    def run(cols):
        words, sets, out = WordHashes(), OrderedDict(), {"a": [], "b": []}
        for a, b, text_a, text_b in zip(cols["a"], cols["b"], cols["text_a"], cols["text_b"]):
            if a not in sets:
                sets[a] = shingles(text_a, words)
                if len(sets) > 64:
                    sets.popitem(last=False)
            s, t = sets[a], shingles(text_b, words)
            common = len(np.intersect1d(s, t, assume_unique=True))
            if common * LIMIT[1] >= (len(s) + len(t) - common) * LIMIT[0]:
                out["a"].append(a)
                out["b"].append(b)
        return out

    return map_batches(both.select("a", "b", "text_a", "text_b"), run, "a long, b long", rows=2048)


def _short_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, set): shingle sets cut to 32 bits, which loses no common element."""
    texts = docs.join(small_side(nodes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def run(cols):
        words = WordHashes()
        sets = [shingles(text, words) for text in cols["text"]]
        return {"node": cols["doc_id"], "n": [len(s) for s in sets], "set": [np.unique((s >> _U(32)).astype(np.uint32)).tobytes() for s in sets]}

    return map_batches(texts, run, "node long, n long, set binary", rows=2048)


def common_counts(few: list[np.ndarray], many: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence matrices in column chunks."""
    rows = [*few, *many]
    values, column = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    column, owner = place[column[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(few), len(many)), dtype=np.float64)
    width = int(shared.sum())
    for low in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [low, low + 4096])
        held = np.zeros((len(rows), min(4096, width - low)), dtype=np.float32)
        held[owner[lo:hi], column[lo:hi] - low] = 1
        total += held[: len(few)] @ held[len(few) :].T
    return total


def _across(rows: DataFrame, first: int) -> DataFrame:
    """Pairs of different components in common buckets that reach the limit; ``first`` bounds those of a block and pair of components, 0 is no bound.

    ``rows`` has key, node, comp, n, set. Every pair across components has a row outside the bucket's
    largest component. Those rows in blocks meet all rows in blocks; every pair of blocks is one group
    of at most about two blocks of rows and bytes, and a bucket ruled by one component is sent about once. Whole
    sets are compared inside the group, so pairs below the limit are never rows.
    """
    per_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum(F.octet_length("set")).alias("v"))
    sizes = per_comp.groupBy("key").agg(F.max(F.struct("c", "comp", "v")).alias("most"), F.sum("c").alias("n_rows"), F.sum("v").alias("n_bytes"))
    blocks = lambda n, v: F.ceil(F.greatest(n / BLOCK, v / BLOCK_BYTES)).cast("int")
    sizes = sizes.select(
        "key", F.col("most.comp").alias("major"), blocks(F.col("n_rows"), F.col("n_bytes")).alias("g"), blocks(F.col("n_rows") - F.col("most.c"), F.col("n_bytes") - F.col("most.v")).alias("gm")
    )
    cut = rows.join(sizes, "key")
    every = cut.select("key", F.explode(F.sequence(F.lit(0), F.col("gm") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("g")).cast("int").alias("j"), F.lit(0).alias("minor"), "node", "comp", "n", "set")
    minor = cut.where("comp <> major").select(
        "key", F.pmod(F.xxhash64("node", F.lit(1)), F.col("gm")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"), F.lit(1).alias("minor"), "node", "comp", "n", "set"
    )
    dealt = every.unionAll(minor).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "minor", "node")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs_of(group: list[tuple]) -> list[tuple[int, int]]:
        many, few = [r for r in group if not r[3]], [r for r in group if r[3]]
        if not many or not few:
            return []
        sets = [[np.frombuffer(r[7], dtype=np.uint32) for r in part] for part in (few, many)]
        node, comp, n = ([np.array([r[k] for r in part], dtype=np.int64) for part in (few, many)] for k in (4, 5, 6))
        lost = [n[k] - np.array([len(s) for s in sets[k]]) for k in (0, 1)]
        common = common_counts(*sets) + np.maximum(lost[0][:, None], lost[1][None, :])
        reach = common * LIMIT[1] >= (n[0][:, None] + n[1][None, :] - common) * LIMIT[0]
        x, y = np.nonzero(reach & (comp[0][:, None] != comp[1][None, :]))
        taken: Counter = Counter()
        found = []
        for p, q in zip(x, y):
            both = (min(comp[0][p], comp[1][q]), max(comp[0][p], comp[1][q]))
            taken[both] += 1
            if not first or taken[both] <= first:
                found.append((int(min(node[0][p], node[1][q])), int(max(node[0][p], node[1][q]))))
        return found

    def run(batches):
        group, out = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    if group and row[:3] != group[0][:3]:
                        out += pairs_of(group)
                        group = []
                    group.append(row)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema=arrow)
                    out = []
        if group:
            out += pairs_of(group)
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema=arrow)
        give_back()

    return durable(dealt.mapInArrow(run, "a long, b long").distinct())


def left_out(rows: DataFrame, least: int) -> DataFrame | None:
    """(doc_id, t) of texts that are not their id's document, where an id comes with several digests; None if no id does.

    ``rows`` has doc_id, t, n, h1, h2. Heads are, per digest of at least ``least`` elements, the smallest id; the
    document of an id is the smallest digest that it heads, or none.
    """
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(*[f(h).alias(f"{k}{h}") for h in ("h1", "h2") for k, f in (("lo", F.min), ("hi", F.max))])
    several = durable(ids.where("loh1 <> hih1 or loh2 <> hih2").select("doc_id"))
    if several.isEmpty():
        return None
    several = hinted(several)
    own = durable(rows.select("doc_id", "t", "n", "h1", "h2").join(several, "doc_id", "left_semi"))
    heads = rows.where(F.col("n") >= least).join(hinted(durable(own.select("h1", "h2").distinct())), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("doc_id").alias("head"))
    chosen = heads.join(several, F.col("head") == F.col("doc_id"), "left_semi").groupBy("head").agg(F.min(F.struct("h1", "h2")).alias("d"))
    chosen = chosen.select(F.col("head").alias("doc_id"), "d.h1", "d.h2")
    return small_side(own.join(chosen, ["doc_id", "h1", "h2"], "left_anti").select("doc_id", "t").distinct())


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, t, n, component for every row of ``docs``; reads one checkpoint, the others are gone."""
    docs = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        signed = durable(signatures(docs))
        # Equal digests are equal sets, so any member's registers are the class's.
        of_class = [F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs")]
        reps = durable(signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(*of_class))
        classes = reps.select("h1", "h2", "node")
        own, odd = signed, left_out(signed, 1)
        if odd is not None:
            docs = docs.withColumn("t", F.xxhash64("text")).join(odd, ["doc_id", "t"], "left_anti").drop("t")
            own = signed.join(odd, ["doc_id", "t"], "left_anti")
            heading = own.select(F.col("doc_id").alias("node"), "h1", "h2").distinct()
            reps = durable(reps.join(heading, ["node", "h1", "h2"], "left_semi").dropDuplicates(["node"]))
        bands = _bands(reps)
        heads = bands.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail").select("key", "head")
        shared = durable(bands.join(heads, "key"))
        pairs = durable(shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
        likely = durable(_estimated(pairs, reps))
        release(pairs)
        collect_garbage(docs.sparkSession)
        links = durable(_confirmed(fitted(likely), docs))
        collect_garbage(docs.sparkSession)
        comp = _linked(shared, docs, likely, links)
        named = signed.select("doc_id", "t", "n", "h1", "h2").join(classes, ["h1", "h2"], "left")
        if odd is not None:
            # A set whose head stands for another one is linked with nothing but its copies.
            named = named.join(heading.withColumn("is_own", F.lit(True)), ["node", "h1", "h2"], "left")
            named = named.withColumn("node", F.when(F.col("is_own"), F.col("node")))
        named = named.join(hinted(comp).withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
        component = F.when(F.col("n") > 0, F.coalesce("component", "node", "doc_id")).otherwise(F.col("doc_id"))
        return keep(named.select("doc_id", "t", "n", component.alias("component")))


def _linked(shared: DataFrame, docs: DataFrame, tried: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) by the confirmed star pairs and by what buckets link across their components.

    ``tried`` holds the pairs that were compared on full sets; pairs that the estimate threw away were not.
    """
    first, sets = FIRST, None
    comp = durable(components(fitted(links)))
    while True:
        labelled = shared.select("key", "node").join(hinted(comp), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
        open_keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        rows = durable(labelled.join(open_keys, "key", "left_semi"))
        if rows.isEmpty():
            return comp
        if sets is None:
            sets = durable(_short_sets(docs, fitted(rows).select("node").distinct()))
        reached = _across(fitted(rows).join(fitted(sets), "node").select("key", "node", "comp", "n", "set"), first)
        release(rows)
        n_reached = reached.count()
        if not n_reached:
            return comp
        fresh = durable(fitted(reached).join(fitted(tried), ["a", "b"], "left_anti"))
        more = durable(_confirmed(fitted(fresh), docs))
        n_more = more.count()
        if n_more:
            before = links, comp
            links = durable(fitted(links).unionAll(fitted(more)))
            comp = durable(components(fitted(links)))
            release(*before)
        if n_more == n_reached:
            # Every pair of components that a bucket links is joined now.
            return comp
        if not n_more:
            if not first:
                return comp
            first = 0
        before = tried
        tried = durable(fitted(tried).unionAll(fitted(fresh)))
        release(before, reached, fresh, more)
        collect_garbage(docs.sparkSession)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id long, text string)."""
    out = _grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of smallest id of each component only. Rows without id stay."""
    grouped = _grouped(docs)
    with scratch(docs.sparkSession, collect=False) as keep:
        gone = keep(grouped.where("doc_id <> component").select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct())
        release(grouped)
    d = docs.alias("d")
    match = (F.col("d.doc_id") == F.col("g.gone_id")) & (F.xxhash64("d.text") == F.col("g.gone_t"))
    return d.join(hinted(gone).alias("g"), match, "left_anti")
