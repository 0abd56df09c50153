"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are lexicon densities, nearness of second-person words to lexicon hits, capitals,
punctuation, obfuscation and elongation rates and lengths. The lexicon is learned: words and word
beginnings of 4 to 6 letters whose share of toxic rows is above the base rate with a likelihood
ratio of at least ``EVIDENCE``; the trees see the ratio too and learn how much of it to ask for. Tokens are also read with look-alike characters undone.
Features of the training rows use the lexicon of the other folds, and the calibration uses
out-of-fold predictions, so neither sees its own labels. Trees, lexicon and calibration are fitted
here, on at most ``TRAIN_ROWS`` labelled rows (those of smallest hash); every document is scored on its
whole text.

Null texts count as empty; empty texts get the score of a text without any sign. Labels that are
null are not used; an id with both labels counts as toxic, and one that comes with several texts is learned
from one of them (the smallest). Without labels of both kinds all scores are the base rate (0 without any).
Repeated rows are scored each and alike; columns named score or predicted are replaced, others pass. An
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, give_back, map_batches, scratch

#: Labelled rows that a model is fitted on at most.
TRAIN_ROWS = 20_000
FOLDS = 4
#: Least likelihood ratio of a lexicon entry.
EVIDENCE = 10.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7

# Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours you're u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
)
# Look-alike characters.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
_EDGES = "\"'`.,;:!?()[]{}<>*#%&$=+-_/\\|~^«»„“”…"
_LETTER = re.compile(r"[^\W\d_]")
_INNER = re.compile(r"[^\W\d_][0-9@$!|*._\-]+[^\W\d_]")
_LONG = re.compile(r"(.)\1{2,}")
_NOT_WORD = re.compile(r"[\W\d_]+")


def readings(token: str) -> tuple[str, str | None]:
    """The plain lower-case word of a token and, if it is disguised, what it reads as."""
    word = token.lower().strip(_EDGES)
    if not _INNER.search(word) and not _LONG.search(word):
        if word.isalpha() or not _LETTER.search(word) or not re.search(r"[0-9@$]", word):
            return word, None
    plain = _NOT_WORD.sub("", word.translate(LOOK_ALIKE))
    plain = _LONG.sub(r"\1", plain)
    return word, plain if plain and plain != word else None


def keys_of(word: str) -> list[str]:
    """Lexicon keys of a word: itself and its beginnings (marked)."""
    if len(word) < 3 or len(word) > 40 or not _LETTER.match(word):
        return []
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Tokens(dict):
    """Row number of each token in the property tables; filled as tokens come, bounded."""

    NAMES = ("weight", "evidence", "disguised_weight", "second", "capitals", "capital", "disguised", "elongated", "letters")
    MOST = 80_000

    def __init__(self, lexicon: dict[str, tuple[float, float]]):
        super().__init__()
        self.lexicon = lexicon
        self.starts = {key[:3] for key in lexicon}
        self.fresh: list[tuple] = []
        self.table = np.zeros((0, len(self.NAMES)), dtype=np.float32)

    def weight(self, word: str) -> tuple[float, float]:
        """Weight and evidence of a word by its best-proven key."""
        if word[:3] not in self.starts:
            return 0.0, 0.0
        return max((self.lexicon[k] for k in keys_of(word) if k in self.lexicon), key=lambda v: v[::-1], default=(0.0, 0.0))

    def __missing__(self, token: str) -> int:
        core = token.strip(_EDGES)
        word = core.lower()
        elongated = _LONG.search(word) is not None
        if core.isalpha() and not elongated:
            row = (*self.weight(word), 0.0, word in SECOND_PERSON, len(core) > 1 and core.isupper(), core[0].isupper(), False, False, True)
        else:
            word, plain = readings(token)
            own = self.weight(word)
            letters = _LETTER.search(token) is not None
            other = self.weight(plain) if plain and not own[0] else (0.0, 0.0)
            row = (*max(own, other), other[0], word in SECOND_PERSON, len(core) > 1 and core.isupper(), letters and core[:1].isupper(), plain is not None, elongated, letters)
        self.fresh.append(row)
        at = self[token] = len(self)
        return at

    def lookup(self, tokens: list[str]) -> np.ndarray:
        if len(self) > self.MOST:
            self.clear()
            self.table = self.table[:0].copy()
        at = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if self.fresh:
            if len(self) > len(self.table):
                grown = np.zeros((max(len(self), 2 * len(self.table)), len(self.NAMES)), dtype=np.float32)
                grown[: len(self.table)] = self.table
                self.table = grown
            self.table[len(self) - len(self.fresh) : len(self)] = self.fresh
            self.fresh = []
        return self.table[at]


FEATURES = ("max_evidence", "max_weight", "sum_weight", "density", "hits", "strong", "disguised_max", "near", "second", "capitals", "capital", "exclaim", "question", "punctuation", "disguised", "elongated", "log_words", "log_chars")


def features(text: str | None, tokens: Tokens) -> list[float]:
    """Dense features of one text, in the order of ``FEATURES``."""
    text = text or ""
    parts = text.split()
    n, chars = len(parts), len(text)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [math.log1p(chars)]
    t = tokens.lookup(parts)
    weight = t[:, 0]
    hit = np.flatnonzero(weight > 0)
    near = 0.0
    if len(hit):
        second = np.flatnonzero(t[:, 3])
        if len(second):
            at = np.searchsorted(second, hit)
            left = np.where(at > 0, hit - second[np.maximum(at - 1, 0)], n)
            right = np.where(at < len(second), second[np.minimum(at, len(second) - 1)] - hit, n)
            near = float((weight[hit] / (1 + np.minimum(np.abs(left), np.abs(right)))).max())
    marks = sum(text.count(c) for c in ".,;:!?*#%&$@")
    return [
        float(t[:, 1].max()), float(weight.max()), float(weight.sum()), len(hit) / n, math.log1p(len(hit)), float((t[:, 1] > 20).sum()), float(t[:, 2].max()), near,
        float(t[:, 3].mean()), float(t[:, 4].mean()), float(t[:, 5].mean()), text.count("!") / chars, text.count("?") / chars, marks / chars,
        float(t[:, 6].mean()), float(t[:, 7].mean()), math.log1p(n), math.log1p(chars),
    ]


def lexicon_from(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, tuple[float, float]]:
    """(weight, evidence) of the keys that tell toxic rows from clean ones: smoothed log odds, and likelihood ratio up to 60."""
    if not toxic or not clean:
        return {}
    base = toxic / (toxic + clean)
    found = {}
    for key, (t, c) in counts.items():
        n = t + c
        if t < 3 or t / n <= base:
            continue
        ratio = 2 * (t * math.log(t / n / base) + (c * math.log(c / n / (1 - base)) if c else 0.0))
        if ratio >= EVIDENCE:
            odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
            if odds > 0.7:
                found[key] = (ratio, odds)
    return {k: (round(odds, 4), round(min(ratio, 60.0), 3)) for k, (ratio, odds) in sorted(found.items())}


class Trees:
    """Gradient boosting with logistic loss: shallow trees over quantile bins."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 1.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        p = (y.sum() + 0.5) / (n + 1)
        self.base = math.log(p / (1 - p))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(m)]
        wide = max(len(c) for c in cuts) + 1
        code = np.stack([np.searchsorted(c, x[:, f], side="left") + f * wide for f, c in enumerate(cuts)], axis=1)
        score = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            every_g, every_h = np.repeat(g, m), np.repeat(h, m)
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                key = ((node - first)[:, None] * (m * wide) + code).ravel()
                gs, hs = (np.bincount(key, w, width * m * wide).reshape(width, m, wide).cumsum(axis=2) for w in (every_g, every_h))
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                for k, (f, b) in enumerate(zip(*divmod(best, wide))):
                    if gain[k, f, b] > 1e-6:
                        feature[first + k], cut[first + k] = f, cuts[f][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            gs, hs = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
            leaf = -self.rate * gs / (hs + self.ridge)
            self.trees.append((feature, cut, leaf))
            score += leaf[node - inner]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score, rows, inner = np.full(len(x), self.base), np.arange(len(x)), (1 << self.depth) - 1
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += leaf[node - inner]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (mean score, smoothed rate) to interpolate between, so order is kept."""
    blocks: list[list[float]] = []
    for s, v in sorted(zip(score.tolist(), y.tolist())):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a, b = blocks[-2], blocks.pop()
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2] + b[2]]
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.1) / (b[2] + 0.2) for b in blocks])


@dataclass
class Model:
    lexicon: dict[str, tuple[float, float]]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.base)
        raw = self.trees.raw(x)
        value = np.interp(raw, *self.knots)
        # A trace of the raw score keeps the order within flat pieces.
        return np.clip(value + 1e-6 * np.tanh(raw / 10), 0.0, 1.0)


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(FOLDS)).cast("int")


def held_out() -> Column:
    """Rows whose labels must not be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic, fold of at most ``rows`` labelled documents that are not held out."""
    usable = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = durable(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "toxic", _fold().alias("fold")))
    # At most ``rows`` rows of 16 bytes: small enough to broadcast whatever the input. One text stands for an id.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return durable(texts.groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text")).select("text", "toxic", "fold"))


def _key_counts(sample: DataFrame) -> DataFrame:
    """(key, fold, toxic, n): rows of each kind that hold a lexicon key."""
    arrow = pa.schema([("key", pa.string()), ("fold", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])

    def run(batches):
        counts: dict[tuple[int, int], Counter] = defaultdict(Counter)
        known: dict[str, list[str]] = {}

        def flush():
            for (fold, toxic), c in counts.items():
                items = list(c.items())
                for at in range(0, len(items), 50_000):
                    part = items[at : at + 50_000]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([fold] * m, pa.int32()), pa.array([toxic] * m, pa.int32()), pa.array([n for _, n in part])], schema=arrow)
            counts.clear()

        rows = (row for batch in batches for at in range(0, batch.num_rows, 512) for row in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)))
        for text, toxic, fold in rows:
            keys = set()
            for token in set((text or "").split()):
                found = known.get(token)
                if found is None:
                    word, plain = readings(token)
                    found = known[token] = keys_of(word) + (keys_of(plain) if plain else [])
                keys.update(found)
            counts[fold, toxic].update(keys)
            if len(known) > 60_000:
                known.clear()
            if sum(map(len, counts.values())) > 300_000:
                yield from flush()
        yield from flush()
        known.clear()
        give_back()

    return sample.mapInArrow(run, "key string, fold int, toxic int, n long").groupBy("key", "fold", "toxic").agg(F.sum("n").alias("n"))


def _evidence(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """Likelihood ratio of a key in t toxic and c clean rows, as ``lexicon_from`` has it; -1 where toxic rows are too few."""
    if not toxic or not clean:
        return F.lit(-1.0)
    base, n = toxic / (toxic + clean), t + c
    ratio = 2 * (t * F.log(t / n / F.lit(base)) + F.when(c > 0, c * F.log(c / n / F.lit(1 - base))).otherwise(0.0))
    return F.when((t >= 3) & (t / n > F.lit(base)), ratio).otherwise(-1.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from the labels outside the held-out rows.

    What reaches the driver is bounded by ``rows``: a row of features for each, and the keys with evidence.
    """
    with scratch(docs.sparkSession):
        return _fit(docs, labels, rows)


def _fit(docs: DataFrame, labels: DataFrame, rows: int) -> Model:
    sample = training_sample(docs, labels, rows)
    size = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(n for (_, y), n in size.items() if y == k) for k in (1, 0))
    base = toxic / (toxic + clean) if toxic + clean else 0.0
    if not toxic or not clean:
        return Model({}, None, (np.zeros(1), np.zeros(1)), base)
    cells = [F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n"))), F.lit(0)).alias(f"c{f}_{y}") for f in range(FOLDS) for y in (0, 1)]
    wide = _key_counts(sample).groupBy("key").agg(*cells)
    # Only keys that have the evidence in all folds or without one of them.
    choices = [[f for f in range(FOLDS) if f != without] for without in (None, *range(FOLDS))]
    evidence = [_evidence(*(sum((F.col(f"c{f}_{y}") for f in use), F.lit(0)) for y in (1, 0)), *(sum(size.get((f, y), 0) for f in use) for y in (1, 0))) for use in choices]
    keys = wide.where(F.greatest(*evidence) >= EVIDENCE - 1e-6).collect()

    def lexicon(without: int | None) -> dict[str, float]:
        use = [f for f in range(FOLDS) if f != without]
        counts = {r["key"]: tuple(sum(r[f"c{f}_{y}"] for f in use) for y in (1, 0)) for r in keys}
        return lexicon_from(counts, *(sum(size.get((f, y), 0) for f in use) for y in (1, 0)))

    by_fold = [lexicon(f) for f in range(FOLDS)]
    final = lexicon(None)

    def measure(cols):
        own = [Tokens(lex) for lex in by_fold]
        return {"toxic": cols["toxic"], "fold": cols["fold"], "x": [features(text, own[f]) for text, f in zip(cols["text"], cols["fold"])]}

    got = map_batches(sample, measure, "toxic int, fold int, x array<double>", rows=512).collect()
    x, y, fold = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], dtype=np.float64), np.array([r["fold"] for r in got])
    order = np.lexsort((*x.T, y))
    x, y, fold = x[order], y[order], fold[order]
    out = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any() and (fold != f).any():
            out[fold == f] = Trees().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(final, Trees().fit(x, y), isotonic(out, y), base)


def score_column(text: str, model: Model) -> Column:
    """Score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        global _TOKENS
        if _TOKENS is None or _TOKENS.lexicon != model.lexicon:
            _TOKENS = Tokens(model.lexicon)
        x = np.array([features(t, _TOKENS) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return score(text)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``, in place of columns of that name."""
    scored = docs.withColumn("score", score_column("text", model))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those predicted toxic."""
    return docs.where(score_column("text", model) < THRESHOLD)


#: Token tables of this worker process, kept between batches and tasks of one model.
_TOKENS: Tokens | None = None
