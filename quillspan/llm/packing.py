"""Packing of token pieces into sequences of fixed capacity.

Piece lengths are integers up to the capacity, so the whole problem is a histogram of at most
``capacity`` counts, whatever the number of rows. The driver packs that histogram: first-fit
decreasing over counts (and, where that misses the lower bound, a minimum-bin-slack start) gives
bin patterns with multiplicities, then a swap-based local search works on the underfull patterns. It moves a piece, or exchanges one for one, two for one or one
for two, from a less to a better filled bin whenever that raises the sum of squared fills, for as
many copies of the two patterns at once as there are; donors shrink until they are empty. Rows
are then sorted by (length, id), and the rank of a row tells its bin and offset by one binary
search in a table of a few thousand entries. One shuffle of small rows; no group is ever in one
task, and hot lengths spread over tasks.

Null texts count as empty (one piece with the end id alone). Texts of any length are encoded whole and
only documents beyond the capacity are cut. Repeated rows are packed as rows of their own; rows that tie
in length, id, piece and checksum are interchangeable. An empty table gives no rows. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from functools import cached_property, lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, global_rank, map_batches

CAPACITY = 1024
END = 2
_BLANKS = re.compile(r"\s+")

Pattern = tuple[int, ...]


def first_fit_decreasing(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """First-fit decreasing over a histogram: patterns (lengths, descending) and how often each is used."""
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left, reverse=True)
    bins: Counter[Pattern] = Counter()
    while sizes:
        room, pattern, taken = capacity, [], Counter()
        for s in sizes:
            if s <= room:
                k = min(room // s, left[s])
                pattern += [s] * k
                taken[s] = k
                room -= s * k
            if room < sizes[-1]:
                break
        times = min(left[s] // k for s, k in taken.items())
        bins[tuple(pattern)] += times
        for s, k in taken.items():
            left[s] -= k * times
        sizes = [s for s in sizes if left[s]]
    return bins


def _best_subset(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """Pieces (of those left) whose sum comes nearest to ``room``, large ones preferred: a bitset of reachable sums."""
    reach, last, mask = 1, {}, (1 << (room + 1)) - 1
    for s in sizes:
        if s > room:
            continue
        for _ in range(min(left[s], room // s)):
            new = (reach << s) & mask & ~reach
            if not new:
                break
            reach |= new
            while new:
                low = new & -new
                last[low.bit_length() - 1] = s
                new ^= low
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    while total:
        chosen.append(last[total])
        total -= last[total]
    return chosen


def least_slack(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Minimum-bin-slack start: the largest piece left, and those that fill its bin best."""
    left = {s: n for s, n in counts.items() if n > 0}
    bins: Counter[Pattern] = Counter()
    while left:
        sizes = sorted(left, reverse=True)
        left[sizes[0]] -= 1
        rest = _best_subset(sizes, left, capacity - sizes[0])
        left[sizes[0]] += 1
        taken = Counter([sizes[0], *rest])
        times = min(left[s] // k for s, k in taken.items())
        bins[tuple(sorted([sizes[0], *rest], reverse=True))] += times
        for s, k in taken.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return bins


def _without(pattern: Pattern, gone: tuple[int, ...], new: tuple[int, ...]) -> Pattern:
    rest = list(pattern)
    for s in gone:
        rest.remove(s)
    return tuple(sorted([*rest, *new], reverse=True))


@lru_cache(maxsize=50_000)
def _picks(pattern: Pattern, k: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Distinct choices of k pieces of a bin, with their sums."""
    found = [()] if k == 0 else sorted(set(combinations(pattern, k)))
    return np.array([sum(f) for f in found], dtype=np.int64), found


def _exchange(donor: Pattern, receiver: Pattern, capacity: int) -> tuple[int, tuple, tuple] | None:
    """The exchange that fills the receiver most, if one raises the sum of squared fills."""
    room, lead, best = capacity - sum(receiver), sum(receiver) - sum(donor), None
    for from_donor, back in ((1, 0), (1, 1), (2, 1), (1, 2)):
        if len(donor) < from_donor or len(receiver) < back:
            continue
        a, pick_a = _picks(donor, from_donor)
        b, pick_b = _picks(receiver, back)
        gain = a[:, None] - b[None, :]
        gain[(gain <= 0) | (gain > room) | (lead + gain <= 0)] = 0
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[i, j] > (best[0] if best else 0):
            best = (int(gain[i, j]), pick_a[i], pick_b[j])
    return best


def local_search(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Swap-based local search over the underfull patterns until no exchange helps or the bins are as few as can be.

    It ends: every exchange raises the sum of squared fills.
    """
    least = -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    done = Counter({p: n for p, n in bins.items() if sum(p) == capacity})
    underfull = Counter({p: n for p, n in bins.items() if sum(p) < capacity})
    known: dict[tuple[Pattern, Pattern], tuple[int, tuple, tuple] | None] = {}
    while done.total() + underfull.total() > least:
        move = None
        by_fill = sorted(underfull, key=lambda p: (sum(p), p))
        for donor in by_fill:
            for receiver in reversed(by_fill):
                if donor == receiver and underfull[donor] < 2:
                    continue
                if (donor, receiver) not in known:
                    known[donor, receiver] = _exchange(donor, receiver, capacity)
                found = known[donor, receiver]
                if found and (move is None or found[0] > move[0][0]):
                    move = (found, donor, receiver)
                    if found[0] == capacity - sum(receiver):
                        break
            if move:
                break
        if not move:
            break
        (_, out, back), donor, receiver = move
        times = underfull[donor] // 2 if donor == receiver else min(underfull[donor], underfull[receiver])
        underfull[donor] -= times
        underfull[receiver] -= times
        for new in (_without(donor, out, back), _without(receiver, back, out)):
            if new:
                (done if sum(new) == capacity else underfull)[new] += times
        underfull = +underfull
    return done + underfull


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> Counter[Pattern]:
    """The better of the local searches from two starts; none is needed where a start meets the lower bound."""
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    best = None
    for start in (first_fit_decreasing, least_slack):
        bins = start(counts, capacity)
        if bins.total() > least:
            bins = local_search(bins, capacity)
        if best is None or bins.total() < best.total():
            best = bins
        if best.total() == least:
            break
    return best


def placement(bins: Counter[Pattern], counts: dict[int, int]) -> dict[str, np.ndarray]:
    """Table that turns the rank of a row (rows sorted by length) into bin and offset."""
    first, at = {}, 0
    for s in sorted(counts):
        first[s] = at
        at += counts[s]
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, times in sorted(bins.items()):
        offset = 0
        for s, k in sorted(Counter(pattern).items(), reverse=True):
            rows.append((first[s] + used[s], k, sequence, offset, s))
            used[s] += k * times
            offset += s * k
        sequence += times
    rows.sort()
    names = ("start", "each", "sequence", "offset", "length")
    return dict(zip(names, np.array(rows, dtype=np.int64).reshape(-1, 5).T))


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have an integer ``length`` of 1 to ``capacity``.

    ``order`` names columns that tell rows apart; rows that agree in all of them are interchangeable.
    """
    pieces = durable(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = placement(pack_histogram(counts, capacity), counts)

    def place(rank: np.ndarray) -> list[np.ndarray]:
        e = np.searchsorted(at["start"], rank, side="right") - 1
        copy, turn = np.divmod(rank - at["start"][e], at["each"][e])
        return [at["sequence"][e] + copy, at["offset"][e] + turn * at["length"][e]]

    extra = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return global_rank(pieces, ["length", *order], extra, place)[0]


class Tokenizer:
    """Ids of the ``tokenizers`` library, through ``tiktoken`` where both give the same.

    The rank file holds the same vocabulary. Texts that hold the special token's string, a character
    beyond printable Latin, or a run of white space on which ``tiktoken``'s matcher would exhaust its
    stack, go through ``tokenizers`` itself.
    """

    #: White space in a row that is left to ``tokenizers``; the other library fails near a million.
    RUN = 10_000

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import regex
        import tiktoken

        from .bpe import read_ranks

        self.json_path = json_path
        ranks = {token: i for i, token in enumerate(read_ranks(rank_path))}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = regex.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*").fullmatch
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]

    @cached_property
    def slow(self):
        """The named library's tokenizer; most workers never need it."""
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.json_path)

    def encode(self, text: str) -> list[int]:
        if self.plain(text) and not any(s in text for s in self.special) and (len(text) < self.RUN or max(map(len, _BLANKS.findall(text)), default=0) < self.RUN):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def tokenizer(json_path: str, rank_path: str, pattern: str) -> Tokenizer:
    return Tokenizer(json_path, rank_path, pattern)


def cut(ids: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Pieces of at most ``capacity`` ids; all but the first are full."""
    head = (len(ids) - 1) % capacity + 1
    return [ids[:head], *(ids[at : at + capacity] for at in range(head, len(ids), capacity))]


def token_pieces(docs: DataFrame, json_path: str, rank_path: str, pattern: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with ``keep_ids``, ids for every piece of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(cols):
        own = tokenizer(json_path, rank_path, pattern)
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, text in zip(cols["doc_id"], cols["text"]):
            before = 0
            for k, part in enumerate(cut(np.array([*own.encode(text or ""), end], dtype="<u4"), capacity)):
                row = (doc, k, before, len(part), zlib.crc32(part.tobytes()), part.tolist() if keep_ids else None)
                before += len(part)
                for name, value in zip(out, row):
                    out[name].append(value)
        return out

    return map_batches(docs.select("doc_id", "text"), run, schema)


def pack_documents(docs: DataFrame, json_path: str, rank_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents as pieces with their place in the sequences."""
    return pack(token_pieces(docs, json_path, rank_path, pattern, capacity), ["doc_id", "piece", "ids_crc32"], capacity)
