import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quillspan.llm import packing

FILES = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.mark.parametrize("draw", [lambda r: r.randrange(1, 1025), lambda r: r.randrange(200, 700), lambda r: r.choice([512, 513, 340, 342, 100]), lambda r: 600])
def test_histogram(draw):
    rng = random.Random(4)
    counts = Counter(draw(rng) for _ in range(2000))
    bins = packing.pack_histogram(counts)
    used = Counter()
    for pattern, times in bins.items():
        assert sum(pattern) <= 1024
        for s in pattern:
            used[s] += times
    assert used == counts
    assert bins.total() <= packing.first_fit_decreasing(counts, 1024).total()


def test_local_search_empties_bins():
    # Four bins, of which exchanges make three.
    start = Counter({(6, 3): 1, (5, 3): 1, (4, 4): 1, (2, 3): 1})
    found = packing.local_search(start, 10)
    assert found.total() == 3 and sum(sum(p) * n for p, n in found.items()) == 30


def test_local_search_goes_on_while_exchanges_help():
    # Each of 4,100 different bins lacks one of 4,100 single pieces: as many exchanges.
    n, capacity = 4100, 20_000
    start = Counter({(capacity - 1 - k, k): 1 for k in range(2, n + 2)})
    start[1,] = n
    assert packing.local_search(start, capacity).total() == n


def test_tokenizer_equals_the_library():
    own, library, rng = packing.Tokenizer(*FILES), Tokenizer.from_file(FILES[0]), random.Random(8)
    letters = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250))]
    texts = ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(1500)]
    for text in [*texts, "a <|endoftext|> b", "漢字 x​", "ಠ͸", "\x1c\x85"]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def check(rows, docs):
    """Rows hold every id of every document once, in sequences without gaps or overlap."""
    library = Tokenizer.from_file(FILES[0])
    want = Counter()
    for i, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        head = (len(ids) - 1) % 1024 + 1
        parts = [ids[:head], *(ids[k : k + 1024] for k in range(head, len(ids), 1024))]
        before = 0
        for k, p in enumerate(parts):
            want[i, k, before, len(p), zlib.crc32(p.tobytes())] += 1
            before += len(p)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    return len(fill)


def test_documents(edge_docs, no_docs, edge_rows):
    check(packing.pack_documents(edge_docs, *FILES).collect(), edge_rows)
    assert packing.pack_documents(no_docs, *FILES).collect() == []


def test_very_long_texts(spark):
    rows = [(1, " " * 1_200_000), (2, "\n" * 1_200_000 + "x"), (3, "a" * 1_200_000), (4, "ab " * 400_000), (5, "x" + "\t " * 600_000)]
    check(packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), *FILES).collect(), rows)


def test_hot_length(spark):
    rows = [(i, "one two three") for i in range(500)] + [(i, "word " * (i % 300)) for i in range(500, 900)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), *FILES).collect()
    assert check(packed, rows) <= -(-sum(r["length"] for r in packed) // 1024) + 1
