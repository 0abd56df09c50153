import math
import random
from collections import Counter

import numpy as np
import pytest
from test_decontaminate import words

from quillspan.llm import lexical as L


def brute(docs, items, k=10, repeats=False):
    bags = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for d, bag in bags:
            n = sum(bag.values())
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum((c if repeats else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * m)) for w, c in Counter(words(text)).items() if w in bag)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(40)], k=n))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(150)]
    docs += [(1000 + k, docs[3][1]) for k in range(30)] + [(None, docs[3][1]), (5, docs[5][1]), (-4, docs[3][1]), (2000, None), (2001, ""), (2002, "!? .")]
    items = [(k, text(rng.randrange(1, 12))) for k in range(15)] + [(50, docs[3][1]), (51, None), (52, "zzz"), (53, "W0, w0 W0 w39"), (54, ""), (55, "w1")]
    return docs, items


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def frames(spark, docs, items, parts=5):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id int, text string")


@pytest.mark.parametrize("repeats", [False, True])
def test_equals_brute_force(spark, corpus, repeats):
    docs, items = corpus
    found = L.rank_documents(*frames(spark, docs, items), repeats=repeats)
    assert key(found.collect()) == key(brute(docs, items, repeats=repeats))


def test_small_blocks_give_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(L, "BLOCK_DOCS", 7)
    monkeypatch.setattr(L, "GATHER", 2)
    found = L.rank_documents(*frames(spark, docs, items, 9), k=4, block_words=13)
    assert key(found.collect()) == key(brute(docs, items, k=4))


def test_ties_go_by_id(spark):
    docs = [(k, "same words here") for k in random.Random(1).sample(range(500), 200)] + [(None, "same words here")]
    found = L.rank_documents(*frames(spark, docs, [(1, "same"), (1, "words")], 6), k=12)
    assert key(found.collect()) == key(brute(docs, [(1, "same"), (1, "words")], k=12))


def test_repeated_items_have_rows_of_their_own(spark, corpus):
    docs, items = corpus
    twice = [items[0], items[0], (None, items[0][1])]
    assert key(L.rank_documents(*frames(spark, docs, twice)).collect()) == key(brute(docs, twice))


def test_edges(spark, edge_docs, edge_rows, no_docs):
    items = [(1, None), (2, ""), (3, "one two"), (4, "é 漢字 tail id"), (5, edge_rows[5][1])]
    i = spark.createDataFrame(items, "item_id string, text string")
    want = [(str(a), *rest) for a, *rest in brute(edge_rows, items)]
    assert key(L.rank_documents(edge_docs, i).collect()) == key(want)
    assert L.rank_documents(no_docs, i).collect() == []
    assert L.rank_documents(edge_docs, i.limit(0)).collect() == []


def test_impacts_beyond_64_bits():
    tf, n = np.array([3, 1]), np.array([10**9, 5])
    n_docs, total = 10**12, 10**15
    want = [10**9 * t // (1000 * t + 8 * (10 + 90 * int(s) * n_docs // total)) for t, s in zip([3, 1], [10**9, 5])]
    assert L.impacts(tf, n, n_docs, total).tolist() == want
