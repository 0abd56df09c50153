import random
import re
import time

import pytest

from quillspan.llm import decontaminate as D
from quillspan.llm.words import split_words, words_of

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def brute(docs, items, window=10):
    """[(doc_id, n_words, hit places, item ids)] by comparing every window with every place."""
    grams = set()
    for i, text in items:
        w = words(text)
        m = min(len(w), window)
        grams |= {(m, tuple(w[k : k + m]), "" if i is None else str(i)) for k in range(len(w) - m + 1) if m}
    out = []
    for d, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for m, gram, i in grams:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) == gram:
                    hit |= set(range(k, k + m))
                    ids.add(i)
        out.append((d, len(w), sorted(hit), sorted(ids)))
    return out


def got(df):
    rows = []
    for r in df.collect():
        h = r["hits"]
        places = [p for a, b in zip(h[::2], h[1::2]) for p in range(a, b)]
        assert len(places) == r["n_hit"] and sorted(set(places)) == places
        rows.append((r["doc_id"], r["n_words"], places, r["items"]))
    return rows


def key(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def few_words():
    """Texts over three words, so that repetitions of all kinds occur, with planted pieces of items."""
    rng = random.Random(3)
    items = [(k, " ".join(rng.choices("abc", k=rng.choice([1, 3, 9, 10, 11, 14, 25]) if k else 6))) for k in range(1, 14)]
    items = [(i, t) for i, t in items if len(t.split()) != 1] + [(20, "a " * 30), (None, "c b c b c b c b c b c"), (21, None), (22, " .,"), (1, "b a c a b a c c a b a")]
    docs = [(k, "".join(w + rng.choice([" ", ", ", "\n", " - "]) for w in rng.choices("abcD", k=rng.randrange(80)))) for k in range(60)]
    docs += [(100 + k, f"d d {t or ''}! D " + "".join(rng.choices(["a ", "d "], k=9))) for k, (_, t) in enumerate(items)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_words_of_a_batch():
    import pyarrow as pa

    texts = ["Été déjà-vu 3.14 ΑΒΓ", None, "", "x", "y", "\x00a\x7fb`c{d", "漢字🙂 Zz", "  "]
    w = split_words(pa.array(["skipped", *texts], pa.string()).slice(1))
    for k, t in enumerate(texts):
        assert [x.decode() for x in w.words[w.first[k] : w.first[k + 1]].to_pylist()] == words(t)
        for p in range(w.first[k], w.first[k + 1]):
            assert w.raw[w.start[p] : w.end[p]].tobytes().lower() == w.words[p].as_py().lower()
    assert words_of(None) == [] and split_words(pa.array([], pa.string())).first.tolist() == [0]


@pytest.mark.parametrize("window", [10, 4])
def test_equals_brute_force(spark, few_words, window):
    docs, items = few_words
    d, i = frames(spark, docs, items)
    assert key(got(D.contaminated(d, i, window))) == key(brute(docs, items, window))


def test_one_word_items(spark, few_words):
    docs, _ = few_words
    items = [(1, "a"), (2, "b c"), (3, "d"), (4, "Q")]
    d, i = frames(spark, docs, items)
    assert key(got(D.contaminated(d, i))) == key(brute(docs, items))


def test_blocks_of_items_give_the_same(spark, few_words):
    docs, items = few_words
    docs = [*docs, docs[0], docs[70], (None, docs[70][1]), (None, docs[70][1])]
    d, i = frames(spark, docs, items)
    whole = D.contaminated(d, i)
    parts = D.contaminated(d, i, block_words=20)
    columns = ("doc_id", "n_words", "n_hit", "items", "hits")
    assert key(map(tuple, parts.select(*columns).collect())) == key(map(tuple, whole.select(*columns).collect()))
    assert key(map(tuple, D.decontaminate(d, i, block_words=20).collect())) == key(map(tuple, D.decontaminate(d, i).collect()))


def test_longest_match(spark):
    item = " ".join(f"w{k}" for k in range(40))
    docs = [(1, "x " + " ".join(f"W{k}" for k in range(5, 30)) + " y"), (2, " ".join(f"w{k}" for k in range(9)))]
    rows = {r["doc_id"]: r for r in D.contaminated(*frames(spark, docs, [(7, item)])).collect()}
    assert (rows[1]["longest"], rows[1]["n_hit"], rows[1]["hits"], rows[1]["items"]) == (25, 25, [1, 26], ["7"])
    assert (rows[2]["longest"], rows[2]["n_hit"], rows[2]["items"]) == (0, 0, [])


def test_removal(spark):
    item = "one two three four five six seven eight nine ten"
    clean, mostly = "Kept — été, wholly.\n", "One two, THREE four (five) six seven eight nine ten"
    long = "word " * 30
    rows = [(1, long + mostly + "! end", "x"), (2, clean, None), (3, "say " + mostly, "y"), (4, None, "z"), (5, "", ""), (6, long + mostly + " " + mostly + " z", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    cut = D.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert cut.schema == docs.schema
    assert sorted(map(tuple, cut.collect())) == [(1, long + "! end", "x"), (2, clean, None), (4, None, "z"), (5, "", ""), (6, long + " z", "w")]


def test_edges(spark, edge_docs, edge_rows, no_docs):
    items = [(1, None), (2, ""), (3, "one two"), (4, "é ñ 漢字"), (5, edge_rows[5][1][1000:2000])]
    i = spark.createDataFrame(items, "item_id long, text string")
    assert key(got(D.contaminated(edge_docs, i))) == key(brute(edge_rows, items))
    assert D.contaminated(no_docs, i).collect() == []
    assert {r["n_hit"] for r in D.contaminated(edge_docs, i.limit(0)).collect()} == {0}
    assert D.decontaminate(edge_docs, i.limit(0)).count() == len(edge_rows)


def test_time_is_linear_in_a_text_that_is_all_hits():
    import pyarrow as pa

    automaton = D.Automaton([(1, [b"a"] * 2000)])
    began = time.time()
    hit, found, longest = D._hits(automaton, split_words(pa.array(["a " * 200_000])))
    assert hit.all() and longest == {0: 2000}
    assert time.time() - began < 10
