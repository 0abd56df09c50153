import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.functions.stemmer import stem_word
from quillspan.functions.text import FOLDED, SEPARATORS
from quillspan.operators import dictionary, index, ranking
from quillspan.operators.lookup import IndexSearcher
from quillspan.operators.segments import SegmentIndex, blocked, forward, placed_terms
from quillspan.plans.query_language import Atom, atom, lex
from quillspan.sources.commits import Commits, ConcurrentCommit

VOCABULARY = "the of and river bank banks banked sand дома домами дом красивая красивые a to be or not".split()


def text(rng, n):
    return "".join(w + rng.choice([" ", ", ", "\n", " - "]) for w in rng.choices(VOCABULARY, weights=range(len(VOCABULARY), 0, -1), k=n))


def tokens(t, mode="reference"):
    folded = (t or "").translate(str.maketrans(FOLDED[mode], FOLDED[mode].lower()))
    return [stem_word(w) for w in re.split("[" + re.escape(SEPARATORS) + "]", folded) if w]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs = {k * 37 % 1000: text(rng, rng.randrange(0, 40)) for k in range(80)}
    docs |= {2000: "", 2001: None, 2002: "to be or not to be", 2003: "be to or not", -5: "The River\nbank bank sand"}
    return docs


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()) if isinstance(docs, dict) else docs, "doc_id long, text string")


@pytest.fixture(scope="module")
def one_shot(spark, corpus, tmp_path_factory):
    ix = SegmentIndex(spark, str(tmp_path_factory.mktemp("index") / "i"), width=64)
    assert ix.apply(frame(spark, corpus))
    return ix


def content(ix):
    """Everything that can be read from an index."""
    places = {(r["term"], r["doc_id"]): tuple(r["places"]) for r in ix.matches(ix.blocks(), "places").collect()}
    rest = {(r["term"], r["doc_id"]): (r["tf"], r["length"], r["title"]) for r in ix.matches(ix.blocks(), "tf", "length", "title").collect()}
    docs = {r["doc_id"]: (r["title"], r["length"], bytes(r["digest"])) for r in ix.docs().collect()}
    terms = {r["term"]: r["doc_freq"] for r in ix.dictionary().collect()}
    assert len(places) == ix.matches(ix.blocks()).count() and len(docs) == ix.docs().count()
    return places, rest, docs, terms, ix.n_docs, ix.n_tokens


def test_placed_terms_equal_plain_python(spark, corpus):
    want = {}
    for d, t in corpus.items():
        found = tokens(t)
        head = len(tokens((t or "").split("\n")[0]))
        for w in set(found):
            places = [k for k, x in enumerate(found) if x == w]
            want[w, d] = (len(places), len(found), places[0] < head, places)
    got = {(r["term"], r["doc_id"]): (r["tf"], r["length"], r["title"], r["places"]) for r in placed_terms(forward(frame(spark, corpus))).collect()}
    assert got == want


def test_one_shot_index(spark, corpus, one_shot):
    places, rest, docs, terms, n_docs, n_tokens = content(one_shot)
    assert (n_docs, n_tokens) == (len(corpus), sum(len(tokens(t)) for t in corpus.values()))
    assert set(places) == {(r[0], r[1]) for r in index.postings_flat(frame(spark, corpus)).collect()}
    assert terms == Counter(w for w, _ in places)
    rows = one_shot.blocks().collect()
    assert all(r["n"] == len(r["ids"]) and r["ids"] == sorted(r["ids"]) and r["max_tf"] == max(r["tfs"]) and r["min_length"] == min(r["lengths"]) for r in rows)
    assert all({i // 64 for i in r["ids"]} == {r["block"]} for r in rows)


def test_blocks_go_on_over_batches(spark, corpus):
    placed = placed_terms(forward(frame(spark, corpus)))
    want = sorted(map(repr, blocked(placed, 64).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(repr, blocked(placed, 64).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_batches_equal_one_shot(spark, corpus, one_shot, tmp_path):
    rng = random.Random(12)
    ix = SegmentIndex(spark, str(tmp_path / "i"), width=64)
    ids = list(corpus)
    rng.shuffle(ids)
    old = {i: text(rng, 9) for i in ids[:30]} | {9000: "gone soon", 9001: "gone too"}
    assert ix.apply(frame(spark, old), merge_at=None)
    assert ix.apply(frame(spark, {i: corpus[i] for i in ids[20:60]}), spark.createDataFrame([(9000,), (777777,), (None,)], "doc_id long"), merge_at=None)
    assert ix.apply(frame(spark, {i: corpus[i] for i in ids[:18] + ids[60:]} | {9002: "left over"}), spark.createDataFrame([(9001,), (ids[0],)], "doc_id long"), merge_at=None)
    assert not ix.apply(frame(spark, {i: corpus[i] for i in ids[:5]}))  # nothing new
    assert ix.refresh(frame(spark, corpus))
    assert len(ix.state["segments"]) >= 3 and ix.state["n_dead"] > 0
    assert content(ix) == content(one_shot)
    before = ix.version
    ix.merge(ix.state["segments"][:2])
    assert content(ix) == content(one_shot) and len(ix.state["segments"]) >= 2 and ix.version == before + 1
    ix.merge()
    assert content(ix) == content(one_shot) and len(ix.state["segments"]) == 1 and not ix.state["tombstones"]
    assert sorted(map(repr, ix.blocks().drop("segment").collect())) == sorted(map(repr, one_shot.blocks().drop("segment").collect()))
    ix.vacuum()
    assert content(SegmentIndex(spark, ix.commits.path)) == content(one_shot)


def test_deletes_and_an_empty_index(spark, corpus, tmp_path):
    ix = SegmentIndex(spark, str(tmp_path / "i"))
    assert ix.docs().collect() == [] and ix.postings().collect() == [] and ix.dictionary().collect() == []
    assert not ix.apply(frame(spark, {}))
    ix.apply(frame(spark, corpus))
    ix.apply(deletes=frame(spark, corpus).select("doc_id"))
    assert content(ix) == ({}, {}, {}, {}, 0, 0)
    assert ranking.Ranker(ix).search("the river").collect() == []
    ix.merge()
    assert content(ix) == ({}, {}, {}, {}, 0, 0)


def test_replays_and_repeated_ids(spark, tmp_path):
    ix = SegmentIndex(spark, str(tmp_path / "i"))
    assert ix.apply(frame(spark, [(1, "b"), (1, "a"), (None, "x"), (2, "c"), (2, "c")]), batch=("s", 3))
    assert sorted((r["term"], r["doc_id"]) for r in ix.postings().collect()) == [("b", 1), ("c", 2)]
    assert not ix.apply(frame(spark, [(1, "z")]), batch=("s", 3)) and not ix.apply(frame(spark, [(1, "z")]), batch=("s", 1))
    ordered = spark.createDataFrame([(1, "new", 5), (1, "old", 4)], "doc_id long, text string, at int")
    assert ix.apply(ordered, batch=("s", 4), order=("at",))
    assert sorted((r["term"], r["doc_id"]) for r in ix.postings().collect()) == [("c", 2), ("new", 1)]


def test_segments_are_merged_in_time(spark, tmp_path):
    ix = SegmentIndex(spark, str(tmp_path / "i"))
    for k in range(3):
        ix.apply(frame(spark, [(k, f"w{k} common")]), merge_at=3)
    assert len(ix.state["segments"]) == 1 and ix.postings().where("term = 'common'").count() == 3


def test_only_one_writer_publishes(spark, tmp_path):
    a, b = (Commits(spark, str(tmp_path / "c")) for _ in range(2))
    assert a.publish(0, {"x": 1}) == 1
    with pytest.raises(ConcurrentCommit):
        b.publish(0, {"x": 2})
    assert b.latest() == (1, {"x": 1})


def score(corpus, query, k):
    import math

    bags = {d: tokens(t) for d, t in corpus.items()}
    mean = sum(map(len, bags.values())) / len(bags)
    out = []
    for d, bag in bags.items():
        total = 0
        for w in dict.fromkeys(tokens(query)):
            df = sum(w in b for b in bags.values())
            tf = bag.count(w)
            if tf:
                total += math.floor(10**6 * math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean)) + 0.5)
        if total:
            out.append((-total, d))
    return [(rank, d, -s / 10**6) for rank, (s, d) in enumerate(sorted(out)[:k], 1)]


def test_bm25_equals_plain_python(spark, corpus, one_shot):
    r = ranking.Ranker(one_shot)
    for query, k in (("river banks", 5), ("The the of", 10), ("домами красивые zzz", 3), ("sand", 500), ("zzz", 5), ("", 5)):
        assert sorted(map(tuple, r.search(query, k).collect())) == score(corpus, query, k), query
    both = r.search_batch({1: "river bank", 2: "not to be", 3: "zzz"}, 4)
    assert sorted(map(tuple, both.collect())) == [(q, *row) for q, text in ((1, "river bank"), (2, "not to be")) for row in score(corpus, text, 4)]


def test_bm25_within_hits(spark, corpus, one_shot):
    inside = {d for d in corpus if d % 2}
    some = spark.createDataFrame([(d,) for d in sorted(inside)], "doc_id long")
    want = [(d, s) for _, d, s in score(corpus, "the river bank", 500) if d in inside][:6]
    got = ranking.Ranker(one_shot).search("the river bank", 6, some).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == want


def test_bm25_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranking, "SEEDS", 2)
    rng = random.Random(3)
    docs = {k: " ".join(["filler"] * rng.randrange(200, 300) + ["rare"] * (1 + 6 * (k in (70, 1500)))) for k in range(2000)}
    ix = SegmentIndex(spark, str(tmp_path / "i"), width=32)
    ix.apply(frame(spark, docs))
    r = ranking.Ranker(ix)
    asked = r.query_terms({0: "rare filler"})
    left = r.survivors(asked, 2)
    assert 2 <= left.count() <= 8 and r.bounds(asked).count() == 63
    assert [row["doc_id"] for row in r.search("rare filler", 2).orderBy("rank").collect()] == [d for _, d, _ in score(docs, "rare filler", 2)]
    plan = r.search("rare filler", 2)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: .*(In|EqualTo)\(block", plan) or "block#" in plan and re.search(r"block#\d+L IN \(", plan)


def hits(corpus, test):
    return sorted(d for d, t in corpus.items() if test(tokens(t)))


def near(bag, words, slack):
    need, size = Counter(words), len(words) + slack
    return any(not need - Counter(bag[k : k + size]) for k in range(len(bag)))


def follows(bag, words):
    return any(bag[k : k + len(words)] == words for k in range(len(bag) - len(words) + 1))


@pytest.mark.parametrize("merged", [True, False])
def test_extended_queries(spark, corpus, one_shot, merged, monkeypatch):
    if not merged:
        monkeypatch.setattr("quillspan.operators.lookup.LISTED", 1)
    s = IndexSearcher(one_shot)
    w = lambda *names: [stem_word(n) for n in names]
    cases = {
        '"the of"': lambda b: follows(b, ["the", "of"]),
        '"the the"': lambda b: follows(b, ["the", "the"]),
        '"to be or not to be"': lambda b: follows(b, "to be or not to be".split()),
        '"the of" && !"of the"': lambda b: follows(b, ["the", "of"]) and not follows(b, ["of", "the"]),
        '"River" sand': lambda b: "river" in b and "sand" in b,
        '"the the river"~2': lambda b: near(b, ["the", "the", "river"], 2),
        '"sand of"~0 || "красивая домами"~9': lambda b: near(b, ["sand", "of"], 0) or near(b, w("красивая", "домами"), 9),
        '"zzz the"': lambda b: False,
        '""': lambda b: False,
        "": lambda b: False,
        "bank*": lambda b: any(x.startswith("bank") for x in b),
        "*nd": lambda b: any(x.endswith("nd") for x in b),
        "*iv* && !b*k*d": lambda b: any("iv" in x for x in b) and not any(re.fullmatch("b.*k.*d", x) for x in b),
        "r*r || *": lambda b: any(re.fullmatch("r.*r", x) for x in b),
        "*a*": lambda b: any("a" in x for x in b),
        "bahk~1": lambda b: "bank" in b,
        "bahk~2": lambda b: any(x in b for x in ("bank", "banks", "be", "a", "and") if distance(x, "bahk") <= 2),
        "дома~1": lambda b: any(distance(x, stem_word("дома")) <= 1 for x in b),
        "(the || der) && !and": lambda b: "the" in b and "and" not in b,
    }
    for q, test in cases.items():
        assert sorted(r[0] for r in s.search(q).collect()) == hits(corpus, test), q
    batch = {k: q for k, q in enumerate(cases)}
    got = {}
    for r in s.search_batch(batch).collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: h for k, test in enumerate(cases.values()) if (h := hits(corpus, test))}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_title_field(spark, corpus, one_shot):
    s = IndexSearcher(one_shot)
    for word in ("river", "the", "bank"):
        want = sorted(d for d, t in corpus.items() if word in tokens((t or "").split("\n")[0]))
        assert sorted(r[0] for r in s.search(f"title:{word}").collect()) == want
    assert -5 in {r[0] for r in s.search("title:river && bank && !title:bank").collect()}


def test_atoms():
    words = lambda t: t.split()
    assert atom('"a b"~3', words) == Atom("near", ("a", "b"), 3) and atom('"a b"', words) == Atom("phrase", ("a", "b"))
    assert atom('"a b', words) == Atom("phrase", ("a", "b")) and atom("a~1", words) == Atom("fuzzy", ("a",), 1)
    assert [atom(v, words).kind for v in ("a~3", "~1", "*", "title:", "a*", "title:x")] == ["term", "term", "term", "term", "pattern", "title"]
    assert [t.value for t in lex('x "a && b"~2 !"c', extended=True)] == ["x", '"a && b"~2', "!", '"c']
    assert [t.value for t in lex('"a b"')] == ['"a', 'b"']


def test_pattern_prefix_is_a_range_of_the_scan(one_shot):
    plan = dictionary.pattern_terms(one_shot, "ba*k")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,ba)" in plan and "LessThanOrEqual(term,ba" in plan


@pytest.mark.parametrize("edits", [1, 2])
def test_fuzzy_join_equals_brute_force(spark, edits):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(0, 7))) for _ in range(150)})
    asked = words[::7] + ["zzz", "aaaaaaaaaaaa"]
    frames = [spark.createDataFrame([(w,) for w in rows], f"{name} string") for name, rows in (("word", asked), ("term", words))]
    got = dictionary.fuzzy_join(*frames, edits)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, distance(a, b)) for a in asked for b in words if distance(a, b) <= edits)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_highlight(spark, one_shot):
    docs = {1: "x x river x x sand x bank river x", 2: "sand sand", 3: "x y z", 4: "river " + "x " * 30 + "river bank"}
    path = one_shot.commits.path + "-h"
    ix = SegmentIndex(spark, path)
    ix.apply(frame(spark, docs))
    s = IndexSearcher(ix)
    got = {r["doc_id"]: (r["begin"], r["snippet"]) for r in s.highlight([1, 2, 3, 4], "river && bank sand", frame(spark, docs), 4).collect()}
    assert got == {1: (5, "sand x bank river"), 2: (0, "sand sand"), 3: (0, "x y z"), 4: (31, "river bank")}


def test_parts_of_blocks_equal_single_rows(spark, corpus):
    from quillspan.functions.text import BATCH_BYTES, bounded_batches
    from quillspan.operators.segments import cut, joined

    docs = frame(spark, corpus).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "256m")
    parts = cut(docs, 64).where("part IS NOT NULL").select("part.*").cache()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == BATCH_BYTES  # before: batches were bounded by rows alone
    plain = blocked(placed_terms(forward(docs)), 64)
    assert sorted(map(repr, joined(parts).collect())) == sorted(map(repr, plain.collect()))
    assert parts.count() < placed_terms(forward(docs)).count()  # what is shuffled
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000b")
    bounded_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000b"
    assert sorted(map(repr, joined(parts).collect())) == sorted(map(repr, plain.collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
