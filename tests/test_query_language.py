import random

import pytest

from quillspan.operators.search import Searcher, normalize_term
from quillspan.plans import fixtures
from quillspan.plans.query_language import QuerySyntaxError, evaluate, rpn_text, to_rpn


@pytest.mark.parametrize(("query", "rpn"), fixtures.RPN_VECTORS.items())
def test_rpn(query, rpn):
    assert rpn_text(query) == rpn


@pytest.mark.parametrize("query", ["a &&", "(a", "a)", "!!a", "", "a && || b", "()"])
def test_strict_refuses(query):
    with pytest.raises(QuerySyntaxError):
        to_rpn(query, strict=True)


@pytest.mark.parametrize("query", ["a b", "!a", "(a || b) && !c", "a !b", "a && (b || !(c d))"])
def test_strict_accepts(query):
    assert to_rpn(query, strict=True) == to_rpn(query)


def sets_answer(query, postings, universe):
    return evaluate(
        to_rpn(query),
        lambda t: postings.get(normalize_term(t), set()),
        lambda a, b: a & b,
        lambda a, b: a | b,
        lambda a: universe - a,
        set(),
    )


def test_plans_agree_with_python_sets(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta"]
    docs = [(i, " ".join(w for w in words if rng.random() < 0.5)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").cache()
    postings = {w: {i for i, t in docs if w in t.split()} for w in words}
    universe = {i for i, _ in docs}
    pieces = [*words, "zzz", "&&", "||", "!", "(", ")"]
    queries = ["(alpha) !beta", "(alpha)(beta)", "!!alpha", "x && (a || b", "alpha && (beta || gamma", "", "!zzz"]
    queries += [" ".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(25)]
    s = Searcher(df)
    got = {}
    for r in s.search_batch(dict(enumerate(queries))).collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    for i, q in enumerate(queries):
        assert got.get(i, set()) == sets_answer(q, postings, universe), q
    for q in queries[:10]:
        want = sets_answer(q, postings, universe)
        assert {r["doc_id"] for r in s.search(q).collect()} == want, q
        assert {r["doc_id"] for r in s.search_sets(q).collect()} == want, q
