import random
import zlib

import numpy as np
import pytest
from brute import prose

from quillspan.llm import toxicity

BAD = ["grubel", "snorfik", "wakto"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1500):
        text = prose(rng, rng.randrange(10, 60)).split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(2):
                word = rng.choice(BAD)
                text.insert(rng.randrange(len(text)), rng.choice([word, word + rng.choice("abcdxyz") + "st", word.upper(), word.replace("o", "0")]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic) if i % 50 else None))
    return spark.createDataFrame(docs, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, toxic int").cache()


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels)).withColumn("held_out", toxicity.held_out()).collect()
    rows = [r for r in scored if r["held_out"]]
    assert rows and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    found = [r["predicted"] for r in rows if r["doc_id"] % 8 == 0]
    wrong = [r["predicted"] for r in rows if r["doc_id"] % 8]
    assert np.mean(found) > 0.9 and np.mean(wrong) < 0.01


def test_held_out_labels_are_not_used(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(tuple, toxicity.score_documents(docs.limit(50), toxicity.fit(docs, x)).collect())) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_edges(spark, labelled, edge_docs, no_docs, edge_rows):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, rows=600)
    got = toxicity.score_documents(edge_docs, model)
    rows = got.collect()
    assert len(rows) == len(edge_rows) and all(r["predicted"] == 0 for r in rows)
    assert sorted(got.columns) == sorted({*edge_docs.columns, "score", "predicted"})
    assert toxicity.score_documents(no_docs, model).collect() == []
    assert toxicity.drop_toxic(edge_docs, model).columns == edge_docs.columns
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(edge_docs, none).collect()} == {0.0}
    one_kind = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score_documents(edge_docs, one_kind).collect()} == {0}


def test_trees_and_calibration():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    raw = toxicity.Trees(rounds=60).fit(x, y).raw(x)
    assert ((raw > 0) == (y == 1)).mean() > 0.97
    knots, rates = toxicity.isotonic(raw, y)
    assert (np.diff(rates) >= -0.05).all() and (np.diff(knots) > 0).all()


@pytest.mark.parametrize(("token", "word", "plain"), [("Grubel,", "grubel", None), ("w4kt0!", "w4kt0", "wakto"), ("s.n.o.r", "s.n.o.r", "snor"), ("noooo", "noooo", "no"), ("2024", "2024", None), ("it's", "it's", None)])
def test_readings(token, word, plain):
    assert toxicity.readings(token) == (word, plain)
