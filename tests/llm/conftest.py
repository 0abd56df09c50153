import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import prose  # noqa: E402

@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text) with nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(1)
    body = prose(rng, 120)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, prose(rng, 40_000)), (7, body), (8, body), (8, body),
        (9, body + " tail"), (None, "no id " + prose(rng, 60)), (10, "a" * 5000), (11, "é ñ 漢字 🙂 \x00 <|endoftext|>"), (-3, prose(rng, 70)),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The same with extra columns whose names clash with those that operators make."""
    rows = [(i, t, "en", None, 1, 2.0, "x", "y") for i, t in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, node string, spans string").cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
