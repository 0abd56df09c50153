"""Operators that run at the same time in one session leave each other's checkpoints alone."""

import random
from concurrent.futures import ThreadPoolExecutor

from brute import prose

from quillspan.llm import common, line_dedup, near_dedup


def test_two_operators_at_once(spark):
    rng = random.Random(8)
    passage = prose(rng, 70)
    docs = spark.createDataFrame([(k, f"{prose(rng, 30)} {passage if k % 3 else ''} {prose(rng, 20 + k % 5)}") for k in range(60)] + [(100, passage), (101, passage)], "doc_id long, text string").cache()
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    runs = [lambda: key(near_dedup.near_duplicates(docs)), lambda: key(line_dedup.drop_repeats(docs))]
    alone = [run() for run in runs]
    with ThreadPoolExecutor(2) as pool:
        for _ in range(2):
            assert [f.result() for f in [pool.submit(run) for run in runs]] == alone


def test_a_scope_owns_what_its_thread_makes(spark):
    made = {}

    def other():
        made["theirs"] = common.durable(spark.range(5))

    with common.scratch(spark, collect=False) as keep:
        with ThreadPoolExecutor(1) as pool:
            pool.submit(other).result()
        common.durable(spark.range(3))
        made["kept"] = keep(spark.range(4))
    assert made["theirs"].count() == 5 and made["kept"].count() == 4
