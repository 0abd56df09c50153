import random
from collections import Counter

import brute
import corpus_pipeline
import pytest
from brute import prose

from quillspan.llm import secrets


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    passage = prose(rng, 70)
    for i in range(600):
        text = prose(rng, rng.randrange(20, 120))
        if i % 9 == 0:
            text = "grubel " + text + " snorfik grubel"
        if i % 31 == 1:
            text += " " + passage
        if i % 40 == 2:
            text += " password=abcd1234efgh"
        rows.append((i, text))
        labels.append((i, 1, int(i % 9 == 0)))
    rows += [(600 + k, rows[10 + k][1]) for k in range(5)] + [(610, None), (611, ""), (612, "one two three"), (613, "One two three")]
    base = prose(rng, 45)
    rows += [(620 + k, base + f" t{k}") for k in range(4)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_against_plain_versions(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, dict(rows)
    stages = dict(corpus_pipeline.STAGES)

    after = stages["toxicity"](spark, docs, folder)
    assert after.columns == columns
    kept = {r["doc_id"]: r["text"] for r in after.collect()}
    assert set(kept) == {i for i in texts if i >= 600 or i % 9}

    after = stages["line_dedup"](spark, after, folder)
    assert after.columns == columns
    gone = brute.repeated_words(kept.items())
    want = {i: " ".join(w for k, w in enumerate((t or "").split()) if k not in gone[i]) for i, t in kept.items()}
    want = {i: t for i, t in want.items() if t or not gone[i]}
    got = {r["doc_id"]: r for r in after.collect()}
    assert {i: " ".join((r["text"] or "").split()) for i, r in got.items()} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())

    after = stages["near_dedup"](spark, after, folder)
    assert after.columns == columns
    groups = brute.near_duplicates(want.items())
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    assert set(got) == {i for i, (_, c) in groups.items() if i == c} and {611, 610, 612, 620} <= set(got) and not {613, 621} & set(got)

    after = stages["secrets"](spark, after, folder)
    assert after.columns == columns
    masked = {r["doc_id"]: r["text"] for r in after.collect()}
    assert {i: t and secrets.redact_text(t, {}) for i, t in got.items()} == masked
    assert not any("password=" in (t or "") for t in masked.values())

    packed = stages["packing"](spark, after, folder).collect()
    assert Counter(r["doc_id"] for r in packed) == Counter(list(masked))
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 1


def test_run_and_registration(spark, corpus):
    import __spark_entry__

    folder, _ = corpus
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 300 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert "pipeline" not in __spark_entry__.oracle_sql()
