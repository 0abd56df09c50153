import random

import brute
import numpy as np
from brute import prose

from quillspan.llm import line_dedup


def run(spark, rows):
    return {r["doc_id"]: r for r in line_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def words_left(text, gone):
    return [w for k, w in enumerate((text or "").split()) if k not in gone]


def test_passages(spark):
    rng = random.Random(3)
    passage, short = prose(rng, 60), prose(rng, 40)
    lines = "\n".join(prose(rng, 20) for _ in range(5))
    rows = [
        (1, f"{prose(rng, 30)} {passage} {prose(rng, 30)}"),
        (2, f"{prose(rng, 200)} {passage}\n{prose(rng, 30)}"),
        (3, f"{prose(rng, 30)} {short} {prose(rng, 30)}"),
        (4, f"{prose(rng, 30)} {short} {prose(rng, 30)}"),
        (5, lines + "\n" + prose(rng, 80)),
        (6, prose(rng, 80) + "\n" + lines.replace("\n", " ")),
        (7, passage + " " + passage),
        (8, lines),
        (9, prose(rng, 90)),
    ]
    want, got = brute.repeated_words(rows), run(spark, rows)
    for i, text in rows:
        assert got[i]["text"].split() == words_left(text, want[i]), i
        assert got[i]["n_removed"] == len(want[i])
    assert got[9]["text"] == rows[8][1] and got[4]["text"] == rows[3][1]
    assert passage in got[1]["text"] and passage not in got[2]["text"] and got[7]["text"] == "" and got[8]["text"] == ""
    assert got[2]["text"].count("\n") == 1


def test_random_texts(spark):
    rng = random.Random(4)
    parts = [prose(rng, n) for n in (55, 80, 120, 50, 49, 200)]
    rows = [(i, " ".join(rng.choice(parts) if rng.random() < 0.4 else prose(rng, rng.randrange(5, 60)) for _ in range(5))) for i in range(80)]
    want, got = brute.repeated_words(rows), run(spark, rows)
    missed = sum(len(words_left(t, set())) - got[i]["n_removed"] - len(words_left(t, want[i])) for i, t in rows if got[i]["n_removed"] < len(want[i]))
    over = [i for i, t in rows if got[i]["text"].split() != words_left(t, want[i]) and got[i]["n_removed"] >= len(want[i])]
    assert missed == 0 and not over


def test_first_place_in_shorter_company(spark):
    """Passages whose beginning or end an earlier document has alone."""
    rng = random.Random(7)
    rows, at = [], 0
    for k in range(40):
        passage = prose(rng, 60).split()
        cut = rng.randrange(26, 50)
        part = passage[:cut] if k % 2 else passage[-cut:]
        for inner in (part, passage, passage):
            rows.append((at, f"{prose(rng, 30)} {' '.join(inner)} {prose(rng, 30)}"))
            at += 1
    want, got = brute.repeated_words(rows), run(spark, rows)
    assert sum(map(len, want.values())) >= 40 * 60
    for i, text in rows:
        assert got[i]["text"].split() == words_left(text, want[i]), i


def test_later_places_share_more(spark):
    """Passages that the first document ends or begins early: the later ones share 1 to 25 words more."""
    rng = random.Random(12)
    rows, at = [], 0
    for k in range(50):
        passage, more = prose(rng, rng.randrange(50, 75)), prose(rng, k // 2 + 1)
        longer = f"{passage} {more}" if k % 2 else f"{more} {passage}"
        for inner in (passage, longer, longer):
            rows.append((at, f"{prose(rng, 30)} {inner} {prose(rng, 30)}"))
            at += 1
    want, got = brute.repeated_words(rows), run(spark, rows)
    for i, text in rows:
        assert got[i]["text"].split() == words_left(text, want[i]), i


def test_monotonous_text(spark):
    rows = [(1, "la " * 4000), (2, ("one two three four five six seven. " * 300)), (3, "la " * 49)]
    got = run(spark, rows)
    assert len(got[1]["text"].split()) == 50 and 50 <= len(got[2]["text"].split()) < 110 and got[3]["text"] == rows[2][1]


def test_edges(edge_docs, no_docs, edge_rows):
    got = line_dedup.drop_repeats(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["text"])
    texts = dict(edge_rows)
    assert by_id[1] == [None] and by_id[2] == [""] and by_id[3] == [texts[3]] and by_id[5] == ["one two"]
    assert by_id[8] == ["", ""] and by_id[7] == [texts[7]] and by_id[9] == ["tail"] and by_id[6] == [texts[6]]
    assert line_dedup.drop_repeats(no_docs).collect() == []
    filtered = line_dedup.drop_repeats(edge_docs, report=False, drop_emptied=True)
    assert filtered.columns == edge_docs.columns
    assert filtered.count() == len(edge_rows) - 2


def test_guarantee():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    _, at = line_dedup.fingerprints(h)
    for start in range(0, 500 - line_dedup.RUN):
        assert ((at >= start) & (at + line_dedup.GRAM <= start + line_dedup.RUN)).any()
    assert len(line_dedup.fingerprints(h[:49])[0]) == 0


def test_ids_with_two_texts(spark):
    rng = random.Random(8)
    passage, other = prose(rng, 60), prose(rng, 250)
    for rows in ([(1, passage), (2, passage), (2, other)], [(1, passage), (2, "short"), (2, passage)], [(1, passage), (1, other), (2, other), (3, passage + " " + other)]):
        df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, _id int")
        got = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_repeats(df).collect())
        left = {t: i for i, t in reversed(rows)}
        want = [(i, t if left.get(t) == i and i != 3 else "") for i, t in rows]
        if rows[-1][0] == 3:
            # Only one of the two texts of id 1 is its document; its other text and what repeats that stay.
            assert got[:3] == sorted([(1, passage), (1, other), (2, "")]) and got[3][1] in (passage, other)
        else:
            assert got == sorted(want)
    assert line_dedup.delete_words("a  b\nc d", [(1, 2)]) == "a\nc d"


def test_clashing_names_and_white_space(spark):
    rng = random.Random(18)
    passage, tail = prose(rng, 60), prose(rng, 20)
    rows = [(1, passage, 5), (2, f"{passage} {tail}", 6), (2, f"{passage}\n{tail}", 7), (None, passage, 8), (3, passage, 9)]
    names = ("_id", "_t", "_spans", "_removed", "f", "src", "t")
    df = spark.createDataFrame([(i, t, *[x] * len(names)) for i, t, x in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = line_dedup.drop_repeats(df, report=False, drop_emptied=True)
    assert got.columns == df.columns
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == sorted([(1, passage, 5), (2, tail, 6), (2, tail, 7), (None, passage, 8)], key=repr)


def test_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    monkeypatch.setattr(line_dedup, "SHARE", 2)
    rng = random.Random(28)
    passage, rare = prose(rng, 90), prose(rng, 55)
    rows = [(i, f"{prose(rng, 20)} {passage if i % 3 else rare + ' ' + prose(rng, 9)} {prose(rng, 30)}") for i in range(40)] + [(50, passage), (51, rare)]
    want, got = brute.repeated_words(rows), run(spark, rows)
    for i, text in rows:
        assert got[i]["text"].split() == words_left(text, want[i]), i


def test_word_hashes(monkeypatch):
    rng = random.Random(11)
    text = " \t".join(rng.choice(["a", "b", "ab", "ba", "é", "漢字", "aé"]) + str(rng.randrange(3)) for _ in range(500)) + "\n"
    whole = line_dedup.word_hashes(text)
    words = text.split()
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    assert len({(w, int(h)) for w, h in zip(words, whole)}) == len(set(words))
    monkeypatch.setattr(line_dedup, "CHUNK", 64)
    assert (line_dedup.word_hashes(text) == whole).all()
    assert len(line_dedup.word_hashes(None)) == len(line_dedup.word_hashes(" \n ")) == 0
    assert line_dedup.merge_packed(np.array([(5 << 32) + 9, (0 << 32) + 3, (3 << 32) + 4, (6 << 32) + 7])) == [(0, 4), (5, 9)]
