import itertools
import random
import time

import duckdb
from pyspark.sql import functions as F

from quillspan.functions import stemmer
from quillspan.functions.text import SEPARATORS, fold, fold_word, title, token_array
from quillspan.operators import index
from quillspan.plans import catalog, fixtures


def test_fold(spark):
    words = spark.createDataFrame([(w,) for w in fixtures.FOLD_VECTORS], "w string")
    assert {r[0]: r[1] for r in words.select("w", fold("w")).collect()} == fixtures.FOLD_VECTORS
    assert fold_word("РСЯ", "cyrillic") == "рся"


def test_tokens(spark):
    rows = [(1, "ПрИвЕт, Мир!"), (2, ""), (3, None), (4, "«закон» — e-mail a_b+c"), (5, "".join(SEPARATORS)), (6, "a" + "x".join(SEPARATORS) + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", token_array("text")).collect()}
    assert got == {1: ["привет", "мир"], 2: [], 3: [], 4: ["«закон»", "—", "e", "mail", "a_b+c"], 5: [], 6: ["a", *["x"] * (len(SEPARATORS) - 1), "b"]}


def test_titles(spark):
    rows = [(1, "T\nrest"), (2, ""), (3, "T\r\nrest"), (4, "\nrest"), (5, None), (6, "one line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: r[1] for r in df.select("doc_id", title()).collect()} == {1: "T", 2: "No Title", 3: "T", 4: "", 5: "No Title", 6: "one line"}


def test_stem_vectors():
    assert {w: stemmer.stem_word(w) for w in fixtures.STEM_VECTORS} == fixtures.STEM_VECTORS


def test_stem_column_equals_scalar(spark):
    rng = random.Random(2)
    ends = [*stemmer.ADJECTIVE, *stemmer.VERB, *stemmer.NOUN, *stemmer.PARTICIPLE, *stemmer.REFLEXIVE, *stemmer.SUPERLATIVE, "ость", "ост", ""]
    words = {"".join(rng.choices("абвгдеиоукмнрст", k=rng.randrange(0, 5))) + a + b for a, b in itertools.product(rng.sample(ends, 40), rng.sample(ends, 40))}
    words |= {"abc", "hello", "mixед", "x", "", *fixtures.STEM_VECTORS}
    df = spark.createDataFrame([(w, stemmer.stem_word(w)) for w in sorted(words)], "w string, want string")
    assert df.where(stemmer.stem("w") != F.col("want")).collect() == []


def test_a_stem_costs_less_than_a_few_pattern_searches(spark):
    """It was a search with a pattern for each of seven lists; this is the time of one such search, in the same array."""
    rng = random.Random(3)
    words = ["".join(rng.choices("абвгдеиоукмнрстялн", k=rng.randrange(3, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(words,)], "w array<string>").crossJoin(spark.range(0, 240, 1, 4)).persist()
    assert df.count() == 240

    def seconds(f):
        took = []
        for _ in range(2):
            began = time.perf_counter()
            df.select(F.transform("w", f).alias("out")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    once = seconds(lambda w: F.regexp_extract(w, stemmer.suffix_pattern(stemmer.VERB) + r"\z", 1))
    stems = seconds(stemmer.stem)
    df.unpersist()
    assert stems < 2.5 * once


def test_transliterated_capitals(spark, tmp_path):
    """The pass that transliterates also folds: capitals, and letters that are folded only when the text is cut into tokens."""
    text = "The DOMAMI Zähne ÄÖÜ Дома НОВОСТЬ РЕКАМИ ёлки ЁЛКИ qUICK-Foxes É"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(f"SELECT term, doc_id FROM ({catalog.ORACLES['cyrillic_postings']})").fetchall()
    got = catalog.QUERIES["cyrillic_postings"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("term", "doc_id").collect())) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("translate(") == 2


def test_counts(spark):
    df = spark.createDataFrame([(k, f"key_{i}") for k, i in enumerate([*range(100), 0])], "doc_id long, text string")
    freq = index.term_frequencies(df)
    assert freq.count() == 100
    assert {r["term"]: r["frequency"] for r in index.frequency_of(freq, ["key_0", "key_7", "none"]).collect()} == {"key_0": 2, "key_7": 1, "none": 0}


def test_russian_documents_meet_in_stems(spark):
    df = spark.createDataFrame([(1, "Дома и дом"), (2, "новости"), (3, "новость"), (4, None)], "doc_id long, text string")
    lists = {r["term"]: r["postings"] for r in index.inverted_index(index.postings_flat(df)).collect()}
    assert lists["дом"] == [1]
    assert lists["новост"] == [2, 3]
    assert {tuple(r) for r in index.postings_for(df, ["новост"]).collect()} == {("новост", 2), ("новост", 3)}
