import json

import pytest

from quillspan.operators import index, search, zipf
from quillspan.sources import readers, writers


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"title {i}\nthe word{i % 7} of {'der' if i % 3 else 'and'}") for i in range(60)] + [(60, ""), (61, "... --")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_stored_index(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    index.build_index(docs, path)
    stored = readers.load_index(spark, path)
    s = search.Searcher(stored.docs, stored.postings)
    plain = search.Searcher(docs)
    for q in ("the && der", "!the", "word1 || word2 !der", "zzz"):
        assert sorted(r[0] for r in s.search(q).collect()) == sorted(r[0] for r in plain.search(q).collect()), q
    assert {60, 61} <= {r[0] for r in s.search("!the").collect()}
    plan = s.search("the && der")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan
    with pytest.raises(FileNotFoundError):
        readers.load_index(spark, str(tmp_path / "none"))


def test_set_operations(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "doc_id long") for xs in ([1, 5, 10, 20], [5, 8, 10, 100]))
    none = a.limit(0)
    values = lambda df: sorted(r[0] for r in df.collect())
    assert values(search.intersection(a, b)) == [5, 10]
    assert values(search.union(a, b)) == [1, 5, 8, 10, 20, 100]
    assert values(search.difference(a, b)) == [1, 20]
    assert values(search.intersection(a, none)) == []
    assert values(search.union(a, none)) == [1, 5, 10, 20]


def test_paging_and_json(docs):
    s = search.Searcher(docs)
    hits = s.search("the")
    assert [r[0] for r in search.page(hits, 2).collect()] == list(range(40, 60))
    assert [r[0] for r in search.page(hits, 3).collect()] == []
    assert search.page_count(hits).first()[:] == (60, 3)
    found = json.loads(writers.results_json(s.with_titles(s.search("word1 && and"))).first()["json"])
    assert found == {"count": 3, "results": [{"id": i, "title": f"title {i}"} for i in (15, 36, 57)]}
    assert json.loads(writers.results_json(s.with_titles(s.search("zzz"))).first()["json"]) == {"count": 0, "results": []}
    assert json.loads(writers.error_json(ValueError('no "x"'))) == {"error": 'no "x"'}


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert search.Searcher(none).search("!a").collect() == []
    assert index.token_stats(none).first()["n_tokens"] == 0
    assert zipf.ranked(index.term_frequencies(none)).collect() == []


def test_zipf(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("aa", 1), ("ab", 1), ("b2", 1), ("я", 1)], "term string, frequency long")
    got = [tuple(r) for r in zipf.with_expected(zipf.ranked(df)).orderBy("rank").select("term", "rank", "zipf_expected").collect()]
    assert got == [("c", 1, 9.0), ("a", 2, 4.5), ("b", 3, 3.0), ("aa", 4, 9 / 4), ("ab", 5, 9 / 5), ("b2", 6, 9 / 6), ("я", 7, 9 / 7)]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"doc_3.txt": "Three\nx", "doc_12.txt": "", "note.TXT": "no"}.items():
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    files = readers.text_directory(spark, str(tmp_path / "in"))
    assert sorted(tuple(r) for r in readers.numbered_documents(files).collect()) == [(3, "Three\nx"), (12, "")]
    freq = spark.createDataFrame([("дом", 3), ("a", 1)], "word string, frequency long")
    writers.write_frequencies(freq, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in readers.frequency_csv(spark, str(tmp_path / "csv")).collect()) == [("a", 1), ("дом", 3)]
    (tmp_path / "old.csv").write_bytes("word,frequency\nдом,3\na,1\n".encode("cp1251"))
    assert sorted(tuple(r) for r in readers.frequency_csv(spark, str(tmp_path / "old.csv")).collect()) == [("a", 1), ("дом", 3)]
    assert readers.query_lines(["a\n", "\n", "b", "exit", "c"]) == ["a", "b"]
    (tmp_path / "c.json").write_text(json.dumps({"db": {"host": "h"}, "sources": [{"name": "s", "max_pages": 2, "other": 1}]}))
    assert readers.read_config(str(tmp_path / "c.json")).sources[0].max_pages == 2


def test_stored_index_follows_the_table(spark, tmp_path):
    from quillspan.plans import retrieval

    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    ask = lambda: sorted(r[0] for r in retrieval.index_lookup(spark, str(tmp_path)).collect())
    put([(1, "the one"), (2, "the two"), (3, "none")])
    assert ask() == [1, 2] == ask()
    put([(2, "two"), (3, "the three"), (5, "the five")])
    assert ask() == [3, 5]
    assert sorted(tuple(r) for r in retrieval.index_forward(spark, str(tmp_path)).collect()) == [(2, "two"), (3, "the three"), (5, "the five")]


def test_small_tables_are_dealt_out_by_row_groups(spark, tmp_path):
    from quillspan.functions import text

    path = str(tmp_path / "t")
    words = "".join(chr(97 + k * 7 % 26) + " " * (k % 5 == 0) for k in range(4000))
    spark.createDataFrame([(k, f"{k} {words}") for k in range(1500)], "doc_id long, text string").coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    assert text._row_groups(one)[0] == 1
    dealt = text.spread(one)
    assert dealt.count() == 1500
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len([n for n in sizes if n]) == min(spark.sparkContext.defaultParallelism, text._row_groups(one)[1] // text.TASK_BYTES)
    assert text._row_groups(spark.range(5)) is None
