"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RAW_DOCUMENTS = _struct(id=_L, url=_S, url_hash=_S, source_name=_S, raw_html=_S, crawled_at=_L)
PAGES = _struct(page_id=_L, url=_S, html=_S)
DOCUMENTS = _struct(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L)
CORPUS = _struct(doc_id=_L, title=_S, text=_S)
POSTINGS = _struct(term=_S, doc_id=_L)
INDEX_DOCS = _struct(doc_id=_L, title=_S)
FREQUENCIES = _struct(word=_S, frequency=_L)
