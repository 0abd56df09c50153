"""URL normalisation, hashing and joining."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme://authority, path, query of a URL without fragment.
URL_PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)?([^?]*)(\?.+)?\??$"


def normalize_url(url: Column | str) -> Column:
    """Lower-case scheme and host, no fragment, one trailing slash less unless the path is the slash."""
    bare = F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"#[\s\S]*$", "")
    head, path, query = (F.regexp_extract(bare, URL_PATTERN, k) for k in (1, 2, 3))
    return F.concat(F.lower(head), F.regexp_replace(path, r"(.)/$", "$1"), query)


def url_hash(url: Column | str) -> Column:
    """MD5 of the normalised URL."""
    return F.md5(normalize_url(url))


def join_url(page: Column | str, href: Column | str) -> Column:
    """Absolute URL of a link on a page."""

    @F.pandas_udf("string")
    def joined(pages: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or h is None else urljoin(p, h) for p, h in zip(pages, hrefs)], dtype=object)

    return joined(page, href)
