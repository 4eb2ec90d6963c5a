"""Arrow UDFs for what the built-in functions can't express: accent folding, sequence likeness, joining addresses."""

from __future__ import annotations

import difflib
import unicodedata
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def fold_text(text: str | None) -> str | None:
    """Lower-case ASCII letters of a text, accents dropped."""
    if text is None:
        return None
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio 2M / (la + lb); null if either side is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def close_match(vocabulary: list[str], cutoff: float = 0.8):
    """UDF: the vocabulary entry nearest to a value (in lower case) from ``cutoff`` on, else null."""
    by_low = {v.lower(): v for v in vocabulary}

    @F.pandas_udf(StringType())
    def nearest(values: pd.Series) -> pd.Series:
        def one(v):
            hits = difflib.get_close_matches((v or "").lower(), list(by_low), n=1, cutoff=cutoff)
            return by_low[hits[0]] if hits else None

        distinct = {v: one(v) for v in values.dropna().unique()}
        return values.map(distinct)

    return nearest


@F.pandas_udf(StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else urljoin(x, y) for x, y in zip(base, link)], dtype=object)


@F.pandas_udf(StringType())
def set_query_param(url: pd.Series, name: pd.Series, value: pd.Series) -> pd.Series:
    """The address with one query parameter set; blank ones stay, repeated ones keep their first value."""

    def one(u, n, v):
        if u is None:
            return None
        parts = urlsplit(u)
        params: dict[str, str] = {}
        for k, x in parse_qsl(parts.query, keep_blank_values=True):
            params.setdefault(k, x)
        params[n] = str(v)
        return urlunsplit(parts._replace(query=urlencode(params)))

    return pd.Series([one(*x) for x in zip(url, name, value)], dtype=object)


def register_udfs(spark: SparkSession) -> None:
    """Make the UDFs callable from SQL."""
    for name, f in (("fold_text", fold), ("sequence_ratio", sequence_ratio), ("join_url", join_url), ("set_query_param", set_query_param)):
        spark.udf.register(name, f)
