"""Operators of a training-data pipeline: cleaning, deduplication, mixing and sharding of documents.

One module per operator.  Each operator takes and returns DataFrames and works on any table that has
the named columns; the query at the end of its module applies it to the whole of ``documents``.
"""

from estatescope.llm import (  # noqa: F401
    bpe, decontamination, language, mixing, pii, quality, ranked_search, secrets, sharding, simhash, substrings, suffixes,
    vector_codes,
)
from estatescope.llm.registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
