"""Case-insensitive, accent-sensitive text comparison that ignores trailing blanks.

Columns keep their plain STRING type and spelling; the collation is applied
inside predicates and keys only.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLATION = "UNICODE_CI_RTRIM"


def collated(col: Column) -> Column:
    return F.collate(col, COLLATION)


def text_eq(col: Column, value: str | Column) -> Column:
    """``col = value`` under the collation; NULL when either side is NULL."""
    return collated(col) == (value if isinstance(value, str) else collated(value))


def text_in(col: Column, values: Iterable[str]) -> Column:
    return collated(col).isin(list(values))


def text_case(col: Column, results: Mapping[str, object], otherwise: object = None) -> Column:
    """``CASE col WHEN key THEN value … ELSE otherwise END`` under the collation."""
    text = collated(col)
    (first, value), *rest = results.items()
    out = F.when(text == first, value)
    for key, value in rest:
        out = out.when(text == key, value)
    return out.otherwise(otherwise)
