"""Predicates over text columns, given by column name."""

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from staycohort.functions.text import quoted, quoted_list


def all_known(*columns: str) -> Column:
    """None of the columns is NULL; each test reaches the Parquet scan."""
    return F.expr(" AND ".join(f"{column} IS NOT NULL" for column in columns))


def lower_in(column: str, values: Iterable[str]) -> Column:
    """Lower-cased text is one of the (lower-case) values; NULL stays NULL, no values: false."""
    if not (values := list(values)):
        return F.lit(False)
    return F.expr(f"lower({column}) IN ({quoted_list(values)})")


def contains_any(column: str, needles: Iterable[str]) -> Column:
    """Lower-cased text contains one of the (lower-case) needles; no needles: false.

    One expression over the text, measured three times as fast as an OR of substring
    tests, each of which lower-cases the text again.
    """
    if not (needles := list(needles)):
        return F.lit(False)
    return F.lower(column).rlike("|".join(re.escape(needle) for needle in needles))


def starts_with_any(column: str, prefixes: Iterable[str]) -> Column:
    """Text starts with one of the prefixes, case kept; reaches the Parquet scan. None: false."""
    if not (prefixes := list(prefixes)):
        return F.lit(False)
    return F.expr(" OR ".join(f"startswith({column}, {quoted(p)})" for p in prefixes))
