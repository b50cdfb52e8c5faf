"""Opt-in filter on categories / keywords.

A term is kept when it is a *substring* of the comma-joined categories or of
the comma-joined keywords (a missing field counts as ``''``).  ``or`` keeps
an item when any term is found, ``and`` when every term is found (each term
in either field).  An empty term list keeps everything.

The predicate is plain ``contains``; a bare column ``contains`` reaches the
Parquet reader as a pushed filter when the input is a stored item table.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _term_found(term: str) -> Column:
    if term == "":
        # '' is a substring of anything, including a missing field
        return F.lit(True)
    return F.col("categories").contains(term) | F.col("keywords").contains(term)


def opt_in_predicate(terms, op: str = "or") -> Column | None:
    terms = list(terms or [])
    if not terms:
        return None
    # No coalesce: in a filter a null (missing field) already counts as "not
    # found", and bare ``contains`` predicates reach the Parquet reader.
    found = [_term_found(t) for t in terms]
    if op.lower() == "or":
        return functools.reduce(operator.or_, found)
    if op.lower() == "and":
        return functools.reduce(operator.and_, found)
    raise ValueError("op must be 'and' or 'or'")


def opt_in(items: DataFrame, terms, op: str = "or") -> DataFrame:
    """Filter items by opt-in terms, as given (no case change)."""
    pred = opt_in_predicate(terms, op)
    return items if pred is None else items.where(pred)


def lower_terms(terms) -> list[str]:
    """The command-line form lower-cases the terms before filtering."""
    return [t.lower() for t in (terms or [])]
