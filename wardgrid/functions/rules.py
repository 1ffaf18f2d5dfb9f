"""Rule tables turned into native CASE expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def case(rules: Iterable[tuple[Column, object]], default=None) -> Column:
    """CASE over ordered (condition, value) rules; a value may be a column or a constant."""
    expr = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    if expr is None:
        return F.lit(default)
    return expr if default is None else expr.otherwise(default)


def stems_pattern(stems: Sequence[str]) -> str:
    return "|".join(re.escape(s).replace(r"\ ", " ").replace(r"\-", "-") for s in stems)


def has_any_stem(text: Column, stems: Sequence[str]) -> Column:
    """True where the lower-cased text holds one of the stems; NULL text is False."""
    return F.coalesce(F.lower(text).rlike(stems_pattern(stems)), F.lit(False))


def keyword_class(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default=None) -> Column:
    """The first class, in rule order, one of whose stems occurs in the text."""
    return case([(has_any_stem(text, stems), label) for label, stems in rules], default)


def upper_bands(value: Column, bands: Sequence[tuple[float | None, object]]) -> Column:
    """Gap-free bands by inclusive upper bound; the last bound is None for 'everything above'."""
    rules = [(value <= F.lit(bound), out) for bound, out in bands if bound is not None]
    top = [out for bound, out in bands if bound is None]
    return F.when(value.isNotNull(), case(rules, top[0] if top else None))


def below_bands(value: Column, bands: Sequence[tuple[float, object]], default) -> Column:
    """Bands by exclusive upper bound."""
    return case([(value < F.lit(bound), out) for bound, out in bands], default)


def at_least_bands(value: Column, bands: Sequence[tuple[float, object]], default) -> Column:
    """Bands by inclusive lower bound, highest first."""
    return case([(value >= F.lit(bound), out) for bound, out in bands], default)


def clip(value: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL (least/greatest alone would return the bound)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def first_range_violation(bounds: Mapping[str, tuple[float, float]], optional: Sequence[str] = ()) -> Column:
    """Name of the first column outside its closed range, or NULL.

    A missing value breaks the contract unless its column is optional.
    """
    rules = []
    for name, (low, high) in bounds.items():
        inside = F.col(name).between(low, high)
        rules.append((~F.coalesce(inside, F.lit(name in optional)), f"{name} out of range"))
    return case(rules)


def contains_any(term: str, columns: Sequence[str]) -> Column:
    """Case-insensitive substring search over several columns; an empty term matches all."""
    needle = term.strip().lower()
    if not needle:
        return F.lit(True)
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False))
    return found


def unpivot_numbers(df, ids: Sequence[str], columns: Sequence[str], name: str, value: str):
    """Wide to tall without a shuffle, NULLs kept, every value as a double."""
    wide = df.selectExpr(*ids, *[f"CAST({c} AS DOUBLE) AS {c}" for c in columns])
    return wide.unpivot(list(ids), list(columns), name, value)
