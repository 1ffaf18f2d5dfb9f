"""Report text to labels, and packed text to arrays, as native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions.rules import case

WINDOW_CHARS = 100
# Case-blind with Unicode word borders and blanks, as in the text rules' definition.
FLAGS = "(?iU)"


def _clause_tail(text: Column) -> Column:
    """The unfinished clause at the end of a text, with the mark before it."""
    return F.regexp_extract(text, r"(?s)[.;\n]?[^.;\n]*\z", 0)


def has_unnegated(text: Column, positive: str, negative: str | None,
                  negation: str = fx.NEGATION_PATTERN) -> Column:
    """True where some match of `positive` has no negation in its clause window.

    The window runs from the last '.', ';' or line break, or from 100 characters back if that is
    nearer, to the end of the match. One fold over the pieces between matches keeps only the last
    100 characters, so a whole text is read once however many matches it has.
    """
    pattern = FLAGS + positive
    blocked = FLAGS + "(" + (f"{negative}|{negation}" if negative else negation) + ")"
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("hit"))

    def step(state: Column, part: Column) -> Column:
        before = F.right(F.concat(state["tail"], part["piece"]), F.lit(WINDOW_CHARS))
        window = F.concat(_clause_tail(before), part["found"])
        fresh = part["found"].isNotNull() & ~window.rlike(blocked)
        tail = F.right(F.concat(before, F.coalesce(part["found"], F.lit(""))), F.lit(WINDOW_CHARS))
        return F.struct(tail.alias("tail"), (state["hit"] | F.coalesce(fresh, F.lit(False))).alias("hit"))

    parts = F.zip_with(pieces, matches, lambda p, m: F.struct(
        F.coalesce(p, F.lit("")).alias("piece"), m.alias("found")))
    # Most texts hold no match at all: decide those without splitting them.
    folded = F.aggregate(parts, start, step, lambda s: s["hit"])
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), folded).otherwise(F.lit(False))


def report_labels(text: Column, patterns: Mapping[str, tuple[str, str | None]] = fx.REPORT_PATTERNS,
                  negation: str = fx.NEGATION_PATTERN, names: Mapping[str, str] | None = None) -> dict[str, Column]:
    """One 0/1 column per finding plus 'No Finding' (no pathology at all; NULL text included)."""
    hits = {finding: has_unnegated(text, pos, neg, negation) for finding, (pos, neg) in patterns.items()}
    return {finding: hit.cast("double") for finding, hit in hits.items()}


def no_finding(columns: Sequence[str]) -> Column:
    """1 where none of the pathology columns is 1."""
    any_hit = F.lit(False)
    for c in columns:
        any_hit = any_hit | (F.col(c) == 1.0)
    return (~any_hit).cast("double")


def resolve_uncertain(df, columns: Sequence[str], policy: str = "u_zero",
                      optimistic: Sequence[str] = tuple(fx.UNCERTAIN_AS_POSITIVE),
                      clear: str = "No Finding"):
    """-1 (uncertain) becomes 0 or 1 by policy, NULL becomes 0; missing columns are added as 0."""
    if policy not in ("u_zero", "u_ones", "u_chexpert"):
        raise ValueError(f"unknown policy {policy}")
    exprs = {}
    for c in columns:
        if c not in df.columns:
            exprs[c] = F.lit(0.0)
            continue
        positive = [1.0, -1.0] if policy == "u_ones" or (policy == "u_chexpert" and c in optimistic) else [1.0]
        exprs[c] = F.coalesce(F.col(f"`{c}`").isin(positive), F.lit(False)).cast("double")
    out = df.withColumns(exprs)
    if clear in columns:
        out = out.withColumn(clear, no_finding([f"`{c}`" for c in columns if c != clear]))
    return out


def list_items(packed: Column) -> Column:
    """A list literal such as ['a', "b's"] as an array; other text becomes one element.

    Elements may use single or double quotes and backslash escapes; a malformed literal is kept
    whole as one element, empty text gives an empty array.
    """
    element = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
    trimmed = F.trim(packed)
    well_formed = trimmed.rlike(rf"(?s)\A\[\s*(?:(?:{element})\s*(?:,\s*(?:{element})\s*)*,?\s*)?\]\z")
    quoted = F.regexp_extract_all(trimmed, F.lit(f"(?s){element}"), F.lit(0))

    def unquote(item: Column) -> Column:
        body = item.substr(F.lit(2), F.length(item) - 2)
        marked = F.replace(body, F.lit("\\\\"), F.lit("\u0001"))
        plain = F.regexp_replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), r"\\(['\"])", "$1")
        return F.replace(plain, F.lit("\u0001"), F.lit("\\"))

    return case([
        (packed.isNull() | (trimmed == ""), F.array().cast("array<string>")),
        (well_formed, F.transform(quoted, unquote)),
    ]).otherwise(F.array(packed))


def path_part(path: Column, index: int) -> Column:
    """0-based part of a '/' path, NULL when there is none."""
    return F.get(F.split(path, "/"), index)


def clean_path(path: Column) -> Column:
    return F.replace(F.trim(path), F.lit("\\"), F.lit("/"))


def image_name(path: Column) -> Column:
    return F.regexp_replace(path_part(path, 4), r"\.jpg|\.png", "")
