"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.operators.slices import running_totals
from wardgrid.session import store

#: A side is broadcast only if it was counted and holds at most so many rows (of a few dozen bytes each).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_or_plain(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `limit` rows (counted now); else left to an ordinary shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def words_sql(text: str, breaks: str) -> str:
    """SQL for the words of `text` between runs of the Java character class `breaks`; empty for null or no words."""
    return f"array_remove(split(coalesce({text}, ''), '{breaks}'), '')"


def shingles_sql(words: str, k: int) -> str:
    """SQL for 64-bit hashes of all `k`-word shingles (repeats included); fewer words make one shingle, none an empty array.

    The words are bound once as a lambda variable, so that no element evaluates them again.
    """
    parts = ", ".join(["get(w, i)"] + [f"get(w, i + {j})" for j in range(1, k)])
    return (f"transform(array({words}), w -> if(size(w) = 0, array(), transform(sequence(0, greatest(size(w) - {k}, 0)), "
            f"i -> xxhash64({parts}))))[0]")


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less the columns whose names an operator adds itself; an input column of such a name is replaced."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Most ranges of ids; their first ids, eight bytes each, are part of the plan.
MOST_RANGES = 200_000


def id_ranges(ids: DataFrame, size: Column, each: int) -> list[int]:
    """The first ids, ascending, of ranges of doc_id with about `each` of `size` in sum; all rows of an id are in one range.

    Sizes are totalled by a prefix scan over sampled ranges, and ids are only compared, so neither extreme nor crowded ids
    matter. One row for each range reaches the driver, MOST_RANGES at most: beyond that the ranges grow.
    """
    per = store(ids.groupBy("doc_id").agg(F.sum(size).cast("long").alias("size")))
    total = per.agg(F.sum("size")).first()[0] or 0
    each = max(each, -(-total // MOST_RANGES))
    scan = running_totals(per, [], ["doc_id"], {"upto": "size"})
    return sorted(r.first for r in scan.groupBy(F.floor((F.col("upto") - F.col("size")) / each).alias("range")).agg(F.min("doc_id").alias("first")).collect())


def _firsts(ranges: list[int]) -> str:
    return f"cast(split('{','.join(map(str, ranges))}', ',') as array<bigint>)"


def range_of(ranges: list[int], name: str = "doc_id") -> Column:
    """Number of the range of an id, from 0, by binary search in the first ids; null for a null id."""
    steps = len(ranges).bit_length()
    return F.expr(f"if({name} is null, null, cast(aggregate(sequence({steps - 1}, 0, -1), 0, (p, k) -> "
                  f"if(get({_firsts(ranges)}, p + shiftleft(1, k) - 1) <= {name}, p + shiftleft(1, k), p)) - 1 as bigint))")


def first_of(ranges: list[int], number: str) -> Column:
    return F.expr(f"get({_firsts(ranges)}, cast({number} as int))")


def in_blocks(df: DataFrame, size: Column, each: int) -> tuple[DataFrame, int]:
    """`df` with `block`, and the number of blocks: ranges of doc_id in ascending order with about `each` of `size` in sum."""
    ranges = id_ranges(df.select("doc_id", size.alias("size")), F.col("size"), each)
    if not ranges:
        return df.withColumn("block", F.lit(0).cast("long")), 1
    return df.withColumn("block", range_of(ranges)), len(ranges)
