"""Mixing sources to target weights by Pfair scheduling: earliest deadline first over blocks with release times.

The j-th block (from 1) of a source with weight w is released at slot floor((j - 1) / w) and due at ceil(j / w). Scheduling
the released block with the earliest deadline fills every slot, and after any number of slots each source is less than
one block off its share. The slots come in rounds of `ticks`, which tasks schedule independently of each other: by the end
of round k a source has had its share of k * ticks slots by the exact weights, rounded by largest remainders, so what a
round rounds off is given back in later ones. Where ticks times each weight is whole, each source stays less than one
block off its share; else less than two, after any number of slots. Spark numbers the documents of each source, and a
join with the slots of their blocks does the rest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardgrid.llm.common import small_or_plain, without
from wardgrid.session import store

#: Least slots of a round, and the most that small weights may make of it: weights under 2 / MOST_TICKS count as that.
TICKS, MOST_TICKS = 1000, 1_000_000
BLOCK_DOCS = 8
#: Rows of a numbering bin, and the most bins per source.
BIN_ROWS, MOST_BINS = 5_000, 1_000_000
#: Blocks that a task places, and rows of its batches.
TASK_BLOCKS, BATCH_ROWS = 100_000, 50_000


def units(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights as they are written in decimals."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def shares(weights: dict[str, float], ticks: int) -> dict[str, int]:
    """Whole ticks for each source in proportion to its weight, `ticks` in all (largest remainders; ties by source)."""
    whole = units(weights)
    total = sum(whole.values())
    parts = {s: divmod(u * ticks, total) for s, u in whole.items()}
    out = {s: q for s, (q, _) in parts.items()}
    for s in sorted(parts, key=lambda s: (-parts[s][1], s))[: ticks - sum(out.values())]:
        out[s] += 1
    return out


def rounds(weights: dict[str, float], ticks: int = TICKS) -> tuple[dict[str, int], int]:
    """Exact weights in whole numbers and the slots of a round, in which each source has two slots at least."""
    whole = units(weights)
    least = -(-2 * sum(whole.values()) // MOST_TICKS)
    whole = {s: max(u, least) for s, u in whole.items()}
    return whole, max(ticks, -(-2 * sum(whole.values()) // min(whole.values())))


def period(parts: dict[str, int], among: set[str] | None = None) -> list[tuple[str, int, int]]:
    """(source, block of the period, slot) by earliest deadline among released blocks; ties by source.

    Only blocks of sources `among` these are placed, if given; slots for which none is released stay empty.
    """
    ticks = sum(parts.values())
    waiting = [(0, s, 0) for s in parts if parts[s] and (among is None or s in among)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * ticks // parts[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * ticks // parts[s], s, j + 1))
        slot += 1
    return out


def placed(whole: dict[str, int], ticks: int, blocks: dict[str, int], number: int) -> list[tuple[str, int, int]]:
    """(source, block, slot) of one round for sources of so many `blocks`; those with none left take no part in it."""
    start, stop = shares(whole, number * ticks), shares(whole, (number + 1) * ticks)
    parts = {s: stop[s] - start[s] for s in whole}
    left = {s: blocks[s] - start[s] for s in whole if blocks[s] > start[s]}
    return [(s, start[s] + j, number * ticks + t) for s, j, t in period(parts, {*left}) if j < left[s]]


def block_slots(spark: SparkSession, whole: dict[str, int], ticks: int, blocks: dict[str, int]) -> DataFrame:
    """(_src, _block, mix_slot): the slot of every block, placed in tasks that take every n-th round."""
    total = sum(whole.values())
    n_rounds = max(-(-(blocks[s] + 1) * total // (whole[s] * ticks)) for s in whole)
    tasks = min(n_rounds, -(-sum(blocks.values()) // TASK_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))],
                                              ["_src", "_block", "mix_slot"])
        for first in (i for b in batches for i in b.column(0).to_pylist()):
            rows: list = []
            for number in range(first, n_rounds, tasks):
                rows += placed(whole, ticks, blocks, number)
                if len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "_src string, _block long, mix_slot long")


def mix(documents: DataFrame, weights: dict[str, float] | None = None, tempering: float = 0.5, ticks: int | None = None,
        block_docs: int = BLOCK_DOCS, seed: int = 17) -> DataFrame:
    """All documents with `mix_slot`, the slot of their block, and `mix_position`, their place in the mixed order.

    `weights` maps sources to weights (documents of a source that is not named share what `""` is given, else the
    smallest weight named); without it a source's weight is its number of documents to the power `tempering`. A
    source's documents come in a seeded pseudo-random order, cut into blocks of `block_docs`. Every document has
    exactly one place; when a source has run out, its later slots stay empty, so positions ascend with gaps. A null
    source is a source of its own. Repeated rows each have a place of their own. An input column named like an
    output is replaced. Rounds have `ticks` slots, or as many more as the smallest weight needs; there may be at most
    `ticks` / 2 sources, and MOST_TICKS / 2 without `ticks`, since one row of each reaches the driver.
    """
    spark = documents.sparkSession
    docs = without(documents, "mix_slot", "mix_position", "_src", "_key", "_bin", "_base", "_rn", "_block")
    rest = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])   # orders rows that repeat an id
    keyed = (docs.withColumn("_src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
             .withColumn("_key", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))))
    most = MOST_TICKS if ticks is None else ticks
    counts = {r[0]: r[1] for r in keyed.groupBy("_src").count().limit(most // 2 + 1).collect()}   # one row per source
    if len(counts) * 2 > most:
        raise ValueError(f"more than {most // 2} sources: raise ticks, or group the sources first")
    if not counts:
        return docs.withColumn("mix_slot", F.lit(0).cast("long")).withColumn("mix_position", F.lit(0).cast("long"))
    if weights is None:
        wanted = {s: n ** tempering for s, n in counts.items()}
    else:
        other = weights.get("", min(weights.values()))
        wanted = {s: weights.get(s[1:], other) for s in counts}
    whole, ticks = rounds(wanted, ticks or TICKS)
    slots = store(block_slots(spark, whole, ticks, {s: -(-n // block_docs) for s, n in counts.items()}))
    bins = min(MOST_BINS, max(1, math.ceil(sum(counts.values()) / BIN_ROWS)))
    # bins follow the order of the key: its top 31 bits, scaled
    keyed = keyed.withColumn("_bin", F.floor(
        (F.shiftrightunsigned("_key", 33) * bins) / F.lit(2 ** 31)).cast("long"))
    per_bin = keyed.groupBy("_src", "_bin").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_src").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    base = store(per_bin.select("_src", "_bin", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")))
    inside = Window.partitionBy("_src", "_bin").orderBy(F.shiftrightunsigned("_key", 33), "_key", "doc_id", rest)
    numbered = (keyed.join(small_or_plain(base), ["_src", "_bin"])
                .withColumn("_rn", F.col("_base") + F.row_number().over(inside) - 1)
                .withColumn("_block", F.floor(F.col("_rn") / block_docs).cast("long")))
    return (numbered.join(small_or_plain(slots), ["_src", "_block"])
            .withColumn("mix_position", (F.col("mix_slot") * block_docs + F.col("_rn") % block_docs).cast("long"))
            .select(*[f"`{c}`" for c in docs.columns], "mix_slot", "mix_position"))
