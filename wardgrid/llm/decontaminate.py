"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A test item is tens of words, a document may be tens of thousands, so the Jaccard similarity of the two says nothing. The
containment of the item's shingles in the document is estimated instead: the item's k shingles of least hash are a random
draw without replacement from its set, and as many of them as the containment says lie in the document. Items are
partitioned by size, sizes 2^p to 2^(p+1) - 1 together, and each partition has its own number of minima and of hits, from the
hypergeometric law (`plan`): the fewest minima for which an item at the threshold reaches `HITS` hits but for a probability
of `MISS`. Partitions too small for that are indexed whole and lose nothing. Documents are only probed: their shingles
stream past the index of minima, and no document set is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.llm.common import shingles_sql, small_or_plain, words_sql
from wardgrid.session import store

WORDS = 5
#: Minima in the document that make it a candidate for an item of many shingles, and the probability that an item at the
#: threshold has fewer.
HITS, MISS = 8, 1e-7
#: Sizes up to which the law is evaluated exactly; larger ones take its limit, the binomial law.
EXACT_SIZE = 512
#: Rows of an item index that may be broadcast (16 bytes each); a larger one is joined by shuffle.
INDEX_ROWS = 1_000_000
BREAKS = r"[^\\p{L}\\p{N}]+"


def shingle_rows(df: DataFrame, key: str, words: int) -> DataFrame:
    """One row (key, n, h) per shingle occurrence; n counts occurrences. Rows without words give none."""
    sql = shingles_sql(words_sql("lower(text)", BREAKS), words)
    return (df.select(F.col(key), F.expr(sql).alias("s"))
            .select(key, F.size("s").alias("n"), F.explode("s").alias("h")))


def short_of(size: int | None, minima: int, hits: int, percent: int) -> float:
    """Probability of fewer than `hits` hits among the minima of an item at the threshold; size None is the limit."""
    if size is None:
        p = percent / 100
        return sum(math.comb(minima, i) * p ** i * (1 - p) ** (minima - i) for i in range(hits))
    held = -(-size * percent // 100)
    return sum(math.comb(held, i) * math.comb(size - held, minima - i) for i in range(hits)) / math.comb(size, minima)


def plan(percent: int) -> list[tuple[int, int]]:
    """(minima, hits) of the partitions of sizes 2^p to 2^(p+1) - 1, p from 0; the last one serves all larger sizes too.

    (0, 0) stands for a partition that is indexed whole: one of its sizes cannot reach `HITS` hits surely enough, even with
    all of its shingles.
    """
    def fewest(sizes: list[int | None]) -> int:
        most = min((s for s in sizes if s is not None), default=None)
        minima = HITS
        while any(short_of(s, minima, HITS, percent) > MISS for s in sizes):
            minima += 1
            if most is not None and minima > most:
                return 0
        return minima

    out = [fewest(list(range(2 ** p, 2 ** (p + 1)))) if 2 ** p >= HITS else 0 for p in range(EXACT_SIZE.bit_length() - 1)]
    return [(m, HITS if m else 0) for m in [*out, fewest([None])]]


def _of_partition(values: list[int]) -> Column:
    """The value of the partition that column `size` is in: partition p holds the numbers of p + 1 binary digits."""
    at = F.least(F.length(F.bin("size")), F.lit(len(values)))
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def item_index(benchmark: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All shingles (item_id, size, h) of the items, and the index (item_id, size, need, h) by size partition."""
    whole = shingle_rows(benchmark.where("item_id is not null"), "item_id", words).select("item_id", "h").distinct()
    whole = store(whole.join(whole.groupBy("item_id").agg(F.count("*").alias("size")), "item_id"))
    minima, hits = zip(*plan(percent))
    parted = whole.withColumns({"minima": _of_partition(minima), "need": _of_partition(hits)})
    exact = (parted.where("minima = 0")
             .withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("size") * percent / 100)).cast("long")))
    # the limit is pushed below the shuffle, so that no task sends more than max(minima) rows of an item
    least = Window.partitionBy("item_id").orderBy(F.xxhash64("h", F.lit(0)), "h")
    drawn = (parted.where("minima > 0").withColumn("rank", F.row_number().over(least))
             .where(F.col("rank") <= max(minima)).where("rank <= minima").withColumn("need", F.col("need").cast("long")))
    columns = ["item_id", "size", "need", "h"]
    return whole, exact.select(*columns).unionByName(drawn.select(*columns))


def contamination(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with `percent` % or more of an item's shingles in a document.

    Words are runs of letters and digits in lower case; fewer than `words` of them make one shingle. Null or wordless
    texts, and rows without an id, take part in no pair. Rows that repeat a doc_id count as one document. Equal items
    are reported each by its own id. Other columns are ignored.
    """
    whole, minima = item_index(benchmark, words, percent)
    probe = small_or_plain(store(minima), INDEX_ROWS)
    docs = documents.where("doc_id is not null").select("doc_id", "text")
    found = (shingle_rows(docs, "doc_id", words).join(probe, "h")
             .where(F.col("n") * 100 >= F.col("size") * percent)
             .groupBy("doc_id", "item_id", "need").agg(F.collect_set("h").alias("hit"))   # at most the item's rows of the index
             .where(F.size("hit") >= F.col("need")).select("doc_id", "item_id"))
    found = store(found)
    candidates = small_or_plain(found.select("doc_id").distinct())
    pairs = (shingle_rows(docs.join(candidates, "doc_id"), "doc_id", words).select("doc_id", "h")
             .join(small_or_plain(whole, INDEX_ROWS), "h")
             .join(found, ["doc_id", "item_id"])
             .groupBy("doc_id", "item_id", "size", "h").agg(F.lit(1).alias("one"))
             .groupBy("doc_id", "item_id", F.col("size").alias("n_item")).agg(F.count("*").alias("n_shared")))
    return (pairs.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
            .withColumn("containment", F.col("n_shared") / F.col("n_item")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """The documents that hold no test item; all their columns, whatever they are called. Rows without an id stay."""
    bad = store(contamination(documents, benchmark, words, percent).select("doc_id").distinct())
    return documents.join(small_or_plain(bad), "doc_id", "left_anti").select(*[f"`{c}`" for c in documents.columns])
