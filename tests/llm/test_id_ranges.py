"""Ranges of ids: extreme, negative, crowded and repeated ones."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wardgrid.llm import common, fingerprint, repeats

LOW, HIGH = -9_200_000_000_000_000_000, 9_200_000_000_000_000_000


@pytest.mark.parametrize("ids", [[LOW, -1, 0, 5, HIGH], [HIGH], [3, 3, 3], list(range(-50, 50)), [2 ** 62 + i for i in range(40)] + [LOW]])
def test_ranges_are_in_order_and_of_like_size(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(3)
    ranges = common.id_ranges(df, F.lit(1), 4)
    got = {r.doc_id: r.n for r in df.select("doc_id", common.range_of(ranges).alias("n")).collect()}
    ordered = sorted(set(ids))
    assert ranges == sorted(ranges) and ranges[0] == ordered[0]
    for i in ordered:
        assert got[i] == sum(f <= i for f in ranges) - 1
    if len(set(ids)) == len(ids):
        sizes = [sum(got[i] == k for i in ids) for k in range(len(ranges))]
        assert max(sizes) <= 4 and min(sizes) >= 1


def test_one_outlier_does_not_crowd_the_rest(spark):
    df = spark.range(0, 100_000).select(F.col("id").alias("doc_id")).union(spark.range(0, 1).select(F.lit(HIGH)))
    ranges = common.id_ranges(df, F.lit(1), 500)
    sizes = [r["count"] for r in df.select(common.range_of(ranges).alias("n")).groupBy("n").count().collect()]
    assert len(sizes) == 201 and max(sizes) <= 1000


def test_no_ids(spark):
    assert common.id_ranges(spark.createDataFrame([], "doc_id long"), F.lit(1), 4) == []


TEXTS = ["one two three four", "", "five six seven", None, "eight nine ten eleven twelve"]


def test_neighbours_of_extreme_ids(spark):
    ids = [LOW, -3, 7, 8, HIGH]
    df = spark.createDataFrame(list(zip(ids, TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in fingerprint.edited_fingerprints(df).collect()}
    texts = [t or "" for t in TEXTS]
    for k, i in enumerate(ids):
        half = len(texts[k]) // 2
        edited = texts[k][: len(texts[k]) - half] + texts[(k + 1) % len(ids)][:half]
        assert got[i] == (len(texts[k]), hashlib.sha256(edited.encode()).hexdigest())


def test_repeats_with_extreme_ids(spark):
    line = "a line of exactly so many bytes that it is found again, wherever. "
    df = spark.createDataFrame([(HIGH, "x" + line), (LOW, line + "y"), (0, "z " + line)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.without_repeats(df, block_bytes=64).collect()}
    assert got == {LOW: 0, 0: len(line), HIGH: len(line)}
