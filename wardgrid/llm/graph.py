"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.session import store

#: Links that one task contracts before the rounds begin.
TASK_LINKS = 200_000


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of one task as stars around the smallest id of each of its components."""
    links = pd.concat([pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)}), *frames])
    ids, at = np.unique(links.to_numpy().ravel(), return_inverse=True)
    root = np.arange(len(ids))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for x, y in at.reshape(-1, 2):
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    top = np.array([find(x) for x in range(len(ids))], np.int64)
    moved = top != np.arange(len(ids))
    yield pd.DataFrame({"u": ids[moved], "v": ids[top[moved]]})


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in `links` (a, b); component is the smallest id that can be reached.

    Each task first contracts a bounded number of links. Where there were several tasks, every round then hangs each id's
    larger neighbours on its smallest neighbour, then its smaller ones, until nothing changes; a round's links are written to the shared folder, so no round repeats another's work.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tasks = max(1, math.ceil(links.count() / TASK_LINKS))
    edges = store(links.coalesce(tasks).mapInPandas(_contracted, "u long, v long").distinct())
    state = None
    while tasks > 1:        # one task that held all links has left stars already
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == tuple(found):
            break
        state = tuple(found)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(smallest, "u")
        edges = store(hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .union(smallest.select("u", F.col("m").alias("v"))).where("u != v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct())
