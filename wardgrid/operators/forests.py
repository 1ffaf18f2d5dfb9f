"""A forest of regression trees with many outputs, grown level by level from histograms that Spark adds up.

Features are binned once. At each level tasks route their rows through the trees so far and count, for every open node,
some features of the tree's own choice: per bin and output the weight and the sum of the rows. The tasks' histograms are
added in groups, and each node's best split is chosen where its histogram is complete, so one short row for each node
reaches the driver. An output that is missing in a row takes no part in that row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgrid.operators.scaling import Scaler
from wardgrid.session import store

#: Bins of a feature, and features that a tree looks at on one level.
BINS, FEATURES = 16, 48
#: Rows that a task turns into histograms at once, and tasks whose histograms are added first.
ROWS, TEAM = 262_144, 64
#: Rows of a histogram that are multiplied at once, and that are gathered at once.
BLOCK, PANEL = 256, 16_384
#: Two counts travel in one double as a + SLOT * b: both are whole, and below SLOT for the rows that a task counts at once.
SLOT = 2.0 ** 26
#: Windows of a run at most: consecutive windows of a series, whose ticks are stored once.
RUN = 64
#: Weights 0, 1, 2, ... of a bootstrap: the Poisson distribution of mean 1.
_POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320]))


@dataclass
class Cells:
    """Bins of windows over ticks that are held once.

    Window w ends at tick `at[w]`; its feature h * width + c, h from 0 for the oldest row, is column c of the tick history - 1 - h before.
    """

    columns: np.ndarray   # (width, tick)
    at: np.ndarray        # (window)
    history: int

    @classmethod
    def of(cls, bins: np.ndarray) -> Cells:
        """Windows that are given feature by feature, (window, feature)."""
        return cls(np.ascontiguousarray(bins.T), np.arange(len(bins)), 1)

    @classmethod
    def runs(cls, bins: np.ndarray, windows: np.ndarray, history: int) -> Cells:
        """Runs of so many windows each, whose ticks (tick, width) follow each other."""
        ticks = windows + history - 1
        ends = np.cumsum(ticks) - windows - (np.cumsum(windows) - windows)
        return cls(np.ascontiguousarray(bins.T), np.arange(windows.sum()) + np.repeat(ends, windows), history)

    def start(self, feature: np.ndarray) -> np.ndarray:
        """What to add to a window's `at` for the place of a feature in `columns`, read row by row."""
        width, ticks = self.columns.shape
        return feature % width * ticks + feature // width - (self.history - 1)

    def features(self, chosen: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(feature, row): the bins of some features of some windows."""
        held, ends = self.columns.ravel(), self.at[rows]
        return np.stack([held.take(ends + start) for start in self.start(chosen)])


@dataclass
class Forest:
    """Trees as heaps: node i has the children 2 i + 1 (bin up to the threshold) and 2 i + 2."""

    trees: int
    depth: int
    outputs: int
    seed: int
    feature: np.ndarray = field(init=False)     # (tree, node); -1: not split
    threshold: np.ndarray = field(init=False)   # (tree, node), a bin
    value: np.ndarray = field(init=False)       # (tree, node, output)
    open: np.ndarray = field(init=False)        # (tree, node): may still be split

    def __post_init__(self) -> None:
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((self.trees, nodes), -1, np.int32)
        self.threshold = np.zeros((self.trees, nodes), np.int16)
        self.value = np.zeros((self.trees, nodes, self.outputs))
        self.open = np.zeros((self.trees, nodes), bool)
        self.open[:, 0] = True

    def looked_at(self, tree: int, level: int, width: int, features: int) -> np.ndarray:
        """The features that a tree looks at on a level, in order."""
        rng = np.random.default_rng([self.seed, tree, level])
        return np.sort(rng.choice(width, min(features, width), replace=False))

    def nodes(self, tree: int, bins: np.ndarray | Cells, rows: np.ndarray | None = None) -> np.ndarray:
        """The deepest node of each row, or of some rows."""
        cells = bins if isinstance(bins, Cells) else Cells.of(bins)
        ends = cells.at if rows is None else cells.at[rows]
        feature, threshold, held = self.feature[tree], self.threshold[tree], cells.columns.ravel()
        start, split = cells.start(np.maximum(feature, 0).astype(np.int64)), feature >= 0
        at = np.zeros(len(ends), np.int64)
        for _ in range(self.depth):
            goes = split.take(at)
            if not goes.any():
                break
            right = held.take(start.take(at) + ends) > threshold.take(at)
            at = np.where(goes, 2 * at + 1 + right, at)
        return at

    def predict(self, bins: np.ndarray | Cells) -> np.ndarray:
        cells = bins if isinstance(bins, Cells) else Cells.of(bins)
        return sum(self.value[t].take(self.nodes(t, cells), axis=0) for t in range(self.trees)) / self.trees


def bootstrap(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's sample, by a hash of its key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % 2 ** 32) * np.uint64(0xD1342543DE82EF95)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(29))) >> np.uint64(11)) / 2.0 ** 53, "right")


def used_cells(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin): whether a feature has other rows in a bin that is not its most frequent one, and (feature): the most frequent one."""
    rows = np.stack([np.bincount(b, minlength=BINS) for b in bins])
    most = rows.argmax(axis=1)
    rows[np.arange(len(bins)), most] = 0
    return rows > 0, most


def histogram(bins: np.ndarray, parts: np.ndarray, used: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """(feature, bin, part): sums of `parts` (row, part) by the bins (feature, row) of each feature.

    A feature's most frequent bin is what its other bins leave of the total; these are multiplied out block by block. `used` may be
    the `used_cells` of more rows than these.
    """
    held, most = used or used_cells(bins)
    of, bin_ = np.nonzero(held)
    bin_ = bin_.astype(np.uint8)[:, None]
    sums = np.zeros((len(of), parts.shape[1]))
    for at in range(0, len(parts), BLOCK):
        sums += (bins[of, at: at + BLOCK] == bin_).astype(float) @ parts[at: at + BLOCK]
    out = np.zeros((len(bins), BINS, parts.shape[1]))
    out[held] = sums
    out[np.arange(len(bins)), most] = parts.sum(axis=0) - out.sum(axis=1)
    return out


def paired(mask: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What is added up of each row, times its weight: 1 and the masks (0 or 1), by twos in one double, and the targets."""
    counts = np.concatenate([np.ones((len(y), 1)), mask, np.zeros((len(y), (mask.shape[1] + 1) % 2))], axis=1)
    return np.concatenate([counts[:, ::2] + SLOT * counts[:, 1::2], np.where(mask > 0, y, 0)], axis=1)


def unpaired(sums: np.ndarray, outputs: int) -> np.ndarray:
    """The weight, the count and the sum of each output, side by side."""
    pairs = outputs // 2 + 1
    out = np.empty((len(sums), 1 + 2 * outputs))
    high = np.floor(sums[:, :pairs] / SLOT)
    out[:, 0: 1 + outputs: 2] = sums[:, :pairs] - SLOT * high
    out[:, 1: 1 + outputs: 2] = high[:, : (1 + outputs) // 2]
    out[:, 1 + outputs:] = sums[:, pairs:]
    return out


def packed(h: np.ndarray) -> bytes:
    """The cells of a histogram (cell, part) that hold rows: their numbers, then their parts."""
    cells = np.flatnonzero(h[:, 0])
    return cells.astype(np.int32).tobytes() + h[cells].tobytes()


def unpacked(h: bytes, parts: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(h) // (4 + 8 * parts)
    return np.frombuffer(h, np.int32, n), np.frombuffer(h, np.float64, n * parts, 4 * n).reshape(n, parts)


def best_split(h: np.ndarray, outputs: int) -> tuple[int, int, float, np.ndarray, np.ndarray, float, float] | None:
    """(place of the feature, bin, gain, left part, right part, weights) with the largest fall of the squared error; None without one.

    Both sides keep some weight. Ties go to the first feature and bin.
    """
    left = np.cumsum(h, axis=1)[:, :-1]
    total = h[0].sum(axis=0)
    right = total - left

    def fit(part: np.ndarray) -> np.ndarray:
        n, s = part[..., 1: 1 + outputs], part[..., 1 + outputs:]
        return np.where(n > 0.5, s * s / np.maximum(n, 1), 0).sum(axis=-1)
    gain = fit(left) + fit(right) - fit(total)
    gain[(left[..., 0] < 0.5) | (right[..., 0] < 0.5)] = -1
    # sums of the same rows in another order differ in their last digits: near-equal gains count as equal
    f, b = np.unravel_index(int(np.argmax(gain >= gain.max() * (1 - 1e-9))), gain.shape)
    if gain[f, b] <= 1e-9 * max(1.0, float(fit(total))):
        return None
    return int(f), int(b), float(gain[f, b]), left[f, b], right[f, b], float(left[f, b, 0]), float(right[f, b, 0])


def means(part: np.ndarray, outputs: int, otherwise: np.ndarray) -> np.ndarray:
    n, s = part[1: 1 + outputs], part[1 + outputs:]
    return np.where(n > 0.5, s / np.maximum(n, 1), otherwise)


def flattened(windows: DataFrame) -> DataFrame:
    """`cells`, the numbers of `X` (history x width) row by row as bytes, and `newest`, its last row, in place of X."""
    kept = [f for f in windows.schema.fields if f.name != "X"]
    number = windows.schema["X"].dataType.elementType.elementType.simpleString()
    kind = np.float32 if number == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("X")
            cells = x.flatten().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(x), -1)
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], batch.column("newest"), pa.array([r.tobytes() for r in cells], pa.binary())], [*names, "newest", "cells"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return windows.select(*[f"`{f.name}`" for f in kept], "X", F.element_at("X", -1).alias("newest")).mapInArrow(
        run, schema + f"newest array<{number}>, cells binary")


def _flat(windows: DataFrame) -> DataFrame:
    return windows if "cells" in windows.columns else flattened(windows)


def _kind(flat: DataFrame) -> type:
    return np.float32 if flat.schema["newest"].dataType.elementType.simpleString() == "float" else np.float64


def bin_edges(rows: DataFrame, row: Column, width: int) -> np.ndarray:
    """(width, BINS - 1) ascending borders of each feature's bins from quantiles of `row`, one array of numbers a row."""
    shares = [k / BINS for k in range(1, BINS)]
    got = rows.select(F.posexplode(row).alias("f", "v")).groupBy("f").agg(
        F.percentile_approx(F.col("v").cast("double"), F.array(*map(F.lit, shares)), 10_000).alias("q")).collect()
    edges = np.full((width, BINS - 1), np.inf)
    for r in got:
        distinct = sorted(set(r.q))
        edges[r.f, : len(distinct)] = distinct
    return edges


def bin_numbers(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many ascending borders lie below each value; NaN lies above all."""
    out = np.zeros(values.shape, np.uint8)
    for border in edges[edges < np.inf]:
        out += values > border
    out[np.isnan(values)] = len(edges)
    return out


def binned(windows: DataFrame, edges: np.ndarray, history: int) -> DataFrame:
    """`bins`, one byte for each cell of X (history x width), older rows first, in place of X; all other columns stay.

    A value is in the bin of how many borders lie below it.
    """
    rows, width = _flat(windows), len(edges)
    kept, kind = [f for f in rows.schema.fields if f.name not in ("newest", "cells")], _kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), kind).reshape(batch.num_rows, history, width)
            out = np.empty(cells.shape, np.uint8)
            for f in range(width):
                out[:, :, f] = bin_numbers(cells[:, :, f].astype(float), edges[f])
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array([r.tobytes() for r in out], pa.binary())], [*names, "bins"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.select(*[f"`{f.name}`" for f in kept], "cells").mapInArrow(run, schema + "bins binary")


def _bytes(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _floats(column: pa.Array) -> np.ndarray:
    return _bytes(column).reshape(len(column), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def column_edges(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """`bin_edges` of rows with one column for each feature."""
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    got = rows.select(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in columns]).first()
    edges = np.full((len(columns), BINS - 1), np.inf)
    for f, q in enumerate(got):
        distinct = sorted(set(q or []))
        edges[f, : len(distinct)] = distinct
    return edges


def runs(ticks: DataFrame, columns: Sequence[str], edges: np.ndarray, history: int, scaler: Scaler | None = None) -> DataFrame:
    """Runs of at most RUN windows from `history_ticks` with a long `key` and arrays `y` and `mask`: their number `n`, `tick`, `key`, `y` and
    `mask` of each as bytes, and `bins` of their ticks, one byte for each column, from the first one's oldest row on.
    """
    width, scaler = len(columns), scaler and replace(scaler, seen=None)

    def values(column: pa.Array, name: str) -> np.ndarray:
        numbers = column.to_numpy(zero_copy_only=False).astype(float)
        if scaler is None:
            return numbers
        return scaler.scaled(name, numbers, column.is_null().to_numpy(zero_copy_only=False)).astype(np.float32).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros((0, width), np.uint8)
        for batch in batches:
            bins = np.empty((len(before) + batch.num_rows, width), np.uint8)
            bins[: len(before)] = before
            for f, c in enumerate(columns):
                bins[len(before):, f] = bin_numbers(values(batch.column(c), c), edges[f])
            number = batch.column("_n").to_numpy()
            kept = np.flatnonzero(batch.column("_kept").to_numpy(zero_copy_only=False) & (number >= history))
            if len(kept):
                windows = batch.take(pa.array(kept))
                tick, key = (windows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tick", "key"))
                y, mask = _matrix(windows.column("y")), (_matrix(windows.column("mask")) > 0).astype(np.uint8)
                # a run ends where a window is left out or another chunk begins, and after RUN windows
                place = kept + len(before)
                new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(number[kept]) != 1)])
                from_start = np.arange(len(kept)) - np.maximum.accumulate(np.where(new, np.arange(len(kept)), 0))
                first = np.flatnonzero(from_start % RUN == 0)
                last = np.append(first[1:], len(kept))
                cut = lambda m: pa.array([m[i:j].tobytes() for i, j in zip(first, last, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    windows.column("stay_id").take(pa.array(first)), windows.column("split").take(pa.array(first)), pa.array(last - first, pa.int32()),
                    cut(tick), cut(key), cut(y), cut(mask),
                    pa.array([bins[place[i] - history + 1: place[j - 1] + 1].tobytes() for i, j in zip(first, last, strict=True)], pa.binary())],
                    ["stay_id", "split", "n", "tick", "key", "y", "mask", "bins"])
            before = bins[max(0, len(bins) - history + 1):]

    stay = ticks.schema["stay_id"].dataType.simpleString()
    return ticks.select("stay_id", "split", "tick", "_n", "_kept", "key", "y", "mask", *columns).mapInArrow(
        run, f"stay_id {stay}, split string, n int, tick binary, key binary, y binary, mask binary, bins binary")


def _held(batch: pa.RecordBatch, history: int) -> tuple:
    """(bins of ticks, windows of each run, keys, y, mask) of rows of `grow`; a row that is no run is one of one window."""
    bins = batch.column("bins")
    if "n" not in batch.schema.names:
        ones = np.ones(len(bins), np.int64)
        return _floats(bins), ones, batch.column("key").to_numpy(), _matrix(batch.column("y")), (_matrix(batch.column("mask")) > 0).astype(float)
    windows = batch.column("n").to_numpy().astype(np.int64)
    n, ticks = int(windows.sum()), int((windows + history - 1).sum())
    y, mask = _bytes(batch.column("y"), np.float64).reshape(n, -1), _bytes(batch.column("mask")).reshape(n, -1).astype(float)
    return _bytes(bins).reshape(ticks, -1), windows, _bytes(batch.column("key"), np.int64), y, mask


def grow(train: DataFrame, outputs: int, trees: int = 30, depth: int = 8, seed: int = 42, features: int = FEATURES, history: int = 1) -> Forest:
    """A forest from stored rows (key long, bins binary, y array, mask array), or stored `runs` of windows over `history` ticks.

    Without rows all trees give 0.
    """
    forest = Forest(trees, depth, outputs, seed)
    for level in range(depth):
        if not forest.open.any():
            break
        for r in _splits(train, forest, level, features, history).collect():
            parent = forest.value[r.tree, r.node]
            forest.open[r.tree, r.node] = False
            if level == 0:
                forest.value[r.tree, 0] = means(np.frombuffer(r.total), outputs, parent)
            if r.feature >= 0:
                forest.feature[r.tree, r.node], forest.threshold[r.tree, r.node] = r.feature, r.bin
                for child, part, n in ((2 * r.node + 1, r.left, r.n_left), (2 * r.node + 2, r.right, r.n_right)):
                    forest.value[r.tree, child] = means(np.frombuffer(part), outputs, forest.value[r.tree, r.node])
                    forest.open[r.tree, child] = n > 1.5 and level + 1 < depth
        forest.open[:, : 2 ** (level + 1) - 1] = False
    return forest


def _splits(train: DataFrame, forest: Forest, level: int, features: int, history: int = 1) -> DataFrame:
    """The best split of each open node of a level (feature -1: none), with what lies on either side."""
    outputs = forest.outputs
    runs_given = "n" in train.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def given() -> Iterator[pa.RecordBatch]:
            bins, windows, keys, y, mask = (np.concatenate(p) for p in zip(*held, strict=True))
            held.clear()
            team = TaskContext.get().partitionId() // TEAM
            cells = Cells.runs(bins, windows, history)
            used, most = used_cells(cells.columns)
            parts = paired(mask, y)
            for tree in range(forest.trees):
                weight = bootstrap(keys, tree, forest.seed)
                use = np.flatnonzero(weight > 0)
                node = forest.nodes(tree, cells, use)
                is_open = forest.open[tree].take(node)
                use, node = use[is_open], node[is_open]
                if not len(use):
                    continue
                order = np.argsort(node.astype(np.min_scalar_type(forest.open.shape[1])), kind="stable")
                use = use[order]
                which, first = np.unique(node[order], return_index=True)
                chosen = forest.looked_at(tree, level, all_features, features)
                of = chosen % len(cells.columns)
                out = []
                for a, b in zip(first, [*first[1:], len(use)], strict=True):
                    total = 0
                    for at in range(a, b, PANEL):
                        some = use[at: min(b, at + PANEL)]
                        total += histogram(cells.features(chosen, some), parts.take(some, axis=0) * weight[some, None], (used[of], most[of]))
                    out.append(packed(total.reshape(-1, total.shape[-1])))
                yield pa.RecordBatch.from_arrays([pa.array([team] * len(which), pa.int32()), pa.array([tree] * len(which), pa.int32()),
                                                  pa.array(which, pa.int32()), pa.array(out, pa.binary())], ["team", "tree", "node", "h"])
        rows = 0
        for batch in batches:
            held.append(_held(batch, history))
            rows += len(held[-1][2])
            if rows >= ROWS:
                yield from given()
                rows = 0
        if rows:
            yield from given()

    def added(batches: Iterator[pa.RecordBatch], pairs: bool = False) -> tuple[tuple, np.ndarray]:
        total, key = np.zeros((min(features, all_features) * BINS, 1 + 2 * outputs)), None
        for batch in batches:
            key = key or tuple(batch.column(c)[0].as_py() for c in ("team", "tree", "node"))
            for h in batch.column("h").to_pylist():
                cells, parts = unpacked(h, outputs // 2 + 1 + outputs if pairs else total.shape[1])
                total[cells] += unpaired(parts, outputs) if pairs else parts
        return key, total

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = added(batches, pairs=True)
        yield pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([packed(total)], pa.binary())], ["team", "tree", "node", "h"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, tree, node), total = added(batches)
        h = total.reshape(-1, BINS, 1 + 2 * outputs)
        best = best_split(h, outputs)
        all_rows = h[0].sum(axis=0)
        if best is None:
            row = (tree, node, -1, 0, 0.0, all_rows.tobytes(), b"", b"", 0.0, 0.0)
        else:
            f, b, gain, left, right, n_left, n_right = best
            chosen = forest.looked_at(tree, level, all_features, features)
            row = (tree, node, int(chosen[f]), b, gain, all_rows.tobytes(), left.tobytes(), right.tobytes(), n_left, n_right)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], _CHOSEN_NAMES).cast(_CHOSEN)

    one = train.select(F.length("bins").alias("bytes"), F.col("n") if runs_given else F.lit(1).alias("n")).first()
    all_features = one.bytes // (one.n + history - 1) * history if one else 0
    schema = "team int, tree int, node int, h binary"
    teams = train.select(*["n"] * runs_given, "key", "bins", "y", "mask").mapInArrow(count, schema).groupBy("team", "tree", "node").applyInArrow(add, schema)
    return teams.groupBy("tree", "node").applyInArrow(
        choose, "tree int, node int, feature int, bin int, gain double, total binary, left binary, right binary, n_left double, n_right double")


_CHOSEN = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("total", pa.binary()),
                     ("left", pa.binary()), ("right", pa.binary()), ("n_left", pa.float64()), ("n_right", pa.float64())])
_CHOSEN_NAMES = _CHOSEN.names


def fit(windows: DataFrame, key: Column, y: Column, mask: Column, outputs: int, trees: int = 30, depth: int = 8,
        seed: int = 42) -> tuple[Forest, np.ndarray, int] | None:
    """(forest, bin borders, history) from windows with the matrix X, or `flattened` ones; borders come from the newest row of X. None without rows."""
    windows = _flat(windows)
    first = windows.select("newest", "cells").first()
    if first is None:
        return None
    width = len(first.newest)
    history = len(first.cells) // (width * np.dtype(_kind(windows)).itemsize)
    edges = bin_edges(windows, F.col("newest"), width)
    rows = windows.select(key.cast("long").alias("key"), y.cast("array<double>").alias("y"), mask.cast("array<double>").alias("mask"), "newest", "cells")
    return grow(store(binned(rows, edges, history)), outputs, trees, depth, seed), edges, history


def predicted(windows: DataFrame, forest: Forest, edges: np.ndarray, history: int) -> DataFrame:
    """The windows, flattened or not, with `predicted`, an array of all outputs, in place of X."""
    rows = binned(windows, edges, history)
    kept = [f for f in rows.schema.fields if f.name != "bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = forest.predict(_floats(batch.column("bins")))
            ends = pa.array(np.arange(len(p) + 1) * forest.outputs, pa.int32())
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], [*names, "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(run, schema + "predicted array<double>")


def fit_runs(ticks: DataFrame, columns: Sequence[str], history: int, outputs: int, trees: int = 30, depth: int = 8,
             seed: int = 42, scaler: Scaler | None = None) -> tuple[Forest, DataFrame]:
    """The forest of the train windows of `history_ticks` with `split`, `key`, `y` and `mask`, and the stored `runs` of all splits.

    It is the one that `fit` makes from the windows' matrices, which are never made: each tick is standardised by the `scaler`, binned,
    stored and read once.
    """
    newest = ticks.where("_kept AND split = 'train'").select(*columns)
    newest = scaler.transform(newest, columns).select(*[F.col(c).cast("float") for c in columns]) if scaler else newest
    edges = column_edges(newest, columns)
    kept = store(runs(ticks, columns, edges, history, scaler))
    return grow(kept.where("split = 'train'"), outputs, trees, depth, seed, history=history), kept


def predicted_runs(kept: DataFrame, forest: Forest, history: int) -> DataFrame:
    """(stay_id, tick, y, mask, predicted) of each window of stored runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, windows, _, y, mask = _held(batch, history)
            p = forest.predict(Cells.runs(bins, windows, history))
            ends = pa.array(np.arange(len(p) + 1) * forest.outputs, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("stay_id").take(pa.array(np.repeat(np.arange(len(windows)), windows))), pa.array(_bytes(batch.column("tick"), np.int64)),
                 *[pa.ListArray.from_arrays(ends, pa.array(m.ravel())) for m in (y, mask, p)]], ["stay_id", "tick", "y", "mask", "predicted"])

    stay = kept.schema["stay_id"].dataType.simpleString()
    return kept.select("stay_id", "n", "tick", "key", "y", "mask", "bins").mapInArrow(
        run, f"stay_id {stay}, tick long, y array<double>, mask array<double>, predicted array<double>")
