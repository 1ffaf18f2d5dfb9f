"""Quality classifier by co-training of a content view and a metadata view.

The content view sees hashed byte trigrams of the whole text, the metadata view sees how the page is made: its length,
lines and words, shares of kinds of characters and of different words, language and source. Both start from a bounded sample of labelled rows. In each round
tasks score all documents without a label, and those of each class on which one view is surest become training rows of
the other; only their features reach the task that trains. Each view is then
calibrated on labelled rows that neither was trained on, and the calibrated log-odds are added up to score every document.
"""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.llm.bytesets import U64, mixed, texts
from wardgrid.llm.common import without
from wardgrid.session import store

GRAMS, NAMES, SHAPES = 2048, 64, 16
#: Bound of the labelled sample; rounds over all documents, and the most that one view gives the other in a round.
LABELLED = 2500
ROUNDS, MOVED = 5, 120
#: Odds (natural logarithms) beyond which a view is sure of a row.
SURE = 2.0
THRESHOLD = 0.5
ADDED = ("p_content", "p_metadata", "quality_score", "keep")

_KIND = np.zeros(256, np.int64)          # 0 other, 1 small letter, 2 capital, 3 digit, 4 blank, 5 line end, 6 mark, 7 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10] = 1, 2, 3, 4, 5
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 6
_KIND[128:] = 7
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"-"]] = True


def content_rows(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(document, GRAMS): square roots of the trigrams' shares, each row of length 1 (0 for texts of under three bytes)."""
    n = len(raw) - 2
    out = np.zeros((len(ends) - 1, GRAMS), np.float32)
    if n <= 0:
        return out
    x = raw.astype(np.uint64)
    gram = (mixed(x[:n] | x[1: n + 1] << U64(8) | x[2: n + 2] << U64(16)) % U64(GRAMS)).astype(np.int64)
    for k in range(len(ends) - 1):
        lo, hi = ends[k], ends[k + 1] - 2
        if hi > lo:
            out[k] = np.sqrt(np.bincount(gram[lo:hi], minlength=GRAMS) / (hi - lo))
    return out


def shape_rows(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(document, SHAPES): length, lines, shares of kinds of bytes and of different words; zeros for an empty text."""
    size = np.diff(ends)
    n = np.maximum(size, 1)
    kind = _KIND[raw]
    share = np.bincount(np.repeat(np.arange(len(size)) * 8, size) + kind, minlength=8 * len(size)).reshape(-1, 8) / n[:, None]

    def counted(flags: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[high] - total[low]
    blanks = share[:, 4] + share[:, 5]
    lines = 1 + counted(raw == 10, ends[:-1], ends[1:])
    odd = share[:, 6] - counted(_PLAIN[raw], ends[:-1], ends[1:]) / n
    blank = (kind == 4) | (kind == 5)
    starts = np.zeros(len(raw), bool)
    starts[1:] = ((kind[1:] < 4) | (kind[1:] == 7)) & blank[:-1]
    began = counted(starts, np.minimum(ends[:-1] + 1, ends[1:]), ends[1:]) / np.maximum(size - 1, 1)
    data, words, different = raw.tobytes(), np.zeros(len(size)), np.zeros(len(size))
    for k, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        split = data[lo:hi].split()
        words[k], different[k] = len(split), len(set(split))
    return (np.stack([
        np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 8, *np.sqrt(share[:, [0, 1, 2, 3, 6, 7]]).T, np.sqrt(blanks),
        np.sqrt(np.maximum(odd, 0)), np.log1p(1 / np.maximum(blanks, 1 / n)) / 4, np.sqrt(began), different / np.maximum(words, 1),
        np.log1p(words) / 8, np.ones(len(size))], axis=1) * (size > 0)[:, None]).astype(np.float32)


def metadata_rows(shapes: np.ndarray, lang: list, source: list) -> np.ndarray:
    """(document, SHAPES + NAMES): the shape of the text, and hashed language and source."""
    out = np.zeros((len(shapes), SHAPES + NAMES), np.float32)
    out[:, :SHAPES] = shapes
    for k in range(len(shapes)):
        for prefix, value in (("lang", lang[k]), ("source", source[k])):
            out[k, SHAPES + _name(prefix, value)] += 0.3
    return out


@lru_cache(100_000)
def _name(prefix: str, value: str | None) -> int:
    return zlib.crc32(f"{prefix}={value}".encode()) % NAMES


class Logistic:
    """Logistic regression by full-batch Adam with weight decay; classes weigh the same."""

    def __init__(self, size: int, hidden: int = 0, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.inner = rng.normal(0, 0.5, (size, hidden)).astype(np.float32) if hidden else None
        self.w = np.zeros(hidden or size, np.float32) if not hidden else rng.normal(0, 0.3, hidden).astype(np.float32)
        self.b = np.zeros(1, np.float32)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(x @ self.inner) if self.inner is not None else x) @ self.w + self.b[0]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> Logistic:
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
        params = [p for p in (self.inner, self.w, self.b) if p is not None]
        first, second = [[np.zeros_like(p) for p in params] for _ in range(2)]
        for number in range(1, steps + 1):
            hidden = np.tanh(x @ self.inner) if self.inner is not None else x
            d = (1 / (1 + np.exp(-np.clip(hidden @ self.w + self.b[0], -30, 30))) - y) * weight
            grads = [hidden.T @ d + decay * self.w, np.array([d.sum()])]
            if self.inner is not None:
                grads.insert(0, x.T @ (np.outer(d, self.w) * (1 - hidden * hidden)) + decay * self.inner)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** number)) / (np.sqrt(v / (1 - 0.99 ** number)) + 1e-8)
        return self


def calibrated(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and intercept, with his smoothed targets; Newton's method, a step halved until it improves."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    spread = max(1.0, float(np.abs(odds).max()))
    x = np.stack([odds / spread, np.ones_like(odds)], axis=1).astype(np.float64)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-3 * (w @ w))

    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (p - target) + 2e-3 * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * move
    return float(w[0] / spread), float(w[1])


class CoTrained:
    """Two calibrated views and the log-odds of the classes."""

    def __init__(self, content: Logistic, metadata: Logistic, scale: list[tuple[float, float]], prior: float) -> None:
        self.views, self.scale, self.prior = (content, metadata), scale, prior

    def scores(self, rows: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by content, by metadata, and by both, given the class independent views."""
        odds = [a * view.odds(x).astype(np.float64) + b for view, x, (a, b) in zip(self.views, rows, self.scale, strict=True)]
        both = odds[0] + odds[1] - self.prior
        return tuple(1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (*odds, both))


def trained(rows: tuple[np.ndarray, np.ndarray], y: np.ndarray, given: list[tuple[np.ndarray, np.ndarray]]) -> CoTrained:
    """Views trained on labelled rows and on what each was `given` by the other; every fourth labelled row is kept for calibration."""
    held = np.arange(len(y)) % 4 == 3
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held = np.zeros(len(y), bool)
    sets = [(np.concatenate([x[~held], more]), np.concatenate([y[~held], mark]).astype(np.float32))
            for x, (more, mark) in zip(rows, given, strict=True)]
    share = float(np.clip(y.mean(), 0.02, 0.98))
    views = [Logistic(GRAMS).fit(*sets[0]), Logistic(SHAPES + NAMES, hidden=12).fit(*sets[1], steps=400, rate=0.03)]
    fair = held if held.any() else np.ones(len(y), bool)
    scale = [calibrated(view.odds(x[fair]).astype(np.float64), y[fair]) for view, x in zip(views, rows, strict=True)]
    return CoTrained(*views, scale, float(np.log(share / (1 - share))))


def _given_back() -> None:
    """Hands freed memory back to the system, so that workers between tasks do not hold what earlier ones needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def _rows(text: pa.Array, lang: list, source: list) -> tuple[np.ndarray, np.ndarray]:
    content, metadata = [], []
    for row, raw, ends in texts(text):
        content.append(content_rows(raw, ends))
        metadata.append(metadata_rows(shape_rows(raw, ends), lang[row: row + len(ends) - 1], source[row: row + len(ends) - 1]))
    return np.concatenate(content), np.concatenate(metadata)


def sampled_rows(sample: DataFrame) -> DataFrame:
    """(doc_id, y, pupil, content, metadata): features of both views of a bounded sample with doc_id, y, pupil, text, lang, source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                content, metadata = _rows(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("pupil"), pa.array([r.astype(np.float16).tobytes() for r in content], pa.binary()),
                                                  pa.array([r.tobytes() for r in metadata], pa.binary())], ["doc_id", "y", "pupil", "content", "metadata"])
    return sample.select("doc_id", "y", "pupil", "text", "lang", "source").mapInArrow(
        run, "doc_id long, y int, pupil int, content binary, metadata binary")


def fitted(rows: pa.Table) -> pa.Table:
    """One row with the views trained on rows with a label (pupil -1) and rows for one view (pupil 0 or 1), as bytes.

    None if the labels are of one class.
    """
    rows = rows.sort_by([("doc_id", "ascending"), ("content", "ascending")])
    y, pupil = rows.column("y").to_numpy(), rows.column("pupil").to_numpy()
    if len({*y[pupil < 0]}) < 2:
        return pa.table({"model": pa.array([], pa.binary())})

    def view(part: np.ndarray, name: str, kind: type, width: int) -> np.ndarray:
        column = rows.column(name).take(pa.array(np.flatnonzero(part)))
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.float32)
    kinds = (("content", np.float16, GRAMS), ("metadata", np.float32, SHAPES + NAMES))
    mine = tuple(view(pupil < 0, *kind) for kind in kinds)
    given = [(view(pupil == k, *kind), (y[pupil == k] > 0).astype(np.int64)) for k, kind in enumerate(kinds)]
    return pa.table({"model": pa.array([pickle.dumps(trained(mine, (y[pupil < 0] > 0).astype(np.int64), given))], pa.binary())})


_KEY = ("doc_id", "key")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, and a hash of the last three, which tells rows of one id apart."""
    return docs.select("doc_id", F.xxhash64("text", "lang", "source").alias("key"), "text", "lang", "source")


def shapes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lang, source, shape): the text's shape of every document, 64 bytes a row, which no round changes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shape_rows(raw, ends) for _, raw, ends in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*_KEY, "lang", "source")],
                                              pa.array([r.tobytes() for part in rows for r in part], pa.binary())], [*_KEY, "lang", "source", "shape"])
            _given_back()
    return keyed(docs).mapInArrow(run, "doc_id long, key long, lang string, source string, shape binary")


def view_odds(docs: DataFrame, shapes: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, o0, o1): the odds that each view gives every document, to four decimals; `shapes` is stored."""
    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for _, raw, ends in texts(batch.column("text")):
                odds = model.views[0].odds(content_rows(raw, ends)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(row, len(odds)) for c in _KEY], pa.array(np.round(odds, 4))], [*_KEY, "o0"])
                row += len(odds)
            _given_back()

    def metadata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shape = np.frombuffer(b"".join(batch.column("shape").to_pylist()), np.float32).reshape(-1, SHAPES)
                odds = model.views[1].odds(metadata_rows(shape, batch.column("lang").to_pylist(), batch.column("source").to_pylist())).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _KEY], pa.array(np.round(odds, 4))], [*_KEY, "o1"])
    # rows of one key are copies, so one of each is enough for the search
    a = keyed(docs).select(*_KEY, "text").mapInArrow(content, "doc_id long, key long, o0 double").dropDuplicates(list(_KEY))
    b = shapes.mapInArrow(metadata, "doc_id long, key long, o1 double").dropDuplicates(list(_KEY))
    return a.join(b, list(_KEY)).select("doc_id", "o0", "o1")


def surest(odds: DataFrame, share: float, moved: int) -> DataFrame:
    """(doc_id, y, pupil): of each class the documents that a view is surest of, for the other view; top-n over all rows.

    Of documents with the same odds by both views, as copies have, one is taken.
    """
    one = odds.groupBy("o0", "o1").agg(F.min("doc_id").alias("doc_id"))
    most = {0: round(moved * (1 - share)), 1: round(moved * share)}
    sides = [F.struct(F.lit(1 - teacher).alias("pupil"), F.lit(y).alias("y"), (F.col(f"o{teacher}") * (1 if y else -1)).alias("sure"))
             for teacher in (0, 1) for y in (0, 1)]
    rows = one.select("doc_id", F.explode(F.array(*sides)).alias("s")).select("doc_id", "s.*").where(F.col("sure") > SURE)
    order = Window.partitionBy("pupil", "y").orderBy(F.desc("sure"), "doc_id")
    # each task keeps its first rows of the four sides only
    ranked = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(*most.values(), 1))
    return ranked.where(F.col("place") <= F.when(F.col("y") == 0, most[0]).otherwise(most[1])).select("doc_id", "y", "pupil")


def plain(documents: DataFrame) -> DataFrame:
    """doc_id, text, lang, source; a missing lang or source column is null."""
    has = {c.lower() for c in documents.columns}
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                            *[(F.col(c) if c in has else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")])


def learned(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, moved: int = MOVED) -> CoTrained | None:
    """Views trained on `labelled` labelled documents at most, the first by a seeded hash of the id, and in each of `rounds`
    on `moved` documents at most that the other view is surest of, searched among all documents without a label.

    A document with several labels takes the lower one. None if the sample holds but one class.
    """
    spark = documents.sparkSession
    marks = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").cast("int").alias("y")))
    docs = plain(documents.where("doc_id is not null"))
    order = F.xxhash64("doc_id", F.lit(77))
    known = docs.select("doc_id").distinct().join(marks, "doc_id").orderBy(order, "doc_id").limit(labelled).withColumn("pupil", F.lit(-1))
    # bounded by limits: one task trains on the features of the chosen rows, and only weights reach the driver
    rows = store(sampled_rows(docs.join(F.broadcast(known), "doc_id")))
    taken, shapes = spark.createDataFrame([], "doc_id long"), None
    for number in range(rounds + 1):
        first = rows.groupBy().applyInArrow(fitted, "model binary").first()
        model = pickle.loads(first[0]) if first else None
        if model is None or number == rounds:
            return model
        shapes = store(shapes_of(docs)) if shapes is None else shapes
        odds = store(view_odds(docs, shapes, model))
        free = odds.join(marks, "doc_id", "left_anti").join(F.broadcast(taken), "doc_id", "left_anti")
        chosen = store(surest(free, 1 / (1 + float(np.exp(-model.prior))), moved))
        if chosen.isEmpty():
            return model
        taken = taken.union(chosen.select("doc_id"))
        rows = rows.union(store(sampled_rows(docs.join(F.broadcast(chosen), "doc_id"))))


def scored(documents: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents with p_content, p_metadata, quality_score (0 to 1) and keep (quality_score >= threshold).

    A null text is scored as an empty one: by its language and source alone. Without a model (no labels, or of one class)
    nothing is rejected and all scores are 1. Null lang and source are values of their own. Repeated rows each have
    their scores. An input column named like an output is replaced.
    """
    docs = without(documents, *ADDED)
    if model is None:
        return docs.select("*", *[F.lit(1.0).alias(c) for c in ADDED[:3]], F.lit(True).alias("keep"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c for c in plain(docs).columns if c != "doc_id" and c in docs.columns])
    for c in ("lang", "source"):
        rows = rows.withColumn(c, F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros((3, 0))]
            lang, source, text = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")
            for lo in range(0, batch.num_rows, 1000):
                parts.append(np.stack(model.scores(_rows(text.slice(lo, 1000), lang[lo: lo + 1000], source[lo: lo + 1000]))))
            p = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(x, pa.float64()) for x in p]], ["row", *ADDED[:3]])
            _given_back()
    schema = f"row {rows.schema['row'].dataType.simpleString()}, p_content double, p_metadata double, quality_score double"
    return (rows.mapInArrow(run, schema).select("row.*", *ADDED[:3], (F.col("quality_score") >= threshold).alias("keep")))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents with their quality scores, by views learned from `labels` (doc_id, quality)."""
    return scored(documents, learned(documents, labels))


def good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    return classify(documents, labels).where("keep").select(*[f"`{c}`" for c in without(documents, *ADDED).columns])
