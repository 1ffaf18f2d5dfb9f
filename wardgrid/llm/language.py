"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads windows of bytes in both directions, labels every position with language probabilities, and a
document's probabilities are the means over all its positions. Training is backpropagation through time on a
bounded sample of labelled documents; prediction covers whole texts, in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.llm.bytesets import texts

HIDDEN, WINDOW, LANES = 8, 128, 2048
#: Bound of the training sample: documents of each language, and the characters taken of each from a seeded place.
SAMPLE_DOCS, SAMPLE_CHARS = 150, 600
STEPS, BATCH, SPAN, RATE = 160, 192, 48, 0.02
UNDETERMINED = "und"


class Gru:
    """One direction. Gate columns: update, reset, candidate; update and reset are sigmoids written as tanh of a half."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.x = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.c = np.zeros(HIDDEN, np.float32)     # bias inside the reset product

    def forward(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, lane, HIDDEN) over bytes (time, lane)."""
        steps, lanes = data.shape
        h = np.zeros((lanes, HIDDEN), np.float32)
        states, kept = np.empty((steps, lanes, HIDDEN), np.float32), []
        for t in range(steps):
            a = self.x.take(data[t], axis=0)
            v = h @ self.u
            gates = np.tanh(a[:, : 2 * HIDDEN] + v[:, : 2 * HIDDEN]) * np.float32(0.5) + np.float32(0.5)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            inner = v[:, 2 * HIDDEN:] + self.c
            n = np.tanh(a[:, 2 * HIDDEN:] + r * inner)
            if keep:
                kept.append((h, z, r, inner, n))
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def backward(self, data: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of x, u, c from those of the states."""
        dx, du, dc = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.c)
        carry = np.zeros_like(grad[0])
        for t in reversed(range(len(data))):
            h, z, r, inner, n = kept[t]
            d = grad[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * 2 * z * (1 - z)         # tanh of a half: the factor is 2 s (1 - s)
            dr = dn * inner * 2 * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            dv = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(dx, data[t], da)
            du += h.T @ dv
            dc += (dn * r).sum(axis=0)
            carry = d * z + dv @ self.u.T
        return [dx, du, dc]


class Tagger:
    """Both directions and the output layer over `labels`."""

    def __init__(self, labels: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.back = Gru(rng), Gru(rng)
        self.out = rng.normal(0, 0.3, (2 * HIDDEN, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(time, lane, label) over bytes (time, lane)."""
        ahead, _ = self.ahead.forward(data)
        back, _ = self.back.forward(data[::-1])
        e = np.exp(np.clip(ahead @ self.out[:HIDDEN] + back[::-1] @ self.out[HIDDEN:] + self.bias, -30, 30))
        return e / e.sum(axis=2, keepdims=True)

    def step(self, data: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy of all positions, each labelled as its document."""
        ahead, kept_a = self.ahead.forward(data, keep=True)
        back, kept_b = self.back.forward(data[::-1], keep=True)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        e = np.exp(np.clip(both @ self.out + self.bias, -30, 30))
        d = e / e.sum(axis=2, keepdims=True)
        d[:, np.arange(data.shape[1]), label] -= 1
        d = (d / (data.shape[0] * data.shape[1])).astype(np.float32)
        g = d @ self.out.T
        return (self.ahead.backward(data, kept_a, g[:, :, :HIDDEN]) + self.back.backward(data[::-1], kept_b, g[::-1, :, HIDDEN:])
                + [np.einsum("tbi,tbj->ij", both, d), d.sum(axis=(0, 1))])

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.x, self.ahead.u, self.ahead.c, self.back.x, self.back.u, self.back.c, self.out, self.bias]

    def fit(self, samples: list[tuple[bytes, int]], steps: int = STEPS, seed: int = 9) -> Tagger:
        """Adam over random windows; each language has the same share of a batch."""
        rng = np.random.default_rng(seed)
        by = [[np.frombuffer(b, np.uint8) for b, k in samples if k == label and b] for label in range(len(self.labels))]
        labels = np.array([k for k, docs in enumerate(by) if docs])
        first, second = [[np.zeros_like(w) for w in self.weights()] for _ in range(2)]
        for number in range(1, steps + 1):
            label = rng.choice(labels, BATCH)
            data = np.full((SPAN, BATCH), 32, np.uint8)
            for lane, k in enumerate(label):
                doc = by[k][rng.integers(len(by[k]))]
                at = rng.integers(max(1, len(doc) - SPAN + 1))
                part = doc[at: at + SPAN]
                data[: len(part), lane] = part
            rate = RATE * min(1, 2 * (1 - (number - 1) / steps))
            for w, g, m, v in zip(self.weights(), self.step(data, label), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9 ** number)) / (np.sqrt(v / (1 - 0.99 ** number)) + 1e-8)
        return self


def learned(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Tagger | None:
    """A tagger fitted on `sample_docs` documents of each language at most; None without a labelled text with letters.

    Only rows with a language whose crc32 of the id as text leaves another remainder than 2 modulo 4 are seen. The
    sample is the first by a seeded hash of the id, with `sample_chars` characters from a seeded place of each.
    """
    rows = (documents.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
            .select("lang", F.xxhash64("doc_id", F.lit(23)).alias("order"), "doc_id",
                    F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id), greatest(length(text) - {sample_chars}, 0) + 1) as int), {sample_chars})").alias("part")))
    first = Window.partitionBy("lang").orderBy("order", "doc_id", "part")
    sample = (rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_docs)
              .select("lang", "rank", "part").toPandas().sort_values(["lang", "rank", "part"]))
    if sample.empty:
        return None
    labels = sorted(sample.lang.unique())
    return Tagger(labels).fit([(t.encode(), labels.index(k)) for t, k in zip(sample.part, sample.lang, strict=True)])


def pooled(tagger: Tagger, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean probabilities (document, label) over all positions of each document."""
    lengths = np.diff(ends)
    counts = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), counts)
    start = np.repeat(ends[:-1], counts) + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    total = np.zeros((len(lengths), len(tagger.labels)))
    for lo in range(0, len(doc), LANES):
        places = np.arange(WINDOW)[:, None] + start[None, lo: lo + LANES]
        inside = places < ends[1:][doc[lo: lo + LANES]]
        data = np.where(inside, raw[np.minimum(places, len(raw) - 1)], 32).astype(np.uint8)
        p = tagger.probabilities(data)
        p *= inside[:, :, None]
        np.add.at(total, doc[lo: lo + LANES], p.sum(axis=0))
    return total / np.maximum(lengths, 1)[:, None]


def predict(documents: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: the likeliest language of the whole text and its mean probability.

    A null text or one without a letter is `und` with score 0, as are all texts when nothing could be learned.
    Ties go to the first language in order. held_out is false where doc_id is null. Repeated rows each have theirs.
    """
    rows = documents.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"),
                            F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if tagger is None:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [pooled(tagger, raw, ends) for _, raw, ends in texts(batch.column("text"))]
            p = np.concatenate(p) if p else np.zeros((0, len(tagger.labels)))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            names = np.where(letters, np.array(tagger.labels, object)[p.argmax(axis=1)], UNDETERMINED)
            score = np.where(letters, np.minimum(p.max(axis=1), 1.0), 0.0) if len(p) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
                                              pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return rows.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Predictions for all rows by a tagger learned from the rows that are not held out."""
    return predict(documents, learned(documents))
