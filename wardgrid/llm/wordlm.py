"""Scores of whole documents by a gated recurrent language model over words, with class-factored output.

Word counts cover all training documents. The most frequent words (the head) are cut by rank into classes of equal size;
all other words fall into classes by their shape. The network gives the probability of the next word's class and, for a
head word, of the word within its class; a word of the tail has its share of the counts of its class, one more than
counted, and every class of the tail keeps one more for words never seen. So all words' probabilities sum to one.

Training is truncated backpropagation through time in numpy: each task trains a copy on its documents window by window,
carrying the state from one window to the next, and the copies' weights are averaged over tasks by their tokens, round by
round. Every round reads all tokens of every training document. Scoring reads whole texts and carries the state through
all of their windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgrid.llm.bytesets import texts
from wardgrid.session import store

#: Words of the head, words of one class of it, and words whose counts every task holds; other counts are joined.
HEAD, CLASS_WORDS, KNOWN = 4096, 64, 100_000
HIDDEN, EMBED = 16, 16
#: Training: tokens of a window, documents side by side, and rounds over all tokens.
WINDOW, LANES, ROUNDS = 32, 64, 2
RATES = (0.01, 0.004)
#: Scoring: documents of about so many bytes side by side.
SCORE_BYTES = 16 << 20
#: In training, classes of so many words of a window at most are computed together.
FEW = 48
#: Positions whose outputs are computed at once.
CHUNK = 1 << 13
#: Documents that are scored side by side, and weights that are updated at once.
ABREAST, NEAR = 512, 1 << 14
#: Distinct words that a task counts before it sends them on.
COUNTED = 200_000
SHAPES = 24
END = b""
#: Floats of the weights that are averaged as one row, and tasks that are averaged together first.
PART, FAN_IN = 1 << 16, 64


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def training(documents: DataFrame) -> DataFrame:
    """The documents that are learned from; those without an id are not."""
    return documents.where(F.col("doc_id").isNotNull() & ~held_out())


def shape(word: bytes) -> int:
    """Class of a word outside the head: how it ends, whether it has bytes beyond ASCII, and its length."""
    last = word[-1:]
    end = 1 if last == b"," else 2 if last == b"." else 0 if last >= b"\x80" or last.isalnum() or not last else 3
    return end * 6 + (not word.isascii()) * 3 + (len(word) > 4) + (len(word) > 8)


def words(raw: np.ndarray, ends: np.ndarray) -> Iterator[list[bytes]]:
    """Each text's words, A-Z in lower case, and the end."""
    data = raw.tobytes().lower()      # of bytes: A-Z only; split() without arguments cuts at the same bytes as the contract
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield [*data[a:b].split(), END]


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, shape, c) over the given documents, counted in tasks before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = list(held)
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array([shape(w) for w in out], pa.int32()),
                                               pa.array(list(held.values()), pa.int64())], ["word", "shape", "c"])
        for batch in batches:
            for _, raw, ends in texts(batch.column(0)):
                for doc in words(raw, ends):
                    held.update(doc)
                if len(held) > COUNTED:
                    yield given()
                    held.clear()
        yield given()

    return documents.select("text").mapInArrow(run, "word binary, shape int, c long").groupBy("word", "shape").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks know of the counts: the most frequent words, and totals of the tail's classes."""

    known: list[bytes]          # by falling count
    counts: np.ndarray
    shapes: np.ndarray
    tail: np.ndarray            # (SHAPES,) tokens and distinct words of each tail class and one
    tokens: int
    distinct: int
    least: int                  # count from which on a word is known

    @classmethod
    def of(cls, counts: DataFrame, head: int, known: int) -> Vocabulary:
        """From stored counts: at most `known` words, those from a count on, and one row for each shape reach the driver.

        The count is found from words per bin of counts, 64 bins an octave, so that no task sends words that are not taken.
        """
        size = F.floor(F.log2("c") * 64).cast("int")
        bins = counts.groupBy(size.alias("bin")).agg(F.count("*").alias("v"), F.min("c").alias("least")).orderBy(F.desc("bin")).collect()
        least, held = 2 ** 63 - 1, 0
        for r in bins:
            held += r.v
            if held > known:
                break
            least = r.least
        top = sorted(counts.where(F.col("c") >= least).collect(), key=lambda r: (-r.c, bytes(r.word)))
        by = {r["shape"]: r for r in counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
        c, s = np.array([r.c for r in top], np.int64), np.array([r["shape"] for r in top], np.int64)
        tail = np.array([(by[k].c + by[k].v if k in by else 0) + 1 for k in range(SHAPES)], np.int64)
        np.subtract.at(tail, s[:head], c[:head] + 1)
        return cls([bytes(r.word) for r in top], c, s, tail, sum(r.c for r in by.values()), sum(r.v for r in by.values()), least)


class Words:
    """Ids for texts: words of the head by rank, others as the head's size and their shape."""

    def __init__(self, vocabulary: Vocabulary, head: int) -> None:
        self.rank = {w: i for i, w in enumerate(vocabulary.known)}
        self.head = min(head, len(vocabulary.known))
        self.ids = np.where(np.arange(len(vocabulary.counts)) < self.head, np.arange(len(vocabulary.counts)), self.head + vocabulary.shapes)
        self.start = int(self.ids[self.rank[END]]) if END in self.rank else self.head + shape(END)

    def ranks(self, doc: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rank.get, doc, repeat(-1)), np.int64, len(doc))

    def of(self, doc: list[bytes], ranks: np.ndarray) -> np.ndarray:
        ids = self.ids[ranks] if len(self.ids) else np.zeros(len(ranks), np.int64)
        for i in np.flatnonzero(ranks < 0).tolist():
            ids[i] = self.head + shape(doc[i])
        return ids


class Network:
    """One layer of gated recurrent units; gates in the order update, reset, candidate.

    States are computed with lanes as the last axis, so that each gate of a time lies in one piece.
    """

    NAMES = ("embed", "x", "u", "bias", "inner", "classes", "class_bias", "out", "out_bias")

    def __init__(self, vocabulary: Vocabulary, head: int, class_words: int, seed: int = 3) -> None:
        """Random weights; the output's biases start at the logarithms of the counts."""
        rng = np.random.default_rng(seed)
        self.head, self.size = min(head, len(vocabulary.known)), class_words
        self.groups = -(-self.head // class_words)
        total = self.groups + SHAPES
        padded = np.zeros(self.groups * class_words)
        padded[: self.head] = vocabulary.counts[: self.head] + 1
        mass = np.concatenate([padded.reshape(-1, class_words).sum(axis=1), vocabulary.tail])
        with np.errstate(divide="ignore"):
            out_bias = np.maximum(np.log(padded), -60)

        def normal(*dims: int) -> np.ndarray:
            return rng.normal(0, dims[0] ** -0.5, dims).astype(np.float32)
        self.embed = rng.normal(0, 0.3, (self.head + SHAPES, EMBED)).astype(np.float32)
        self.x, self.u = normal(EMBED, 3 * HIDDEN), normal(HIDDEN, 3 * HIDDEN)
        self.bias, self.inner = np.zeros(3 * HIDDEN, np.float32), np.zeros(HIDDEN, np.float32)
        self.classes, self.class_bias = normal(HIDDEN, total) * np.float32(0.1), np.log(mass / mass.sum()).astype(np.float32)
        self.out, self.out_bias = rng.normal(0, 0.02, (len(padded), HIDDEN)).astype(np.float32), out_bias.astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def together(self) -> np.ndarray:
        """All weights in one array, of which they are parts from now on."""
        flat, at = self.flat(), 0
        for name in self.NAMES:
            w = getattr(self, name)
            setattr(self, name, flat[at: at + w.size].reshape(w.shape))
            at += w.size
        return flat

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for w in self.weights():
            w[...] = flat[at: at + w.size].reshape(w.shape)
            at += w.size

    def _gates(self) -> np.ndarray:
        """Weights (4 * HIDDEN, HIDDEN + EMBED + 1) from state, input and one to halved update, halved reset, the candidate's state and input part."""
        k = HIDDEN
        w = np.zeros((4 * k, k + EMBED + 1), np.float32)
        w[: 3 * k, : k], w[2 * k: 3 * k, -1] = self.u.T, self.inner
        for at, part in ((0, slice(0, 2 * k)), (3 * k, slice(2 * k, 3 * k))):
            size = part.stop - part.start
            w[at: at + size, k: -1], w[at: at + size, -1] = self.x[:, part].T, self.bias[part]
        w[: 2 * k] *= np.float32(0.5)
        return w

    def steps(self, ids: np.ndarray, alive: np.ndarray, h: np.ndarray, kept: list | None = None) -> tuple[np.ndarray | None, np.ndarray]:
        """States (time, lane, HIDDEN) after input ids (time, lane) from h, and the last ones; lanes beyond `alive` of a time stand still.

        With `kept`, puts states and inputs, gates and candidates of all times there instead of giving states.
        """
        k, (times, lanes), weights = HIDDEN, ids.shape, self._gates()
        slots = times if kept is not None else 1
        x = np.empty((slots + (kept is not None), k + EMBED + 1, lanes), np.float32)
        x[0, :k], x[:, -1] = h.T, 1
        gates, c = np.zeros((slots, 4 * k, lanes), np.float32), np.zeros((slots, k, lanes), np.float32)
        if kept is not None:
            x[:-1, k: -1] = self.embed[ids].transpose(0, 2, 1)
            kept += [x, gates, c]
        states = np.zeros((times, lanes, k), np.float32) if kept is None else None
        half, one = np.float32(0.5), np.float32(1)
        for t, n in enumerate(alive.tolist()):
            now, after = (t, t + 1) if kept is not None else (0, 0)
            if kept is not None and n < lanes:
                x[after, :k, n:] = x[now, :k, n:]
            if not n:
                if kept is None:
                    break
                continue
            if kept is None:
                x[0, k: -1, :n] = self.embed.take(ids[t, :n], axis=0).T
            g, mine, new = gates[now, :, :n], c[now, :, :n], x[after, :k, :n]
            np.matmul(weights, x[now, :, :n], out=g)
            both = g[: 2 * k]
            np.tanh(both, out=both)
            both += one
            both *= half
            np.multiply(g[k: 2 * k], g[2 * k: 3 * k], out=mine)
            mine += g[3 * k:]
            np.tanh(mine, out=mine)
            np.subtract(x[now, :k, :n], mine, out=new)
            new *= g[:k]
            new += mine
            if states is not None:
                states[t, :n] = new.T
        return states, x[-1, :k].T.copy()

    def log_probabilities(self, h: np.ndarray, target: np.ndarray, grads: list | None = None) -> np.ndarray:
        """Natural logarithms of P(target's class) P(target in its class) after states h; a tail word counts by its class alone.

        With `grads`, puts the gradients of the mean loss by h and the output's weights there.
        """
        n = len(target)
        if n > CHUNK and grads is None:
            return np.concatenate([self.log_probabilities(h[i: i + CHUNK], target[i: i + CHUNK]) for i in range(0, n, CHUNK)])
        group = np.where(target < self.head, target // self.size, self.groups + target - self.head)
        # by class from here on, so that the rows of one lie side by side
        order = np.argsort(_short(group, self.groups + SHAPES), kind="stable")
        h, target, group = h[order], target[order], group[order]
        safe = self._bound() < 80
        out, e, total = _chosen(h @ self.classes, self.class_bias, group, safe)
        if grads is not None:
            d = _by_logits(e, total, group, n)
            d_h, d_out, d_out_bias = d @ self.classes.T, np.zeros_like(self.out), np.zeros_like(self.out_bias)
            d_classes, d_class_bias = h.T @ d, np.ones(n, np.float32) @ d
        ends = np.searchsorted(group, np.arange(self.groups + 1))
        sizes = np.diff(ends)
        if grads is not None:
            most = FEW
            while most:                 # classes of like numbers of rows together, as each is filled up to the longest
                least = most // 2 if most > 6 else 0
                few = np.flatnonzero((sizes > least) & (sizes <= most))
                if len(few):
                    self._few(h, target, ends[few], sizes[few], few, safe, out, d_h, d_out, d_out_bias)
                    sizes[few] = 0
                most = least
        for k in np.flatnonzero(sizes).tolist():
            rows, at = slice(ends[k], ends[k + 1]), slice(k * self.size, (k + 1) * self.size)
            mine, word = h[rows], target[rows] - k * self.size
            chosen, e, total = _chosen(mine @ self.out[at].T, self.out_bias[at], word, safe)
            out[rows] += chosen
            if grads is not None:
                d = _by_logits(e, total, word, n)
                d_h[rows] += d @ self.out[at]
                d_out[at] = d.T @ mine
                d_out_bias[at] = np.ones(len(d), np.float32) @ d
        given = np.empty_like(out)
        given[order] = out
        if grads is not None:
            by_h = np.empty_like(d_h)
            by_h[order] = d_h
            grads += [by_h, d_classes, d_class_bias, d_out, d_out_bias]
        return given

    def _few(self, h: np.ndarray, target: np.ndarray, first: np.ndarray, sizes: np.ndarray, few: np.ndarray, safe: bool,
             out: np.ndarray, d_h: np.ndarray, d_out: np.ndarray, d_out_bias: np.ndarray) -> None:
        """Adds the words' part of the classes `few`, each of few rows, to the results: all classes at once, filled up to the longest."""
        place = np.arange(sizes.max())
        there = place < sizes[:, None]
        rows = np.where(there, first[:, None] + place, first[:, None])
        mine, word = h[rows], target[rows] - few[:, None] * self.size
        weights = self.out.reshape(self.groups, self.size, HIDDEN)[few]
        logits = mine @ weights.transpose(0, 2, 1)
        logits += self.out_bias.reshape(self.groups, 1, self.size)[few]
        if not safe:
            logits -= logits.max(axis=2, keepdims=True)
        which = (np.arange(len(few))[:, None], place, word)
        chosen = logits[which]
        np.exp(logits, out=logits)
        total = logits @ np.ones(self.size, logits.dtype)
        real = rows[there]
        out[real] += (chosen - np.log(total))[there]
        share = there / np.float32(len(target))
        logits *= (share / total).astype(np.float32)[..., None]
        logits[which] -= share.astype(np.float32)
        d_h[real] += (logits @ weights)[there]
        d_out.reshape(self.groups, self.size, HIDDEN)[few] = logits.transpose(0, 2, 1) @ mine
        d_out_bias.reshape(self.groups, self.size)[few] = (np.ones((1, len(place)), np.float32) @ logits)[:, 0]

    def _bound(self) -> float:
        """No logit is larger than this, as no state is larger than 1."""
        one = np.ones(HIDDEN, np.float32)
        return max(float((one @ np.abs(self.classes) + self.class_bias).max()), float((np.abs(self.out) @ one + self.out_bias).max(initial=-np.inf)))

    def gradients(self, ids: np.ndarray, target: np.ndarray, alive: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
        """Gradients of the window's mean loss, the states to carry on (not differentiated through), and the loss."""
        kept: list = []
        _, last = self.steps(ids, alive, h, kept)
        x, gates, c = kept
        k, (times, lanes) = HIDDEN, ids.shape
        valid = np.arange(lanes) < alive[:, None]
        states = x[1:, :k].transpose(0, 2, 1)[valid]
        out: list = []
        loss = -float(self.log_probabilities(states, target[valid], out).mean())
        grad = np.zeros((times, lanes, k), np.float32)
        grad[valid] = out[0]
        grad = np.ascontiguousarray(grad.transpose(0, 2, 1))
        # what a state's gradient is multiplied by for each gate, for all times; only what hangs on the later times is left to the loop
        z, r, inner = gates[:, :k], gates[:, k: 2 * k], gates[:, 2 * k: 3 * k]
        by = np.empty((times, 4, k, lanes), np.float32)
        stay = 1 - z
        np.multiply(c, c, out=by[:, 3])
        np.subtract(np.float32(1), by[:, 3], out=by[:, 3])
        by[:, 3] *= stay
        np.multiply(by[:, 3], r, out=by[:, 2])
        np.multiply(by[:, 2], inner, out=by[:, 1])
        by[:, 1] *= 1 - r
        np.subtract(x[:-1, :k], c, out=by[:, 0])
        by[:, 0] *= z
        by[:, 0] *= stay
        flat, carry = by.reshape(times, 4 * k, lanes), np.zeros((k, lanes), np.float32)
        for t in range(times - 1, -1, -1):
            d = grad[t]
            d += carry
            by[t] *= d
            np.matmul(self.u, flat[t, : 3 * k], out=carry)
            d *= z[t]
            carry += d
        by_weights = (flat @ x[:-1].transpose(0, 2, 1)).sum(axis=0)
        by_inputs = np.concatenate([by_weights[: 2 * k], by_weights[3 * k:]])
        back = np.zeros((4 * k, EMBED), np.float32)
        back[: 2 * k], back[3 * k:] = self.x[:, : 2 * k].T, self.x[:, 2 * k:].T
        d_seen, seen, d_embed = (flat.transpose(0, 2, 1) @ back)[valid], ids[valid], np.zeros_like(self.embed)
        order = np.argsort(_short(seen, len(self.embed)), kind="stable")
        seen = seen[order]
        first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
        d_embed[seen[first]] = np.add.reduceat(d_seen[order], first, axis=0)
        return [d_embed, by_inputs[:, k: -1].T, by_weights[: 3 * k, :k].T, by_inputs[:, -1], by_weights[2 * k: 3 * k, -1], *out[1:]], last, loss


def _short(numbers: np.ndarray, below: int) -> np.ndarray:
    """The same numbers in two bytes if they fit, which are sorted faster."""
    return numbers.astype(np.uint16) if below <= 1 << 16 else numbers


def _by_logits(e: np.ndarray, total: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Gradients of the mean loss over `n` rows by the logits of rows with undivided shares `e`, which are overwritten."""
    e *= (np.float32(1 / n) / total)[:, None]
    e[np.arange(len(which)), which] -= np.float32(1 / n)
    return e


def _chosen(logits: np.ndarray, bias: np.ndarray, which: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logarithm of the chosen share of each row, all shares before they are divided, and their sums; overwrites `logits`.

    Only where a logit could overflow, the largest of a row is taken off first.
    """
    logits += bias
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    out = logits[np.arange(len(which)), which]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    out -= np.log(total)
    return out, logits, total


class Trainer:
    """Adam over windows of documents side by side."""

    def __init__(self, network: Network, start: int, rate: float) -> None:
        self.network, self.start, self.rate, self.number, self.tokens = network, start, rate, 0, 0
        self.flat = network.together()
        self.first, self.second, self.whole = (np.zeros_like(self.flat) for _ in range(3))
        self.room = np.empty(NEAR, np.float32)

    def fit(self, docs: list[np.ndarray]) -> None:
        """Documents of like length side by side; the state is carried from window to window of a document."""
        docs = sorted(docs, key=len, reverse=True)
        groups = [docs[i: i + LANES] for i in range(0, len(docs), LANES)]
        for g in np.random.default_rng(len(docs)).permutation(len(groups)).tolist():
            self._group(groups[g])

    def _group(self, docs: list[np.ndarray]) -> None:
        lengths = np.array([len(d) for d in docs])
        h, last = np.zeros((len(docs), HIDDEN), np.float32), np.full(len(docs), self.start)
        for at in range(0, int(lengths[0]), WINDOW):
            lanes = int(np.searchsorted(-lengths, -at, "left"))
            ids, target, alive = window(docs[:lanes], lengths[:lanes], at, WINDOW, last)
            grads, h, _ = self.network.gradients(ids, target, alive, h[:lanes])
            last = target[-1]
            self.number += 1
            self.tokens += int(alive.sum())
            whole = np.concatenate([x.ravel() for x in grads], out=self.whole)
            scale = np.float32(0.1 / max(1.0, np.sqrt(float(whole @ whole))))
            rate = np.float32(self.rate * np.sqrt(1 - 0.99 ** self.number) / (1 - 0.9 ** self.number))
            for i in range(0, len(whole), NEAR):         # piece by piece, so that each stays in the cache
                g, m, v, w = (x[i: i + NEAR] for x in (whole, self.first, self.second, self.flat))
                room = self.room[: len(g)]
                g *= scale               # a tenth, whose square is the hundredth that the second moment takes
                m *= np.float32(0.9)
                m += g
                g *= g
                v *= np.float32(0.99)
                v += g
                np.sqrt(v, out=room)
                room += np.float32(1e-6)
                np.divide(m, room, out=room)
                room *= rate
                w -= room


def window(docs: list[np.ndarray], lengths: np.ndarray, at: int, size: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets (time, lane) from position `at` of documents by falling length, and how many lanes each time has."""
    target = np.zeros((min(size, int(lengths[0]) - at), len(docs)), np.int64)
    for lane, doc in enumerate(docs):
        part = doc[at: at + size]
        if not len(part):
            break
        target[: len(part), lane] = part
    ids = np.concatenate([last[None, : len(docs)], target[:-1]])
    alive = np.searchsorted(-lengths, -(at + np.arange(len(target))), "left")
    return ids, target, alive


def encoded(documents: DataFrame, vocabulary: Vocabulary, head: int) -> DataFrame:
    """(ids) of all words of each document and its end. Stored once for all rounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Words(vocabulary, head)
        for batch in batches:
            for _, raw, ends in texts(batch.column("text")):
                out = [to.of(doc, to.ranks(doc)).astype(np.int32) for doc in words(raw, ends)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in out])])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(out)))], ["ids"])

    return store(documents.select("text").mapInArrow(run, "ids array<int>"))


def trained(parts: DataFrame, network: Network, start: int, rate: float) -> Network:
    """One round: each task trains a copy on its documents; the weights' means over tasks, by tokens, come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy
        mine = Trainer(copy.deepcopy(network), start, rate)
        for batch in batches:
            column = batch.column(0)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy().astype(np.int64)
            mine.fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        if mine.tokens:
            flat = mine.network.flat() * np.float32(mine.tokens)
            yield _rows([(TaskContext.get().partitionId() // FAN_IN, p, mine.tokens, flat[p * PART: (p + 1) * PART]) for p in range(-(-len(flat) // PART))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens, key = 0.0, 0, None
        for batch in batches:
            key = key or (batch.column("team")[0].as_py(), batch.column("part")[0].as_py())
            tokens += sum(batch.column("tokens").to_pylist())
            for w in batch.column("w").to_pylist():
                total = total + np.frombuffer(w, np.float32)
        yield _rows([(*key, tokens, total)])

    schema = "team long, part int, tokens long, w binary"
    teams = parts.mapInArrow(run, schema).groupBy("team", "part").applyInArrow(add, schema)
    rows = teams.withColumn("team", F.lit(0).cast("long")).groupBy("team", "part").applyInArrow(add, schema).collect()
    if rows:
        rows.sort(key=lambda r: r.part)
        network.load(np.concatenate([np.frombuffer(r.w, np.float32) / r.tokens for r in rows]))
    return network


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    team, part, tokens, w = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(team, pa.int64()), pa.array(part, pa.int32()), pa.array(tokens, pa.int64()),
                                       pa.array([np.asarray(x, np.float32).tobytes() for x in w], pa.binary())], ["team", "part", "tokens", "w"])


def document_scores(network: Network, start: int, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihoods of documents' ids; the state is carried through all windows of each."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    out = np.empty(len(docs))
    for i in range(0, len(docs), ABREAST):
        some = order[i: i + ABREAST]
        out[some] = _scores_abreast(network, start, [docs[j] for j in some])
    return out


def _scores_abreast(network: Network, start: int, ordered: list[np.ndarray]) -> np.ndarray:
    """Of documents by falling length, all side by side."""
    lengths = np.array([len(d) for d in ordered])
    total = np.zeros(len(ordered))
    h, last = np.zeros((len(ordered), HIDDEN), np.float32), np.full(len(ordered), start)
    at = 0
    while at < lengths[0]:
        lanes = int(np.searchsorted(-lengths, -at, "left"))
        size = max(WINDOW, min(1024, 2 * CHUNK // lanes))      # few lanes: longer windows; the result does not depend on it
        ids, target, alive = window(ordered[:lanes], lengths[:lanes], at, size, last)
        states, h[:lanes] = network.steps(ids, alive, h[:lanes])
        last = target[-1]
        valid = np.arange(lanes) < alive[:, None]
        total[:lanes] += np.bincount(np.nonzero(valid)[1], network.log_probabilities(states[valid], target[valid]).astype(float), lanes)
        at += len(target)
    return total


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    head: int


def learned(documents: DataFrame, head: int = HEAD, class_words: int = CLASS_WORDS, known: int = KNOWN) -> tuple[Model, DataFrame]:
    """The model of all training documents, and their stored word counts."""
    rows = training(documents)
    counts = store(word_counts(rows))
    vocabulary = Vocabulary.of(counts, head, known)
    network = Network(vocabulary, head, class_words)
    parts = encoded(rows, vocabulary, head)
    start = Words(vocabulary, head).start
    for rate in RATES[:ROUNDS]:
        network = trained(parts, network, start, rate)
    return Model(vocabulary, network, head), counts


def scanned(documents: DataFrame, model: Model) -> DataFrame:
    """Stored rows: what tasks can score by themselves, and the words whose counts they do not hold with how often each occurs."""
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = model.vocabulary, model.network
        to = Words(vocabulary, model.head)
        row = TaskContext.get().partitionId() << 40
        more = np.log10(np.append(vocabulary.counts, 0) + 1.0)      # by rank; -1: not known here
        less = np.append(np.zeros(to.head), np.log10(vocabulary.tail))    # by id: the tail's counts are shares of their class
        all_tokens = np.log10(float(vocabulary.tokens + vocabulary.distinct + 1))
        for batch in batches:
            done = 0
            held: list[tuple] = []

            def given() -> pa.RecordBatch:
                nonlocal row, done, held
                score = document_scores(network, to.start, [h[0] for h in held]) / np.log(10)
                late, n = [h[4] for h in held], len(held)
                out = pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(done, n), batch.column("held_out").slice(done, n),
                    pa.array([len(h[0]) for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
                    pa.array([h[2] - len(h[0]) * all_tokens for h in held], pa.float64()), pa.array(score + [h[3] for h in held], pa.float64()),
                    pa.array([list(x) for x in late], pa.list_(pa.binary())), pa.array([list(x.values()) for x in late], pa.list_(pa.int32()))],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"])
                row, done, held = row + n, done + n, []
                return out
            size = 0
            for _, raw, ends in texts(batch.column("text")):
                if held and size + len(raw) > SCORE_BYTES:
                    yield given()
                    size = 0
                size += len(raw)
                for doc in words(raw, ends):
                    ranks = to.ranks(doc)
                    ids = to.of(doc, ranks)
                    counted = float(more[ranks].sum())
                    in_tail = ids >= to.head
                    held.append((ids, int((ranks >= 0).sum()), counted, float((more[ranks[in_tail]] - less[ids[in_tail]]).sum()) if in_tail.any() else 0.0,
                                 Counter(doc[i] for i in np.flatnonzero(ranks < 0).tolist())))
            if held:
                yield given()

    return store(documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema))


def score(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is its end alone. Repeated rows each have theirs; without an id, held_out is false and the row is
    not learned from. Without training documents every word is unknown: the base score is 0, and the score that of the
    words' shapes by an untrained network.
    """
    scan = scanned(documents, model)
    rest = counts.where(F.col("c") < model.vocabulary.least)
    late = scan.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    gains = late.join(rest.select("word", "c"), "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("late"), F.sum("times").alias("late_known"))
    extra = F.coalesce("late", F.lit(0.0))
    return scan.drop("words", "times").join(gains, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"),
        (F.col("score") + extra).alias("score"))


def score_documents(documents: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return score(documents, *learned(documents))
