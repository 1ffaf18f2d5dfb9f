"""Alignment of two tokenizers' tokens, counted over the corpus by spilled runs.

Tasks encode each text twice, cut both token sequences at the byte offsets where tokens of both end, and link the two
tokens that end there. The links of some thousand documents make one run for each radix of the B id: its pairs in
B-major order with the documents that hold them, packed by zstd and written once to the shared folder. A heap merges the
heads of many runs and adds up each pair; merged runs are merged again until one is left for each radix. In its B-major
order all pairs of a B id come together, so the highest count of the id is known when they end. Last, the counts stream
back past the runs, and each run returns what its documents gain.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.session import store

#: Folder of the public vocabularies, on every worker.
FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How A's file cuts texts before its merges (a fixed pattern of byte-level vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_SPACE = re.compile(r"\s{5000}")
#: Documents and bytes of text that make a run; a longer text makes one by itself.
RUN_DOCS, RUN_BYTES = 2048, 4 << 20
#: Bytes of text that are encoded and aligned at once; their links take a small part of the tokenizers' own records.
ENCODED_BYTES = 1 << 18
RADICES = 32
#: Runs that one merge takes on average.
FAN_IN = 64
#: Pairs that a merge reads of a run at once.
PAGE = 4096


class Tokenizers:
    """Both tokenizers, each id's bytes, and each id's decimal text with the marks that may follow it."""

    def __init__(self, folder: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(os.path.join(folder, A_FILE))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        byte_of = byte_level()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [entries[i].encode() if i in special else bytes(byte_of[c] for c in entries[i]) if i in entries else b""
                        for i in range(max(entries) + 1)]
        # the same vocabulary, pattern and order of merges by a faster program; its pattern fails on very long white space
        self.fast = Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes) if b and i not in special}, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # decimal ids followed by ',' or the mark that ends their part of a group
        na, nb = len(self.a_bytes), len(self.b_bytes)
        self.written = [f"{i}," for i in range(na)] + [f"{i}|" for i in range(na)] + [f"{i}," for i in range(nb)] + [f"{i};" for i in range(nb)]

    def encode(self, batch: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A of space+text and by B of text; two empty lists where either's bytes are not those of space+text."""
        a = [self.a.encode(f" {t}", add_special_tokens=False).ids if LONG_SPACE.search(t) else self.fast.encode_ordinary(f" {t}") for t in batch]
        b = self.b.encode(batch, num_threads=1)
        for i, text in enumerate(batch):
            raw = f" {text}".encode()
            if not text or b"".join(map(self.a_bytes.__getitem__, a[i])) != raw or b"".join(map(self.b_bytes.__getitem__, b[i])) != raw:
                a[i], b[i] = [], []
        return a, b


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the others for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@cache
def loaded(folder: str) -> Tokenizers:
    """The tokenizers, read once by each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizers(folder)


def aligned(t: Tokenizers, a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[str]]:
    """Links (document, A id, B id) of documents' tokens, each document's number of groups, and the digest of its groups.

    Every token has at least one byte, so one A and one B token end at a place where both do: a link for each group.
    """
    ids_a, ids_b = [np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (a, b)]
    if not len(ids_a):
        return ids_a, ids_a, ids_b, [0] * len(a), [""] * len(a)
    ends_a, ends_b = np.cumsum(t.a_size[ids_a]), np.cumsum(t.b_size[ids_b])   # over all documents, which end together
    at = np.searchsorted(ends_b, ends_a)
    final_a, final_b = ends_b[at] == ends_a, np.zeros(len(ids_b), bool)
    last_a = np.flatnonzero(final_a)
    last_b = at[last_a]
    final_b[last_b] = True
    doc = np.repeat(np.arange(len(a)), [len(d) for d in a])[last_a]
    groups = np.bincount(doc, minlength=len(a))
    # tokens in order of their group, A before B: each one's place is its own number plus those of the other side before it
    group_a, group_b = np.cumsum(final_a) - final_a, np.cumsum(final_b) - final_b
    before_b = np.concatenate([[0], last_b + 1])
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    na, nb = len(t.a_bytes), len(t.b_bytes)
    order[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + na * final_a
    order[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = 2 * na + ids_b + nb * final_b
    marks = list(map(t.written.__getitem__, order.tolist()))
    digests, at = [], 0
    for x, y in zip(a, b, strict=True):
        n = len(x) + len(y)
        digests.append(hashlib.sha256("".join(marks[at: at + n])[:-1].encode()).hexdigest() if n else "")
        at += n
    return doc, ids_a[last_a], ids_b[last_b], groups.tolist(), digests


def packed(*parts: np.ndarray) -> bytes:
    """Arrays of numbers in one zstd frame, each by its type and length."""
    head = np.array([len(parts), *[v for p in parts for v in (ord(p.dtype.char), len(p))]], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(p.tobytes() for p in parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * count, 8)
    out, at = [], 8 * (1 + 2 * count)
    for kind, n in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, np.dtype(chr(kind)), n, at))
        at += out[-1].nbytes
    return out


def runs_of(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(radix, run): pairs in B-major order, how many documents hold each, those documents and how often each does."""
    key = b.astype(np.int64) << 32 | a
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(key)))
    key, doc = key[at], doc[at]
    radix = (key >> 32) % RADICES
    for r in np.unique(radix).tolist():
        mine = radix == r
        pairs, first = np.unique(key[mine], return_index=True)
        holders = np.diff(np.append(first, mine.sum()))
        yield r, packed(pairs, np.add.reduceat(times[mine], first), holders.astype(np.uint32), doc[mine].astype(np.uint32), times[mine].astype(np.uint32))


_SPILL = ("run long, radix int, doc int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "records binary")


def spilled(documents: DataFrame, folder: str = FOLDER) -> DataFrame:
    """The stored runs (radix from 0) and the documents' own rows (radix -1), told apart by `radix`; texts are encoded once."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        t, number = loaded(folder), TaskContext.get().partitionId() << 32
        schema = None
        for batch in batches:
            column = batch.column("text")
            if schema is None:
                schema = pa.schema([("run", pa.int64()), ("radix", pa.int32()), ("doc", pa.int32()), ("doc_id", batch.schema.field("doc_id").type),
                                    *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("records", pa.binary())])
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for low, high in _pieces(sizes, 0, len(sizes), RUN_DOCS, RUN_BYTES):
                links: list[tuple] = []
                n_a, n_b, groups, digests = [], [], [], []
                for first, stop in _pieces(sizes, low, high, RUN_DOCS, ENCODED_BYTES):
                    a, b = t.encode(column.slice(first, stop - first).fill_null("").to_pylist())
                    doc, link_a, link_b, g, d = aligned(t, a, b)
                    links.append(((doc + first - low).astype(np.int32), link_a.astype(np.int32), link_b.astype(np.int32)))
                    n_a += map(len, a)
                    n_b += map(len, b)
                    groups += g
                    digests += d
                n, runs = high - low, list(runs_of(*map(np.concatenate, zip(*links, strict=True))))
                nothing = [None] * len(runs)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * (n + len(runs)), pa.int64()), pa.array([-1] * n + [r for r, _ in runs], pa.int32()),
                    pa.array([*range(n), *nothing], pa.int32()),
                    pa.concat_arrays([batch.column("doc_id").slice(low, n), pa.nulls(len(runs), batch.schema.field("doc_id").type)]),
                    *[pa.array([*values, *nothing], pa.int64()) for values in (n_a, n_b, groups, groups)],
                    pa.array([*digests, *nothing], pa.string()), pa.array([None] * n + [r for _, r in runs], pa.binary())], schema=schema)
                number += 1

    return store(documents.select("doc_id", "text").mapInArrow(run, _SPILL.format(kind=kind)))


def _pieces(sizes: np.ndarray, low: int, stop: int, docs: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of the rows low to stop with `docs` texts and about `most` bytes at most; a longer text is one."""
    held = 0
    for row, size in enumerate(sizes[low:stop].tolist(), low):
        if row > low and (held + size > most or row - low >= docs):
            yield low, row
            low, held = row, 0
        held += size
    if low < stop:
        yield low, stop


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and summed counts of sorted runs: a heap holds each run's next page by its last pair.

    What lies up to the least of these ends is complete in the pages at hand, so it is added up at once and given out.
    """
    at = [0] * len(runs)
    heap = []
    for k, (pairs, _) in enumerate(runs):
        if len(pairs):
            heap.append((int(pairs[min(PAGE, len(pairs)) - 1]), k))
    heapq.heapify(heap)
    out_pairs, out_counts = [], []
    while heap:
        bound = heap[0][0]
        got = []
        for _, k in heap:
            pairs, counts = runs[k]
            stop = at[k] + int(np.searchsorted(pairs[at[k]: at[k] + PAGE], bound, "right"))
            got.append((pairs[at[k]: stop], counts[at[k]: stop]))
            at[k] = stop
        keys, back = np.unique(np.concatenate([p for p, _ in got]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, np.concatenate([c for _, c in got]))
        out_pairs.append(keys)
        out_counts.append(total)
        while heap and heap[0][0] == bound:
            k = heap[0][1]
            pairs = runs[k][0]
            if at[k] < len(pairs):
                heapq.heapreplace(heap, (int(pairs[min(at[k] + PAGE, len(pairs)) - 1]), k))
            else:
                heapq.heappop(heap)
    if not out_pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_pairs), np.concatenate(out_counts)


def highest(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair's count is the highest of its B id, whose pairs lie together."""
    if not len(pairs):
        return np.zeros(0, bool)
    b = pairs >> 32
    starts = np.flatnonzero(np.diff(b, prepend=-1))
    return counts == np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(b))))


def pair_counts(runs: DataFrame) -> DataFrame:
    """(radix, records): one merged run of pairs and their counts for each radix, from runs (radix, slice, records).

    A merge takes the runs of one slice; slices are merged FAN_IN at a time until each radix has one.
    """
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = None, []
        for batch in batches:
            first = first or (batch.column("radix")[0].as_py(), batch.column("slice")[0].as_py())
            parts += [tuple(unpacked(r)[:2]) for r in batch.column("records").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.int32()), pa.array([first[1]], pa.int64()),
                                          pa.array([packed(*merged(parts))], pa.binary())], ["radix", "slice", "records"])

    slices = runs.agg(F.max("slice")).first()[0] or 0
    out = runs
    while True:
        out = out.groupBy("radix", "slice").applyInArrow(merge, "radix int, slice long, records binary")
        if slices == 0:
            return out.select("radix", "records")
        slices //= FAN_IN
        out = store(out.withColumn("slice", F.expr(f"slice div {FAN_IN}")))


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, doc, n_best, count_sum): what each run's documents gain from its pairs' counts, summed over the radices."""
    slices = int((runs.agg(F.max("slice")).first()[0] or 0)) + 1
    # a radix's counts go once to each of its slices
    both = (runs.selectExpr("radix", "slice", "run", "records")
            .unionByName(counts.selectExpr("radix", f"explode(sequence(0L, {slices - 1}L)) AS slice", "-1L AS run", "records")))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, known = [], None
        for batch in batches:
            for number, records in zip(batch.column("run").to_pylist(), batch.column("records").to_pylist(), strict=True):
                if number < 0:
                    pairs, count = unpacked(records)
                    known = pairs, count, highest(pairs, count)
                else:
                    waiting.append((number, records))
        for number, records in waiting:
            pairs, _, holders, doc, times = unpacked(records)
            at = np.searchsorted(known[0], pairs)
            count, best = np.repeat(known[1][at], holders), np.repeat(known[2][at], holders)
            docs, back = np.unique(doc, return_inverse=True)
            total = np.zeros(len(docs), np.int64)
            np.add.at(total, back, count * times)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array(
                [packed(docs, np.bincount(back, best * times, len(docs)).astype(np.int64), total)], pa.binary())], ["run", "gains"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, total, number = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            number = batch.column("run")[0].as_py()
            for gains in batch.column("gains").to_pylist():
                docs, b, c = unpacked(gains)
                more = int(docs[-1]) + 1 - len(best)
                if more > 0:
                    best, total = np.append(best, np.zeros(more, np.int64)), np.append(total, np.zeros(more, np.int64))
                best[docs] += b
                total[docs] += c
        n = len(best)
        yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(best), pa.array(total)],
                                         ["run", "doc", "n_best", "count_sum"])

    gains = both.groupBy("radix", "slice").applyInArrow(give, "run long, gains binary")
    return gains.groupBy("run").applyInArrow(add, "run long, doc int, n_best long, count_sum long")


def align(documents: DataFrame, folder: str = FOLDER) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose tokens do not give back their bytes, have zeros and an empty digest. Repeated
    rows each have theirs and count each time; a null doc_id stays null. An empty table gives no rows.
    """
    spill = spilled(documents, folder)
    rows = spill.where("radix = -1").drop("radix", "records")
    number = spill.where("radix >= 0").select("run").distinct().count()
    slices = max(1, -(-number // FAN_IN))
    runs = spill.where("radix >= 0").select("run", "radix", F.expr(f"pmod(xxhash64(run), {slices}L)").alias("slice"), "records")
    gains = contributions(runs, store(pair_counts(runs)))
    return rows.join(gains, ["run", "doc"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
