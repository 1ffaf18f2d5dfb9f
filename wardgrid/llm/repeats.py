"""Repeated byte strings: bucket refinement over sampled suffixes.

Suffixes are bucketed by their first 20 bytes; buckets of one block leave, those in many blocks are split once by 15 bytes
more, and then the hashes of whole 50-byte strings are sorted. The recursion of bucket-pointer refinement, with identifiers of
later offsets reused at each step, is left out. Two more things differ from the
sequential method, so that no task needs the whole text. Bucket identifiers are 64-bit hashes of the bytes instead of
ranks: only equality of 50-byte prefixes is asked for, never their order, and a hash for any later offset comes from
the same prefix sums as the one before. And only sampled suffixes take part: each 50-byte string is represented by
its 20-byte substring of least hash, the same one wherever the string occurs, so a sixteenth of all positions is shuffled.

Documents lie in blocks of ascending doc_id, so that "starts in a document with a smaller doc_id" is "starts in an earlier
block, or in an earlier document of the block". Three passes over the blocks: (1) the 20-byte buckets of each block meet,
and those of one block alone leave; (2) the surroundings of each remaining member go to its bucket, which is refined
by the 15 bytes after and before it if it has members in many blocks, and there all 50-byte strings around it are sorted
and those seen in an earlier block are marked; (3) each block removes the marked bytes and those repeated inside the block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.llm.bytesets import U64, _powers, mixed, texts
from wardgrid.llm.common import in_blocks, small_or_plain
from wardgrid.session import store, store_bucketed

LENGTH, CORE = 50, 20
SIDE = 15                       # bytes beside the core that refine a bucket
SPAN = LENGTH - CORE + 1        # core places in one string
BLOCK_BYTES = 3 << 20
BUCKET_ROWS = 10_000
#: Surroundings that a task copies at once.
PART_ROWS = 4_096
#: A core in more blocks than this is refined by the bytes beside it before its members meet.
WIDE_BLOCKS = 64
#: (bytes before the core, bytes from its start, first and last offset of strings): right and left surroundings of wide cores, and both
SIDES = ((SIDE, LENGTH, 0, SIDE), (LENGTH - CORE, LENGTH - SIDE - 1, SIDE + 1, LENGTH - CORE), (LENGTH - CORE, LENGTH, 0, LENGTH - CORE))
#: bytes before and from the start of the core that name the bucket of a side
REFINED = ((0, CORE + SIDE), (SIDE, CORE), (0, CORE))
OUTSIDE = 0xFF                  # never a byte of UTF-8
VALUE = np.random.Generator(np.random.PCG64(50)).integers(0, 2 ** 63, 256, dtype=np.uint64) * U64(2) + U64(1)


class Piece:
    """Whole documents side by side, with prefix sums that hash any substring."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray) -> None:
        self.raw, self.ends = raw, ends
        powers, self.inverses = _powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(VALUE[raw] * powers[: len(raw)], out=self.total[1:])

    def hashed(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[stop] - self.total[start]) * self.inverses[start]

    def starts(self) -> np.ndarray:
        """Starts of all strings that lie inside one document."""
        lengths = np.diff(self.ends)
        counts = np.maximum(lengths - LENGTH + 1, 0)
        first = np.repeat(self.ends[:-1], counts)
        return first + np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of strings, and the place of each string's core."""
        starts = self.starts()
        if not len(starts):
            return starts, starts
        n = len(self.raw) - CORE + 1
        with np.errstate(over="ignore"):
            key = mixed((self.total[CORE:] - self.total[:n]) * self.inverses[:n])
        place_bits = U64(max(1, int(n).bit_length()))
        least = (key >> place_bits << place_bits) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width:])
        return starts, (least[starts] & ((U64(1) << place_bits) - U64(1))).astype(np.int64)

    def cores(self, at: np.ndarray) -> np.ndarray:
        return mixed(self.hashed(at, at + CORE)).astype(np.int64)

    def around(self, at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For cores at `at`: bounds of their surroundings inside the document, and a hash that names them."""
        before, after, _, _ = SIDES[side]
        doc = np.searchsorted(self.ends, at, "right") - 1
        lo, hi = np.maximum(at - before, self.ends[doc]), np.minimum(at + after, self.ends[doc + 1])
        with np.errstate(over="ignore"):
            shape = ((lo - (at - before)) * 128 + (at + after - hi)).astype(np.uint64) * U64(4) + U64(side)
            return lo, hi, mixed(self.hashed(lo, hi) + shape * U64(0xD6E8FEB86659FD93)).astype(np.int64)


def pieces(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, Piece]]:
    """(doc ids, piece) over a block's packed documents, in ascending doc_id."""
    if not blobs:
        return
    docs = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).sort_by("doc_id").combine_chunks()
    ids = docs.column("doc_id").to_numpy()
    for row, raw, ends in texts(docs.column("text")):
        yield ids[row: row + len(ends) - 1], Piece(raw, ends)


def packed(documents: DataFrame, blocks: int) -> DataFrame:
    """(block, docs): documents of a block as compressed Arrow streams, in a table bucketed by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            of = np.asarray(batch.column("block"))
            for block in np.unique(of):
                part = rows.take(pa.array(np.flatnonzero(of == block))).select(["doc_id", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                 ["block", "docs"])
    return store_bucketed(documents.select("doc_id", "text", "block").mapInArrow(run, "block long, docs binary"),
                          ["block"], ["block"], blocks)


def _blobs(table: pa.Table) -> list[bytes]:
    return table.column("docs").to_pylist()


def _block_of(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values lie in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def core_buckets(table: DataFrame) -> DataFrame:
    """(key, block): the different cores of each block."""
    def run(block: pa.Table) -> pa.Table:
        found = [np.unique(piece.cores(np.unique(piece.sampled()[1]))) for _, piece in pieces(_blobs(block))]
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pa.table({"key": pa.array(keys, pa.int64()), "block": pa.array(np.full(len(keys), _block_of(block)), pa.int64())})
    return table.groupBy("block").applyInArrow(run, "key long, block long")


def surroundings(table: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(bucket, side, block, bytes): the different surroundings in each block of cores that other blocks have too."""
    def run(block: pa.Table, keys: pa.Table) -> pa.Table:
        wanted, wide = keys.column("key").to_numpy(), keys.column("wide").to_numpy()
        sides = [np.sort(wanted[wide])] * 2 + [np.sort(wanted[~wide])]
        out: dict[str, list] = {"bucket": [], "side": [], "bytes": []}
        known = [np.zeros(0, np.int64)] * len(SIDES)
        for _, piece in pieces(_blobs(block)) if len(wanted) else ():
            every = np.unique(piece.sampled()[1])
            core = piece.cores(every)
            for side, (before, after, _, _) in enumerate(SIDES):
                at = every[_member(core, sides[side])]
                if not len(at):
                    continue
                lo, hi, name = piece.around(at, side)
                name, first = np.unique(name, return_index=True)
                new = ~_member(name, known[side])
                known[side] = np.union1d(known[side], name[new])
                left, right = REFINED[side]
                powers, _ = _powers(left + right)
                for low in range(0, int(new.sum()), PART_ROWS):
                    mine = first[new][low: low + PART_ROWS]
                    places = at[mine, None] + np.arange(-before, after)
                    inside = (places >= lo[mine, None]) & (places < hi[mine, None])
                    found = np.where(inside, piece.raw[np.clip(places, 0, len(piece.raw) - 1)], OUTSIDE).astype(np.uint8)
                    refined = found[:, before - left: before + right]
                    with np.errstate(over="ignore"):
                        route = mixed((VALUE[refined] * powers[: left + right]).sum(axis=1, dtype=np.uint64))
                    out["bucket"].append((route % U64(buckets)).astype(np.int32))
                    out["side"].append(np.full(len(mine), side, np.int8))
                    out["bytes"] += [row.tobytes() for row in found]
        n = len(out["bytes"])
        of = _block_of(block) if block.num_rows else 0
        return pa.table({"bucket": pa.array(np.concatenate(out["bucket"]) if n else [], pa.int32()),
                         "side": pa.array(np.concatenate(out["side"]) if n else [], pa.int8()),
                         "block": pa.array(np.full(n, of), pa.int64()), "bytes": pa.array(out["bytes"], pa.binary())})
    return table.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, "bucket int, side byte, block long, bytes binary")


def _seen_before(found: np.ndarray, block: np.ndarray, side: int) -> np.ndarray:
    """For each row of surroundings a bit per offset: the 50 bytes there are in an earlier block's surroundings too."""
    before, _, first, last = SIDES[side]
    powers, inverses = _powers(found.shape[1] + 1)
    width = found.shape[1]
    with np.errstate(over="ignore"):
        total = np.zeros((len(found), width + 1), np.uint64)
        np.cumsum(VALUE[found] * powers[:width], axis=1, out=total[:, 1:])
        bad = np.zeros((len(found), width + 1), np.int32)
        np.cumsum(found == OUTSIDE, axis=1, out=bad[:, 1:])
        at = before - np.arange(first, last + 1)
        name = mixed((total[:, at + LENGTH] - total[:, at]) * inverses[at])
    whole = (bad[:, at + LENGTH] == bad[:, at]).ravel()
    name, of = name.ravel()[whole], np.repeat(block, len(at))[whole]
    order = np.lexsort((of, name))
    name, of = name[order], of[order]
    start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
    least = np.repeat(of[start], np.diff(np.r_[start, len(name)]))
    seen = np.zeros(len(found) * len(at), bool)
    seen[np.flatnonzero(whole)[order[of > least]]] = True
    return seen.reshape(len(found), len(at)).astype(np.int64) @ (1 << np.arange(len(at), dtype=np.int64))


def _name_of(found: np.ndarray, side: int) -> np.ndarray:
    """The hash that Piece.around gives the same surroundings."""
    powers, inverses = _powers(found.shape[1] + 1)
    inside = found != OUTSIDE
    lo = inside.argmax(axis=1)
    right = found.shape[1] - lo - inside.sum(axis=1)
    with np.errstate(over="ignore"):
        total = (np.where(inside, VALUE[found], U64(0)) * powers[: found.shape[1]]).sum(axis=1, dtype=np.uint64)
        shape = (lo * 128 + right).astype(np.uint64) * U64(4) + U64(side)
        return mixed(total * inverses[lo] + shape * U64(0xD6E8FEB86659FD93)).astype(np.int64)


def marked(surrounding: DataFrame) -> DataFrame:
    """(block, name, side, mask): surroundings that hold strings of an earlier block, with a bit for each."""
    def run(rows: pa.Table) -> pa.Table:
        out = []
        sides, block = rows.column("side").to_numpy(), rows.column("block").to_numpy()
        values = rows.column("bytes").to_pylist()
        for side, (before, after, _, _) in enumerate(SIDES):
            mine = np.flatnonzero(sides == side)
            if not len(mine):
                continue
            found = np.frombuffer(b"".join(values[i] for i in mine), np.uint8).reshape(len(mine), before + after)
            mask = _seen_before(found, block[mine], side)
            hit = mask != 0
            out.append(pd.DataFrame({"block": block[mine][hit], "name": _name_of(found[hit], side), "side": np.int8(side), "mask": mask[hit]}))
        frame = pd.concat(out) if out else pd.DataFrame({"block": [], "name": [], "side": [], "mask": []})
        return pa.table({"block": pa.array(frame.block, pa.int64()), "name": pa.array(frame.name, pa.int64()),
                         "side": pa.array(frame.side, pa.int8()), "mask": pa.array(frame["mask"], pa.int64())})
    return surrounding.groupBy("bucket").applyInArrow(run, "block long, name long, side byte, mask long")


def _inside_block(block: list[tuple[np.ndarray, Piece]], sampled: list) -> list[np.ndarray]:
    """For each piece the starts of strings that an earlier document of the block has too."""
    core = [piece.cores(np.unique(at)) for (_, piece), (_, at) in zip(block, sampled, strict=True)]
    doc = [np.searchsorted(piece.ends, np.unique(at), "right") - 1 + base
           for (_, piece), (_, at), base in zip(block, sampled, np.cumsum([0] + [len(ids) for ids, _ in block[:-1]]), strict=True)]
    rank = np.unique(np.concatenate([ids for ids, _ in block]), return_inverse=True)[1]   # rows of one id are one document
    keys, docs = np.concatenate(core), rank[np.concatenate(doc)]
    order = np.lexsort((docs, keys))
    same = keys[order][1:] == keys[order][:-1]
    differs = same & (docs[order][1:] != docs[order][:-1])
    shared = np.unique(keys[order][1:][differs])
    names, owners, places = [], [], []
    base = 0
    for number, ((ids, piece), (starts, at)) in enumerate(zip(block, sampled, strict=True)):
        unique_at = np.unique(at)
        hot = unique_at[_member(piece.cores(unique_at), shared)]
        mine = starts[_member(at, hot)]
        names.append(mixed(piece.hashed(mine, mine + LENGTH)))
        owners.append(rank[np.searchsorted(piece.ends, mine, "right") - 1 + base])
        places.append(np.stack([np.full(len(mine), number), mine]))
        base += len(ids)
    name, owner, place = np.concatenate(names), np.concatenate(owners), np.concatenate(places, axis=1)
    out = [np.zeros(0, np.int64)] * len(block)
    if len(name):
        order = np.lexsort((owner, name))
        name, owner = name[order], owner[order]
        start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        later = owner > np.repeat(owner[start], np.diff(np.r_[start, len(name)]))
        hit = place[:, order[later]]
        out = [hit[1][hit[0] == number] for number in range(len(block))]
    return out


def removed(table: DataFrame, marks: DataFrame) -> DataFrame:
    """The result rows of all packed documents."""
    def run(block: pa.Table, mark: pa.Table) -> pa.Table:
        held = list(pieces(_blobs(block)))
        rows: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        if held:
            sampled = [piece.sampled() for _, piece in held]
            local = _inside_block(held, sampled)
            side_of, names, masks = (mark.column(c).to_numpy() for c in ("side", "name", "mask"))
            for (ids, piece), (_, at), own in zip(held, sampled, local, strict=True):
                starts = [own]
                at = np.unique(at)
                for side, (_, _, first, last) in enumerate(SIDES):
                    mine = np.flatnonzero(side_of == side)
                    mine = mine[np.argsort(names[mine], kind="stable")]
                    if not len(mine) or not len(at):
                        continue
                    name = piece.around(at, side)[2]
                    where = np.minimum(np.searchsorted(names[mine], name), len(mine) - 1)
                    hit = names[mine][where] == name
                    for bit, offset in enumerate(range(first, last + 1)):
                        with_bit = hit & ((masks[mine][where] >> bit) & 1 == 1)
                        starts.append(at[with_bit] - offset)
                covered = np.zeros(len(piece.raw) + 1, np.int64)
                start = np.unique(np.concatenate(starts))
                np.add.at(covered, start, 1)
                np.add.at(covered, start + LENGTH, -1)
                gone = np.cumsum(covered[:-1]) > 0
                for i, doc_id in enumerate(ids):
                    lo, hi = piece.ends[i], piece.ends[i + 1]
                    cut = gone[lo:hi]
                    rows["doc_id"].append(int(doc_id))
                    rows["n_bytes"].append(int(hi - lo))
                    rows["n_removed"].append(int(cut.sum()))
                    rows["n_spans"].append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
                    rows["kept_sha256"].append(hashlib.sha256(piece.raw[lo:hi][~cut].tobytes()).hexdigest())
        return pa.table({c: pa.array(v, pa.string() if c == "kept_sha256" else pa.int64()) for c, v in rows.items()})
    return table.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document less the 50-byte strings of smaller doc_ids.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id; matches never cross
    documents. A null or empty text has no bytes. Texts shorter than 50 bytes keep all. A text equal to one of a smaller
    doc_id goes whole, without being read again. Rows without doc_id are left out; rows that repeat a doc_id are parts of
    one document, which never remove from each other, and each has its row. Other columns are ignored.
    """
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    digests = store(docs.select("doc_id", size.cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    least = digests.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1")
    copies = store(digests.join(small_or_plain(store(least.drop("k"))), "sha").where("doc_id > least").select("doc_id", "n_bytes", "sha"))
    whole = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                          F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    copied = small_or_plain(copies.select("doc_id", "sha").distinct())
    first = docs.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).join(copied, ["doc_id", "sha"], "left_anti").drop("sha")
    placed, blocks = in_blocks(first, size, block_bytes)
    table = packed(placed, blocks)

    # cores of two blocks or more stay; a core has one row per block at most
    cores = core_buckets(table)
    of_key = Window.partitionBy("key")
    shared = store(cores.withColumn("low", F.min("block").over(of_key)).withColumn("high", F.max("block").over(of_key))
                   .withColumn("wide", F.count("*").over(of_key) > WIDE_BLOCKS).where("low < high").select("key", "block", "wide"))
    marks = marked(surroundings(table, shared, max(1, math.ceil(shared.count() / BUCKET_ROWS))))
    return removed(table, marks).unionByName(whole)
