"""Near-duplicates by chosen-path set similarity join.

Each document's set of word shingles is read as `POSITIONS` minwise tokens. A tree starts with all documents in one node; a
node branches by `BRANCH` positions that its own identifier chooses, and a document goes to the child named by its token
at the position. Two sets of similarity s take the same branch with probability s, so a pair of similarity 0.8 stays
together in some branch of a tree with a probability above 0.93 at any depth, and `TREES` independent trees miss it
with a probability below 1e-6. Nodes of up to `NODE_DOCS` documents are compared exhaustively; larger ones branch again.

Comparing is in two steps, so that a large group of near-copies does not cost its square. First each document of a node
proposes its `NEAREST` most similar partners (by minwise tokens); these are confirmed on whole shingle sets, and
confirmed links give components. Then only nodes in which some document had more partners, or which stayed large, are
looked at again, and in them only pairs of different components, each in the first node that holds both; large nodes are
cut into cells of bounded size. So every pair that a tree brings together is either confirmed, refuted on its whole sets,
or inside one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.llm.bytesets import mixed, shingle_sets
from wardgrid.llm.common import small_or_plain
from wardgrid.llm.graph import components
from wardgrid.session import store

POSITIONS, BRANCH, TREES, DEPTH = 128, 2, 6, 4
NODE_DOCS, CELL_DOCS, NEAREST = 2048, 1024, 4
#: Of 128 tokens, 80 must agree before sets are compared: five standard deviations below the threshold of 0.8.
AGREE = 80
#: Rows that a task compares at once; the number of buckets follows from the number of rows.
BUCKET_ROWS = 20_000
CELL_COLUMNS = ["node", "cell", "minor", "component", "doc_id", "n", "sketch", "before"]
FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 2 ** 31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _tokens(grams: np.ndarray) -> np.ndarray:
    """The minwise token of each position."""
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 1024):
            np.minimum(out, (x[at: at + 1024, None] * FACTORS).min(axis=0), out=out)
    return out


def profiles(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, same, tokens, sketch): set size, digest of the set, minwise tokens and one byte of each (empty without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, tokens, sketch = [], [], [], []
            for grams in shingle_sets(batch.column("text"), words):
                n.append(len(grams))
                with np.errstate(over="ignore"):
                    twice = mixed(grams * np.uint64(3) + np.uint64(11))
                    same.append(np.array([grams.sum(dtype=np.uint64), twice.sum(dtype=np.uint64)]).tobytes())
                of = _tokens(grams) if len(grams) else np.empty(0, np.uint32)
                tokens.append(of.tobytes())
                sketch.append(_sketch(of).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()),
                                              pa.array(tokens, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n", "same", "tokens", "sketch"])
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, same binary, tokens binary, sketch binary")


def _children(nodes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """BRANCH children of each row: positions are chosen by the node alone."""
    out = np.empty((len(nodes), BRANCH), np.int64)
    rows = np.arange(len(nodes))
    with np.errstate(over="ignore"):
        for b in range(BRANCH):
            place = mixed(nodes.astype(np.uint64) + np.uint64(b) * np.uint64(0x9E3779B97F4A7C15))
            # the second position differs from the first
            position = place % np.uint64(POSITIONS) if b == 0 else (position + np.uint64(1) + place % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)
            token = tokens[rows, position.astype(np.int64)].astype(np.uint64)
            out[:, b] = (mixed(place ^ mixed(token + np.uint64(0x632BE59BD9B4E019))) >> np.uint64(1)).astype(np.int64)
    return out


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def branched(rows: DataFrame) -> DataFrame:
    """(node, doc_id) of all children; rows: node, doc_id, tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _matrix(batch.column("tokens"), np.uint32, POSITIONS)
            nodes = np.asarray(batch.column("node"))
            docs = np.asarray(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(_children(nodes, tokens).ravel()), pa.array(np.repeat(docs, BRANCH))],
                                             ["node", "doc_id"])
    return rows.select("node", "doc_id", "tokens").mapInArrow(run, "node long, doc_id long")


def leaves(members: DataFrame) -> DataFrame:
    """(node, size, doc_id) of the nodes where branching ended and that hold two documents or more."""
    roots = members.withColumn("node", F.explode(F.array(*[F.lit(t + 1).cast("long") for t in range(TREES)])))
    rows = store(branched(roots))
    done = []
    for depth in range(1, DEPTH + 1):
        sizes = store(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"))
        sized = rows.join(small_or_plain(sizes), "node")
        large = sizes.where(F.col("size") > NODE_DOCS).limit(1).count() > 0
        if depth == DEPTH or not large:
            done.append(sized.select("node", "size", "doc_id"))
            break
        done.append(sized.where(F.col("size") <= NODE_DOCS).select("node", "size", "doc_id"))
        deep = store(sized.where(F.col("size") > NODE_DOCS).select("node", "doc_id"))
        rows = store(branched(members.select("doc_id", "tokens").join(small_or_plain(deep), "doc_id")))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """One byte of each token."""
    with np.errstate(over="ignore"):
        return ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), POSITIONS)


def _runs(cells: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal cells."""
    edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    yield from zip(edges[:-1], edges[1:], strict=True)


def _near(s: np.ndarray, n: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of `rows`: its row, similar rows and how many tokens agree with each."""
    for i in rows:
        agree = (s == s[i]).sum(axis=1)
        fits = (agree >= AGREE) & (100 * np.minimum(n, n[i]) >= 80 * np.maximum(n, n[i]))
        fits[i] = False
        found = np.flatnonzero(fits)
        if len(found):
            yield i, found, agree[found]


def proposals(cells: DataFrame, buckets: int) -> DataFrame:
    """(node, a, b, more): each document's nearest partners in its cell; more: it has others."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "block"], kind="stable")
        s, n, docs, nodes = _sketches(pdf.sketch), pdf.n.to_numpy(), pdf.doc_id.to_numpy(), pdf.node.to_numpy()
        cell = pdf.groupby(["node", "block"], sort=False).ngroup().to_numpy()
        bounds = np.array(list(_runs(cell)))
        out = []
        two = bounds[bounds[:, 1] - bounds[:, 0] == 2, 0]     # most cells are pairs: all at once
        agree = (s[two] == s[two + 1]).sum(axis=1)
        near = two[(agree >= AGREE) & (100 * np.minimum(n[two], n[two + 1]) >= 80 * np.maximum(n[two], n[two + 1]))]
        out += [(nodes[i], docs[i], docs[i + 1], False) for i in near]
        for lo, hi in bounds[bounds[:, 1] - bounds[:, 0] > 2]:
            for i, found, agree in _near(s[lo:hi], n[lo:hi], np.arange(hi - lo)):
                best = found[np.lexsort((docs[lo:hi][found], -agree))]
                out += [(nodes[lo], docs[lo + i], docs[lo + j], len(best) > NEAREST) for j in best[:NEAREST]]
        return pd.DataFrame([(x, min(a, b), max(a, b), m) for x, a, b, m in out], columns=["node", "a", "b", "more"])
    return (cells.withColumn("bucket", F.pmod(F.xxhash64("node", "block"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(run, "node long, a long, b long, more boolean"))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * shared >= 80 * (len(x) + len(y) - shared)


def shingle_table(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, grams): the whole shingle set of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [g.tobytes() for g in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(grams, pa.binary())], ["doc_id", "grams"])
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, grams binary")


def confirmed(pairs: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """The pairs (node, a, b) whose whole sets are similar enough; a node's pairs are compared together."""
    need = store(pairs.select("node", F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    need = sets.join(small_or_plain(need), "doc_id")
    both = (pairs.select("node", "a", "b", F.lit(None).cast("binary").alias("grams"))
            .unionByName(need.select("node", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "grams")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        is_set = pdf.grams.notna()
        wanted = {x: g for x, g in pdf[~is_set].groupby("node")}
        for node, held in pdf[is_set].groupby("node"):
            sets_of = {a: np.frombuffer(g, np.uint64) for a, g in zip(held.a, held.grams, strict=True)}
            for a, b in zip(wanted[node].a, wanted[node].b.astype("int64"), strict=True):
                if _linked(sets_of[a], sets_of[b]):
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"])
    return (both.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(run, "a long, b long"))


def _crossings(cell: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a cell with the similar rows of other components that they are compared with here.

    Two minor rows are compared once, in the cell of their block with itself (a number from 0), and two documents only in
    the first node that they share: their other nodes leave them to it.
    """
    s, n, comp, minor = _sketches(cell.sketch), cell.n.to_numpy(), cell.component.to_numpy(), cell.minor.to_numpy()
    lists = cell.before.tolist()
    before = np.zeros((len(cell), max(map(len, lists))), np.int64)      # nodes are never 0
    for i, nodes in enumerate(lists):
        before[i, : len(nodes)] = nodes
    inner = cell.cell.iat[0] >= 0
    for i, found, _ in _near(s, n, np.flatnonzero(minor)):
        here = found[(comp[found] != comp[i]) & (~minor[found] | (inner & (found > i)))]
        if len(lists[i]) and len(here):
            here = here[~np.isin(before[here], lists[i]).any(axis=1)]
        if len(here):
            yield i, here


def candidates(rows: DataFrame, buckets: int) -> DataFrame:
    """(node, cell, minor, component, doc_id, n, sketch, before): rows of cells that have a similar one of another component, by tokens.

    rows: the same columns; without `before`, no document has an earlier node. Only these need their whole sets; none of the
    pairs leaves its task.
    """
    if "before" not in rows.columns:
        rows = rows.withColumn("before", F.array().cast("array<long>"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, cell in pdf.groupby(["node", "cell"], sort=False):
            needed = np.zeros(len(cell), bool)
            for i, others in _crossings(cell):
                needed[others] = True
                needed[i] = True
            out.append(cell[needed])
        return pd.concat(out)[CELL_COLUMNS]
    return (rows.withColumn("bucket", F.pmod(F.xxhash64("node", "cell"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(run, rows.select(*CELL_COLUMNS).schema))


def crossing(rows: DataFrame, buckets: int) -> DataFrame:
    """Confirmed links (a, b) between components inside each cell, one per pair of components at most.

    rows: node, cell, minor, component, doc_id, n, sketch, before, grams; a pair has a minor document of the cell on one side.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, cell in pdf.groupby(["node", "cell"], sort=False):
            cell = cell.drop_duplicates("doc_id")
            comp, docs = cell.component.to_numpy().copy(), cell.doc_id.to_numpy()
            grams = [np.frombuffer(g, np.uint64) for g in cell.grams]
            for i, others in _crossings(cell):
                for j in others:
                    if comp[i] != comp[j] and _linked(grams[i], grams[j]):
                        out.append((docs[i], docs[j]))
                        comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(out, columns=["a", "b"])
    return (rows.withColumn("bucket", F.pmod(F.xxhash64("node", "cell"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(run, "a long, b long"))


def _buckets(rows: int, each: int = BUCKET_ROWS) -> int:
    return max(1, math.ceil(rows / each))


def _again(leaf: DataFrame, dense: DataFrame, parts: DataFrame, members: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """Links between components in the nodes that one round of proposals did not settle."""
    rows = (leaf.join(small_or_plain(dense), "node").select("node", "doc_id")
            .join(parts, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    rows = store(rows)
    shares = rows.groupBy("node", "component").agg(F.count("*").alias("k"))
    main = shares.groupBy("node").agg(F.max(F.struct("k", "component")).alias("m"), F.count("*").alias("parts"), F.sum("k").alias("size"))
    main = store(main.where("parts > 1").select("node", F.col("m.component").alias("main"), "size"))
    rows = (rows.join(small_or_plain(main), "node")
            .withColumn("minor", F.col("component") != F.col("main"))
            .withColumn("blocks", F.ceil(F.col("size") / CELL_DOCS).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
            .withColumn("before", F.collect_list("node").over(Window.partitionBy("doc_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))))
    # a cell is one block of minor documents beside one block of others, or within itself (from 0): each row goes to the
    # cells of its block; of two blocks' minor documents, those of the larger number are the others
    outer, inner = "-1 - ({} * cast(blocks as bigint) + {})", "cast(block as bigint)"
    mine, its = outer.format("block", "o"), outer.format("m", "block")
    columns = ["node", "component", "doc_id", "before"]
    as_any = rows.select(*columns, F.lit(False).alias("minor"), F.explode(F.expr(
        f"transform(filter(sequence(0, blocks - 1), m -> not minor or m < block), m -> if(m = block, {inner}, {its}))")).alias("cell"))
    as_minor = rows.where("minor").select(*columns, F.lit(True).alias("minor"), F.explode(F.expr(
        f"transform(sequence(0, blocks - 1), o -> if(o = block, {inner}, {mine}))")).alias("cell"))
    used = as_minor.select("node", "cell").distinct()
    cells = store(as_any.join(used, ["node", "cell"], "left_semi").unionByName(as_minor))
    n = cells.count()
    if not n:
        return None
    held = small_or_plain(store(cells.select("doc_id").distinct()))
    sketches = members.select("doc_id", "n", "sketch").join(held, "doc_id", "left_semi")
    near = store(candidates(cells.join(sketches, "doc_id"), _buckets(n, 2 * CELL_DOCS)))
    n = near.count()
    if not n:
        return None
    wanted = near.select("doc_id").distinct()
    sets = shingle_table(documents.join(small_or_plain(store(wanted)), "doc_id", "left_semi"), words)
    return store(crossing(near.join(sets, "doc_id"), _buckets(n, 2 * CELL_DOCS)))


def link_components(documents: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked by shingle sets of similarity 0.8 or more.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case. A document of fewer than `words` words
    has one shingle, of all of them; a null text or one without words has none and is linked with nothing. component_id
    is the smallest doc_id that links reach, kept the row of that id. Documents with equal sets are one vertex, so
    copies cost nothing; rows equal in doc_id and words count once. Rows without doc_id are left out. Other
    columns are ignored.
    """
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_docs = store(profiles(docs, words))
    some = all_docs.where("n > 0")
    classes = some.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").select("same", "rep")
    copies = store(some.select("doc_id", "same").join(small_or_plain(store(classes)), "same")
                   .where("doc_id != rep").select("doc_id", "rep").distinct())
    left = some.join(small_or_plain(copies.select("doc_id")), "doc_id", "left_anti")
    again = small_or_plain(store(some.groupBy("doc_id").count().where("count > 1").select("doc_id")))      # only these rows need a shuffle
    members = store(left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])))

    leaf = store(leaves(members))
    n_leaf = leaf.count()
    cells = leaf.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / NODE_DOCS)).cast("int"))
    proposed = store(proposals(cells.join(members.select("doc_id", "n", "sketch"), "doc_id"), _buckets(n_leaf)))
    pairs = store(proposed.groupBy("a", "b").agg(F.min("node").alias("node")))
    n_pairs = pairs.count()
    texts_of = store(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = shingle_table(docs.join(small_or_plain(texts_of), "doc_id", "left_semi"), words)
    links = store(confirmed(pairs, sets, _buckets(n_pairs, 1_000)))
    parts = store(components(links).withColumnsRenamed({"id": "doc_id"}))

    dense = store(proposed.where("more").select("node").union(leaf.where(F.col("size") > NODE_DOCS).select("node")).distinct())
    if dense.limit(1).count():
        more = _again(leaf, dense, parts, members, docs, words)
        if more is not None and more.limit(1).count():
            whole = parts.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
            parts = store(components(whole.union(more)).withColumnsRenamed({"id": "doc_id"}))
    vertex = all_docs.select("doc_id", "n").join(small_or_plain(copies), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    return (vertex.join(small_or_plain(parts.select(F.col("doc_id").alias("rep"), "component")), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
            .distinct().withColumn("kept", F.col("doc_id") == F.col("component_id")))


def deduplicate(documents: DataFrame, words: int = 5) -> DataFrame:
    """The documents less all but the smallest doc_id of each linked group; all their columns. Rows without an id stay."""
    gone = store(link_components(documents, words).where("not kept").select("doc_id").distinct())
    return documents.join(small_or_plain(gone), "doc_id", "left_anti").select(*[f"`{c}`" for c in documents.columns])
