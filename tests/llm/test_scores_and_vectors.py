"""Language-model scores, token alignment and whitening against brute force and on awkward small inputs."""

import bisect
import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ROWS
from wardgrid.llm import alignment, whitening, wordlm

needs_tokenizers = pytest.mark.skipif(not os.path.isdir(alignment.FOLDER), reason="no vocabularies here")
TEXTS = [" ".join(f"the cat{i % 7} sat on mat{i % 3}, and {i % j} ran." for i in range(40)) for j in range(1, 25)]


# 11: scores of a language model

def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS + ["", None, "never seen words", "THE CAT1", "the cat1"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return rows, wordlm.score_documents(df).collect(), wordlm.learned(df, head=30, class_words=4, known=40), df


def expected(rows):
    counts = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)))
            for i, t in rows}


def test_counts_and_base_scores(scored):
    rows, got, _, _ = scored
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_counts_of_words_that_tasks_do_not_hold_are_joined(scored):
    rows, _, (model, counts), df = scored
    want = expected(rows)
    for r in wordlm.score(df, model, counts).collect():
        assert r.n_known == want[r.doc_id][1] and r.base_score == pytest.approx(want[r.doc_id][3])


def test_training_reads_every_word(scored):
    """Each text has far more words than one window, and each word of each training document is there once."""
    rows, _, (model, _), df = scored
    to = wordlm.Words(model.vocabulary, model.head)
    want = sorted(to.of(t, to.ranks(t)).tolist() for i, t in ((i, tokens(t)) for i, t in rows) if zlib.crc32(str(i).encode()) % 7 != 2)
    parts = wordlm.encoded(wordlm.training(df), model.vocabulary, model.head)
    assert sorted(r.ids for r in parts.collect()) == want and max(map(len, want)) > 4 * wordlm.WINDOW


def test_score_is_the_probability_word_by_word(scored):
    """Unbatched: one step at a time, all classes and all words of a class."""
    rows, _, (model, counts), df = scored
    net, voc = model.network, model.vocabulary
    all_counts = {bytes(r.word): r.c for r in counts.collect()}
    to = wordlm.Words(voc, model.head)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    got = {r.doc_id: r.score for r in wordlm.score(df, model, counts).collect()}
    for i, text in rows:
        h, last, total = np.zeros(wordlm.HIDDEN), to.start, 0.0
        for w in tokens(text):
            a, v = net.embed[last].astype(float) @ net.x + net.bias, h @ net.u
            k = wordlm.HIDDEN
            z, r = sigmoid(a[:k] + v[:k]), sigmoid(a[k:2 * k] + v[k:2 * k])
            c = np.tanh(a[2 * k:] + r * (v[2 * k:] + net.inner))
            h = c + z * (h - c)
            p = np.exp(h @ net.classes + net.class_bias)
            p /= p.sum()
            rank = to.rank.get(w, -1)
            if 0 <= rank < to.head:
                g = rank // net.size
                q = np.exp(net.out[g * net.size: (g + 1) * net.size] @ h + net.out_bias[g * net.size: (g + 1) * net.size])
                total += np.log10(p[g] * q[rank % net.size] / q.sum())
                last = rank
            else:
                s = wordlm.shape(w)
                total += np.log10(p[net.groups + s] * (all_counts.get(w, 0) + 1) / voc.tail[s])
                last = to.head + s
        assert got[i] == pytest.approx(total, rel=1e-4)


def test_probabilities_of_all_words_sum_to_one(scored):
    _, _, (model, counts), _ = scored
    net, voc = model.network, model.vocabulary
    h = np.random.default_rng(1).normal(0, 1, (1, wordlm.HIDDEN)).astype(np.float32)
    head = np.exp(net.log_probabilities(np.repeat(h, net.head, 0), np.arange(net.head))).sum()
    tail = np.exp(net.log_probabilities(np.repeat(h, wordlm.SHAPES, 0), net.head + np.arange(wordlm.SHAPES)))
    shares = np.ones(wordlm.SHAPES)            # one more for words never seen
    in_head = {w for w in voc.known[: net.head]}
    for r in counts.collect():
        if bytes(r.word) not in in_head:
            shares[r["shape"]] += r.c + 1
    assert (shares == voc.tail).all()
    assert head + (tail * shares / voc.tail).sum() == pytest.approx(1, abs=1e-4)


def test_classes_of_few_words_are_trained_together(scored, monkeypatch):
    """With all, some and none of the classes computed at once, and where logits could overflow."""
    _, _, (model, _), _ = scored
    rng = np.random.default_rng(2)
    net = wordlm.Network(model.vocabulary, 30, 4)
    target = np.concatenate([rng.integers(0, 30 + wordlm.SHAPES, 60), np.full(20, 5)])
    h = rng.normal(0, 0.5, (80, wordlm.HIDDEN)).astype(np.float32)
    for factor in (1, 1000):
        net.out *= np.float32(factor)
        found = []
        for few in (0, 8, 80):
            monkeypatch.setattr(wordlm, "FEW", few)
            grads: list = []
            found.append([net.log_probabilities(h, target, grads), *grads])
        assert all(np.allclose(x, y, rtol=1e-4, atol=1e-5) for other in found[1:] for x, y in zip(found[0], other, strict=True))


def test_gradients(scored):
    _, _, (model, _), _ = scored
    rng = np.random.default_rng(0)
    net = wordlm.Network(model.vocabulary, 12, 5)
    docs = [rng.integers(0, 12 + wordlm.SHAPES, n) for n in (7, 7, 4, 1)]
    ids, target, alive = wordlm.window(docs, np.array([7, 7, 4, 1]), 0, 7, np.zeros(4, int))
    h = rng.normal(0, 1, (4, wordlm.HIDDEN)).astype(np.float32)
    grads, _, _ = net.gradients(ids, target, alive, h)
    for w, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = w[at], []
        for step in (0.01, -0.01):
            w[at] = old + np.float32(step)
            losses.append(net.gradients(ids, target, alive, h)[2])
        w[at] = old
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_windows_hold_no_lanes_of_ended_documents(scored, monkeypatch):
    """Each token is trained on once, and no window computes lanes without one; weights move as by Adam written out."""
    _, _, (model, _), _ = scored
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 30 + wordlm.SHAPES, n) for n in (5, 100, 40, 33, 1)]
    monkeypatch.setattr(wordlm, "NEAR", 100)
    trainer = wordlm.Trainer(wordlm.Network(model.vocabulary, 30, 4), 0, 0.01)
    w, m, v = trainer.flat.astype(float), 0.0, 0.0
    seen, plain = [], trainer.network.gradients

    def watched(ids, target, alive, h):
        nonlocal w, m, v
        assert np.allclose(trainer.flat, w, rtol=1e-3, atol=1e-4)
        found = plain(ids, target, alive, h)
        seen.append((ids.shape[1], int(alive[0]), int(alive.sum())))
        g = np.concatenate([x.ravel() for x in found[0]]).astype(float)
        g /= max(1.0, np.sqrt(g @ g))
        m, v, k = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, len(seen)
        w = trainer.flat - 0.01 * np.sqrt(1 - 0.99 ** k) / (1 - 0.9 ** k) * m / (np.sqrt(v) + 1e-6)
        return found
    monkeypatch.setattr(trainer.network, "gradients", watched)
    trainer.fit(docs)
    assert [x[0] for x in seen] == [x[1] for x in seen] == [5, 3, 1, 1]
    assert sum(x[2] for x in seen) == trainer.tokens == sum(map(len, docs)) and np.allclose(trainer.flat, w, rtol=1e-3, atol=1e-4)


def test_scores_do_not_depend_on_what_is_scored_abreast(scored, monkeypatch):
    _, _, (model, _), _ = scored
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, model.network.head + wordlm.SHAPES, n) for n in (3, 90, 1, 40, 3)]
    found = []
    for abreast in (1, 2, 512):
        monkeypatch.setattr(wordlm, "ABREAST", abreast)
        found.append(wordlm.document_scores(model.network, 0, docs))
    assert np.allclose(found[0], found[1], rtol=1e-4) and np.allclose(found[0], found[2], rtol=1e-4)
    assert len(wordlm.document_scores(model.network, 0, [])) == 0


def test_training_beats_the_counts_on_held_out_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(" ".join(("ab", "cd", "ef")) if rng.random() < .5 else "gh ij kl" for _ in range(30))) for i in range(6000)]
    got = [r for r in wordlm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got) and len(got) > 500


def test_scores_of_awkward_rows(docs, no_docs):
    got = wordlm.score_documents(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((i is None, i or 0, len(tokens(t))) for i, t, *_ in ROWS)
    assert all(np.isfinite(r.score) and r.score <= 1e-6 and not (r.doc_id is None and r.held_out) for r in got)
    assert wordlm.score_documents(no_docs).count() == 0


def test_scores_without_training_rows(docs):
    for r in wordlm.score_documents(docs.where("doc_id IS NULL")).collect():
        assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and np.isfinite(r.score) and r.score < 0


# 12: alignment

def brute_alignment(rows):
    t = alignment.loaded(alignment.FOLDER)
    links, out = [], []
    for i, text in rows:
        (a,), (b,) = t.encode([text or ""])
        ends_a, ends_b = [dict(zip(np.cumsum([len(table[k]) for k in ids]).tolist(), ids)) for ids, table in ((a, t.a_bytes), (b, t.b_bytes))]
        both = sorted(set(ends_a) & set(ends_b))
        groups = {e: ([], []) for e in both}
        for side, ends in enumerate((ends_a, ends_b)):
            for e, k in ends.items():
                groups[both[bisect.bisect_left(both, e)]][side].append(str(k))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in groups.values()]
        links.append([(ends_a[e], ends_b[e]) for e in both])
        out.append((i, len(a), len(b), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(p for x in links for p in x)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(*o[:4], len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), o[4]) for o, x in zip(out, links)]


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["<|endoftext|> is plain text", "<s> </s> <unk> <0x41>", "  two  spaces\n\tand breaks ", "日本語 тест 🎉 é", "▁ a mark", "nul\x00 byte", "ﬁ ligature", " "]


@needs_tokenizers
@pytest.mark.parametrize(("fan_in", "run_docs"), [(64, 4096), (2, 3)])
def test_alignment_equals_brute_force(spark, monkeypatch, fan_in, run_docs):
    monkeypatch.setattr(alignment, "FAN_IN", fan_in)
    monkeypatch.setattr(alignment, "RUN_DOCS", run_docs)
    rows = [(i, t) for i, t in enumerate(TEXTS + ODD + ["", None, TEXTS[0]])] + [(3, TEXTS[3]), (None, "no id")]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.select(*ALIGNED).collect()), key=str) == sorted(brute_alignment(rows), key=str)


@needs_tokenizers
def test_alignment_of_awkward_rows(docs, no_docs):
    got = alignment.align(docs).select(*ALIGNED).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_alignment([(i, t) for i, t, *_ in ROWS]), key=str)
    assert alignment.align(no_docs).count() == 0


@needs_tokenizers
def test_both_tokenizers_give_back_their_bytes():
    t = alignment.loaded(alignment.FOLDER)
    a, b = t.encode(ODD[:1] + TEXTS[:1])
    for x, y, text in zip(a, b, ODD[:1] + TEXTS[:1]):
        assert b"".join(t.a_bytes[i] for i in x) == b"".join(t.b_bytes[i] for i in y) == f" {text}".encode()


@needs_tokenizers
def test_the_fast_encoder_is_the_file():
    """Letters, marks, digits and white space of all scripts, alone, doubled and beside others."""
    t = alignment.loaded(alignment.FOLDER)
    for low in range(0, 0x20000, 2048):
        batch = [f" x{c}1 {c}2{c}{c}a {c} {c}  {c}\n\t{c} 's{c}" for c in map(chr, range(low, low + 2048)) if not 0xD800 <= ord(c) < 0xE000]
        if batch:
            assert [e.ids for e in t.a.encode_batch_fast(batch, add_special_tokens=False)] == [t.fast.encode_ordinary(x) for x in batch]


@needs_tokenizers
def test_very_long_white_space():
    t = alignment.loaded(alignment.FOLDER)
    (a,), _ = t.encode(["a" + " " * 1_000_000 + "b"])
    assert a == [] or sum(len(t.a_bytes[i]) for i in a) == 1_000_003


def test_merge_of_many_pages(monkeypatch):
    monkeypatch.setattr(alignment, "PAGE", 3)
    rng = np.random.default_rng(4)
    runs = [np.unique(rng.integers(0, 90, rng.integers(0, 60))) for _ in range(9)]
    want = Counter()
    for k, r in enumerate(runs):
        want.update({int(p): k + 1 for p in r})
    pairs, counts = alignment.merged([(r, np.full(len(r), k + 1)) for k, r in enumerate(runs)])
    assert list(zip(pairs.tolist(), counts.tolist())) == sorted(want.items())


# 13: whitening

@pytest.mark.parametrize("x", [np.random.default_rng(0).integers(-50, 50, (1000, 5)), np.random.default_rng(1).integers(-2 ** 62, 2 ** 62, (70, 3)),
                               np.full((3, 2), 7), np.array([[-4]])])
def test_bit_sliced_sums_are_exact(x):
    ones = np.concatenate([np.ones((len(x), 1), object), x.astype(object)], axis=1)
    assert (whitening.scatter(x) == ones.T @ ones).all()


def test_limbs():
    for v in (0, -1, 2 ** 130 + 5, -(2 ** 140) + 3):
        assert sum(p << (whitening.LIMB * k) for k, p in enumerate(whitening.limbs(v))) == v


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    m = (rng.normal(0, 1, (300, 6)) @ rng.normal(0, 1, (6, 6))).astype(np.float32)
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(m)] + [(0, [float(e) for e in m[0]]), (None, [float(e) for e in m[1]])]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0])]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows + bad], "vec_id long, embedding array<float>, whitened double").repartition(3)
    got = whitening.whiten(df, components=4).collect()
    x = np.array([[int(np.floor(64 * e)) + 1_000_000 for e in v] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    cov = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    want = (x - s / n) @ vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    deviation = ((n * x - s) ** 2).sum(axis=1)
    assert len(got) == 4 * n and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for k in range(4):
        sign = np.sign(by[5, k + 1][0].whitened * want[5, k])
        for (i, _), v, d in zip(rows, want[:, k], deviation):
            r = by[i, k + 1][0]
            assert r.whitened == pytest.approx(sign * v, abs=1e-9) and r.deviation == d
            assert r.explained == pytest.approx(values[::-1][k] / values.sum()) and r.identity_error < 1e-9
    assert len(by[0, 1]) == 2


def test_whitening_of_equal_huge_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(same) == 4 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in same} == {(None, None, None, 0)}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 1.0])], schema)).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id != 3} == {None} and max(r.identity_error for r in huge) < 1e-3
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
