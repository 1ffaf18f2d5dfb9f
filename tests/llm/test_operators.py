"""The training-data operators on awkward small inputs, by brute force, by round trips, and on held-out rows."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from wardgrid.llm import chat, decontaminate, extract, fingerprint, language, mixing, neardup, pii, quality, queries, repeats
from wardgrid.llm.bytesets import shingle_sets

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=str)
    want = con.execute(queries.ORACLES[name])
    order = sorted(range(len(cols)), key=lambda i: want.description[i][0])
    assert [want.description[i][0] for i in order] == cols
    assert got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


# 1: near-duplicates

def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_edges(docs, no_docs):
    got = by_id(neardup.link_components(docs, 4), "n_shingles", "component_id", "kept")
    assert got == brute_components({(i, t) for i, t, *_ in ROWS if i is not None}, 4)
    assert neardup.link_components(no_docs).count() == 0
    kept = neardup.deduplicate(docs, 4)
    assert kept.columns == docs.columns and kept.count() == 10          # 2, 3, 9 and 12 go; the row without an id and both rows of 7 stay


def test_near_duplicates_are_proposed_by_one_byte_a_token(spark):
    """The joins carry `sketch`, a quarter of `tokens`."""
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, text.replace("word", "other")), (4, "")], "doc_id long, text string")
    rows = neardup.profiles(df, 4)
    assert {(len(r.tokens), len(r.sketch)) for r in rows.where("n > 0").collect()} == {(4 * neardup.POSITIONS, neardup.POSITIONS)}
    cells = rows.where("n > 0").select(F.lit(7).cast("long").alias("node"), F.lit(0).alias("block"), "doc_id", "n", "sketch")
    assert [tuple(r) for r in neardup.proposals(cells, 1).distinct().collect()] == [(7, 1, 2, False)]


def test_near_duplicates_send_whole_sets_only_of_candidates(spark):
    """Of a cell, the rows with a similar one of another component: not those that are like none, nor like their own component only."""
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, text), (2, text + " end"), (3, text + " more"), *[(i, text.replace("word", f"w{i}x")) for i in range(4, 40)]]
    members = neardup.profiles(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    component = F.when(F.col("doc_id") < 3, 1).when(F.col("doc_id") > 37, 38).otherwise(F.col("doc_id")).cast("long")
    cells = members.select(F.lit(7).cast("long").alias("node"), F.lit(0).cast("long").alias("cell"), (component != 1).alias("minor"),
                           component.alias("component"), "doc_id", "n", "sketch")
    assert sorted((r.doc_id, r.component, r.minor) for r in neardup.candidates(cells, 2).collect()) == [(1, 1, False), (2, 1, False), (3, 3, True)]
    assert neardup.candidates(cells.where("doc_id != 3"), 2).count() == 0


def test_near_duplicates_compare_a_pair_in_one_node_only(spark):
    """Rows that only share pairs with an earlier node, or that another cell of the node has, are no candidates: their sets are not sent again."""
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(i, f"{text} end{i}") for i in range(1, 5)]
    members = neardup.profiles(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    places = spark.createDataFrame([(7, 0, i, i > 1, []) for i in (1, 2, 3)] + [(9, 0, i, i > 1, [7] if i < 4 else []) for i in (1, 2, 4)]
                                   + [(11, 0, i, i > 1, [7, 9]) for i in (1, 2)] + [(13, -2, i, True, []) for i in (3, 4)],
                                   "node long, cell long, doc_id long, minor boolean, before array<long>")
    near = neardup.candidates(places.withColumn("component", F.col("doc_id")).join(members.select("doc_id", "n", "sketch"), "doc_id"), 2)
    assert sorted((r.node, r.doc_id) for r in near.collect()) == [(7, 1), (7, 2), (7, 3), (9, 1), (9, 2), (9, 4)]
    sets = neardup.shingle_table(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    links = sorted(tuple(sorted(r)) for r in neardup.crossing(near.join(sets, "doc_id"), 2).collect())
    assert len(links) == 4 and {x for pair in links for x in pair} == {1, 2, 3, 4}      # two in each node: its components become one


def test_near_duplicates_of_large_nodes(spark, monkeypatch):
    """A crowd of near-copies, larger than a node, with strays that link to one or none of them."""
    monkeypatch.setattr(neardup, "NODE_DOCS", 16)
    monkeypatch.setattr(neardup, "CELL_DOCS", 8)
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 5), replace=False):
            w[at] = f"e{i}_{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(neardup.link_components(df, 4), "n_shingles", "component_id", "kept") == brute_components(rows, 4)


def test_components_of_scattered_links(spark, monkeypatch):
    from wardgrid.llm import graph
    monkeypatch.setattr(graph, "TASK_LINKS", 40)
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 450)] + [(7, 7)]
    root = list(range(500))
    for _ in range(500):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert got == {i: root[i] for i in {x for a, b in links for x in (a, b) if a != b}}


def test_shingle_sets_count_words_by_bytes():
    import pyarrow as pa
    texts = ["a b c d e", "A B\tC D\x0bE", "", None, "a b", "é x y z w v", "one " * 50]
    sizes = [len(s) for s in shingle_sets(pa.array(texts), 4)]
    assert sizes == [len(shingles(t, 4)) for t in texts]
    a, b, *_ = shingle_sets(pa.array(texts), 4)
    assert (a == b).all()


# 2: language

def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    tagger = language.Tagger(["a", "b"])
    for gru in (tagger.ahead, tagger.back):
        for name in ("x", "u", "c"):
            setattr(gru, name, getattr(gru, name).astype(np.float64))
    tagger.out, tagger.bias = tagger.out.astype(np.float64), tagger.bias.astype(np.float64)
    data, label = rng.integers(97, 100, (6, 3)).astype(np.uint8), np.array([0, 1, 1])

    def loss():
        p = tagger.probabilities(data)
        return -np.log(p[:, np.arange(3), label]).mean()
    for w, g in zip(tagger.weights(), tagger.step(data, label), strict=True):
        at = (97, 3) if w.shape[0] == 256 else tuple(0 for _ in w.shape)
        old = w[at]
        w[at] = old + 1e-3
        up = loss()
        w[at] = old - 1e-3
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 1e-3


@needs_data
def test_language_of_held_out_rows(spark, docs, no_docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    tagger = language.learned(d)
    got = language.predict(d, tagger).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    edge = language.predict(docs, tagger).collect()
    assert len(edge) == len(ROWS)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in edge if r.doc_id in (4, 5, 6))
    assert language.identify(no_docs).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


# 3: mixing

def test_schedule_deviates_by_less_than_a_block():
    parts = mixing.shares({"a": 5.5, "b": 3.1, "c": 1.0, "d": 0.01}, 1000)
    assert sum(parts.values()) == 1000
    seen = Counter()
    rows = sorted(mixing.period(parts), key=lambda r: r[2])
    assert [r[2] for r in rows] == list(range(1000))
    for t, (s, j, _) in enumerate(rows, 1):
        assert seen[s] == j and j * 1000 // parts[s] < t <= -(-(j + 1) * 1000 // parts[s])      # between release and deadline
        seen[s] += 1
        assert all(abs(seen[x] - parts[x] * t / 1000) < 1 for x in parts)


def test_mix_places_every_row_once(docs, no_docs):
    got = mixing.mix(docs, {"a": 2, "b": 1, "": 1}, block_docs=2).collect()
    assert len(got) == len(ROWS) and len({r.mix_position for r in got}) == len(ROWS)
    assert {r.source for r in got} == {"a", "b", "c", "", None}
    parts = mixing.shares({"=a": 2, "=b": 1, "=c": 1, "=": 1, "null": 1}, 1000)
    slot = {(s, j): t for s, j, t in mixing.period(parts)}
    for name in ("a", "b", "c"):
        mine = sorted(r.mix_position for r in got if r.source == name)
        assert mine == [slot[f"={name}", k // 2] * 2 + k % 2 for k in range(len(mine))]
    assert mixing.mix(no_docs).count() == 0 and mixing.mix(docs, {"a": 1}).columns.count("mix_slot") == 1
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs, ticks=4)


@pytest.mark.parametrize("weights, bound", [
    ({"a": 0.7, "b": 0.2, "c": 0.1}, 1), ({"a": 1, "b": 1, "c": 1, "d": 0.004}, 2),
    ({f"s{i:03}": 1.0 if i else 10.05 for i in range(200)}, 2), ({f"s{i:03}": 1 + i % 7 for i in range(700)}, 2)])
def test_schedule_keeps_to_the_given_weights_over_rounds(weights, bound):
    whole, ticks = mixing.rounds(weights)
    share = np.array(list(weights.values())) / sum(weights.values())
    seen = np.zeros(len(weights))
    at = {s: k for k, s in enumerate(weights)}
    for number in range(7):
        rows = sorted(mixing.placed(whole, ticks, dict.fromkeys(weights, 10 ** 9), number), key=lambda r: r[2])
        assert [r[2] for r in rows] == list(range(number * ticks, (number + 1) * ticks))
        for s, j, t in rows:
            assert seen[at[s]] == j
            seen[at[s]] += 1
            assert np.abs(seen - share * (t + 1)).max() < bound + 1e-6


def test_mix_of_many_sources_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TASK_BLOCKS", 500)
    got = mixing.mix(spark.range(9000).selectExpr("id as doc_id", "concat('s', if(id % 3 = 0, 0, id % 700)) as source"), block_docs=1).collect()
    assert len(got) == len({r.mix_position for r in got}) == 9000
    n = Counter(r.source for r in got)
    root = sum(x ** 0.5 for x in n.values())
    for k, slot in enumerate(sorted(r.mix_slot for r in got if r.source == "s0"), 1):
        assert abs(k - n["s0"] ** 0.5 / root * (slot + 1)) < 2


# 4: decontamination

def test_contamination_by_size(spark):
    """Items of every size partition at the threshold and one shingle below it."""
    docs, items, expected = [], [], {}
    for number, size in enumerate([1, 4, 7, 8, 10, 15, 16, 17, 31, 32, 40, 63, 64, 100, 500, 511, 512, 700, 1500]):
        words = [f"w{number}x{i}" for i in range(size + 4)]
        items.append((number, " ".join(words)))
        need = -(-size * 80 // 100)
        for doc, held in ((2 * number, need), (2 * number + 1, need - 1)):
            part = words[size - held:] if held else words[:4]
            docs.append((doc, " ".join(["before"] * 9 + part + ["after"] * 9)))
        expected[2 * number, number] = (size, need)
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                      spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in got.collect()} == expected


def test_size_partitions_keep_items_at_the_threshold():
    for percent in (50, 80, 95, 100):
        parts = decontaminate.plan(percent)
        assert len({m for m, _ in parts}) >= (2 if percent == 100 else 3)
        for size in range(1, 2000):
            minima, hits = parts[min(size.bit_length(), len(parts)) - 1]
            if minima:
                assert minima <= size and decontaminate.short_of(size, minima, hits, percent) <= decontaminate.MISS


def test_contamination(spark, docs, no_docs):
    item = " ".join(ROWS[0][1].split()[10:40])
    bench = spark.createDataFrame([(1, item.upper() + "!"), (2, "one two"), (3, None), (4, ""), (None, item), (5, item), (6, "not in any of the documents at all")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(d, i): (26, 26) for d in (1, 2, 3) for i in (1, 5)} | {(d, 2): (1, 1) for d in (7, 12)}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 8, 9, 10, 11]
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_containment_threshold_is_exact(spark):
    words = [f"q{i}" for i in range(104)]                                          # 100 shingles
    docs = spark.createDataFrame([(k, " ".join(words[:4 + k])) for k in (79, 80, 81)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {r.doc_id: r.n_shared for r in decontaminate.contamination(docs, bench).collect()} == {80: 80, 81: 81}


# 5: pages

PAGES = {
    "<html><head><title>T</title><script>var a='</p>';</script><style>p{}</style></head><body><nav><ul><li><a href=/x>Home</a></li><li><a href=/y>News</a></li></ul></nav>"
    "<div class=\"ad\">Buy this now today.</div><article><h1>The  title &amp; more</h1><p>First\n paragraph of the text &eacute; here.<p><b>Second one, bold.<br></article>"
    "<footer>&copy; someone &middot; all rights</footer></body></html>": "The title & more First paragraph of the text é here. Second one, bold.",
    "<body><header><div class=\"logo\">Site name</div></header><main><h1>Heading here</h1><p>A paragraph of the story, long enough to read.</p></main>"
    "<aside class=\"sidebar\"><p>Most read stories of the week</p></aside><section id=\"comments\"><div class=\"comment\"><p>I do not agree with this at all.</p></div></section>"
    "<form class=\"search\"><label>Search</label><input></form></body>": "Heading here A paragraph of the story, long enough to read.",
    None: "", "": "", "<nav><a href=/>Home</a></nav>": "",
}


def test_main_text(spark):
    sample = spark.createDataFrame([(1, "u", h, "x") for h in PAGES] * 2, "page_id long, url string, html string, text string")
    labeller = extract.Labeller().fit(extract.layouts([" ".join(f"lorem{i * k} ipsum{k}" for i in range(30)) + "." for k in range(40)]))
    got = extract.extract(sample, labeller).collect()
    assert sorted(r.text for r in got) == sorted(list(PAGES.values()) * 2) and all(r.n_chars == len(r.text) for r in got)
    assert extract.extract(sample.limit(0)).count() == 0


def test_head_without_end_tag():
    for html in ("<html><head><title>t</title><body><p>the text</p></body></html>", "<head><title>t</title><p>the text",
                 "<head><title>t</title><script>x</script>the text", "<head><noscript><img></noscript><meta><body><p>the text",
                 "<head><title>t</title></head><body><p>the text</p>"):
        assert [b[0] for b in extract.blocks(html)] == ["the text"]
    assert extract.blocks("<head><template><p>not shown</p></template></head>") == []


def test_features_of_whole_blocks():
    text = " ".join(["w"] * 40 + ["advertisement"] + ["w"] * 40)
    words = extract.features([(text, ("div",), 0.0)])[1][0]
    assert words[extract.hashed("advertisement", extract.WORDS)] == pytest.approx(1 / 81)
    names = " ".join(["px", "mt", "flex", "grid"] * 5 + ["sidebar"])
    assert ".sidebar" in extract.blocks(f'<div class="{names}">text</div>')[0][1]


# 6: fingerprints

def test_fingerprints(docs, no_docs):
    got = fingerprint.edited_fingerprints(docs).collect()
    rows = sorted((i, t or "") for i, t, *_ in ROWS if i is not None)
    at = {r.doc_id: r for r in got}
    want = [(i, len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + following[:len(t) // 2]).encode()).hexdigest())
            for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True)]
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert at[1].fingerprint == at[2].fingerprint and at[1].near_next == 1.0 and at[5].fingerprint == "" and at[5].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 for r in got)
    assert fingerprint.edited_fingerprints(no_docs).count() == 0


def test_collision_rate_is_generalised_jaccard(spark):
    a, b = Counter({f"w{i}": 1 + i % 5 for i in range(40)}), Counter({f"w{i}": 1 + i % 3 for i in range(15, 60)})
    exact = sum((a & b).values()) / sum((a | b).values())
    df = spark.createDataFrame([(k, " ".join(c.elements())) for k, c in enumerate((a, b))], "k int, text string")
    x, y = (np.array(r.sig) for r in fingerprint.signatures(df, ["k"], samples=200).orderBy("k").collect())
    assert abs((x == y).mean() - exact) < 4 * (exact * (1 - exact) / 200) ** 0.5


def test_likeness_at_the_samples_of_the_query(spark):
    rng = np.random.default_rng(5)
    rows, exact = [], []
    for pair in range(120):
        # shared words with other counts, and words of one side
        a, b = Counter(), Counter()
        for i in range(60):
            n = int(rng.integers(1, 6))
            a[f"p{pair}w{i}"] = n if i < 50 else 0
            b[f"p{pair}w{i}"] = n * int(rng.integers(1, 3)) if i >= 10 else 0
        exact.append(sum((a & b).values()) / sum((a | b).values()))
        rows += [(pair, 0, " ".join(a.elements())), (pair, 1, " ".join(b.elements()))]
    sig = fingerprint.signatures(spark.createDataFrame(rows, "pair int, side int, text string"), ["pair", "side"])
    both = sig.where("side = 0").selectExpr("pair", "sig as a").join(sig.where("side = 1").selectExpr("pair", "sig as b"), "pair")
    got = np.array([r.near for r in both.select("pair", fingerprint.likeness("a", "b").alias("near")).orderBy("pair").collect()])
    error = got - np.array(exact)
    assert abs(error.mean()) < 4 * 0.5 / (fingerprint.SAMPLES * len(got)) ** 0.5
    assert (error ** 2).mean() ** 0.5 < 0.08       # sqrt(j (1 - j) / 48) is 0.072 at most


# 7: quality

@needs_data
def test_quality_of_unseen_rows(spark, docs, no_docs):
    d, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.learned(d, marks, labelled=260)
    seen = [r[0] for r in marks.orderBy(F.xxhash64("doc_id", F.lit(77)), "doc_id").limit(260).select("doc_id").collect()]
    rest = quality.scored(d, model).join(marks, "doc_id").where(~F.col("doc_id").isin(seen)).toPandas()
    assert ((rest.quality == 1) == rest.keep).mean() > 0.9
    edge = quality.scored(docs, model)
    assert edge.count() == len(ROWS) and edge.columns.count("keep") == 1 and edge.where("quality_score between 0 and 1").count() == len(ROWS)
    assert quality.good(docs, marks.limit(0)).count() == len(ROWS)
    assert quality.classify(no_docs, marks).count() == 0


def test_surest_rows_come_from_all_documents(spark):
    # beyond 2,500 rows, and with many copies of the surest one
    rows = [(i, -3.0 - i / 10_000, 0.0) for i in range(6000)] + [(10_000 + i, 9.0, 2.5) for i in range(300)] + [(20_000, 8.0, 1.0)]
    got = {tuple(r) for r in quality.surest(spark.createDataFrame(rows, "doc_id long, o0 double, o1 double"), 0.5, 4).collect()}
    assert got == {(5999, 0, 1), (5998, 0, 1), (10_000, 1, 1), (20_000, 1, 1), (10_000, 1, 0)}


# 8: repeats

def brute_repeats(rows):
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            s = t[p:p + 50]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("block_bytes", "wide"), [(500, 64), (500, 1), (8 << 20, 64)])
def test_repeats(docs, no_docs, spark, monkeypatch, block_bytes, wide):
    monkeypatch.setattr(repeats, "WIDE_BLOCKS", wide)
    rng = np.random.default_rng(2)
    rows = [(i, t) for i, t, *_ in ROWS if i not in (None, 8, 9)] + [(8, "ab" * 300), (9, "ab" * 200 + "é" * 60)]
    passage = "".join(chr(97 + k) for k in rng.integers(0, 26, 200))
    for i in range(20, 45):
        fill = "".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(0, 120)))
        lo = rng.integers(0, 150)
        rows.append((i, fill + passage[lo: lo + rng.integers(40, 120)] + fill[::-1] + (passage if i % 3 == 0 else "")))
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes)
    assert sorted(map(tuple, got.collect())) == brute_repeats([(i, (t or "").encode()) for i, t in rows])
    assert repeats.without_repeats(no_docs).count() == 0


# 9: personal data

def test_pseudonyms_keep_format_links_and_can_be_undone(spark, docs, no_docs):
    values = ["4111111111111111", "4111 1111 1111 1111", "1234567890123456789", "12.34.56.78", "255.0.0.255", "+1 (017) 555-7713", "555-123-4567", "2024-02-29", "31/12/1999",
              "01.01.2000", "123-45-6789"]
    secret = ["jo.doe@mail.example.com", "0123456789abcdef0123456789abcdef01234567"]
    clean = ["no data", "Version 2.0.", "300.1.2.3", "2023-02-30", "12:30", "page 12 of 2024", ""]
    text = [f"a {v} b, {v}." for v in values + secret] + clean + [None]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(text)], "doc_id long, text string, n_chars long")
    hidden = pii.pseudonymise(df, "k")
    out = by_id(hidden, "text")
    for i, v in enumerate(values + secret):
        m = re.fullmatch(r"a (.*) b, (.*)\.", out[i][0])
        assert m[1] == m[2] and m[1] != v
        if v in values:
            assert re.sub(r"\d", "9", m[1]) == re.sub(r"\d", "9", v) or v.count(".") == 3
    luhn = [int(c) for c in re.sub(r"\D", "", out[0][0].split(" b")[0])][::-1]
    assert sum(luhn[::2]) + sum(x * 2 - 9 * (x > 4) for x in luhn[1::2]) == sum(luhn[::2]) + sum(sum(divmod(2 * x, 10)) for x in luhn[1::2])
    assert (sum(luhn[::2]) + sum(sum(divmod(2 * x, 10)) for x in luhn[1::2])) % 10 == 0
    assert [out[len(values) + len(secret) + k][0] for k in range(len(clean))] == clean and out[len(text) - 1][0] is None
    back = by_id(pii.pseudonymise(hidden, "k", undo=True), "text")
    assert [back[i][0] for i in range(len(values))] == text[: len(values)]
    assert out != by_id(pii.pseudonymise(df, "other key"), "text")
    assert sorted(map(str, pii.pseudonymise(docs).collect())) == sorted(map(str, docs.collect())) and pii.pseudonymise(no_docs).count() == 0


def test_pseudonyms_are_a_short_expression():
    """Rounds written out one inside another made 24,777 characters, for which the driver's parser kept 90 MB and touched 300."""
    for undo in (False, True):
        assert len(pii.pseudonym("k", undo)) < 12_000


def test_feistel_keeps_its_values_and_can_be_undone(spark):
    """The rounds by hand."""
    left, right, want = 17, 11, []
    for x in range(left * right):
        a, b = divmod(x, right)
        for k in range(pii.ROUNDS):
            of = int(hashlib.sha256(f"k'|t|{k}|{a if k % 2 else b}".encode()).hexdigest()[:12], 16)
            a, b = (a, (b + of) % right) if k % 2 else ((a + of) % left, b)
        want.append(a * right + b)
    there = pii.feistel("id", "17", "11", "t", "k'")
    rows = spark.range(left * right).select("id", F.expr(there).alias("y")).withColumn("back", F.expr(pii.feistel("y", "17", "11", "t", "k'", undo=True)))
    assert sorted(tuple(r) for r in rows.collect()) == [(i, y, i) for i, y in enumerate(want)]


def test_feistel_is_a_permutation(spark):
    got = spark.range(17 * 11).select(F.expr(pii.feistel("id", "17", "11", "t", "k")).alias("y")).collect()
    assert sorted(r.y for r in got) == list(range(17 * 11))


# 10: chat

def test_rotation(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "", "who"), (1, None, "ann", "early"), (2, 0, "system", "alone"),
             (None, 0, "ann", "lost"), (3, 5, None, "x")]
    df = spark.createDataFrame([(*t, "extra", 1) for t in turns], "conv_id long, turn long, role string, text string, perspective string, seq int")
    for slice_turns in (1, 64):
        got = chat.rotate(df, slice_turns).collect()
        assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "unknown")}
        for conv, who in {(r.conv_id, r.perspective) for r in got}:
            mine = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, who)), key=lambda r: r.seq)
            assert [r.seq for r in mine] == list(range(len(mine)))
            whole = "".join(r.segment for r in mine)
            assert [whole[r.start:r.stop] for r in mine] == [r.segment for r in mine]
            assert all((r.role == "assistant") == r.trained for r in mine)
            assert all(whole[r.mask_start:r.mask_stop] == r.segment.split("\n", 1)[1][:-1] for r in mine)
    ann = sorted((r for r in got if (r.conv_id, r.perspective) == (1, "ann")), key=lambda r: r.seq)
    assert [r.segment for r in ann] == [
        "<|im_start|>assistant\nearly<|im_end|>\n", "<|im_start|>system\nBe kind.<|im_end|>\n", "<|im_start|>assistant\nHi<|im_end|>\n",
        "<|im_start|>user name=bob\n<|im_end|>\n", "<|im_start|>user name=bob\n<|im_end|>\n", "<|im_start|>user name=unknown\nwho<|im_end|>\n"]
    assert chat.rotate(df.limit(0)).count() == 0


# the pipeline

@needs_data
def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    start = spark.read.parquet(f"{SF}/documents.parquet")
    final = corpus_pipeline.run(spark, SF)
    assert set(start.columns) < set(final.columns) and 0 < final.count() < start.count()
    assert final.select("mix_position").distinct().count() == final.count()
    assert decontaminate.contamination(final, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns or set(stage(spark, docs, SF).columns) == set(docs.columns) - {"keep"}
