import random
import re

import numpy as np
import pandas as pd
import pytest

from lockstep.llm import jaccard_join as jj
from lockstep.operators import graph


def brute(rows, k, p, q):
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
        n = max(len(words) - k + 1, 1) if words else 0
        sets.append({tuple(words[i : i + k]) for i in range(n)})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(s), least.get(find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        at = r.randrange(len(out))
        out[at : at + 1] = r.choice([[], [f"x{r.randrange(10**6)}"], [out[at], f"y{r.randrange(10**6)}"]])
    return out


def corpus(seed, size=240):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = r.choices(vocabulary, k=60)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "one two"), (7, "ONE\x0btwo three")]
    while len(rows) < size:
        base = r.choices(vocabulary, k=r.choice([3, 8, 12, 20, 30, 60, 200, 600, 1500]))
        for _ in range(r.choice([1, 1, 3, 8])):
            words = edited(r, base, r.randrange(0, max(2, len(base) // 25 + 1)))
            if r.random() < 0.2:
                words += passage
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize(("k", "t"), [(3, (9, 10)), (5, (4, 5))])
def test_same_components_as_brute_force(spark, k, t):
    rows = corpus(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.link_components(docs, k=k, t=t).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, k, *t)


@pytest.mark.parametrize(("block", "shingles"), [(8, 1 << 20), (512, 300)])
def test_clusters_of_many_blocks(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", shingles)
    r = random.Random(9)
    base = [f"w{i}" for i in range(70)]
    rows = [(i, " ".join(edited(r, base, r.choice([0, 1, 1, 2, 3])))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.link_components(docs).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(rows, 3, 9, 10)


def test_long_sets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", 30_000)
    r, rows = random.Random(11), []
    for size in (600, 1500, 5000, 20_000):
        base = [f"w{r.randrange(10**6)}" for _ in range(size)]
        # Differences spread out singly and all in one place, on both sides of the threshold.
        for share in (0.0, 0.01, 0.016, 0.0172, 0.0178, 0.02, 0.03):
            words, n = list(base), int(share * size)
            for at in r.sample(range(size), n):
                words[at] = f"x{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
            rows.append((len(rows), " ".join([*base[: size - 3 * n], *(f"y{r.randrange(10**9)}" for _ in range(n))])))
    got = jj.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(rows, 3, 9, 10)
    assert 4 < len({x.component_id for x in got}) < len(rows) - 8


def test_a_group_of_thousands(spark):
    r = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(r, base, 1))) for i in range(5000)] + [(5000 + i, "copy of one text with a few words") for i in range(500)]
    got = jj.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id < 5000, x.component_id) for x in got} == {(True, 0), (False, 5000)} and len(got) == 5500


@pytest.mark.parametrize("chain", [False, True])
def test_meetings_join_each_signature(spark, chain):
    r = random.Random(13)
    held = [(r.randrange(40), r.randrange(300)) for _ in range(1500)] + [(99, i) for i in range(2000)] + [(98, 7)] * 50
    pairs = jj.meetings(spark.createDataFrame(held, "sig long, node long").repartition(7), chain).collect()
    for sig in range(100):
        nodes = {n for s, n in held if s == sig}
        label = {n: n for n in nodes}

        def find(n, label=label):
            while label[n] != n:
                n = label[n]
            return n

        for x in pairs:
            if x.sig == sig:
                label[find(x.a)] = find(x.b)
        assert len({find(n) for n in nodes}) == min(len(nodes), 1)


def test_one_of_each_keeps_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other, third = " ".join(f"v{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(1, text, "a"), (2, text + " more", "b"), (2, other, "c"), (None, text, "d"), (None, third, "e"), (7, third + " end", "f"), (8, None, "g"), (8, None, "h"), (9, " \t", "i"), (3, other, "j"), (1, text, "a"), (1, text, "a")]
    docs = spark.createDataFrame([(*r, 1.5, [2]) for r in rows], "doc_id long, text string, node string, `_id.x` double, _hash array<int>")
    got = jj.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((x.doc_id, x.node) for x in got.collect()), key=repr) == sorted([(1, "a"), (2, "c"), (7, "f"), (8, "g"), (8, "h"), (9, "i")], key=repr)
    assert jj.one_of_each(docs.limit(0)).collect() == []


def test_the_query_itself(spark, tmp_path):
    rows = corpus(8, 60)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = jj.op8_jaccard_join(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows, 3, 9, 10)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, text), (4, text), (4, "other words here now"), (9, "long" * 100_000), (None, "alone in the world")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node long, sig long")
    got = sorted((tuple(r) for r in jj.link_components(docs).collect()), key=repr)
    assert got == brute(rows, 3, 9, 10)
    assert jj.link_components(docs.limit(0)).collect() == []


def test_tree_keeps_every_link():
    r = random.Random(5)
    sets, frame = [], []
    for i in range(90):
        base = sets[r.randrange(len(sets))] if sets and r.random() < 0.6 else {r.randrange(2**63) for _ in range(r.choice([20, 60, 300]))}
        own = {x for x in base if r.random() > 0.03} | {r.randrange(2**63) for _ in range(r.randrange(3))}
        sets.append(own)
        hashes = np.array(sorted(own), np.uint64)
        frame.append({"node": i, "n_shingles": len(own), "root": i, "bits": jj.bitmap(hashes), "shingles": hashes.view(np.int64), "side": 0})
    tree = jj.Tree(pd.DataFrame(frame))
    a, b = (tree.node[k] for k in jj.dual_traversal(tree, tree, (9, 10)))
    got = {(int(x), int(y)) for x, y in zip(a, b, strict=True) if x < y}
    links = {(i, j) for i in range(90) for j in range(i + 1, 90) if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])}
    assert links and links <= got
    assert len(got) < 90 * 89 / 4
    joined = list(jj._tree_links((9, 10))(pd.DataFrame(frame)).itertuples(index=False, name=None))
    assert {tuple(sorted(x)) for x in joined} <= links

    def parts(pairs):
        label = list(range(90))
        for x, y in pairs:
            label = [label[x] if c == label[y] else c for c in label]
        return [label.index(c) for c in label]

    assert parts(joined) == parts(links)


def test_prefixes_of_linked_sets_meet(spark):
    rng = random.Random(5)
    common = [rng.getrandbits(63) for _ in range(30)]
    sets = []
    for _ in range(60):
        own = set(rng.sample(common, rng.randint(0, 30))) | {rng.getrandbits(63) for _ in range(rng.randint(1, 40))}
        sets.append(own)
        for _ in range(rng.randint(0, 2)):
            gone = rng.sample(sorted(own), len(own) // 10)
            sets.append(own - set(gone) | {rng.getrandbits(63) for _ in gone[::2]})
    sets += [set(common), set(common[1:])]
    rows = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in enumerate(sets)], "node long, n_shingles long, shingles array<long>")
    met: dict[int, set[int]] = {}
    for sig, node in jj.prefixes(rows.repartition(5), (4, 5)).collect():
        met.setdefault(node, set()).add(sig)
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(linked) > 20
    assert all(met[a] & met[b] for a, b in linked)
    alone = {i for i in range(len(sets))} - {i for pair in linked for i in pair}
    assert len(alone & set(met)) < len(alone)


def test_common_passage_takes_no_sets_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 4)
    taken, across = [], jj._across
    monkeypatch.setattr(jj, "_across", lambda *a: taken.append(across(*a)) or taken[-1])
    rng = random.Random(3)
    passage = " ".join(f"c{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))) for i in range(120)]
    rows += [(200, rows[7][1] + " end"), (201, rows[70][1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jj.link_components(docs).collect()}
    assert got == {i: {200: 7, 201: 70}.get(i, i) for i, _ in rows}
    assert sum(x.count() for x in taken) == 0


def test_a_traversal_compares_few_pairs_at_a_time(monkeypatch):
    r, rows = np.random.default_rng(2), []
    base = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
    for n in range(300):
        h = np.unique(np.append(base[r.permutation(len(base))[5:]], r.integers(0, 1 << 63, 5).astype(np.uint64)))
        rows.append((n + 1, len(h), n + 1, jj.bitmap(h), h.view(np.int64)))
    tree = jj.Tree(pd.DataFrame(rows, columns=["node", "n_shingles", "root", "bits", "shingles"]))
    small = jj.Tree(pd.DataFrame(rows[:7], columns=["node", "n_shingles", "root", "bits", "shingles"]))
    seen, repeat = [0], np.repeat
    whole = [jj.dual_traversal(x, y, (4, 5)) for x, y in ((tree, tree), (tree, small), (small, tree))]
    monkeypatch.setattr(jj, "PORTION", 64)
    monkeypatch.setattr(np, "repeat", lambda i, n: seen.append(len(i)) or repeat(i, n))
    parts = [jj.dual_traversal(x, y, (4, 5)) for x, y in ((tree, tree), (tree, small), (small, tree))]
    assert max(seen) <= 64 and len(whole[0][0]) > 10_000
    for one, other in zip(whole, parts, strict=True):
        assert len(one[0]) and sorted(zip(*map(list, one), strict=True)) == sorted(zip(*map(list, other), strict=True))


@pytest.mark.parametrize("few", [0, 400_000])
def test_components_of_few_edges_take_no_shuffles(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    plans, kept = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a))
    pairs = [(i, i + 1) for i in range(1, 90)] + [(200, 300), (300, 250), (-5, 200), (400, 400)]
    got = graph.connected(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted([(i, 1) for i in range(1, 91)] + [(i, -5) for i in (-5, 200, 250, 300)])
    assert len(plans) > 2 and all(("Exchange hashpartitioning" in p) == (few == 0) for p in plans[1:])


def test_edges_of_one_group_are_reduced_before_they_step(spark, monkeypatch):
    kept, sizes = graph.written, []

    def counted(df, *a):
        out = kept(df, *a)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    # 60 signatures of 200 nodes, each linked with a first node of its own, and a chain beside them.
    edges = [(s, n) for s in range(60) for n in range(200) if n != s] + [(i, i + 1) for i in range(1000, 1300)]
    random.Random(3).shuffle(edges)
    for kind in ("long", "int"):
        sizes.clear()
        got = graph.connected(spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(3)).collect()
        assert sorted(map(tuple, got)) == [(i, 0) for i in range(200)] + [(i, 1000) for i in range(1000, 1301)]
        assert sizes[0] <= 3 * 500 and len(sizes) == 3
    names = spark.createDataFrame([(f"n{a:04}", f"n{b:04}") for a, b in edges[::7]], "a string, b string")
    assert {r.root for r in graph.connected(names).collect() if r.node < "n1000"} == {"n0000"}


@pytest.mark.parametrize("few", [0, 150, 700])
def test_components_beyond_few_edges(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    r = random.Random(few)
    edges = [(r.randrange(-900, 900), r.randrange(-900, 900)) for _ in range(1100)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for a, b in edges * 2:
        if a != b:
            x, y = label[a], label[b]
            label = {n: min(x, y) if c in (x, y) else c for n, c in label.items()}
    got = graph.connected(spark.createDataFrame(edges, "a long, b long").repartition(6, "b")).collect()
    assert sorted(map(tuple, got)) == sorted(label.items()) and len(set(label.values())) > 3


def test_small_clusters_are_divided_too(spark, monkeypatch):
    seen, own = [], jj.prefixes
    monkeypatch.setattr(jj, "prefixes", lambda sets, t: seen.append(sets.count()) or own(sets, t))
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(6)] + [(9, "alone in the world")]
    got = jj.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 9, 10) and seen == [6]
