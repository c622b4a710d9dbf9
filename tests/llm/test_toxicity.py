import random
import zlib

import numpy as np
import pytest

from lockstep.llm import toxicity


def words(r, n):
    return [f"w{r.randrange(10**5)}" for _ in range(n)]


def units(text):
    """The symbols of each word (its ends as None) and its stretches: a plain reading of the rules."""
    for word in text.lower().split():
        core = word.strip(toxicity._PUNCTUATION)
        if core:
            yield core


def plain_grams(core):
    """(place, row) of a word's subwords, each by Python's own whole numbers."""
    mask, by = (1 << 32) - 1, [int(x) for x in toxicity._BY_PLACE]

    def row(h):
        return ((h ^ h >> 15) * 0x9E3779B1 & mask) >> 14

    whole = 0
    for i, c in enumerate(core):
        h = (ord(c) + 1 + i * by[-1]) * by[-2] & mask
        whole += (h ^ h >> 13) * 0x9E3779B1 & mask
    symbols = [0, *map(ord, core), 0]
    out = [(0, row(whole & mask))]
    for n in toxicity.NGRAMS:
        for i in range(len(symbols) - n + 1):
            out.append((i, row(sum((symbols[i + j] + 1) * by[j] for j in range(n)) & mask)))
    return out


def plain_score(text, model):
    total, n = np.zeros(toxicity.DIM), 0
    for core in units(text or ""):
        held = {}
        for place, row in plain_grams(core):
            held.setdefault(max(place - 1, 0) // toxicity.STRETCH, []).append(model.vectors[row].astype(float))
        for vectors in held.values():
            total += np.mean(vectors, axis=0)
            n += 1
    z = total / max(n, 1) @ model.softmax + model.bias
    return 1 / (1 + np.exp(z[0] - z[1]))


def odd_texts():
    r = random.Random(2)
    texts = ["", None, "a", "ab!", "...", "- x -", "Ünï, (códe)", "日本語のテキスト\u3000です", "x" * 64, "x" * 65, "y" * 200, "#tag's_end", "\t\n a\x1fb\u2003c ", "🙂 🙂🙂"]
    return texts + ["".join(r.choice("abcdé .,日\n_-") for _ in range(r.randrange(1, 400))) for _ in range(30)]


def random_model(seed=1):
    r = np.random.default_rng(seed)
    return toxicity.Model(r.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)), r.normal(0, 1, (toxicity.DIM, 2)), np.array([0.2, -0.1]))


@pytest.mark.parametrize("chunk", [1 << 19, 100])
def test_scores_agree_with_a_plain_forward_pass(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    model = random_model()
    texts = [t for t in odd_texts() if chunk > 100 or max((len(w) for w in (t or "").split()), default=0) < 60]
    scorer = toxicity.Scorer(*model.margins())
    want = [plain_score(t, model) for t in texts]
    assert np.allclose(scorer.scores(texts), want, atol=1e-5)
    assert np.allclose([scorer.score(t) for t in texts], want, atol=1e-5)
    for t, x in zip(texts, want, strict=True):
        rows, share = toxicity.bag(t)
        z = (model.vectors[rows] * share[:, None]).sum(0) @ model.softmax + model.bias
        assert np.isclose(1 / (1 + np.exp(z[0] - z[1])), x, atol=1e-5)


def test_pieces_hold_every_gram(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    r = random.Random(3)
    for text in ("ab" * 200, "".join(r.choice("abc   ") for _ in range(500)), "x" * 49 + " " * 60 + "y" * 51):
        got = toxicity.pieces(text)
        assert all(len(p) <= 50 for p in got)
        grams = {w[i : i + 6] for w in text.split() for i in range(len(w) - 5)}
        assert grams <= {w[i : i + 6] for p in got for w in p.split() for i in range(len(w) - 5)}
        if max(map(len, text.split())) < 50:
            assert " ".join(got).split() == text.split()


def test_learns_stems(spark):
    r = random.Random(4)
    good = [" ".join(words(r, 40)) for _ in range(200)]
    bad = [" ".join([*words(r, 38), r.choice(["blarg", "zuffle"]) + r.choice(["s", "ed", "er"]), "blargs"]) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "x", 2.0) for i, t in enumerate([*good, *bad])] + [(900, None, "x", 2.0), (901, "", "x", 2.0), (902, "!!! ...", "x", 2.0), (None, "blarg", "x", None), (5, "repeated id", "x", 2.0)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, int(i >= 200), 1) for i in range(400)] + [(None, 1, 1), (900, None, 1), (5, 7, 1), (6, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    got = {(x.doc_id, x.text): x.score for x in toxicity.score_toxicity(docs, model, ["doc_id", "text", "score"]).collect()}
    assert len(got) == 405
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i, [*good, *bad][i]] >= 0.5) == (i >= 200) for i in held]) > 0.95
    assert got[900, None] == got[901, ""] == got[902, "!!! ..."] < 0.6
    seen = toxicity.Scorer(*model.margins())
    assert seen.score(good[0] + " blarging") > seen.score(good[0] + " walking")  # an unseen form of a known stem
    assert toxicity.score_toxicity(docs.limit(0), model, ["doc_id"]).collect() == []
    assert toxicity.fit(docs, labels.limit(0)).margins()[1] < 0
    assert toxicity.fit(docs, labels.filter("toxic = 1")).margins()[1] > 0
    few = toxicity.fit(docs, labels, sample=20, sample_bytes=3000)
    assert 0 < np.count_nonzero(few.vectors.any(1)) < np.count_nonzero(model.vectors.any(1))


def test_every_row_that_was_seen_has_a_vector():
    r = random.Random(5)
    bags = [toxicity.bag(" ".join([*words(r, 30), "blarg" if i % 2 else "fine"])) for i in range(60)]
    model = toxicity.train(bags, [i % 2 for i in range(60)])
    seen = np.unique(np.concatenate([b[0] for b in bags]))
    evident = toxicity.evidence(bags, np.array([i % 2 for i in range(60)])) > 0
    assert set(np.flatnonzero(model.vectors.any(1))) <= set(seen) and model.vectors[np.flatnonzero(evident)].any(1).mean() > 0.99


def test_long_words_are_read_whole():
    r = random.Random(7)
    joined = lambda n, mark: mark.join(words(r, n))
    for mark in ("_", "/", ","):
        bad = [f"{joined(40, mark)}{mark}blarg{mark}{joined(1 + r.randrange(40), mark)}" for _ in range(100)]
        good = [f"{joined(40, mark)}{mark}walks{mark}{joined(1 + r.randrange(40), mark)}" for _ in range(100)]
        model = toxicity.train([toxicity.bag(t) for t in good[:60] + bad[:60]], [0] * 60 + [1] * 60)
        scorer = toxicity.Scorer(*model.margins())
        assert np.mean([x < 0.5 for x in scorer.scores(good[60:])] + [x >= 0.5 for x in scorer.scores(bad[60:])]) > 0.9


def test_the_query_itself(spark, tmp_path):
    r = random.Random(9)
    docs = [(i, " ".join([*words(r, 30), "blarg" if i % 2 else "fine"])) for i in range(300)] + [(None, "blarg"), (300, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 302 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    assert np.mean([x.predicted == x.doc_id % 2 for x in got if x.held_out and x.doc_id < 300]) > 0.95
