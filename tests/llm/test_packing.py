import itertools
import random

import numpy as np

from lockstep.llm import packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_bounds_are_best():
    r = random.Random(1)
    for _ in range(150):
        lengths = sorted(r.sample(range(50), r.randrange(1, 12)))
        counts = [r.randrange(1, 20) for _ in lengths]
        k = r.randrange(1, 5)
        got = packing.best_bounds(np.array(lengths), np.array(counts), k)
        least = min(padding(lengths, counts, [*some, lengths[-1]]) for n in range(k) for some in itertools.combinations(lengths[:-1], min(n, len(lengths) - 1)))
        assert len(got) <= k and padding(lengths, counts, got) == least


def test_batches(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 9, 40, 41, 300]))) for i in range(500)] + [(None, None), (None, ""), (7, "w"), (7, "w"), (9, "w " * 900)]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, bucket string, slot long")
    out = packing.pack(docs, buckets=3, budget=200).collect()
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_tokens) for x in out) == sorted((i if i is not None else -1, len((t or "").split())) for i, t in rows)
    batches = {}
    for x in out:
        assert x.padding == x.padded_to - x.n_tokens >= 0
        batches.setdefault((x.bucket, x.batch), []).append(x)
    for (bucket, batch), held in batches.items():
        assert sorted(x.slot for x in held) == list(range(len(held)))
        assert len({x.padded_to for x in held}) == 1
        assert len(held) == 1 or len(held) * held[0].padded_to <= 200 or held[0].padded_to == 0
    assert any([x.n_tokens for x in held] == [900] for held in batches.values()) or max(x.padded_to for x in out) == 900
    assert packing.pack(docs.limit(0)).collect() == []


def test_many_lengths():
    r = np.random.default_rng(3)
    lengths = np.unique(r.integers(0, 10**7, 60_000))
    counts = r.integers(1, 50, len(lengths))
    bounds = packing.best_bounds(lengths, counts, 12)
    assert len(bounds) == 12 and bounds[-1] == lengths[-1]

    def of(bounds):
        return int((counts * (np.array(bounds)[np.searchsorted(bounds, lengths)] - lengths)).sum())

    least = of(bounds)
    for k in range(11):
        for move in (-1, 1):
            at = np.searchsorted(lengths, bounds[k]) + move
            assert of(sorted({*bounds[:k], int(lengths[at]), *bounds[k + 1 :]})) >= least


def test_given_lengths_and_the_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, 3, "a b"), (2, None, None), (3, 70_000, "x"), (None, 3, "")], "doc_id long, ids_n int, text string")
    got = {(x.doc_id, x.n_tokens) for x in packing.pack(docs, length=docs["ids_n"]).collect()}
    assert got == {(1, 3), (2, 0), (3, 70_000), (None, 3)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.op7_packing(spark, str(tmp_path))
    assert sorted((x.n_tokens, x.padding) for x in out.collect()) == [(0, 0), (0, 0), (1, 0), (2, 0)]
