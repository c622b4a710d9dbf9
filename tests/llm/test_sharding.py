import numpy as np
import pytest

from lockstep.llm import common, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 65_537])
def test_permutation(n):
    rows = np.arange(n)
    places = sharding.permute(rows, n, 42)
    assert sorted(places.tolist()) == rows.tolist()
    assert sharding.restore(places, n, 42).tolist() == rows.tolist()
    if n >= 97:
        assert (places != rows).mean() > 0.9
        assert (places != sharding.permute(rows, n, 43)).mean() > 0.9


def test_shards(spark):
    rows = [(i, i * 3 % 50) for i in range(999)] + [(None, 1)] * 3 + [(7, 7)] * 5000
    df = spark.createDataFrame(rows, "a long, b long")
    got = sharding.shard_rows(df, ["a", "b"], 40).collect()
    assert sorted(((x.a, x.b) for x in got), key=repr) == sorted(rows, key=repr)
    slots = {}
    for x in got:
        slots.setdefault(x.shard, []).append(x.slot)
    sizes = [len(s) for s in slots.values()]
    assert len(slots) == 40 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for x in got[:200]:
        place = int(sharding.permute(np.array([x.row_number]), len(rows), 42)[0])
        assert (x.shard, x.slot) == (place % 40, place // 40)
    other = sharding.shard_rows(df.repartition(7), ["a", "b"], 40).collect()
    assert sorted(map(tuple, other), key=repr) == sorted(map(tuple, got), key=repr)
    assert sharding.shard_rows(df.limit(0), ["a", "b"], 40).collect() == []


def test_numbers_within_groups(spark):
    df = spark.createDataFrame([(i % 3 if i % 3 else None, i // 2) for i in range(300)], "g int, v long")
    numbers, sizes = common.numbered(df, ["v"], within="g", buckets=4)
    held = {}
    for x in numbers.collect():
        held.setdefault(x.g, []).append(x.row_number)
    assert {g: sorted(n) for g, n in held.items()} == {g: list(range(100)) for g in (None, 1, 2)}
    assert {x.g: x.group_rows for x in sizes.collect()} == {None: 100, 1: 100, 2: 100}


def plain_place(x, n, seed):
    """The same permutation in Python's whole numbers."""
    mask = (1 << 64) - 1

    def mixed(v, key):
        v = (v + key) * 0x9E3779B97F4A7C15 & mask
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & mask
        v = (v ^ v >> 27) * 0x94D049BB133111EB & mask
        return v ^ v >> 31

    side = 2
    while side * side < n:
        side += 1
    keys = [mixed(i, seed) for i in range(1, sharding.ROUNDS + 1)]
    while True:
        left, right = divmod(x, side)
        for key in keys:
            left, right = right, (left + mixed(right, key) % side) % side
        x = left * side + right
        if x < n:
            return x


def test_the_query_against_plain_placing(spark, tmp_path):
    import zlib

    texts = [(i, f"text {i % 37}" * (i % 5)) for i in range(300)] + [(None, None), (7, ""), (7, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op3_feistel_shards(spark, str(tmp_path)).collect()
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts), key=repr)
    assert sorted(((x.doc_id, x["size"], x.text_crc32) for x in got), key=repr) == want
    assert sorted(x.row_number for x in got) == list(range(303)) and {(x.law, x.grown_shard) for x in got} == {("rows", None)}
    for x in got:
        place = plain_place(x.row_number, 303, 42)
        assert (x.shard, x.slot) == (place % 40, place // 40)
