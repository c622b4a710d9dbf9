import random

import pytest

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    r = random.Random(6)

    def words(n):
        return [f"w{r.randrange(10**5)}" for _ in range(n)]

    passage = words(70)
    rows = [(i, " ".join(words(60))) for i in range(200)]
    rows += [(200 + i, " ".join([*words(40), r.choice(["blarg", "zuffles"]), "blargs"])) for i in range(200)]
    near = words(120)
    rows += [(400, " ".join(near)), (401, " ".join([*near, "more"])), (402, " ".join(near)), (403, " ".join([*words(30), *passage])), (404, " ".join([*passage, *words(30)]))]
    rows += [(405, None), (406, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = docs
    left = []
    for name, stage in pipeline.STAGES:
        held = stage(spark, held, str(tmp_path))
        held.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert held.columns == docs.columns
        left.append({x.doc_id for x in held.select("doc_id").collect()})
    clean = set(range(200)) | {400, 401, 402, 403, 404, 405, 406}
    assert len(clean - left[0]) <= 4 and len(left[0] - clean) <= 10
    assert left[0] - left[1] == {401, 402}
    assert left[1] == left[2] == left[3]
    text = {x.doc_id: x for x in spark.read.parquet(f"{tmp_path}/substring_dedup").collect()}
    assert len(text[404].text) < 0.6 * len(dict(rows)[404]) and text[404].n_chars == len(text[404].text)
    assert text[403].text == dict(rows)[403]
    assert pipeline.run(spark, str(tmp_path)).count() == len(left[3])


@pytest.fixture
def tables(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, " ".join([*(f"w{r.randrange(10**5)}" for _ in range(40)), "blarg" if i % 2 else "fine"])) for i in range(120)]
    spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, str(tmp_path)


def through(spark, docs, sf_dir):
    out = []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{sf_dir}/odd-{name}")
        docs = spark.read.parquet(f"{sf_dir}/odd-{name}")
        out.append(docs)
    return out


def test_repeated_ids_nulls_and_clashing_columns(spark, tables):
    rows, sf_dir = tables
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    odd = [(901, a), (902, a), (902, b), (903, c), (903, c), (None, c + " end"), (904, None), (904, ""), (905, " \t\n"), (None, None), (906, " ".join(b.split()[:35]) + "\n\t" + " ".join(c.split()[:35]))]
    held = [(i, t, 1.5, "s", "x", n) for n, (i, t) in enumerate([*[x for x in rows if x[0] % 2 == 0], *odd])]
    docs = spark.createDataFrame(held, "doc_id long, text string, score double, _row string, first_ids string, n long")
    tox, near, cut, packed = through(spark, docs, sf_dir)
    first = len(rows) // 2
    assert all(x.columns == docs.columns for x in (tox, near, cut))
    assert {x.n for x in tox.collect()} >= set(range(first, first + len(odd)))
    kept = sorted(x.n - first for x in near.collect() if x.n >= first)
    # Of (901, a), (902, a) the first stays; (902, b) stays; of two equal rows one; null texts and white space stay.
    assert kept in ([0, 2, 3, 6, 7, 8, 9, 10], [0, 2, 4, 6, 7, 8, 9, 10])
    texts = {x.n - first: x.text for x in cut.collect()}
    # 906 is a part of b and one of c: nothing but white space is left of it, so it goes.
    assert set(kept) - {10} == {n for n in texts if n >= 0} and texts[2] == b and texts[8] == " \t\n" and texts[6] is None
    assert packed.count() == cut.count()


def test_a_table_without_rows(spark, tables):
    rows, sf_dir = tables
    docs = spark.createDataFrame(rows, "doc_id long, text string").limit(0)
    assert [x.count() for x in through(spark, docs, sf_dir)] == [0, 0, 0, 0]


def test_stages_bound_what_tasks_hold_at_once(spark, tables, monkeypatch):
    rows, sf_dir = tables
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        docs = spark.createDataFrame([(i, "long " * 60_000 + t) for i, t in rows[:20]], "doc_id long, text string").coalesce(1)
        pipeline.near_duplicates(spark, docs, sf_dir)
        assert {k: int(spark.conf.get(k).removesuffix("b")) for k in keys} == keys

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        seen = [x.n for x in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(seen) == 20 and max(seen) <= 5
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "64")
        pipeline.near_duplicates(spark, docs.limit(0), sf_dir)
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "64"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
