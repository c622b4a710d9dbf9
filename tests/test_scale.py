"""Queries and loops over more rows than the smallest tables have."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.operators import learning, registry
from lockstep.plans import bsp, storage


def many_lines(spark, path, times):
    """Lines as those of the tables, each ``times`` over, so that summed gradients overshoot at a fixed step."""
    n = F.col("id")
    rows = spark.range(2000 * times).select(
        n.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (n % 50 + 1).cast("double").alias("l_quantity"), (n % 11 / 100).alias("l_discount"),
        (n % 97 * 1000.0).alias("l_extendedprice"), F.when(n % 3 == 0, "R").otherwise("N").alias("l_returnflag"),
    )
    rows.write.parquet(f"{path}/lineitem.parquet")


def rising(spark, tmp_path, name, times):
    many_lines(spark, str(tmp_path), times)
    got = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).orderBy("round").collect()]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(db.sql(registry.oracle_sql()[name]).fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-9, abs=2e-6)
    costs = [r[-1] for r in got]
    assert any(b > a for a, b in zip(costs, costs[1:], strict=False))


def test_linear_rounds_are_told_where_costs_rise(spark, tmp_path):
    rising(spark, tmp_path, "gradient_descent_rounds", 1500)


def test_own_model_rounds_are_told_where_costs_rise(spark, tmp_path):
    rising(spark, tmp_path, "own_model_rounds", 1500)


def test_logistic_rounds_are_told_where_costs_rise(spark, tmp_path):
    rising(spark, tmp_path, "logistic_rounds", 10_000)


def test_logistic_cost_counts_rows_far_off(spark):
    h = learning.logistic_hypothesis(F.array(F.lit(1.0)), F.array(F.col("x")))
    got = spark.createDataFrame([(-800.0,)], "x double").select(learning.logistic_cost(h, F.lit(1.0), 1)).first()[0]
    assert 744 < got < 745


def test_a_peer_takes_many_rows_in_chunks_and_queues_many_messages(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("int").alias("peer"), "id", F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 2 == 0, F.array(F.col("id").cast("double"))).alias("v"))

    def gather(peer):
        peer.state["alone"] = []
        for r in peer.rows():
            assert r["name"] == f"n{r['id']}" and r["v"] == (None if r["id"] % 2 else [float(r["id"])])
            peer.send(0, -1.0)
            peer.write(r["id"])
        assert len(peer.outgoing.held) <= bsp.QUEUED and len(peer.output.held) <= bsp.QUEUED
        assert len(peer.outgoing) == len(peer.output) == 20_000
        peer.clear()
        for _ in range(25_000):
            peer.send(1, float(peer.index))

    def finish(peer):
        got = list(peer.messages())
        if got:
            peer.write(int(sum(got)) * 1_000_000 + len(got))

    out, counters = bsp.run_supersteps(spark, [gather, finish], 3, "double", "x long", rows)
    assert sorted(r.x for r in out.collect()) == [*range(60_000), 75_000_075_000]
    assert counters["messages_sent"] == 75_000 and counters["output_records"] == 60_001


def test_each_peer_has_a_task_of_its_own(spark):
    def own(peer):
        from pyspark import TaskContext

        peer.write(peer.index, TaskContext.get().partitionId(), sum(1 for _ in peer.rows()))

    out, _ = bsp.run_supersteps(spark, [own], 4, "double", "peer int, task int, n long", spark.range(4000).select(F.col("id").alias("x")))
    got = out.collect()
    assert sorted((r.peer, r.task) for r in got) == [(i, i) for i in range(4)] and sum(r.n for r in got) == 4000


def test_a_round_of_training_makes_no_object_for_each_row(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").alias("k"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0), (F.col("id") % 7 > 3).cast("double")).alias("vec"))
    net = learning.LayeredNetwork([2, 3, 1], ["Sigmoid", "Sigmoid"], "CrossEntropy", rate=0.4, momentum=0.2)
    plain = learning.LayeredNetwork([2, 3, 1], ["Sigmoid", "Sigmoid"], "CrossEntropy", rate=0.4, momentum=0.2)
    v = np.array([r.vec for r in rows.collect()])
    monkeypatch.setattr(DataFrame, "mapInPandas", None)
    net.train(rows, rounds=3, batch=0)
    for _ in range(3):
        plain.step(plain.gradients(v[:, :2], v[:, 2:]), len(v))
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(net.weights, plain.weights, strict=True))
    got = net.predict(rows.repartition(3)).orderBy("k").collect()
    assert np.allclose([r.output for r in got], net.forward(v[:, :2])[-1]) and [r.vec for r in got] == v.tolist()
    with pytest.raises(Exception, match="differ in length"):
        net.train(spark.createDataFrame([([1.0, 2.0, 0.0],), ([1.0],)], "vec array<double>").coalesce(1), rounds=1, batch=0)


def test_a_superstep_shuffles_its_messages_alone(spark):
    frame = storage.dealt(spark.range(50).select("id", F.lit(1).alias("value")), "vertices", "id")
    links = storage.dealt(spark.range(50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), "edges", "src")
    plan = frame.hint("merge").join(links, F.col("id") == F.col("src"))
    assert plan.count() == 50 and "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("vertices", "edges"))]


def test_ratings_stay_in_cells(spark, monkeypatch):
    from lockstep.operators import learning

    monkeypatch.setattr(learning, "CELL", 20)
    draw = np.random.default_rng(4)
    # One user has rated most items, so that cells are divided; another has a rating that isn't known.
    pairs = sorted({(0, i) for i in range(150)} | {(int(u), int(i)) for u, i in zip(draw.integers(1, 40, 300), draw.integers(0, 160, 300), strict=True)})
    rows = [(f"u{u}", i, float(draw.random() * 5)) for u, i in pairs] + [("lost", 3, None)]
    users, items = learning.factorize(spark.createDataFrame(rows, "user string, item long, rating double"), rank=2, rounds=0)
    u, v = ({r[0]: np.array(r[1]) for r in side.collect()} for side in (users, items))
    begun = {k: x.copy() for k, x in u.items()}
    for _ in range(3):
        sums = [{}, {}]
        for a, b, rating in rows:
            e = 0.0 if rating is None else 2 * 0.01 * (rating - u[a] @ v[b])
            for side, key, other in ((0, a, v[b]), (1, b, u[a])):
                n, x = sums[side].get(key, (0, 0.0))
                sums[side][key] = (n + 1, x + e * other)
        for factors, side in ((u, 0), (v, 1)):
            for key, (n, x) in sums[side].items():
                factors[key] = factors[key] + x * min(1.0, 8 / n)
    users, items = learning.factorize(spark.createDataFrame(rows, "user string, item long, rating double"), rank=2, rounds=3)
    for got, want in ((users, u), (items, v)):
        found = {r[0]: r[1] for r in got.collect()}
        assert found.keys() == want.keys()
        assert all(np.allclose(found[k], want[k], rtol=1e-9) for k in want)
    assert np.allclose(u["lost"], begun["lost"])


def test_pagerank_reads_edges_as_they_lie(spark, monkeypatch):
    from lockstep.operators import graph
    from lockstep.plans import pregel as loop

    names, dealt = [], loop.dealt
    monkeypatch.setattr(loop, "dealt", lambda df, name, key, **more: names.append((name, key)) or dealt(df, name, key, **more))
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long")
    got = graph.pagerank(edges.select(F.col("src").alias("id")).distinct(), edges, rounds=2, eps=None).collect()
    assert abs(sum(r["value"] for r in got) - 1) < 1e-9
    assert names.count(("edges", "src")) == 1
