"""Readers, writers, exchange and superstep programs on the test tables, each with its SQL.

What a writer leaves in the shared folder a reader reads back, so both are under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import bsp
from ..plans.pregel import merged_vertices
from ..plans.storage import shared_dir
from ..sources import sinks
from ..sources import text as T
from ..streaming import pipe
from . import exchange, graph, learning
from .queries import _SALES, _TRADE, _sales, _t, _trade


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _joined(df: DataFrame, by: str, item: Column, separator: str) -> DataFrame:
    """(by, items): a group's items in order as one text; a group is a nation's or supplier's neighbours."""
    return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(item)), separator).alias("items"))


def text_files(spark, sf_dir):
    """Customers and suppliers written as compressed text in two folders, read as one list of paths."""
    a, b = _place(spark, "customers"), _place(spark, "suppliers")
    sinks.write_text(_t(spark, sf_dir, "customer").select("c_name", "c_nationkey"), a, "c_name", "c_nationkey", compression="gzip")
    sinks.write_text(_t(spark, sf_dir, "supplier").select("s_name", "s_nationkey"), b, "s_name", "s_nationkey", compression="gzip")
    return T.key_values(T.lines(spark, f"{a},{b}", "*.gz"))


def line_offsets(spark, sf_dir):
    """Bytes at which the nations' lines begin in one file: the table has a fixed 25 rows."""
    path = _place(spark, "nations")
    _t(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return T.lines_with_offsets(spark, path)


def binary_pairs(spark, sf_dir):
    """Orders as binary pairs, dumped as text."""
    path = _place(spark, "pairs")
    sinks.write_pairs(_t(spark, sf_dir, "orders").select(_text("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value")), path)
    return sinks.pairs_as_text(spark, path, "key string, value string")


def empty_inputs(spark, sf_dir):
    return T.empty_splits(spark, 8)


def plain_adjacency(spark, sf_dir):
    """The trade graph as lines without weights, parsed to vertices and edges."""
    _, edges = _trade(spark, sf_dir)
    lines = _joined(edges, "src", _text("dst"), "\t").select(F.concat_ws("\t", _text("src"), "items").alias("value"))
    vertices, parsed = merged_vertices(T.adjacency(lines), self_edges=True)
    return vertices.join(parsed, F.col("id") == F.col("src")).groupBy("id").agg(F.count("*").alias("links"), F.sum(F.col("dst").cast("long")).alias("targets"))


def array_adjacency(spark, sf_dir):
    _, edges = _trade(spark, sf_dir)
    rows = edges.groupBy("src").agg(F.collect_list(_text("dst")).alias("adj"))
    return T.array_adjacency(rows, "src", "adj").select("id", F.explode("edges").alias("e")).select("id", "e.dst")


def bipartite_text(spark, sf_dir):
    """Suppliers' side of the sales graph as lines, parsed back."""
    _, edges = _sales(spark, sf_dir)
    lines = _joined(edges.filter("src >= 0"), "src", F.concat(F.lit("c"), _text(-F.col("dst"))), " ")
    text = lines.select(F.concat(F.lit("s"), _text("src"), F.lit(" R:"), "items").alias("value"))
    return T.bipartite(text).select("id", "side", F.explode("edges").alias("e")).select("id", "side", "e.dst")


def cluster_text(spark, sf_dir):
    _, edges = _trade(spark, sf_dir)
    lines = _joined(edges, "src", F.concat_ws("-", _text("dst"), _text("weight")), ",").select(F.concat_ws("\t", _text("src"), "items").alias("value"))
    text = lines.unionByName(spark.createDataFrame([("# a comment",)], "value string"))
    return T.cluster_adjacency(text).select("id", F.explode("edges").alias("e")).select("id", "e.dst", "e.weight")


def bare_ids(spark, sf_dir):
    return T.bare_ids(_t(spark, sf_dir, "orders").select(F.concat(F.lit(" "), _text("o_orderkey")).alias("value")))


def rating_text(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.concat_ws("::", _text("l_orderkey"), _text("l_partkey"), _text("l_quantity"), F.lit("99")).alias("value"))
    return T.ratings(rows)


# Three genres of the item file's published format.
_NAMED = ["Action", "Drama", "War"]


def item_text(spark, sf_dir):
    """Parts as items of genres by their size."""
    genres = F.when(F.col("p_size") < 20, F.lit("Action|War")).when(F.col("p_size") < 35, F.lit("Drama")).otherwise(F.lit("unknown"))
    items = T.rated_items(_t(spark, sf_dir, "part").select(F.concat_ws("::", _text("p_partkey"), "p_name", genres).alias("value")))
    slots = [F.get("features", T.GENRES.index(g)).alias(g.lower()) for g in _NAMED]
    return items.select("item", "title", *slots, F.aggregate("features", F.lit(0.0), lambda s, x: s + x).alias("genres"))


def typed_lines(spark, sf_dir):
    """A file of nations and regions, told apart by their first character."""
    text = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_name").alias("value")).unionByName(_t(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_name").alias("value")))
    held = T.typed_rows(text, {"nation": "n", "region": "r"})
    return held["nation"].select(F.lit("nation").alias("kind"), "value").unionByName(held["region"].select(F.lit("region").alias("kind"), "value"))


def split_places(spark, sf_dir):
    """Rows, and rows without the file and bytes of the split that they came from."""
    rows = T.file_places(_t(spark, sf_dir, "orders"))
    return rows.agg(F.count("*").alias("rows"), F.count_if((F.col("file") == "") | (F.col("split_bytes") <= 0) | (F.col("split_start") < 0)).alias("lost"))


def null_output(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    sinks.write_nothing(orders)
    return orders.agg(F.count("*").alias("rows"))


def vertex_files(spark, sf_dir):
    path = _place(spark, "vertices")
    sinks.write_vertices(graph.in_links(*_sales(spark, sf_dir)), path)
    return spark.read.parquet(path)


def cluster_files(spark, sf_dir):
    """Each nation with its region and itself as clusters, as text."""
    nations, path = _t(spark, sf_dir, "nation"), _place(spark, "clusters")
    both = nations.select(F.col("n_name").alias("id"), F.concat(F.lit("r"), _text("n_regionkey")).alias("cluster")).unionByName(nations.select(F.col("n_name").alias("id"), F.lit("own").alias("cluster")))
    sinks.write_clusters(both, path)
    return T.key_values(T.lines(spark, path))


def centre_files(spark, sf_dir):
    """The first three orders as centres, written and read."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("vec"))
    path = _place(spark, "centres")
    sinks.write_centres(spark, learning.first_centres(rows, 3, "o_orderkey"), path)
    return spark.read.parquet(path).select("centre", F.get("vec", 0).alias("x"), F.get("vec", 1).alias("y"))


def hash_dealt(spark, sf_dir):
    """Customers, and the most partitions that one's orders are in when dealt by hash."""
    rows = exchange.by_hash(_t(spark, sf_dir, "orders").select("o_custkey"), 6, "o_custkey").withColumn("p", F.spark_partition_id())
    each = rows.groupBy("o_custkey").agg(F.countDistinct("p").alias("n"))
    return each.agg(F.count("*").alias("keys"), F.max("n").alias("most"))


def merged_partitions(spark, sf_dir):
    """Rows of each peer when 10 partitions by key are merged to 4 owners."""
    rows = exchange.merged(_t(spark, sf_dir, "orders"), 10, 4, F.col("o_custkey"))
    return rows.groupBy("peer").agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("keys"))


def shared_totals(spark, sf_dir):
    """What an all-reduce tells every later plan: here each order's share of the total."""
    orders = _t(spark, sf_dir, "orders")
    got = exchange.all_reduce(orders, n=F.count("*"), total=F.sum("o_totalprice"))
    return orders.select("o_orderkey", F.round(F.col("o_totalprice") * got["n"] / got["total"], 6).alias("share"))


def _sums(peer):
    total = n = 0
    for r in peer.rows():
        total, n = total + r["x"], n + 1
    peer.state["n"] = n
    peer.increment("rows", n)
    return float(total)


def _orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("x"))


def superstep_broadcast(spark, sf_dir):
    """Each of 5 peers tells its sum to all; each writes what it got, after a run that was resumed at step 1."""
    def gather(peer):
        peer.broadcast(_sums(peer))

    def finish(peer):
        peer.write(peer.index, sum(peer.messages()))

    path = _place(spark, "run")
    args = (spark, [gather, finish], 5, "double", "peer int, total double", _orders(spark, sf_dir))
    bsp.run_supersteps(*args, path=path)
    return bsp.run_supersteps(spark, [gather, finish], 5, "double", "peer int, total double", _orders(spark, sf_dir), resume_at=1, path=f"{path}/")[0]


def superstep_combined(spark, sf_dir):
    """Peers send a message for each row; a sum combiner leaves one for each sender and receiver."""
    def gather(peer):
        for r in peer.rows():
            peer.send(r["x"] % 2, float(r["x"]))

    def finish(peer):
        got = list(peer.messages())
        if got:
            peer.write(peer.index, len(got), sum(got))

    return bsp.run_supersteps(spark, [gather, finish], 5, "double", "peer int, messages int, total double", _orders(spark, sf_dir), combine=F.sum)[0]


def superstep_counters(spark, sf_dir):
    """A run's counters: of the user and of the engine. The run is halted after two of its three steps."""
    def gather(peer):
        peer.send(0, _sums(peer))
        peer.send(1, 0.0)
        peer.clear()
        peer.send(0, 1.0)

    def finish(peer):
        peer.halt()
        for m in peer.messages():
            peer.write(m)

    _, counters = bsp.run_supersteps(spark, [gather, finish, gather], 4, "double", "x double", _orders(spark, sf_dir))
    return spark.createDataFrame(sorted(counters.items()), "counter string, amount long")


def superstep_persistent(spark, sf_dir):
    """Messages that a step doesn't read come again in the next."""
    def gather(peer):
        peer.send(0, _sums(peer))

    def finish(peer):
        got = list(peer.messages())
        if got:
            peer.write(len(got), sum(got))

    return bsp.run_supersteps(spark, [gather, lambda peer: None, finish], 3, "double", "messages int, total double", _orders(spark, sf_dir), persistent=True)[0]


def piped_rows(spark, sf_dir):
    """Orders through an external program, line by line."""
    return pipe.piped(_t(spark, sf_dir, "orders").select(_text("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value")), "cat")


def program_owner(spark, sf_dir):
    """Rows of each peer where an external program names the owner of each customer."""
    rows = pipe.owner_by_program(_t(spark, sf_dir, "orders").select(_text("o_custkey").alias("key")), "cat", 4)
    return rows.groupBy("peer").agg(F.count("*").alias("rows"))


QUERIES = {f.__name__: f for f in (
    text_files, line_offsets, binary_pairs, empty_inputs, plain_adjacency, array_adjacency, bipartite_text, cluster_text, bare_ids, rating_text, item_text, typed_lines,
    split_places, null_output, vertex_files, cluster_files, centre_files, hash_dealt, merged_partitions, shared_totals, superstep_broadcast, superstep_combined,
    superstep_counters, superstep_persistent, piped_rows, program_owner,
)}

SQL = {
    "text_files": "SELECT c_name AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR) FROM supplier",
    "line_offsets": "SELECT CAST(coalesce(sum(strlen(n_name) + 1) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", n_name AS value FROM nation",
    "binary_pairs": "SELECT CAST(o_orderkey AS VARCHAR) || chr(9) || o_orderpriority AS value FROM orders",
    "empty_inputs": "SELECT CAST(range AS INTEGER) AS peer FROM range(8)",
    "plain_adjacency": f"WITH {_TRADE}, held AS (SELECT src, dst FROM trade UNION ALL SELECT DISTINCT src, src FROM trade) SELECT CAST(src AS VARCHAR) AS id, count(*) AS links, CAST(sum(dst) AS BIGINT) AS targets FROM held GROUP BY src",
    "array_adjacency": f"WITH {_TRADE} SELECT src AS id, CAST(dst AS VARCHAR) AS dst FROM trade",
    "bipartite_text": f"WITH {_SALES} SELECT 's' || dst AS id, 'R' AS side, 'c' || (-src) AS dst FROM pairs",
    "cluster_text": f"WITH {_TRADE} SELECT CAST(src AS VARCHAR) AS id, CAST(dst AS VARCHAR) AS dst, CAST(weight AS DOUBLE) AS weight FROM trade",
    "bare_ids": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS value FROM orders",
    "rating_text": 'SELECT l_orderkey AS "user", l_partkey AS item, l_quantity AS rating FROM lineitem',
    "item_text": """SELECT p_partkey AS item, p_name AS title, CASE WHEN p_size < 20 THEN 1 ELSE 0 END::DOUBLE AS action, CASE WHEN p_size BETWEEN 20 AND 34 THEN 1 ELSE 0 END::DOUBLE AS drama,
CASE WHEN p_size < 20 THEN 1 ELSE 0 END::DOUBLE AS war, CASE WHEN p_size < 20 THEN 2 ELSE 1 END::DOUBLE AS genres FROM part""",
    "typed_lines": "SELECT 'nation' AS kind, n_name AS value FROM nation UNION ALL SELECT 'region', r_name FROM region",
    "split_places": "SELECT count(*) AS rows, 0::BIGINT AS lost FROM orders",
    "null_output": "SELECT count(*) AS rows FROM orders",
    "vertex_files": f"WITH {_SALES} SELECT id, count(e.src) AS value FROM vertices LEFT JOIN edges e ON e.dst = id GROUP BY id",
    "cluster_files": "SELECT n_name AS key, 'own,r' || n_regionkey AS value FROM nation",
    "centre_files": "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS centre, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders ORDER BY o_orderkey LIMIT 3",
    "hash_dealt": "SELECT count(DISTINCT o_custkey) AS keys, 1::BIGINT AS most FROM orders",
    "merged_partitions": "SELECT CAST(o_custkey % 10 % 4 AS INTEGER) AS peer, count(*) AS rows, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY 1",
    "shared_totals": "SELECT o_orderkey, round(o_totalprice * count(*) OVER () / sum(o_totalprice) OVER (), 6) AS share FROM orders",
    "superstep_broadcast": "SELECT CAST(range AS INTEGER) AS peer, (SELECT CAST(sum(o_custkey) AS DOUBLE) FROM orders) AS total FROM range(5)",
    "superstep_combined": "SELECT CAST(o_custkey % 2 AS INTEGER) AS peer, 5 AS messages, CAST(sum(o_custkey) AS DOUBLE) AS total FROM orders GROUP BY 1",
    "superstep_counters": "SELECT 'messages_sent' AS counter, 4::BIGINT AS amount UNION ALL SELECT 'output_records', 4 UNION ALL SELECT 'supersteps', 2 UNION ALL SELECT 'rows', count(*) FROM orders",
    "superstep_persistent": "SELECT 3 AS messages, CAST(sum(o_custkey) AS DOUBLE) AS total FROM orders",
    "piped_rows": "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS value FROM orders",
    "program_owner": "SELECT CAST(o_custkey % 4 AS INTEGER) AS peer, count(*) AS rows FROM orders GROUP BY 1",
}
