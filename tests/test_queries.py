"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lockstep.operators import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
SOME = [
    "text_files", "bipartite_text", "vector_makers", "activations", "matrix_parts", "network_round", "rating_tops", "semi_clusters_pairs", "join_outer", "join_nested",
    "superstep_combined", "pagerank_resumed", "logistic_rounds", "sparse_rows",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def shaped(rows):
    def plain(x):
        x = x.item() if hasattr(x, "item") else x
        return None if x is None or (isinstance(x, float) and math.isnan(x)) else x + 0.0 if isinstance(x, float) else x

    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert shaped(got.select(*columns).collect()) == shaped([[r[i] for i in place] for r in want.fetchall()])


def test_every_query_has_a_name_of_its_own():
    assert len(registry.queries()) == sum(len(m.QUERIES) for m in registry.MODULES)
    assert set(registry.oracle_sql()) <= set(registry.queries())
