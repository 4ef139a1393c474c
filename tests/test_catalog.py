import os
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entries
from treeline import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("nation", "customer", "supplier", "orders", "lineitem", "events")
SAMPLE = ("edges_canonical", "graph_stats", "msf_nation_trade", "msf_by_strategy", "percentile_progress", "prefix_detectability", "gap_histogram_pow2", "bfs_levels", "components_order_forest", "parse_cpu_list")


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(entries.oracle_sql()) <= set(entries.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = db.sql(catalog.ORACLES[name]).df()
    found = pd.DataFrame([r.asDict() for r in catalog.QUERIES[name](spark, DATA).collect()])
    assert sorted(found.columns) == sorted(want.columns)
    key = lambda df: sorted(str(tuple(None if pd.isna(v) else round(float(v), 4) if isinstance(v, (int, float)) or hasattr(v, "item") and not isinstance(v, str) else v for v in r)) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    assert key(found) == key(want)


#: Queries over parts and suppliers that are held against their SQL where part ids reach those of suppliers.
SHARED_IDS = (
    "edges_part_supplier",
    "kth_edge",
    "light_edges_k",
    "weight_threshold_filter",
    "edges_with_id",
    "lightest_top",
    "order_breaks",
    "pivot_partition",
    "msf_part_supplier",
)


@pytest.fixture(scope="module")
def shared_ids(tmp_path_factory):
    """Lines of parts around the first supplier's id: edges with the larger end first, mirrored pairs, loops."""
    folder, rng = tmp_path_factory.mktemp("shared-ids"), random.Random(5)
    lines = [(1_000_000 + rng.randint(-20, 20), rng.randint(0, 20), rng.choice([500.0, 1500.0, 1999.5, 20000.0, 30000.0]) + rng.randint(0, 400)) for _ in range(900)]
    lines += [(1_000_003, 3, 90_000.0), (1_000_004, 5, 700.0), (1_000_005, 4, 701.0)]
    pd.DataFrame(lines, columns=["l_partkey", "l_suppkey", "l_extendedprice"]).to_parquet(folder / "lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", SHARED_IDS)
def test_parts_with_ids_of_suppliers(spark, shared_ids, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{shared_ids}/lineitem.parquet'")
    want = db.sql(catalog.ORACLES[name])
    found = catalog.QUERIES[name](spark, shared_ids).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data")
def test_entry(spark):
    row = entries.entry(spark).collect()
    assert len(row) == 14
