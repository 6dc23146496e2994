import duckdb
import pytest

import __spark_entry__ as entry

FAST = ["unified_events", "enriched_nodes", "relationship_recency", "ranking_metrics", "normalized_propagation",
        "link_targets", "typed_node_split"]


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["node_id", "node_key", "entity_type"] and df.count() == 25


@pytest.mark.parametrize("name", FAST)
def test_queries_run(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_every_sql_runs(sf_dir):
    """All but those of the operators that a part of its own brings."""
    from tools.check_oracles import TABLES
    from tracewright import plans

    duck = duckdb.connect()
    duck.execute("SET TimeZone='UTC'")
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in plans.oracle_sql().items():
        found = duck.execute(sql)
        assert found.description, name
