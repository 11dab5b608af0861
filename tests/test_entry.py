"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from marlstone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that rest on ranks, running sums or matching: run over several partitions too, adaptive execution on and off.
PARTITIONED = "quartile_summary quartile_strata roc_auc operating_sweep".split()


def connected(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    against_sql(spark, con, name, SF)


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("name", PARTITIONED)
def test_query_over_many_partitions(spark, name, adaptive):
    folder = "/root/testdata/sf0.01"
    small = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    held = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        against_sql(spark, connected(folder), name, folder)
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def against_sql(spark, con, name, folder):
    got = registry.queries()[name](spark, folder)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 1
        return
    want = con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(str(x) if not isinstance(x, float) else f"{x:.9g}" for x in r) for r in rows)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
