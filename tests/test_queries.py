"""Every registered query against its SQL, and the two that have none against known figures."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from swissline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_sql(spark, oracle, name):
    got, want = rows(registry.queries()[name](spark, SF).toPandas()), rows(oracle.sql(registry.oracles()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if "f" in (got[c].dtype.kind, want[c].dtype.kind):
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1.1e-6, rtol=0, equal_nan=True), c
        else:
            assert (got[c].fillna("~").astype(str) == want[c].fillna("~").astype(str)).all(), c


@pytest.mark.parametrize("name", ["recent_winrate_5", "matches_30d", "mode_winrate_182d", "h2h_last3", "ratio_split", "auc_rank", "swiss_mc"])
def test_partitions_do_not_matter(spark, name):
    query, found = registry.queries()[name], []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, query(spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
