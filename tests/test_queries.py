"""Every registered query that has SQL, against DuckDB on the same tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from probelight.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else float(f"{float(value):.7g}")
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("k, n", [(0, 0), (0, 3), (2, 4), (5, 40), (121_440, 241_080), (250_100, 500_000), (1_000_900, 2_000_000)])
def test_sign_test_in_sql_sums_all_outcomes(spark, k, n):
    """The SQL that mcnemar, paired_evaluation and paired_bundle share, against the query's form, on counts beyond 100,000 too."""
    from probelight.functions.stats import binomial_p, r6
    from probelight.plans.contrast import _BINOMIAL

    got = spark.createDataFrame([(k, n)], "k long, n long").select(r6(binomial_p(F.col("k"), F.col("n")))).first()[0]
    (want,) = duckdb.sql(f"SELECT round({_BINOMIAL.format(k='k', n='n')}, 6) FROM (SELECT {k}::BIGINT AS k, {n}::BIGINT AS n)").fetchall()[0]
    assert plain(got) == plain(want) and (n < 100_000 or got > 0)
