import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from probelight.llm import queries, topk


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(con.sql(queries.OP5_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op5_exact_top_k(spark, sf_dir).collect()) == want


def test_invalid_ties_lengths_and_few(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.5, math.nan], 1), (4, None, 1), (5, [0.1, None], 1), (6, [9.0], 1), (7, [], 1), (8, [math.inf, 0.0], 1), (None, [1.0, 1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit(0)).withColumn("block", F.lit("b"))
    got = topk.exact_top_k(vectors, F.col("vec_id") == 0, 5).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 65536), (2, 2, 65536)]


def test_empty_table(spark):
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_whole_tiles_are_passed_over(spark, monkeypatch):
    """Clustered vectors in small blocks: results are those of all pairs, and most pairs of blocks never meet."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        v = rng.normal(size=16) * 0.01
        v[4 * (i % 4) : 4 * (i % 4) + 4] += 1 if i % 8 < 4 else -1
        rows.append((i, v.tolist()))
    vectors = spark.createDataFrame([*rows, rows[7], rows[7]], "vec_id long, embedding array<double>")
    made = []
    tiles = topk._tiles
    monkeypatch.setattr(topk, "_tiles", lambda t, k: made.append(t.count()) or tiles(t, k))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect()}
    ids = np.array([r[0] for r in rows] + [7, 7])
    x = np.floor(256 * np.array([r[1] for r in rows] + [rows[7][1]] * 2)).astype(int)
    for q in range(0, 400, 50):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:5]
        assert [got[q, r + 1] for r in range(5)] == [(ids[j], score[j]) for j in order]
    assert made[1] < 0.6 * 21 * 4  # of 21 blocks of rows and 4 of queries
