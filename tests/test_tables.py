"""The paired study: what a task holds of it, and odd rows."""

from probelight.plans import contrast, study
from probelight.sources import tables


def test_tasks_of_the_study_are_dealt_by_its_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "ITEMS_OF_TASK", 50)
    orders = tables.load(spark, sf_dir, "orders").count()
    assert tables.pairs(spark, sf_dir).rdd.getNumPartitions() == tables.pair_rows(spark, sf_dir).rdd.getNumPartitions() == -(-orders // 50)


def test_blocks_and_classes_read_the_study_once(spark, sf_dir):
    for query in (study.feature_blocks, contrast.headroom):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and plan.count("l_orderkey") > 0


def test_odd_rows_of_the_study(spark, tmp_path):
    """A flag that is missing counts as none, a missing quantity is left out of its mean, an order listed twice is one item."""
    order = (7, 3, "O", "1-URGENT")
    spark.createDataFrame([order, order], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(7, "A", 30.0), (7, "A", None), (7, None, 20.0), (7, "N", 40.0), (8, "R", 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    (row,) = tables.pairs(spark, str(tmp_path)).collect()
    assert (row.item, row.clause, row.delta_b, row.delta_c, row.delta_none) == (7, "1#3", 5.0, None, 5.0)
    assert {(r.cond, r.delta) for r in tables.pair_rows(spark, str(tmp_path)).collect()} == {("B", 5.0), ("none", 5.0)}
