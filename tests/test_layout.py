import pytest
from pyspark.sql import functions as F

from labeltide import session
from labeltide.operators import layout
from labeltide.functions import text as X


def test_keep_where_semantics(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x")], "id long, t string")
    toks = df.select("id", X.tokens(F.col("t")).alias("k"))
    got = layout.keep_where(toks, F.size("k") > 1).collect()
    assert [(r.id, r.k) for r in got] == [(1, ["a", "b", "c"])]
    # NULL conditions drop the row, as a WHERE clause does
    assert layout.keep_where(df, F.col("t") == "x").count() == 1
    assert layout.keep_where(df, F.lit(None).cast("boolean")).count() == 0


def test_keep_where_evaluates_expression_once(spark):
    df = spark.range(10).select(F.col("id"), X.clean_text(F.lit("Hello  World 1")).alias("c"))
    plan = layout.keep_where(df, F.length("c") > 3)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan


def test_one_split_is_spread_and_larger_inputs_are_not(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    spread = layout.spread_one_split(one)
    assert spread.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread.collect()) == list(range(100))
    many = spark.range(0, 100, numPartitions=spark.sparkContext.defaultParallelism * 2)
    assert layout.spread_one_split(many) is many
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
        assert layout.spread_one_split(one) is one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stored_tables_have_a_size_and_can_be_cleared(spark):
    import os

    small = session.stored(spark.range(5))
    plan = spark.range(100).join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    path = session._SCRATCH[-1].removeprefix("file:")
    assert os.path.exists(path)
    session.clear_scratch(spark)
    assert not os.path.exists(path)


def test_scratch_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="share"):
        session.ensure_checkpoint_dir(Session())
