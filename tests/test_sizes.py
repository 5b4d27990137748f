"""What Spark takes a staged table's size for."""

from pyspark.sql import functions as F

from gridlume.operators.lineage import stage


def test_a_staged_table_of_many_small_rows_is_not_broadcast(spark):
    rows = spark.range(1_500_000).select(F.lit(1).cast("decimal(38,0)").alias("label"), (F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    staged = stage(rows, "size")
    size = int(str(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size > 10 << 20  # the limit of a broadcast
    plan = staged.join(staged.groupBy("y").agg(F.min("x").alias("first")), "y")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
