"""What the planner is told of sizes, and so what the driver has to hold."""

from pyspark.sql import functions as F

from tidewire.lineage import cut
from tidewire.sources import tables


def estimate(frame):
    return frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_rounds_of_joins_do_not_lengthen_the_estimate(spark):
    labels = cut(spark.range(8).select("id", (F.col("id") % 3).alias("story")))
    for _ in range(4):
        up = labels.select(F.col("id").alias("up"), F.col("story").alias("over"))
        labels = cut(labels.join(up, labels.story == up.up).select("id", F.col("over").alias("story")))
    assert estimate(labels) < 1 << 64
    assert {(r.id, r.story) for r in labels.collect()} == {(k, k % 3) for k in range(8)}


def test_no_table_of_the_items_is_broadcast_for_its_files_being_small(spark):
    rows = tables.items(spark, "/root/testdata/sf0.001").select("id", "ai_selected", "engagement")
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() >= 200
