"""Plans that keep large sides where they are."""

from pyspark.sql import functions as F

from sightline.operators import tv
from sightline.plans.chain import confirmed


def test_verdicts_are_not_broadcast(spark):
    """Ten thousand verdicts a video, made by explode, which Spark takes for a few bytes."""
    rows = spark.range(40).select(F.concat(F.lit("v"), "id").alias("video_id"), F.col("id").alias("event_id"))
    verdicts = rows.select("video_id").distinct().select("video_id", F.explode(F.sequence(*(F.lit(k).cast("long") for k in (0, 9_998, 2)))).alias("event_id")).withColumn("confirmed", F.col("event_id") % 3 != 0)
    out = confirmed(rows.withColumn("rank", F.lit(1)), verdicts)
    assert {(r.event_id, r.confirmed) for r in out.collect()} == {(k, k % 3 != 0 if k % 2 == 0 else None) for k in range(40)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildLeft" in plan and "Broadcast" not in plan


def test_texts_are_gathered_once_for_each_range(spark):
    """A thousand questions on two ranges: a range's texts are met twice at most, not once a question."""

    q = spark.range(1000).select(F.col("id").alias("qid"), F.lit(1).alias("season"), F.lit(2).alias("episode"), (F.col("id") % 2 * 5.0).alias("abs_start"), (F.col("id") % 2 * 5.0 + 3).alias("abs_end"))
    subs = spark.createDataFrame([(1, 2, 1, 2.0, 6.0, "b"), (1, 2, 0, 0.0, 3.0, "a"), (1, 2, 2, 8.0, 9.0, "never"), (1, 3, 0, 0.0, 9.0, "other")], "season int, episode int, pos int, start_time double, end_time double, text string")
    out = tv.said(q, subs)
    assert {(r.qid, r.subtitle) for r in out.collect()} == {(k, "b" if k % 2 else "a b") for k in range(1000)}
    keys = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "collect_set" in line]
    assert keys and all("abs_start" in line and "qid" not in line for line in keys)
