"""Streams over files give what the batch rule gives."""

from pyspark.sql import functions as F

from sightline.streaming import sessions


def stream(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def rows(spark, seconds):
    return spark.createDataFrame([("v", float(s), "pointing", i) for i, s in enumerate(seconds)], "video_id string, s double, gesture_type string, gesture_key long").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_sessions_break_at_exactly_one_gap(spark, tmp_path):
    s = stream(spark, rows(spark, [0, 0.5, 1.1, 1.7, 1000]), tmp_path, "a")
    got = run(spark, sessions.sessions(s, ["video_id"], 600_000), tmp_path, "sess")
    assert sorted(r.rows for r in got) == [1, 1, 2]


def test_tumbling_counts(spark, tmp_path):
    s = stream(spark, rows(spark, [0, 39.9, 40, 1000]), tmp_path, "b")
    assert sorted(r.n for r in run(spark, sessions.tumbling_counts(s), tmp_path, "tumb")) == [1, 2]


def test_pairs(spark, tmp_path):
    a = stream(spark, rows(spark, [10, 100]).withColumnRenamed("gesture_key", "event_id"), tmp_path, "g")
    b = stream(spark, rows(spark, [7, 13.1, 101]), tmp_path, "h")
    got = run(spark, sessions.pairs(a, b), tmp_path, "prs")
    assert {(r.event_id, r.gesture_key) for r in got} == {(0, 0), (1, 2)}
