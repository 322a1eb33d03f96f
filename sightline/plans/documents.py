"""Round trips: rows of the tables written as documents and read back, beside SQL on the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, reports
from ..session import new_path
from ..sources import adapters, documents
from .gaze import BASE as GAZE_BASE
from .gaze import gaze, rounded
from .timeline import BASE, gestures

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _samples(spark, sf_dir):
    rows = gaze(spark, sf_dir)
    path = new_path(spark, "samples")
    documents.write(documents.sample_documents(rows, features.person_summary(features.observed(rows))), path)
    return documents.named(spark, path, documents.SAMPLES)


@query(f"with g as ({adapters.sql(adapters.GAZE)}) select video_id, dense_rank() over (partition by video_id order by frame_pos) - 1 frame_pos, frame_idx, ts, person_id, face_detected, fx1, fy1, fx2, fy2, case when gy is not null then gx end gx, case when gx is not null then gy end gy, inout from g")
def s1_gaze_documents(spark, sf_dir):
    return documents.samples(_samples(spark, sf_dir)).drop("dup_no")


@query(f"with g as ({adapters.sql(adapters.GAZE)}) select video_id, person_id, min(frame_idx) first_frame, max(frame_idx) last_frame, count(distinct frame_idx) track_length from g group by 1, 2")
def s2_person_summaries(spark, sf_dir):
    return documents.persons(_samples(spark, sf_dir)).select("video_id", "person_id", "first_frame", "last_frame", "track_length")


@query(f"{GAZE_BASE} select video_id, pos, frame_idx, ts, person_id, round(fv, 6) + 0e0 frame_velocity, round(x, 6) + 0e0 x, round(y, 6) + 0e0 y, round(conf, 6) + 0e0 conf, method from r")
def s3_feature_documents(spark, sf_dir):
    rows = features.features(gaze(spark, sf_dir))
    path = new_path(spark, "features")
    documents.write(documents.feature_documents(rows, features.frame_features(rows)), path)
    return rounded(documents.feature_rows(documents.named(spark, path, documents.FEATURES)), "frame_velocity", "x", "y", "conf")


def _events(spark, sf_dir):
    rows = adapters.rows(spark, sf_dir, adapters.GAZE_EVENTS).withColumns({"start_frame": F.floor(F.col("start_time") * 30), "end_frame": F.floor(F.col("end_time") * 30), "persons": F.array("person_a", "person_b")})
    path = new_path(spark, "events")
    documents.write(documents.event_documents(rows), path)
    return documents.named(spark, path, documents.EVENTS)


@query(f"with e as ({adapters.sql(adapters.GAZE_EVENTS)}) select video_id, event_id, event_type, start_time, end_time, cast(floor(start_time*30) as bigint) start_frame, cast(floor(end_time*30) as bigint) end_frame, confidence, concat(person_a, ',', person_b) persons from e")
def s4_event_documents(spark, sf_dir):
    return documents.elements(_events(spark, sf_dir), "events").withColumn("persons", F.array_join("persons_involved", ",")).drop("persons_involved")


@query(f"with e as ({adapters.sql(adapters.GAZE_EVENTS)}) select video_id, event_type, count(*) n, sum(count(*)) over (partition by video_id) as of_video from e group by 1, 2")
def s4_event_counts(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return rows.select("video_id", F.explode("event_counts").alias("event_type", "n"), F.col("num_events").alias("of_video"))


@query(f"{BASE} select video_id, row_number() over (partition by video_id order by gesture_key) - 1 gesture_index, gesture_type, initiator_id, start_time, end_time, target_type, target_person_id, confidence from s")
def s5_gesture_documents(spark, sf_dir):
    rows = gestures(spark, sf_dir)
    clock = lambda c: F.when(F.col("gesture_key") % 2 == 0, F.col(c).cast("string")).otherwise(F.concat(F.floor(F.col(c) / 60).cast("string"), F.lit(":"), F.format_string("%05.2f", F.col(c) % 60))).alias(c)
    kept = ["gesture_type", "initiator_id", clock("start_time"), clock("end_time"), "target_type", "target_person_id", F.lit(None).cast("string").alias("target_description"), "confidence"]
    path = new_path(spark, "gestures")
    documents.write(rows.groupBy("video_id").agg(documents.listed("gestures", "gesture_key", kept)), path)
    got = documents.gestures(documents.named(spark, path, documents.GESTURES)).drop("target_description")
    return got.withColumns({"gesture_index": F.col("gesture_index").cast("long"), "start_time": F.round("start_time", 2), "end_time": F.round("end_time", 2)})


@query(f"with e as ({adapters.sql(adapters.GAZE_EVENTS)}) select video_id, event_id, event_id % 3 <> 0 as confirmed, case when event_id % 2 = 0 then person_a = 1 end as caused_shift, case when event_id % 2 = 0 then concat(person_a, ',', person_b) end responders from e")
def s6_confirmations(spark, sf_dir):
    rows = adapters.rows(spark, sf_dir, adapters.GAZE_EVENTS).withColumn("ok", F.col("event_id") % 3 != 0)
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")  # the two kinds of documents
    a, b = new_path(spark, "classified"), new_path(spark, "validated")
    fields = ["event_id", F.col("ok").alias("event_confirmed"), (F.col("person_a") == 1).alias("caused_gaze_shift"), F.array("person_a", "person_b").alias("responder_ids")]
    documents.write(old.groupBy("video_id").agg(documents.listed("classifications", "event_id", fields)), a)
    documents.write(new.groupBy("video_id").agg(documents.listed("event_validations", "event_id", fields[:2])), b)
    got = documents.confirmations(documents.named(spark, a, documents.CLASSES), documents.named(spark, b, documents.GESTURES))
    return got.withColumn("responders", F.array_join("responders", ","))


@query("select concat('v', cast(event_id % 40 as varchar(10))) video_id, cast(event_id as bigint) frame, concat('Person', cast(event_id % 4 as varchar(10))) person, case event_type when 'view' then 'mutual' when 'click' then 'share' when 'signup' then 'refer' when 'purchase' then 'single' end kind from events where event_type <> 'error'")
def s8_gaze_label_text(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "Mutual").when(F.col("event_type") == "click", "share").when(F.col("event_type") == "signup", "REFER").when(F.col("event_type") == "purchase", "single").otherwise("other")
    line = F.concat_ws("  ", F.lit(" 0 1 2 3 4"), F.col("event_id").cast("string"), F.lit("0 0 0"), F.concat(F.lit("Person"), (F.col("event_id") % 4).cast("string")), F.lit("na"), kind, F.lit("P2"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("v"), (F.col("event_id") % 40).cast("string")).alias("video"), line.alias("value"))
    path = new_path(spark, "labels")
    rows.write.partitionBy("video").text(path)
    # written in a folder a video; the reader names videos by file, so the folder's name stands in
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"video=([^/]*)/", 1).alias("video_id"))
    return documents.label_rows(lines, ["mutual", "share", "refer", "single"])


@query("select concat('e', cast(floor(event_id/50) as bigint)) as path, event_id % 50 pos, (event_id % 50)*2e0 start_time, (event_id % 50)*2e0 + 15e-1 end_time, concat('said ', event_type, ' ', cast(event_id as varchar(20))) as text from events")
def s9_subtitles(spark, sf_dir):
    n = F.col("event_id") % 50
    clock = lambda half: F.concat(F.lit("00:"), F.lpad(F.floor((n * 2 + half) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(((n * 2 + half) % 60).cast("string"), 2, "0"))
    block = F.concat(n.cast("string"), F.lit("\n"), clock(0), F.lit(",000 --> "), clock(1), F.lit(".500\n<i>said</i> "), F.col("event_type"), F.lit("\n  "), F.col("event_id").cast("string"), F.lit(" \n"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("e"), F.floor(F.col("event_id") / 50).cast("string")).alias("path"), n.alias("n"), block.alias("block"))
    texts = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("value"))
    return documents.subtitles(texts).withColumn("pos", F.col("pos").cast("long"))


@query(f"{BASE} select video_id, place, source, item, kind, start_time, end_time, confidence, array_to_string(persons, ',') persons from tl")
def s11_timeline_documents(spark, sf_dir):
    from .timeline import merged

    rows = merged(spark, sf_dir)
    path = new_path(spark, "timeline")
    documents.write(rows.groupBy("video_id").agg(documents.listed("timeline", "place", ["source", "item", "kind", "start_time", "end_time", "confidence", "persons"])), path)
    got = documents.elements(documents.named(spark, path, documents.TIMELINE), "timeline", "place")
    return got.withColumns({"place": F.col("place").cast("long"), "persons": F.array_join("persons", ",")})


@query(f"with g as ({adapters.sql(adapters.GAZE)}) select concat(video_id, '.json') filename, cast(count(distinct person_id) as varchar) person_count from g group by video_id")
def s14_person_count_csv(spark, sf_dir):
    counts = reports.persons_of_videos(gaze(spark, sf_dir)).select(F.concat("video_id", F.lit(".json")).alias("filename"), F.col("persons").alias("person_count"))
    path = new_path(spark, "counts")
    documents.person_counts_csv(counts, path)
    return spark.read.option("header", True).csv(path)


@query("select (select count(*) from (select distinct o_custkey from orders)) - (select count(*) from (select distinct o_custkey from orders) where o_custkey % 5 = 0) documents, (select count(*) from (select distinct o_custkey from orders) where o_custkey % 5 = 0) bad")
def s17_bad_documents(spark, sf_dir):
    """A fifth of the documents is cut off."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct()
    whole = F.to_json(F.struct(F.lit(1).alias("num_events"), F.array(F.struct(F.col("o_custkey").alias("event_id"))).alias("events")))
    path = new_path(spark, "bad")
    rows.select(F.when(F.col("o_custkey") % 5 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value")).write.text(path)
    read = spark.read.schema(f"{documents.EVENTS}, _corrupt_record string").json(path)
    return documents.outcome(read.withColumn("bad", documents.bad_document(read, documents.fields_of(documents.EVENTS))))
