"""JSON documents of the annotation stages, one a video, as rows and back.

Readers take a folder or pattern and give a row for each element, with video_id from the file's name. Schemas are stated,
as inference would make a field of each person id. A file that is no such document gives no rows and counts as bad.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geometry import corners, in_frame
from ..functions.text import parse_time, plain_path, srt_time, video_of

BOX, POINT = "array<double>", "array<double>"
SAMPLES = f"video_fps double, sample_fps double, persons_summary map<string, struct<first_frame: bigint, last_frame: bigint, track_length: bigint, face_detection_pct: double, inframe_gaze_pct: double>>, frames array<struct<frame_idx: bigint, timestamp: double, persons: array<struct<person_id: bigint, face_detected: boolean, face_bbox: {BOX}, gaze_point: {POINT}, inout: boolean>>>>"
FEATURES = f"frame_features array<struct<frame_idx: bigint, timestamp: double, num_persons: bigint, num_faces_detected: bigint, person_velocities: map<string, double>, person_gaze_points: map<string, {POINT}>, person_gaze_confidences: map<string, double>, person_gaze_methods: map<string, string>, gaze_convergence_score: double>>"
EVENTS = "num_events bigint, event_counts map<string, bigint>, events array<struct<event_id: bigint, event_type: string, start_time: double, end_time: double, start_frame: bigint, end_frame: bigint, confidence: double, persons_involved: array<bigint>>>"
GESTURES = "gesture_counts map<string, bigint>, event_validations array<struct<event_id: bigint, event_confirmed: boolean>>, gestures array<struct<gesture_type: string, initiator_id: bigint, start_time: string, end_time: string, target_type: string, target_person_id: bigint, target_description: string, confidence: double>>"
CLASSES = "classifications array<struct<event_id: bigint, event_confirmed: boolean, caused_gaze_shift: boolean, responder_ids: array<bigint>, deictic_gestures: array<struct<gesture_type: string, initiator_id: bigint, target_type: string, target_person_id: bigint, target_description: string>>>>"
TIMELINE = "timeline array<struct<source: string, item: bigint, kind: string, start_time: double, end_time: double, confidence: double, persons: array<bigint>>>"
GRAPH = "num_events_raw bigint, num_events_filtered bigint, num_gaze bigint, num_gesture bigint, num_cross_modal_pairs bigint, events array<struct<place: bigint, source: string, item: bigint, kind: string, start_time: double, end_time: double, confidence: double, persons: array<bigint>, description: string>>, cross_modal_pairs array<struct<gaze_idx: bigint, gesture_idx: bigint, relation: string, seconds: double>>"
QUESTIONS = "qa_pairs array<struct<question_id: string, category: string, subcategory: string, format: string, question: string, answer: string, answer_text: string, options: array<string>, time_range: array<double>>>"
TRACKS = f"tracks map<string, array<struct<person_id: bigint, bbox: {BOX}, score: double>>>"
PREDICTIONS = f"video_path string, video_fps double, video_size {POINT}, total_frames bigint, processed_frames bigint, sample_fps double, text_prompt string, frames array<struct<frame_idx: bigint, timestamp: double, gaze_point: {POINT}, gaze_point_px: {POINT}, inout: double, head_bbox: {BOX}, head_bbox_px: {BOX}>>"
TV_QUESTIONS = "qid bigint, vid_name string, ts array<double>, q string, a0 string, a1 string, a2 string, a3 string, a4 string, answer_idx bigint, bbox map<string, array<struct<label: string, left: double, top: double, width: double, height: double>>>"
#: Endings of documents that later stages put beside those they read.
DERIVED = ["_features.json", "_events.json", "_gestures.json", "_qa_dataset.json"]


def skipped(path: Column) -> Column:
    """Whether a path is that of a document derived from others."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.endswith(path, F.lit(e)) for e in DERIVED)), F.lit(False))


def fields_of(schema: str) -> list[str]:
    return StructType.fromDDL(schema).fieldNames()


def read(spark: SparkSession, path: str, schema: str, ending: str = "*.json", derived: bool = False) -> DataFrame:
    """A row for each document: video_id, path, the fields of schema, bad. Documents derived from others are left out, unless
    they are what is asked for."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("pathGlobFilter", ending).option("recursiveFileLookup", True).json(path)
    rows = rows.withColumn("path", plain_path(F.col("_metadata.file_path")))
    if not derived:
        rows = rows.where(~skipped(F.col("path")))
    fields = fields_of(schema)
    return rows.select(video_of(F.col("path")).alias("video_id"), "path", *fields, bad_document(rows, fields).alias("bad"))


def bad_document(rows: DataFrame, fields: list[str]) -> Column:
    """Whether a row read is no document: it doesn't parse, or has none of the fields."""
    return F.col("_corrupt_record").isNotNull() | reduce(lambda a, b: a & b, (rows[c].isNull() for c in fields))


def elements(documents: DataFrame, field: str, place: str | None = None) -> DataFrame:
    """A row for each element of an array of structs: video_id, its place from 0 and its fields."""
    return documents.where("NOT bad").select("video_id", F.posexplode(field).alias(place or "place", "_e")).select("video_id", *([place] if place else []), "_e.*")


def outcome(documents: DataFrame) -> DataFrame:
    """Documents read and bad ones."""
    return documents.agg(F.count_if(~F.col("bad")).alias("documents"), F.count_if("bad").alias("bad"))


def write(rows: DataFrame, path: str) -> None:
    """A document a line, named by its column video_id; in folders by dataset, which are replaced one by one, if rows have that
    column. At most one document for each video."""
    from .sinks import save_by

    if "dataset" in rows.columns:
        save_by(rows, path, ["dataset"], ["video_id"], "json", 100_000)
    else:
        rows.write.json(path)


def export(rows: DataFrame, path: str) -> None:
    """A file for each document, for tools that look for one: files/video=<video_id>/. For few videos, as stores list files slowly."""
    rows.withColumn("video", F.col("video_id")).write.option("maxRecordsPerFile", 1).partitionBy("video").json(path)


def listed(field: str, order: str, columns: list[str]) -> Column:
    """The rows of a group as an array of structs in order. A group is a video's rows, which one document holds anyway."""
    rows = F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_s")))  # maps have no order, places do
    return F.transform(F.array_sort(rows, lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)), lambda x: x["_s"]).alias(field)


def by_id(key: str, value: str) -> Column:
    """A map from ids as text, as documents hold it."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))).alias(value)


def named(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that write() made, from all datasets."""
    rows = spark.read.schema(f"video_id string, {schema}").option("recursiveFileLookup", True).json(path)
    return rows.withColumn("bad", F.col("video_id").isNull())


def samples(documents: DataFrame) -> DataFrame:
    """Gaze rows: video_id, frame_pos, frame_idx, ts, person_id, dup_no, face_detected, fx1..fy2, gx, gy, inout."""
    frames = documents.where("NOT bad").select("video_id", F.posexplode("frames").alias("frame_pos", "f"))
    each = frames.select("video_id", "frame_pos", F.col("f.frame_idx").alias("frame_idx"), F.col("f.timestamp").alias("ts"), F.posexplode("f.persons").alias("dup_no", "p"))
    box = [F.get("p.face_bbox", F.lit(k)).alias(n) for k, n in enumerate(("fx1", "fy1", "fx2", "fy2"))]
    return each.select("video_id", F.col("frame_pos").cast("long").alias("frame_pos"), "frame_idx", "ts", "p.person_id", "dup_no", "p.face_detected", *box, F.get("p.gaze_point", F.lit(0)).alias("gx"), F.get("p.gaze_point", F.lit(1)).alias("gy"), "p.inout")


def sample_documents(gaze: DataFrame, summary: DataFrame) -> DataFrame:
    """Gaze rows and summaries of persons (person_id, first_frame, last_frame, track_length, face_pct, inframe_pct) as documents."""
    box = F.when(F.col("fx1").isNotNull(), F.array("fx1", "fy1", "fx2", "fy2")).alias("face_bbox")
    point = F.when(F.col("gx").isNotNull() & F.col("gy").isNotNull(), F.array("gx", "gy")).alias("gaze_point")
    persons = gaze.select("video_id", "frame_pos", "frame_idx", F.col("ts").alias("timestamp"), "person_id", F.struct("person_id", "face_detected", box, point, "inout").alias("p"))
    frames = persons.groupBy("video_id", "frame_pos", "frame_idx", "timestamp").agg(F.transform(F.array_sort(F.collect_list(F.struct("person_id", "p"))), lambda x: x["p"]).alias("persons"))
    whole = frames.groupBy("video_id").agg(listed("frames", "frame_pos", ["frame_idx", "timestamp", "persons"]))
    told = summary.select("video_id", "person_id", F.struct("first_frame", "last_frame", "track_length", F.col("face_pct").alias("face_detection_pct"), F.col("inframe_pct").alias("inframe_gaze_pct")).alias("persons_summary"))
    return whole.join(told.groupBy("video_id").agg(by_id("person_id", "persons_summary")), "video_id", "left")


def persons(documents: DataFrame) -> DataFrame:
    """Summaries of persons."""
    return documents.where("NOT bad").select("video_id", F.explode("persons_summary").alias("person", "s")).select("video_id", F.col("person").cast("long").alias("person_id"), "s.*")


def feature_documents(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Feature rows of persons and frames (see operators/features.py) as documents with maps by person id."""
    seen = rows.select("video_id", "pos", "person_id", F.col("frame_velocity").alias("person_velocities"), F.when(F.col("x").isNotNull(), F.array("x", "y")).alias("person_gaze_points"), F.col("conf").alias("person_gaze_confidences"), F.col("method").alias("person_gaze_methods"))
    maps = seen.groupBy("video_id", "pos").agg(*(by_id("person_id", c) for c in ("person_velocities", "person_gaze_points", "person_gaze_confidences", "person_gaze_methods")))
    told = frames.select("video_id", "pos", "frame_idx", F.col("ts").alias("timestamp"), "num_persons", F.col("num_faces").alias("num_faces_detected"), F.col("convergence").alias("gaze_convergence_score")).join(maps, ["video_id", "pos"])
    return told.groupBy("video_id").agg(listed("frame_features", "pos", ["frame_idx", "timestamp", "num_persons", "num_faces_detected", "person_velocities", "person_gaze_points", "person_gaze_confidences", "person_gaze_methods", "gaze_convergence_score"]))


def feature_rows(documents: DataFrame) -> DataFrame:
    """Back from feature documents: video_id, pos, frame_idx, ts, person_id, frame_velocity, x, y, conf, method."""
    frames = elements(documents, "frame_features", "pos")
    each = frames.select("video_id", "pos", "frame_idx", F.col("timestamp").alias("ts"), "person_gaze_points", "person_gaze_confidences", "person_gaze_methods", F.explode("person_velocities").alias("person", "frame_velocity"))
    of = lambda c: F.try_element_at(c, F.col("person"))
    return each.select("video_id", F.col("pos").cast("long").alias("pos"), "frame_idx", "ts", F.col("person").cast("long").alias("person_id"), "frame_velocity", F.get(of("person_gaze_points"), F.lit(0)).alias("x"), F.get(of("person_gaze_points"), F.lit(1)).alias("y"), of("person_gaze_confidences").alias("conf"), of("person_gaze_methods").alias("method"))


def event_documents(events: DataFrame) -> DataFrame:
    """Events (event_id, event_type, times, frames, confidence, persons) as documents with counts by type."""
    kept = ["event_id", "event_type", "start_time", "end_time", "start_frame", "end_frame", "confidence", F.col("persons").alias("persons_involved")]
    counts = events.groupBy("video_id", "event_type").agg(F.count("*").alias("event_counts")).groupBy("video_id").agg(by_id("event_type", "event_counts"))
    return events.groupBy("video_id").agg(F.count("*").alias("num_events"), listed("events", "event_id", kept)).join(counts, "video_id")


def gestures(documents: DataFrame) -> DataFrame:
    """Gestures with their place in the document; times may be written as clock times."""
    return elements(documents, "gestures", "gesture_index").withColumns({"start_time": parse_time(F.col("start_time")), "end_time": parse_time(F.col("end_time"))})


def with_defaults(gestures: DataFrame, initiator: int = -1) -> DataFrame:
    """Gestures whose missing fields are filled in: kinds `unknown`, no text, confidence 1, times 0. initiator: -1 where they are
    evaluated, 0 where they are written. Times may be numbers or texts; a text that is no time counts as missing."""
    second = lambda c: F.coalesce(parse_time(F.col(c).cast("string")), F.lit(0.0))
    given = {"gesture_type": "unknown", "target_type": "unknown", "target_description": "", "confidence": 1.0, "initiator_id": initiator}
    return gestures.withColumns({c: F.coalesce(F.col(c), F.lit(x)) for c, x in given.items()} | {c: second(c) for c in ("start_time", "end_time")})


def ground_truth(documents: DataFrame) -> DataFrame:
    """Annotated gestures of documents `*.mp4.json`: gt_video (the file's name), gt_key (place in it) and their fields, filled in."""
    rows = with_defaults(elements(documents, "gestures", "gt_key"))
    return rows.withColumnRenamed("video_id", "gt_video").withColumn("gt_key", F.col("gt_key").cast("long"))


def predictions(documents: DataFrame) -> DataFrame:
    """Gaze of one subject: video_id, frame_pos, frame_idx, ts, gx, gy, inout, in_frame (score over a half), hx1..hy2 (head)."""
    f = elements(documents, "frames", "frame_pos")
    point = [F.get("gaze_point", F.lit(k)).alias(n) for k, n in enumerate(("gx", "gy"))]
    head = [F.get("head_bbox", F.lit(k)).alias(n) for k, n in enumerate(("hx1", "hy1", "hx2", "hy2"))]
    return f.select("video_id", F.col("frame_pos").cast("long").alias("frame_pos"), "frame_idx", F.col("timestamp").alias("ts"), *point, "inout", in_frame(F.col("inout")).alias("in_frame"), *head)


def prediction_documents(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Rows of predictions() as documents; places in pixels are cut to whole ones, as the point and box are drawn there."""
    px = lambda cs: F.array(*(F.floor(F.col(c) * (width, height)[k % 2]).cast("double") for k, c in enumerate(cs)))
    point, head = ["gx", "gy"], ["hx1", "hy1", "hx2", "hy2"]
    frames = listed("frames", "frame_pos", ["frame_idx", F.col("ts").alias("timestamp"), F.array(*point).alias("gaze_point"), px(point).alias("gaze_point_px"), "inout", F.array(*head).alias("head_bbox"), px(head).alias("head_bbox_px")])
    size = F.array(F.lit(float(width)), F.lit(float(height))).alias("video_size")
    return rows.groupBy("video_id").agg(F.count("*").alias("processed_frames"), size, frames)


def tv_questions(spark: SparkSession, path: str, ending: str = "*.json", lines: bool = False) -> DataFrame:
    """Questions on TV clips: files that hold an array of entries (or, lines, an entry a line); a row for each entry."""
    return spark.read.schema(TV_QUESTIONS).option("multiLine", not lines).option("pathGlobFilter", ending).option("recursiveFileLookup", True).json(path)


def tv_boxes(questions: DataFrame) -> DataFrame:
    """The boxes of an entry's annotated frames: qid, frame, box_no, label, x1..y2."""
    frames = questions.select("qid", F.explode("bbox").alias("frame", "boxes"))
    each = frames.select("qid", F.col("frame").cast("long").alias("frame"), F.posexplode("boxes").alias("box_no", "b"))
    box = corners(F.col("b.left"), F.col("b.top"), F.col("b.width"), F.col("b.height"))
    return each.select("qid", "frame", F.col("box_no").cast("long").alias("box_no"), "b.label", *(c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"))))


def confirmations(classified: DataFrame, validated: DataFrame) -> DataFrame:
    """One view of both kinds of documents: video_id, event_id, confirmed, caused_shift, responders (null in the second)."""
    a = elements(classified, "classifications").select("video_id", "event_id", F.col("event_confirmed").alias("confirmed"), F.col("caused_gaze_shift").alias("caused_shift"), F.col("responder_ids").alias("responders"))
    b = elements(validated, "event_validations").select("video_id", "event_id", F.col("event_confirmed").alias("confirmed"))
    return a.unionByName(b, allowMissingColumns=True)


def gaze_labels(spark: SparkSession, path: str, kinds: list[str], ending: str = "NewAnt_*.txt") -> DataFrame:
    """Label rows of white-space columns: video_id, frame, person, kind. At least 12 fields, label `Person...`, a kind that is known."""
    lines = spark.read.option("pathGlobFilter", ending).text(path).select("value", F.regexp_extract(plain_path(F.col("_metadata.file_path")), r"NewAnt_([^/]*)\.txt$", 1).alias("video_id"))
    return label_rows(lines, kinds)


def label_rows(lines: DataFrame, kinds: list[str]) -> DataFrame:
    """gaze_labels() of lines: video_id, value."""
    f = F.split(F.trim("value"), r"\s+")
    out = lines.where((F.size(f) >= 12) & F.startswith(F.get(f, F.lit(9)), F.lit("Person")))
    return out.select("video_id", F.get(f, F.lit(5)).try_cast("long").alias("frame"), F.get(f, F.lit(9)).alias("person"), F.lower(F.get(f, F.lit(11))).alias("kind")).where(F.col("kind").isin(kinds) & F.col("frame").isNotNull())


def subtitles(texts: DataFrame) -> DataFrame:
    """Entries of SRT files: path, pos, start_time, end_time, text. texts: path, value (the whole file)."""
    blocks = texts.select("path", F.posexplode(F.split(F.trim(F.regexp_replace("value", "\r\n?", "\n")), r"\n\s*\n")).alias("pos", "block"))
    lines = F.split(F.trim("block"), "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("-->"))), F.lit(True)).cast("int")
    told = blocks.where((F.size(lines) >= 2) & (at > 0)).select("path", "pos", F.get(lines, at - 1).alias("time"), F.slice(lines, at + 1, F.size(lines)).alias("said"))
    text = F.regexp_replace(F.array_join(F.filter(F.transform("said", lambda x: F.trim(x)), lambda x: x != ""), " "), "<[^>]+>", "")
    out = told.select("path", "pos", srt_time(F.col("time")).alias("start_time"), srt_time(F.regexp_replace("time", r"^.*?-->", "")).alias("end_time"), text.alias("text"))
    return out.where("start_time IS NOT NULL AND end_time IS NOT NULL AND text <> ''")


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    return subtitles(spark.read.option("pathGlobFilter", "*.srt").option("recursiveFileLookup", True).text(path, wholetext=True).select(plain_path(F.col("_metadata.file_path")).alias("path"), "value"))


def tracks(documents: DataFrame) -> DataFrame:
    """Boxes of a tracker's chunk: video_id, frame, person_id, x1..y2, score."""
    frames = documents.where("NOT bad").select("video_id", F.explode("tracks").alias("frame", "p")).select("video_id", F.col("frame").cast("long").alias("frame"), F.explode("p").alias("p"))
    return frames.select("video_id", "frame", "p.person_id", *(F.get("p.bbox", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))), "p.score")


def person_counts_csv(counts: DataFrame, path: str) -> None:
    """filename, person_count by filename, with a header."""
    counts.select("filename", "person_count").orderBy("filename").write.option("header", True).csv(path)


def track_documents(rows: DataFrame) -> DataFrame:
    """Rows of tracks() as documents with a map by frame."""
    boxes = rows.groupBy("video_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("person_id", F.struct("person_id", F.array("x1", "y1", "x2", "y2").alias("bbox"), "score").alias("p")))), lambda x: x["p"]).alias("tracks"))
    return boxes.groupBy("video_id").agg(by_id("frame", "tracks"))


def not_done(videos: DataFrame, done: DataFrame) -> DataFrame:
    """Videos without a result yet."""
    return videos.join(done.select("video_id").distinct(), "video_id", "left_anti")
