"""Queries on whole jobs: ingest, sinks, chains, graphs, merges and evaluation, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import evaluate, features, graph, questions, timeline, tv
from ..session import new_path, save
from ..sources import adapters, documents, pairing, sinks
from .chain import gaze_chain
from .gaze import ALL
from .gaze import BASE as GAZE_BASE
from .gaze import gaze, rounded
from .questions import WRITTEN, _written
from .timeline import BASE, gaze_events, gestures, gt, merged
from .timeline import ORACLE as TIMELINE_SQL

QUERIES, ORACLE = {}, {}
NUMBER = "cast(substr(video_id, 2, 10) as bigint)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- ingest, sinks and chains -------------------------------------------------------------------------------------


@query(f"with e as ({adapters.sql(adapters.GAZE_EVENTS)}), v as (select {NUMBER} k, count(*) n from e group by 1) select concat('d', k % 7) dataset, count(*) filter (k % 5 <> 0) documents, count(*) filter (k % 5 = 0) bad, coalesce(sum(n) filter (k % 5 <> 0), 0) events from v group by 1")
def r1_ingest(spark, sf_dir):
    """Documents of half the videos, then of the others and again of some: what was taken in already stays as it is."""
    k = F.expr(NUMBER)
    rows = adapters.rows(spark, sf_dir, adapters.GAZE_EVENTS).groupBy("video_id").agg(F.count("*").alias("num_events"), documents.listed("events", "event_id", ["event_id"]))
    rows = save(rows.withColumns({"k": k, "dataset": F.concat(F.lit("d"), k % 7)}), "videos")
    folder, to = new_path(spark, "arriving"), new_path(spark, "ingested")

    def arrive(some):
        whole = F.to_json(F.struct("video_id", "num_events", "events"))
        some.select("dataset", F.when(F.col("k") % 5 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value")).write.mode("append").partitionBy("dataset").text(folder)
        sinks.ingest(spark, folder, f"video_id string, {documents.EVENTS}", to, [f"dataset=d{n}" for n in range(7)], "*", lines=True).awaitTermination()

    arrive(rows.where("k % 2 = 0"))
    again = rows.where("k % 4 = 0 AND k % 5 <> 0").withColumn("num_events", F.lit(-1).cast("long"))
    arrive(rows.where("k % 2 = 1").unionByName(again))
    name = F.replace(F.col("dataset"), F.lit("dataset="), F.lit("")).alias("dataset")
    counts = sinks.taken(spark, to).groupBy("dataset").agg(F.sum("num_events").alias("events"))
    return sinks.ingest_outcome(spark, to).join(counts, "dataset", "left").select(name, "documents", "bad", F.coalesce("events", F.lit(0)).alias("events"))


@query("with o as (select o_orderkey, concat('d', o_orderkey % 7) dataset, o_orderkey % 7 < 3 again from orders) select dataset, count(*) n, sum(o_orderkey) keys, max(case when again then 'second' else 'first' end) run from o where not again or o_orderkey % 2 = 0 group by 1")
def s12_dataset_sink(spark, sf_dir):
    """Written twice: the second run replaces the three datasets that it holds."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("d"), F.col("o_orderkey") % 7).alias("dataset"), F.lit("first").alias("run"))
    path = new_path(spark, "datasets")
    sinks.save_by(rows, path, ["dataset"], ["o_orderkey"])
    sinks.save_by(rows.where("o_orderkey % 7 < 3 AND o_orderkey % 2 = 0").withColumn("run", F.lit("second")), path, ["dataset"], ["o_orderkey"])
    return spark.read.parquet(path).groupBy("dataset").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.max("run").alias("run"))


@query(f"with w as ({WRITTEN.format(conversations='conversations')}), c as (select *, concat('d', video_id % 7) dataset, case when video_id % 5 = 0 then 'test' else 'train' end split from w where n_times >= 2) select dataset, split, concat(case when split = 'test' then 'test/' else '' end, printf('v%d_qa%04d.json', video_id, idx)) path, count(*) n from c group by all")
def s13_clip_sink(spark, sf_dir):
    """Questions on clips in folders by dataset and split, and the names by which they are looked for."""
    k = F.col("video_id").cast("long")
    rows = _written(spark, sf_dir).withColumns({"length": F.lit(120.0), "_k": k}).withColumn("video_id", F.concat(F.lit("v"), F.col("_k").cast("string")))
    clips = questions.clip_questions(rows).withColumn("_k", F.substring("video_id", 2, 20).cast("long"))
    clips = clips.withColumns({"dataset": F.concat(F.lit("d"), F.col("_k") % 7), "split": F.when(F.col("_k") % 5 == 0, "test").otherwise("train")}).drop("_k")
    path = new_path(spark, "clips")
    sinks.save_by(clips, path, ["dataset", "split"], ["clip_name"], "json", 100_000)
    back = spark.read.schema(clips.schema).json(path)
    return back.groupBy("dataset", "split", sinks.clip_path(F.col("clip_name"), F.col("split")).alias("path")).agg(F.count("*").alias("n"))


KINDS = ", ".join(f"count(*) filter (event_type = '{t}') {t}" for t in ("sudden_gaze_shift", "joint_attention", "gaze_following", "attention_capture", "mutual_gaze"))


@query(f"{ALL}, t as (select *, case when confidence >= 75e-2 then row_number() over (partition by video_id, confidence >= 75e-2 order by confidence desc, start_time, event_id) end rank from every), c as (select *, rank <= 15 chosen, case when rank <= 15 and event_id % 2 = 0 then event_id % 3 <> 0 end ok from t) select video_id, count(*) events, count(*) filter (chosen) candidates, count(*) filter (ok) confirmed, count(*) filter (not ok) rejected, {KINDS} from c group by video_id")
def e23_gaze_pipeline(spark, sf_dir):
    """All stages over some of the videos, then over all: the second run only works on those that are new. Every other event
    has a verdict."""
    rows = gaze(spark, sf_dir)
    ids = F.explode(F.flatten(F.array(*(F.sequence(F.lit(b).cast("long"), F.lit(b + 998).cast("long"), F.lit(2).cast("long")) for b in range(0, 5000, 1000)))))
    verdicts = rows.select("video_id").distinct().select("video_id", ids.alias("event_id")).withColumn("confirmed", F.col("event_id") % 3 != 0)
    chain = gaze_chain(spark, new_path(spark, "chain"), verdicts)
    chain.run(rows.where(f"{NUMBER} % 3 = 0"))
    chain.run(rows)
    return chain.rows("counts")


# --- documents ----------------------------------------------------------------------------------------------------


@query(f"with g as ({adapters.sql(adapters.GT_GESTURES)}), n as (select *, row_number() over (partition by video_id order by gt_key) - 1 i from g) select video_id gt_video, i gt_key, case when i % 5 = 0 then 'unknown' else gesture_type end gesture_type, case when i % 4 = 0 then 0e0 else start_time end start_time, end_time, -1 initiator_id, 'unknown' target_type, case when i % 2 = 0 then 1e0 else 5e-1 end confidence from n")
def s7_ground_truth(spark, sf_dir):
    """Annotated gestures with fields missing here and there, which are filled in."""
    n = F.row_number().over(timeline.Window.partitionBy("video_id").orderBy("gt_key")) - 1
    rows = gt(spark, sf_dir).withColumn("i", n)
    kept = [F.when(F.col("i") % 5 != 0, F.col("gesture_type")).alias("gesture_type"), F.when(F.col("i") % 4 != 0, F.col("start_time").cast("string")).alias("start_time"), F.col("end_time").cast("string").alias("end_time"), F.when(F.col("i") % 2 != 0, 0.5).alias("confidence")]
    path = new_path(spark, "truth")
    documents.write(rows.groupBy("video_id").agg(documents.listed("gestures", "i", kept)), path)
    out = documents.ground_truth(documents.named(spark, path, documents.GESTURES))
    return out.select("gt_video", "gt_key", "gesture_type", "start_time", "end_time", F.col("initiator_id").cast("long").alias("initiator_id"), "target_type", "confidence")


def _tv(spark, sf_dir):
    """An entry a line: two frames with a box or two each."""
    k = F.col("event_id")
    box = lambda name, at: F.struct(name.alias("label"), (k % 50 + at).cast("double").alias("left"), F.lit(10.0).alias("top"), (k % 30 + 1.0).alias("width"), F.lit(5.5).alias("height"))
    boxes = F.map_from_arrays(F.array((k % 20 + 3).cast("string"), (k % 20).cast("string")), F.array(F.array(box(F.lit(" annie"), 0), box(F.lit("table"), 1)), F.array(box(F.when(k % 2 == 0, "Bobby").otherwise("chair"), 2))))
    answers = [F.when(k % 3 == 0, "(Zoe!)").otherwise("no one").alias("a0"), *(F.lit(f"a{j}").alias(f"a{j}") for j in range(1, 5))]
    rows = table(spark, sf_dir, "events").select(k.alias("qid"), F.concat(F.lit("s01e02_clip_"), (k % 9).cast("string")).alias("vid_name"), F.array(F.lit(1.5), F.lit(4.0)).alias("ts"), F.lit("Who met\tANN, not Annx?").alias("q"), *answers, (k % 5).alias("answer_idx"), boxes.alias("bbox"))
    path = new_path(spark, "tv")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return documents.tv_questions(spark, path, "*", lines=True)


@query("with b as (select event_id qid, event_id % 20 + 3 frame, 0 box_no, ' annie' as label, event_id % 50 + 0e0 x1, event_id % 30 + 1e0 w from events union all select event_id, event_id % 20 + 3, 1, 'table', event_id % 50 + 1e0, event_id % 30 + 1e0 from events union all select event_id, event_id % 20, 0, case when event_id % 2 = 0 then 'Bobby' else 'chair' end, event_id % 50 + 2e0, event_id % 30 + 1e0 from events) select qid, frame, box_no, label, x1, 10e0 y1, x1 + w x2, 155e-1 y2, case when frame = qid % 20 then 1 else 2 end number from b")
def s10_tv_boxes(spark, sf_dir):
    """Boxes of annotated frames as corners, frames numbered from 1."""
    return tv.numbered_frames(documents.tv_boxes(_tv(spark, sf_dir))).withColumn("number", F.col("number").cast("long"))


PEOPLE = {"ann": "Ann", "annie": "Ann", "bobby": "Bob", "bob": "Bob", "zoe": "Zoe"}


@query("select event_id qid, unnest(list_filter(['Ann', case when event_id % 2 = 0 then 'Bob' end, case when event_id % 3 = 0 then 'Zoe' end], lambda x: x is not null)) as name, concat('P', unnest(range(0, 1 + (event_id % 2 = 0)::int + (event_id % 3 = 0)::int))) as label from events")
def a22_names(spark, sf_dir):
    """Distinct names of each entry, from labels and words."""
    rows = _tv(spark, sf_dir)
    return tv.name_map(tv.mentioned(rows, documents.tv_boxes(rows)), PEOPLE)


@query(f"with g as ({adapters.sql(adapters.GAZE)}), p as (select video_id, row_number() over (partition by video_id order by frame_pos) - 1 frame_pos, frame_idx, ts, gx, gy, (frame_pos % 10) / 1e1 inout, fx1 hx1, fy1 hy1, fx2 hx2, fy2 hy2 from g where person_id = 1 and gx is not null and gy is not null) select *, inout > 5e-1 in_frame from p")
def s16_predictions(spark, sf_dir):
    rows = gaze(spark, sf_dir).where("person_id = 1 AND gx IS NOT NULL AND gy IS NOT NULL").select("video_id", "frame_pos", "frame_idx", "ts", "gx", "gy", ((F.col("frame_pos") % 10) / 10.0).alias("inout"), F.col("fx1").alias("hx1"), F.col("fy1").alias("hy1"), F.col("fx2").alias("hx2"), F.col("fy2").alias("hy2"))
    path = new_path(spark, "predictions")
    documents.write(documents.prediction_documents(rows, 1280, 720), path)
    return documents.predictions(documents.named(spark, path, documents.PREDICTIONS))


@query(f"with g as ({adapters.sql(adapters.GAZE)}) select video_id, frame_pos frame, person_id, fx1 x1, fy1 y1, fx2 x2, fy2 y2, (person_id + 1) / 1e1 score from g where fx1 is not null")
def s15_tracks(spark, sf_dir):
    rows = gaze(spark, sf_dir).where("fx1 IS NOT NULL").select("video_id", F.col("frame_pos").alias("frame"), "person_id", F.col("fx1").alias("x1"), F.col("fy1").alias("y1"), F.col("fx2").alias("x2"), F.col("fy2").alias("y2"), ((F.col("person_id") + 1) / 10.0).alias("score"))
    path = new_path(spark, "tracks")
    documents.write(documents.track_documents(rows), path)
    return documents.tracks(documents.named(spark, path, documents.TRACKS))


@query("with k as (select o_orderkey k, concat('v', o_orderkey, '.x') v from orders), g as (select v from k where k % 2 = 0), h as (select v from k where k % 3 = 0) select coalesce(g.v, h.v) video_id, case when g.v is not null then concat('/a/', g.v, '_sam3rf_gaze_events.json') end gaze_path, case when h.v is not null then concat('/b/', h.v, '_gestures_v2.json') end gesture_path from g full join h on g.v = h.v")
def j20_merge_inputs(spark, sf_dir):
    """Paths of both inputs of a merge by video, from listings that hold other files as well."""
    k = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("v"), F.col("o_orderkey").cast("string"), F.lit(".x")).alias("v"))
    put = lambda where, folder, ending: k.where(where).select(F.concat(F.lit(folder), "v", F.lit(ending)).alias("path"))
    gaze_files = put("o_orderkey % 2 = 0", "/a/", "_sam3rf_gaze_events.json").union(put("o_orderkey % 7 = 0", "/a/", "_features.json"))
    return pairing.merge_inputs(gaze_files, put("o_orderkey % 3 = 0", "/b/", "_gestures_v2.json"))


@query("with k as (select o_orderkey k, case o_orderkey % 3 when 0 then concat('v', o_orderkey, '_sam3rf') else concat('v', o_orderkey) end b, concat('v', o_orderkey) s from orders) select concat('/v/', b, '_viz.mp4') path, case when k % 2 = 0 then concat('/e/', b, '_gaze_events.json') when k % 5 = 0 then concat('/e/', b, '_sam3rf_gaze_events.json') end events_path, case when k % 4 = 1 then concat('/g/', s, '_gestures_v2.json') when k % 4 = 2 then concat('/g/', b, '_viz_gestures_v2.json') end gestures_path from k")
def j21_paired_files(spark, sf_dir):
    """The events and gestures that belong to rendered videos, by the names they may have."""
    n = F.col("o_orderkey")
    k = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("v"), n.cast("string"), F.when(n % 3 == 0, "_sam3rf").otherwise("")).alias("b"), F.concat(F.lit("v"), n.cast("string")).alias("s"))
    put = lambda where, folder, name, ending: k.where(where).select(F.concat(F.lit(folder), name, F.lit(ending)).alias("path"))
    found = put("o_orderkey % 2 = 0", "/e/", "b", "_gaze_events.json").union(put("o_orderkey % 5 = 0", "/e/", "b", "_sam3rf_gaze_events.json"))
    held = put("o_orderkey % 4 = 1", "/g/", "s", "_gestures_v2.json").union(put("o_orderkey % 4 = 2", "/g/", "b", "_viz_gestures_v2.json")).union(put("o_orderkey % 4 = 1", "/g/", "b", "_viz_gestures_v2.json"))
    return pairing.paired_files(put("true", "/v/", "b", "_viz.mp4"), found, held)


@query(f"with w as ({WRITTEN.format(conversations='conversations')}) select concat('v', video_id) video_id, row_number() over (partition by video_id order by idx) - 1 place, category, format, question, answer, answer_text, n_options, n_times from w")
def s11_question_documents(spark, sf_dir):
    """Questions written as documents and read back."""
    rows = _written(spark, sf_dir).withColumn("video_id", F.concat(F.lit("v"), F.col("video_id").cast("string")))
    kept = [F.col("idx").cast("string").alias("question_id"), "category", F.lit(None).cast("string").alias("subcategory"), "format", "question", "answer", "answer_text", "options", "time_range"]
    path = new_path(spark, "questions")
    documents.write(rows.groupBy("video_id").agg(documents.listed("qa_pairs", "idx", kept)), path)
    got = documents.elements(documents.named(spark, path, documents.QUESTIONS), "qa_pairs", "place")
    return got.select("video_id", F.col("place").cast("long").alias("place"), "category", "format", "question", "answer", "answer_text", F.size("options").cast("long").alias("n_options"), F.size("time_range").cast("long").alias("n_times"))


@query(f"{BASE}, p as (select video_id, gaze_place gaze_idx, gesture_place gesture_idx, case when o then 'overlap' else 'adjacent' end relation, (select count(*) from tl where tl.video_id = pairs.video_id) num_events_filtered from pairs) select * from p")
def s11_graph_documents(spark, sf_dir):
    """Graphs (here without their filter) written as documents and read back."""
    rows = merged(spark, sf_dir)
    pairs = timeline.cross_modal_pairs(rows).select("video_id", F.col("gaze_place").alias("gaze_idx"), F.col("gesture_place").alias("gesture_idx"), "relation", "seconds")
    events_ = rows.withColumn("description", F.lit(None).cast("string")).groupBy("video_id").agg(F.count("*").alias("num_events_filtered"), documents.listed("events", "place", ["place", "source", "item", "kind", "start_time", "end_time", "confidence", "persons", "description"]))
    held = pairs.withColumn("_at", F.struct("gaze_idx", "gesture_idx")).groupBy("video_id").agg(documents.listed("cross_modal_pairs", "_at", ["gaze_idx", "gesture_idx", "relation", "seconds"]))
    path = new_path(spark, "graphs")
    documents.write(events_.join(held, "video_id", "left"), path)
    docs = documents.named(spark, path, documents.GRAPH)
    return documents.elements(docs, "cross_modal_pairs").drop("seconds").join(docs.select("video_id", "num_events_filtered"), "video_id")


@query(f"{BASE} select distinct video_id from s where video_id not in (select video_id from e where confidence = 1e0)")
def j19_not_done(spark, sf_dir):
    """Videos that have gestures and no result yet (here an event that is sure)."""
    return documents.not_done(gestures(spark, sf_dir).select("video_id").distinct(), gaze_events(spark, sf_dir).where("confidence = 1"))


# --- graphs, merges and evaluation --------------------------------------------------------------------------------


def _items(spark, sf_dir):
    return gaze_events(spark, sf_dir).select("video_id", F.col("event_id").alias("item"), F.col("event_type").alias("kind"), "start_time", "end_time", "confidence")


def _replies(spark, sf_dir):
    """A reply a video: a map from ids to texts of a third of its events, some within other words, some broken."""
    rows = gaze_events(spark, sf_dir).where("event_id % 3 = 0").groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("says \"it\" "), F.col("event_id").cast("string"))).otherwise("").alias("t"))))).alias("m"))
    body, k = F.to_json("m"), F.expr(NUMBER)
    return rows.select("video_id", F.when(k % 3 == 0, body).when(k % 3 == 1, F.concat(F.lit("Here you are:\n"), body, F.lit("\nDone."))).otherwise("{ broken").alias("reply"))


@query(f"""{BASE}, k as (select *, {NUMBER} v from e where confidence >= 9e-1), r as (select *, row_number() over (partition by video_id order by confidence desc, start_time, event_id) <= 50 p from k),
d as (select *, case when v % 3 < 2 and event_id % 6 = 0 then 1 end said from r), n as (select *, row_number() over (partition by video_id order by start_time, end_time, event_id) n from k), x as (select a.video_id, count(*) edges from n a join n b on a.video_id = b.video_id and a.n < b.n and b.start_time - a.end_time <= 3 group by 1)
select e.video_id, count(*) as events, coalesce(max(kept), 0) kept, coalesce(max(described), 0) described, coalesce(max(edges), 0) edges, coalesce(max(f), 0) first_start, coalesce(max(l), 0) last_end, coalesce(max(p), 0) in_prompt
from e left join (select video_id, count(*) kept, count(said) described, min(start_time) f, max(end_time) l, count(*) filter (p) p from d group by 1) using (video_id) left join x using (video_id) group by 1""")
def e10_event_graph(spark, sf_dir):
    nodes, _, told = graph.event_graph(_items(spark, sf_dir), _replies(spark, sf_dir))
    asked = nodes.groupBy("video_id").agg(F.count_if("in_prompt").alias("in_prompt"))
    return told.join(asked, "video_id", "left").na.fill(0, ["in_prompt"])


@query(f"{BASE}, k as (select *, {NUMBER} v from e where confidence >= 9e-1) select video_id, event_id item, case when v % 3 < 2 and event_id % 6 = 0 then concat('says \"it\" ', event_id) end description from k")
def j15_descriptions(spark, sf_dir):
    nodes, _, _ = graph.event_graph(_items(spark, sf_dir), _replies(spark, sf_dir))
    return nodes.select("video_id", "item", "description")


@query()
def e9_cross_graph(spark, sf_dir):
    """The graph of the filtered timeline with its pairs; greedy, held against a loop."""
    return graph.cross_graph(merged(spark, sf_dir))[2]


def _told(spark, sf_dir):
    """The merged timeline with details of its events."""
    k = F.col("event_id")
    details = F.struct(F.when(k % 2 == 0, F.col("person_a")).alias("leader_id"), F.col("person_b").alias("follower_id"), ((k % 4) / 2.0).alias("lag_seconds"), (F.col("end_time") - F.col("start_time")).alias("duration"), (k % 3).alias("num_persons"))
    told = gaze_events(spark, sf_dir).select("video_id", k.alias("item"), graph.told_details(F.col("event_type"), details).alias("told"))
    target = gestures(spark, sf_dir).select("video_id", F.col("gesture_key").alias("item"), "initiator_id", "target_type", "target_person_id", F.when(F.col("gesture_key") % 2 == 0, "a cup").otherwise("").alias("target_description"))
    rows = merged(spark, sf_dir)
    a = rows.where("source = 'gaze'").join(told, ["video_id", "item"])
    b = rows.where("source = 'gesture'").join(target, ["video_id", "item"])
    return a.unionByName(b, allowMissingColumns=True)


DETAILED = "case event_type when 'gaze_following' then concat('\"follower_id\":', person_b, case when event_id % 4 <> 0 then concat(',\"lag_seconds\":', (event_id % 4) / 2e0) else '' end, ',\"leader_id\":', case when event_id % 2 = 0 then person_a::varchar else 'null' end) when 'mutual_gaze' then case when end_time <> start_time then concat('\"gaze_duration\":', end_time - start_time) else '' end when 'sudden_gaze_shift' then '' else case when event_id % 3 <> 0 then concat('\"num_persons\":', event_id % 3) else '' end end"


@query(f"{BASE} select video_id, event_id item, replace(concat('{{', {DETAILED}, '}}'), '.0,', ',') told from e where confidence >= 9e-1")
def f4_details(spark, sf_dir):
    """What is told of each gaze event, by its kind, as JSON in order of names."""
    rows = _told(spark, sf_dir).where("source = 'gaze'")
    return rows.select("video_id", "item", F.replace(F.to_json(F.to_variant_object("told")), F.lit(".0,"), F.lit(",")).alias("told"))


@query(f"""{BASE}, x as (select tl.*, s.initiator_id, s.target_type, s.target_person_id, e.person_a, e.person_b, e.event_type, e.event_id from tl left join s on source = 'gesture' and s.video_id = tl.video_id and s.gesture_key = item left join e on source = 'gaze' and e.video_id = tl.video_id and e.event_id = item),
j as (select video_id, place, case when source = 'gaze' then concat('{{"end_time":', end_time, ',"event_type":"', kind, '"', case when event_type = 'gaze_following' then concat(',"follower_id":', person_b) else '' end, case when event_type = 'mutual_gaze' and end_time <> start_time then concat(',"gaze_duration":', end_time - start_time) else '' end, ',"index":', place,
  case when event_type = 'gaze_following' then concat(case when event_id % 4 <> 0 then concat(',"lag_seconds":', (event_id % 4) / 2e0) else '' end, ',"leader_id":', case when event_id % 2 = 0 then person_a::varchar else 'null' end) else '' end, case when event_type in ('joint_attention', 'attention_capture') and event_id % 3 <> 0 then concat(',"num_persons":', event_id % 3) else '' end,
  ',"persons_involved":[', array_to_string(persons, ','), '],"source":"gaze","start_time":', start_time, '}}')
  else concat('{{"end_time":', end_time, ',"gesture_type":"', kind, '","index":', place, ',"initiator_id":', initiator_id, ',"source":"gesture","start_time":', start_time, case when item % 2 = 0 then ',"target_description":"a cup"' else '' end, ',"target_person_id":', coalesce(target_person_id::varchar, 'null'), ',"target_type":"', target_type, '"}}') end t from x)
select video_id, replace(replace(concat('[', string_agg(t, ',' order by place), ']'), '.0,', ','), '.0}}', '}}') payload from j group by 1""")
def f17_payloads(spark, sf_dir):
    """The events of each video as JSON, with only what their kinds are told with."""
    out = graph.payloads(_told(spark, sf_dir))
    return out.withColumn("payload", F.replace(F.replace("payload", F.lit(".0,"), F.lit(",")), F.lit(".0}"), F.lit("}")))


def _segments(spark, sf_dir):
    """Videos as segments of longer ones: ten of each, and lengths of two in three."""
    name = F.format_string("m_%d_%03d", F.floor(F.expr(NUMBER) / 10), F.expr(NUMBER) % 10 + 1)
    re = lambda d: d.withColumn("video_id", name)
    order = F.row_number().over(timeline.Window.partitionBy("video_id").orderBy("gesture_key")) - 1
    hands = re(gestures(spark, sf_dir)).withColumn("gesture_key", order.cast("long"))
    lengths = hands.select("video_id").distinct().where("cast(right(video_id, 3) as int) % 3 > 0").withColumn("seconds", F.substring("video_id", -3, 3).cast("double") + 100)
    n = F.row_number().over(timeline.Window.partitionBy("gt_video").orderBy("_k")) - 1
    truth = gt(spark, sf_dir).withColumn("_k", F.col("gt_key")).withColumn("gt_video", F.format_string("m %d", F.floor(F.expr(NUMBER) / 20) * 2)).withColumn("gt_key", n.cast("long"))
    shift = (F.expr(NUMBER) % 20) * 60.0
    truth = truth.withColumns({c: F.col(c) + shift for c in ("start_time", "end_time")}).select("gt_video", "gt_key", "gesture_type", "start_time", "end_time")
    return re(gaze_events(spark, sf_dir)), hands, lengths, truth


SEGMENTED = f"""{BASE}, m as (select *, printf('m_%d_%03d', cast(floor({NUMBER} / 10) as bigint), {NUMBER} % 10 + 1) seg, {NUMBER} % 10 + 1 k from s), q as (select seg, case when k % 3 > 0 then k + 1e2 else 12e1 end sec, row_number() over (partition by seg order by gesture_key) - 1 i, gesture_type, floor(start_time*2)/2e0 a, ceil(end_time*2)/2e0 z, confidence from m),
h as (select * from q where confidence >= 85e-2 and z <= sec), y as (select printf('m_%d_%03d', cast(floor({NUMBER} / 10) as bigint), {NUMBER} % 10 + 1) seg, * from e)"""


@query(f"{SEGMENTED}, n as (select seg from y union select seg from q) select n.seg video_id, (select count(*) from y where y.seg = n.seg and confidence >= 9e-1) gaze_events, (select count(*) from h where h.seg = n.seg) gestures, (select count(*) from y where y.seg = n.seg and confidence >= 9e-1) + (select count(*) from h where h.seg = n.seg) total from n")
def e8_merge_job(spark, sf_dir):
    """Segments merged, with their own lengths, where there is no truth."""
    events_, hands, lengths, _ = _segments(spark, sf_dir)
    return graph.merge_job(events_, hands, lengths)[1]


@query()
def e8_merge_job_truth(spark, sf_dir):
    """Segments merged, gestures kept by the truth of their whole videos; greedy, held against a loop."""
    return graph.merge_job(*_segments(spark, sf_dir))[1]


@query()
def e14_evaluate_job(spark, sf_dir):
    """Gestures of segments against the truth of whole videos; greedy, held against a loop."""
    _, hands, lengths, truth = _segments(spark, sf_dir)
    return graph.evaluate_job(hands, lengths, truth, 0.75)[0]


@query(f"{SEGMENTED}, o as (select distinct seg, sec, cast(right(seg, 3) as int) n, regexp_extract(seg, '^(.+)_\\d+$', 1) v from q), t as (select *, coalesce(sum(sec) over (partition by v order by n rows between unbounded preceding and 1 preceding), 0e0) f from o) select q.seg video_id, i gesture_key, a + f start_time, z + f end_time from q join t using (seg)")
def x33_video_clock(spark, sf_dir):
    """Snapped gestures of segments on the clock of their videos."""
    _, hands, lengths, _ = _segments(spark, sf_dir)
    snapped = hands.withColumns({"start_time": F.floor(F.col("start_time") * 2) / 2.0, "end_time": F.ceil(F.col("end_time") * 2) / 2.0})
    return graph.on_video_clock(snapped, graph.segment_times(hands.select("video_id"), lengths)).select("video_id", "gesture_key", "start_time", "end_time")


@query(f"{BASE} select video_id, event_id, least, source from (select *, 'merge' source, 8e-1 least from e where confidence is not null and confidence >= 8e-1 and event_id % 4 <> 0 union all select *, 'count', 8e-1 from e where event_id % 4 = 0 or confidence >= 8e-1)")
def f6_confidence(spark, sf_dir):
    """Events without a confidence (every fourth) count as sure where events are counted, and as unsure where they are merged."""
    rows = gaze_events(spark, sf_dir).withColumn("confidence", F.when(F.col("event_id") % 4 != 0, F.col("confidence")))
    out = graph.at_least(rows, 0.8).withColumn("source", F.lit("merge")).union(graph.at_least(rows, 0.8, 1.0).withColumn("source", F.lit("count")))
    return out.select("video_id", "event_id", F.lit(0.8).alias("least"), "source")


@query(f"{BASE} select dataset, count(*) n, count(distinct video_id) videos from (select *, concat('d', {NUMBER} % 7) dataset from e) where dataset in ('d1', 'd4') and video_id in ('v00001', 'v00004', 'v00008', 'v00011') group by 1")
def f18_chosen(spark, sf_dir):
    """Datasets and listed videos, from a table in folders by dataset."""
    rows = gaze_events(spark, sf_dir).withColumn("dataset", F.concat(F.lit("d"), F.expr(NUMBER) % 7))
    path = new_path(spark, "chosen")
    sinks.save_by(rows, path, ["dataset"], ["event_id"])
    some = graph.chosen(spark.read.parquet(path), ["d1", "d4"], ["v00001", "v00004", "v00008", "v00011"])
    return some.groupBy("dataset").agg(F.count("*").alias("n"), F.countDistinct("video_id").alias("videos"))


@query(f"{BASE} select video_id, gesture_type, count(*) n from s group by all")
def a15_gesture_counts(spark, sf_dir):
    return questions.gesture_counts(gestures(spark, sf_dir))


@query(f"{BASE} select video_id, count(*) filter (event_id % 3 <> 0) confirmed, count(*) filter (event_id % 3 = 0) rejected from e group by 1")
def a15_confirmed_counts(spark, sf_dir):
    return questions.verdict_counts(gaze_events(spark, sf_dir).withColumn("confirmed", F.col("event_id") % 3 != 0))


KIND = ", ".join(f"coalesce(sum(n) filter (coalesce(pred_type, 'missed') = '{k}'), 0) {k}" for k in (*questions.GESTURES, "missed"))


@query(f"with c as ({TIMELINE_SQL['a13_confusion']}) select gt_type, {KIND} from c group by gt_type")
def a13_confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(evaluate.confusion(gt(spark, sf_dir), gestures(spark, sf_dir)), list(questions.GESTURES))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a - w / 2, 6) x1, round(b - h / 2, 6) y1, round(a + w / 2, 6) x2, round(b + h / 2, 6) y2, a <= 5e-1 + w and 5e-1 <= a + w meet from (select *, (l_partkey % 100) / 1e2 a, (l_suppkey % 50) / 5e1 b, l_quantity / 1e2 w, 1e-1 + l_discount h from lineitem)")
def x22_boxes(spark, sf_dir):
    """Corners of boxes given by centre and size; and spans of equal length that touch or overlap."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 100 / 1e2).alias("a"), (F.col("l_suppkey") % 50 / 5e1).alias("b"), (F.col("l_quantity").cast("double") / 1e2).alias("w"), (F.col("l_discount").cast("double") + 0.1).alias("h"))
    box = geometry.corners_of_centre(F.col("a"), F.col("b"), F.col("w"), F.col("h"))
    spans = geometry.overlaps(F.col("a"), F.col("a") + F.col("w"), F.lit(0.5), F.lit(0.5) + F.col("w"), strict=False)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.round(c, 6).alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"))), spans.alias("meet"))


# --- features -----------------------------------------------------------------------------------------------------


@query(f"{GAZE_BASE}, p as (select *, face and x is not null known from r), c as (select *, avg(case when known then x end) over w ax, avg(case when known then y end) over w ay from p window w as (partition by video_id, pos)) select video_id, pos, round(case when count(*) filter (known) >= 2 then exp(-3e0 * median(case when known then sqrt((x-ax)*(x-ax) + (y-ay)*(y-ay)) end)) else 0e0 end, 6) + 0e0 convergence from c group by all")
def a3_plain_convergence(spark, sf_dir):
    out = features.plain_convergence(features.features(gaze(spark, sf_dir)))
    return rounded(out, "convergence").withColumn("pos", F.col("pos").cast("long"))


@query(f"{GAZE_BASE} select video_id, frame_pos, person_id, round(pos / 2e0, 6) sampled_ts, round(frame_idx / 3e1, 6) video_ts from o")
def w11_frame_times(spark, sf_dir):
    return rounded(features.frame_times(gaze(spark, sf_dir), 2.0, 30.0), "sampled_ts", "video_ts").select("video_id", "frame_pos", "person_id", "sampled_ts", "video_ts")


@query(f"{GAZE_BASE}, h as (select a.*, case when a.face_detected then (a.fx1+a.fx2)/2 end hx, case when a.face_detected then (a.fy1+a.fy2)/2 end hy, b.ix bx, b.iy by_ from i a left join i b on b.video_id = a.video_id and b.person_id = a.person_id and b.obs_pos = a.pos), d as (select *, bx - hx dx, by_ - hy dy from h), lg as (select *, lag(dx) over w ldx, lag(dy) over w ldy, lag(hx) over w lhx, lag(hy) over w lhy, ts - lag(ts) over w dt from d window w as (partition by video_id, person_id order by obs_pos)), mv as (select *, sqrt((hx-lhx)*(hx-lhx)+(hy-lhy)*(hy-lhy)) moved, sqrt((dx-ldx)*(dx-ldx)+(dy-ldy)*(dy-ldy)) turned from lg) select video_id, frame_pos, person_id, round(dx, 6) + 0e0 dir_x, round(dy, 6) + 0e0 dir_y, round(case when moved <= 3e-1 then case when dt > 0 then moved / dt else 0e0 end end, 6) + 0e0 anchor_velocity, round(case when moved <= 3e-1 and turned is not null then case when dt > 0 then turned / dt else 0e0 end end, 6) + 0e0 gaze_dir_velocity from mv")
def w3_anchor_motion(spark, sf_dir):
    """The gaze's direction from the face with its positional lookup, and how fast it turns."""
    out = features.anchor_motion(features.fill_gaps(features.observed(gaze(spark, sf_dir))))
    return rounded(out, "dir_x", "dir_y", "anchor_velocity", "gaze_dir_velocity").select("video_id", "frame_pos", "person_id", "dir_x", "dir_y", "anchor_velocity", "gaze_dir_velocity")


@query(f"{GAZE_BASE} select video_id, person_id, count(*) track_length, round(coalesce(max(velocity), 0), 6) max_velocity, round_even(100e0*count(*) filter (face_detected)/count(*), 1) face_pct, round_even(100e0*count(*) filter (valid)/count(*), 1) inframe_pct from v group by all")
def a1_person_table(spark, sf_dir):
    out = features.person_table(features.velocities(features.fill_gaps(features.observed(gaze(spark, sf_dir)))))
    return rounded(out, "max_velocity").select("video_id", "person_id", "track_length", "max_velocity", "face_pct", "inframe_pct")
