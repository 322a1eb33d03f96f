"""Queries on functions of times, names, texts and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, text

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("select event_id, case event_id % 4 when 0 then event_id % 600 + 5e-1 when 1 then (event_id % 60)*60 + event_id % 59 + 25e-2 when 2 then 3600e0*(event_id % 5) + 60*(event_id % 60) + event_id % 61 % 60 end as seconds from events")
def x1_parse_time(spark, sf_dir):
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    clock = F.when(k % 4 == 0, F.concat(F.lit(" "), s(k % 600), F.lit(".5"))).when(k % 4 == 1, F.concat(s(k % 60), F.lit(":"), s(k % 59), F.lit(".25"))).when(k % 4 == 2, F.concat(s(k % 5), F.lit(":"), s(k % 60), F.lit(":"), s(k % 61 % 60))).otherwise("x:1")
    return table(spark, sf_dir, "events").select("event_id", text.parse_time(clock).alias("seconds"))


@query("select event_id, floor(value*2)/2e0 down, ceil(value*2)/2e0 up, round_even(value*2, 0)/2e0 nearest, case when value*50 >= 3600 then concat(cast(floor(value*50/3600) as bigint), 'h ', cast(floor((value*50) % 3600 / 60) as bigint), 'm ', cast(floor((value*50) % 60) as bigint), 's') when value*50 >= 60 then concat(cast(floor(value*50/60) as bigint), 'm ', cast(floor((value*50) % 60) as bigint), 's') else concat(cast(floor(value*50) as bigint), 's') end long from events")
def x3_snap_and_duration(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", text.snap_down(v).alias("down"), text.snap_up(v).alias("up"), text.snap_to_frame(v).alias("nearest"), text.duration_text(v * 50).alias("long"))


@query("select event_id, case when event_id % 3 < 2 then 3600e0 + (event_id % 60)*60 + event_id % 59 + (event_id % 1000)/1e3 end as seconds, concat('clip.', event_type) video, case when event_id % 2 = 0 then event_id % 1000 end segment, case when event_id % 5 > 0 then event_id % 13 end season, case when event_id % 5 > 0 then event_id % 25 end episode from events")
def x4_names_of_clips(spark, sf_dir):
    k = F.col("event_id")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    srt = F.when(k % 3 == 2, "later").otherwise(F.concat(F.lit("01:"), pad(k % 60, 2), F.lit(":"), pad(k % 59, 2), F.when(k % 3 == 0, ",").otherwise("."), pad(k % 1000, 3)))
    name = F.when(k % 2 == 0, F.concat(F.lit("clip."), "event_type", F.lit("_"), pad(k % 1000, 3))).otherwise(F.concat(F.lit("clip."), "event_type"))
    tv = F.when(k % 5 == 0, "s1").otherwise(F.concat(F.lit("s"), pad(k % 13, 2), F.lit("e"), pad(k % 25, 2), F.lit("_seg01")))
    rows = table(spark, sf_dir, "events").select("event_id", text.srt_time(srt).alias("seconds"), text.segment_name(name).alias("n"), text.episode(tv).alias("e"))
    return rows.select("event_id", "seconds", "n.video", F.col("n.segment").cast("long").alias("segment"), F.col("e.season").cast("long").alias("season"), F.col("e.episode").cast("long").alias("episode"))


@query("select o_orderkey, concat('clip_', o_orderkey) video_id, case o_orderkey % 3 when 0 then 'b' when 1 then 'a' else 'unknown' end dataset, concat('data_', case o_orderkey % 3 when 0 then 'b' when 1 then 'a_b' else 'z' end, '_x') flat from orders")
def s18_names_of_documents(spark, sf_dir):
    k = F.col("o_orderkey")
    stage = F.when(k % 4 == 0, "_sam3rf_gaze_events.json").when(k % 4 == 1, "_gestures_v2.json").when(k % 4 == 2, ".mp4.json").otherwise("_events.json")
    folder = F.when(k % 3 == 0, "b").when(k % 3 == 1, "a/b").otherwise("z")
    path = F.concat(F.lit("/data/"), folder, F.lit("/clip_"), k.cast("string"), stage)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.video_of(path).alias("video_id"), text.dataset_of(F.concat(F.lit("/"), folder, F.lit("/")), ["/a/", "/b/"]).alias("d"), text.flat_name(F.concat(F.lit("data/"), folder, F.lit("/x"))).alias("flat")).withColumn("dataset", F.when(F.col("d") == "unknown", "unknown").otherwise(F.translate("d", "/", ""))).drop("d")


@query("select distinct o_custkey path from orders")
def s19_distinct_paths(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path")).dropDuplicates(["path"])


@query("select event_id, case event_id % 4 when 0 then 'unknown persons' when 1 then concat('Person ', event_id % 7) when 2 then concat('Person ', event_id % 7, ' and Person ', event_id % 5) else concat('Person ', event_id % 7, ', Person ', event_id % 5, ', and Person ', event_id % 3) end persons, case when event_type in ('view', 'click') then concat(event_type, ' it') end chosen from events")
def x31_person_lists(spark, sf_dir):
    k = F.col("event_id")
    persons = F.slice(F.array(k % 7, k % 5, k % 3), F.lit(1), (k % 4).cast("int"))
    options = F.array(F.concat(F.lit("A) "), F.lit("view it")), F.concat(F.lit(" b)  "), F.lit("click it")))
    answer = F.when(F.col("event_type") == "view", " a").when(F.col("event_type") == "click", "b").otherwise("C")
    options = F.transform(options, lambda o: F.regexp_replace(o, r"^ b\)", "B)"))
    return table(spark, sf_dir, "events").select("event_id", text.persons_text(persons).alias("persons"), text.option_text(options, answer).alias("chosen"))


@query(r"with w as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) a, list_distinct(list_filter(regexp_split_to_array(lower(after), '\s+'), lambda x: x <> '')) b, regexp_matches(text, '(?i)\b(how\s+(much\s+time|long)|time\s+passes|elapsed|delay|duration)\b') asks from (select *, coalesce(lead(text) over (partition by conv_id order by turn), '') after from conversations)) select conv_id, turn, len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) jaccard, asks from w")
def x32_word_sets(spark, sf_dir):
    """The words of each turn and of the one after it."""
    t, after = F.col("text"), F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return table(spark, sf_dir, "conversations").withColumn("after", after).select("conv_id", "turn", text.jaccard(t, F.col("after")).alias("jaccard"), text.asks_duration(t).alias("asks"))


@query("with b as (select event_id, (event_id % 97)/1e2 x, (event_id % 89)/1e2 y, 1e-1 + (event_id % 7)/5e1 w, 1e-1 + (event_id % 5)/5e1 h, (event_id % 83)/1e2 u, (event_id % 79)/1e2 v from events), c as (select *, greatest(0, least(x+w, u+2e-1) - greatest(x, u)) iw, greatest(0, least(y+h, v+2e-1) - greatest(y, v)) ih from b) select event_id, round(iw*ih/((x+w-x)*(y+h-y) + (u+2e-1-u)*(v+2e-1-v) - iw*ih), 6) iou, (x+(x+w))/2 >= u and (x+(x+w))/2 <= u+2e-1 and (y+(y+h))/2 >= v and (y+(y+h))/2 <= v+2e-1 inside, cast(trunc(x*1920) as bigint) px, printf('position: [%.4f, %.4f]', (x+(x+w))/2, (y+(y+h))/2) place from c")
def x8_boxes(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (k % 97 / 1e2).alias("x"), (k % 89 / 1e2).alias("y"), (0.1 + k % 7 / 5e1).alias("w"), (0.1 + k % 5 / 5e1).alias("h"), (k % 83 / 1e2).alias("u"), (k % 79 / 1e2).alias("v"))
    a = geometry.corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    b = [F.col("u"), F.col("v"), F.col("u") + 0.2, F.col("v") + 0.2]
    cx, cy = geometry.centre(a)
    return rows.select("event_id", F.round(geometry.box_iou(a, b), 6).alias("iou"), geometry.inside(cx, cy, b, 0.0).alias("inside"), geometry.pixel(F.col("x"), 1920).alias("px"), geometry.position_text(a).alias("place"))


@query("with v as (select vec_id, label, embedding e from embeddings), p as (select a.vec_id, list_dot_product(cast(a.e as double[]), cast(b.e as double[])) d, sqrt(list_dot_product(cast(a.e as double[]), cast(a.e as double[]))) n, sqrt(list_dot_product(cast(b.e as double[]), cast(b.e as double[]))) m, list_position(a.e, list_max(a.e)) - 1 top from v a join v b on b.vec_id = a.vec_id + 1) select vec_id, round(d / (n*m + 1e-8), 5) cosine, top % 8 x, top // 8 y from p")
def x14_cosine_and_argmax(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x, y = geometry.heat_point(F.col("embedding"), 8)
    return a.join(b, "vec_id").select("vec_id", F.round(geometry.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"), x.alias("x"), y.alias("y"))


@query("with s as (select s_suppkey video, 20 + s_suppkey % 300 n from supplier), k as (select video, n, unnest(range(0, n)) k from s) select video, cast(floor(k * 125e-1) as bigint) frame, cast(floor(k * 5e-1 * 25) as bigint) by_time, k // 120 chunk from k")
def x25_sampled_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video"), (20 + F.col("s_suppkey") % 300).alias("n"))
    k = F.col("k")
    frames = rows.select("video", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    return frames.select("video", geometry.sampled(k, 25.0, 2.0).alias("frame"), F.floor(k * 0.5 * 25).alias("by_time"), F.floor(k / 120).alias("chunk"))


@query("with s as (select s_suppkey video, 20 + s_suppkey % 900 n from supplier), c as (select video, n, unnest(range(0, cast(ceil(greatest(n - 5, 1) / 120e0) as bigint))) chunk from s) select video, chunk, chunk * 120 as first_frame, least(chunk * 120 + 125, n) last_frame from c")
def x26_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video"), (20 + F.col("s_suppkey") % 900).alias("n"))
    return rows.select("video", F.inline(geometry.chunks(F.col("n"), 125, 5)))


@query("with s as (select s_suppkey video, 10e0 * (s_suppkey % 3) a, 10e0 * (s_suppkey % 3) + 30 + s_suppkey % 400 z from supplier), c as (select *, unnest(range(0, cast(ceil((z - a) / 120) as bigint))) k from s) select video, a + k * 120 as start_time, least(a + (k + 1) * 120, z) end_time from c")
def x27_split_scenes(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("video"), (10.0 * (k % 3)).alias("a"), (10.0 * (k % 3) + 30 + k % 400).alias("z"))
    return rows.select("video", F.inline(geometry.split_scene(F.col("a"), F.col("z"), 120.0)))
