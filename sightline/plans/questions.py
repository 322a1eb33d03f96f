"""Queries on questions, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, questions
from ..sources import adapters
from .gaze import gaze

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


EVENTS = f"select video_id, event_id, event_type, start_time, end_time, person_a, person_b, case when event_id % 6 < 3 then event_id % 3 end target_id from ({adapters.GAZE_EVENTS})"
CLASSES = "select concat('v', lpad(cast(o_orderkey % 400 as varchar(10)),5,'0')) video_id, o_orderkey event_id, o_orderkey % 4 <> 0 confirmed, o_custkey % 2 = 0 caused_shift, o_custkey % 3 n_responders from {orders} where o_orderkey % 5 <> 4"
GESTURES = """select concat('v', lpad(cast(l_orderkey % 400 as varchar(10)),5,'0')) video_id, l_orderkey event_id, l_linenumber*1000000 + l_partkey*100 + l_suppkey % 100 gesture_no,
  case l_linenumber % 4 when 0 then 'pointing' when 1 then 'showing' when 2 then 'giving' else 'reaching' end gesture_type, case when l_suppkey % 5 < 4 then l_suppkey % 4 end initiator_id,
  case l_partkey % 3 when 0 then 'person' when 1 then 'object' else 'location' end target_type, case when l_partkey % 2 = 0 then (l_suppkey + 1) % 4 end target_person_id, case when l_partkey % 7 > 1 then concat('thing ', cast(l_partkey % 10 as varchar(5))) when l_partkey % 7 = 1 then '' end target_description
from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from {lineitem})"""


def _rows(spark, sf_dir, text):
    return adapters.rows(spark, sf_dir, text)


def _events(spark, sf_dir):
    return _rows(spark, sf_dir, EVENTS).withColumn("persons", F.array("person_a", "person_b")).drop("person_a", "person_b")


def _classes(spark, sf_dir):
    return _rows(spark, sf_dir, CLASSES).withColumn("responders", F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), F.col("n_responders"))).drop("n_responders")


SECONDS = "concat('Between ', printf('%.1f', start_time), 's and ', printf('%.1f', end_time), 's, ')"
BASE = f"""with ev as (select *, concat(person_a, ',', person_b) persons from ({adapters.sql(EVENTS)})), cl as ({adapters.sql(CLASSES)}), ge as ({adapters.sql(GESTURES)}),
sure as (select ev.*, caused_shift, {SECONDS} b from ev join cl using (video_id, event_id) where confirmed),
op as (select ev.*, coalesce(n_responders, 0) n_responders, {SECONDS} b from ev left join cl using (video_id, event_id) where confirmed is null or confirmed),
x as (select sure.*, ge.* exclude (video_id, event_id) from sure join ge using (video_id, event_id)),
ask as (select sure.*, o from sure join (select video_id, event_id, bool_or(target_type in ('object', 'location')) o from ge group by all) using (video_id, event_id)),
"""
COLUMNS = "start_time, end_time, persons"
RULES = f"""{BASE} g as (select *, dense_rank() over (partition by video_id order by frame_pos) - 1 pos from ({adapters.sql(adapters.GAZE)})),
l as (select *, case when pos - lag(pos) over w = 1 then lag(gx) over w end px, case when pos - lag(pos) over w = 1 then lag(gy) over w end py from g window w as (partition by video_id, person_id order by pos)),
mv as (select *, gx - px dx, gy - py dy, degrees(atan2(gy - py, gx - px)) a, cast(person_id as varchar) persons, concat('At ', printf('%.1f', ts)) at_, ts - 5e-1 start_time, ts + 5e-1 end_time from l where gx is not null and gy is not null and px is not null and py is not null),
q as (
select video_id, concat('A2_', frame_idx, '_', person_id) question_id, 'A' category, 'A2' subcategory, 'classification' task_type, concat(at_, 's, which direction did P', person_id, '''s gaze shift?') question, case when a >= -225e-1 and a < 225e-1 then 'right' when a >= 225e-1 and a < 675e-1 then 'down-right' when a >= 675e-1 and a < 1125e-1 then 'down' when a >= 1125e-1 and a < 1575e-1 then 'down-left' when a >= 1575e-1 or a < -1575e-1 then 'left' when a < -1125e-1 then 'up-left' when a < -675e-1 then 'up' else 'up-right' end answer, 'easy' difficulty, {COLUMNS} from mv where not (abs(dx) < 2e-2 and abs(dy) < 2e-2)
union all select video_id, concat('A3_', frame_idx, '_', person_id), 'A', 'A3', 'classification', concat(at_, 's, how much did P', person_id, '''s gaze shift?'), case when sqrt(dx*dx + dy*dy) < 1e-1 then 'small' when sqrt(dx*dx + dy*dy) < 3e-1 then 'medium' else 'large' end, 'easy', {COLUMNS} from mv
union all select video_id, concat_ws('_', 'B1', event_id, initiator_id), 'B', 'B1', 'classification', concat(b, 'who initiated the ', gesture_type, ' gesture?'), concat('P', initiator_id), 'medium', {COLUMNS} from x where initiator_id is not null
union all select video_id, concat_ws('_', 'B2', event_id, initiator_id), 'B', 'B2', 'classification', b || 'who is ' || ('P' || initiator_id) || '''s ' || gesture_type || ' directed at?', concat('P', target_person_id), 'medium', {COLUMNS} from x where target_type = 'person' and target_person_id is not null
union all select video_id, concat_ws('_', 'B2', event_id, initiator_id), 'B', 'B2', 'classification', b || 'what is ' || ('P' || initiator_id) || '''s ' || gesture_type || ' directed at?', target_description, 'medium', {COLUMNS} from x where target_type <> 'person' and target_description <> ''
union all select video_id, concat_ws('_', 'D1', event_id, initiator_id), 'D', 'D1', 'classification', b || 'what ' || target_type || ' is ' || ('P' || initiator_id) || ' ' || gesture_type || ' at?', target_description, 'medium', {COLUMNS} from x where target_type <> 'person' and target_description <> ''
union all select video_id, concat('B3_', event_id), 'B', 'B3', 'binary', concat(b, 'did any gesture cause others to shift their gaze?'), case when caused_shift then 'yes' else 'no' end, 'hard', {COLUMNS} from ask
union all select video_id, concat('D2_', event_id), 'D', 'D2', 'binary', concat(b, 'did pointing to an object cause others to shift their gaze?'), case when caused_shift then 'yes' else 'no' end, 'hard', {COLUMNS} from ask where o
union all select video_id, concat('C2_', event_id), 'C', 'C2', 'binary', concat(b, 'did anyone respond with a gaze shift?'), case when n_responders > 0 then 'yes' else 'no' end, 'easy', {COLUMNS} from op
union all select video_id, concat('C3_', event_id), 'C', 'C3', 'classification', concat(b, 'which pair is engaged in mutual gaze?'), concat('P', person_a, ' and P', person_b), 'hard', {COLUMNS} from op where event_type = 'mutual_gaze'
union all select video_id, concat('C1_', event_id), 'C', 'C1', 'classification', concat(b, 'who is being looked at?'), concat('P', target_id), 'medium', {COLUMNS} from op where event_type in ('mutual_gaze', 'gaze_following') and target_id <> 0
union all select video_id, concat('NEG_', event_id, '_', t), 'NEG', concat('NEG_', t), 'binary', concat(b, 'did anyone perform a ', t, ' gesture?'), 'no', 'easy', {COLUMNS} from sure, (select unnest(['pointing', 'showing', 'giving', 'reaching']) t) where not exists (select 1 from ge where ge.video_id = sure.video_id and ge.event_id = sure.event_id and gesture_type = t))
"""


def _rules(spark, sf_dir):
    rows = features.observed(gaze(spark, sf_dir))
    return questions.rule_questions(rows, _events(spark, sf_dir), _classes(spark, sf_dir), _rows(spark, sf_dir, GESTURES))


@query(f"{RULES} select * from q")
def e11_rule_questions(spark, sf_dir):
    return _rules(spark, sf_dir).withColumn("persons", F.array_join("persons", ","))


@query(f"{RULES} select subcategory, difficulty, count(*) questions from q group by grouping sets ((subcategory), (difficulty), ())")
def a16_question_counts(spark, sf_dir):
    return questions.question_counts(_rules(spark, sf_dir))


@query(f"{RULES} select subcategory, difficulty, least(count(*), 20) n from q group by all")
def t8_balanced_by_difficulty(spark, sf_dir):
    return questions.balanced_sample(_rules(spark, sf_dir), 1_000_000, 20).groupBy("subcategory", "difficulty").agg(F.count("*").alias("n"))


WRITTEN = """select conv_id video_id, cast(turn as bigint) idx, case conv_id % 4 when 0 then 'T1' when 1 then 'G2' when 2 then 'C1' else 'C4' end category, case when turn % 3 = 0 then 'open_ended' when turn % 17 = 5 then 'essay' else 'mcq' end format,
  case conv_id % 4 when 0 then 'gaze' when 1 then 'gesture' when 2 then 'cross' else case when turn % 2 = 0 then 'cross' else 'gaze' end end mode,
  concat('At ', cast(turn % 7 as varchar(5)), '.5s and 12.0 seconds, does Person ', cast(conv_id % 5 as varchar(5)), case when turn % 2 = 0 then ' look and point: ' else ' wait: ' end, substring(text, 1, cast(floor(length(text)/2e0) as int))) question,
  case turn % 6 when 5 then 'AB' when 4 then 'E' else 'B' end answer, concat(substring(text, cast(floor(length(text)/2e0) as int) + 1), case when conv_id % 11 = 0 then ' unlikely' else '' end) answer_text, 3 + case when conv_id % 9 > 0 then 1 else 0 end n_options, case when conv_id % 13 > 0 then 2 else 1 end n_times from {conversations}"""


def _written(spark, sf_dir):
    rows = spark.sql(WRITTEN, conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    option = F.transform(F.sequence(F.lit(0), F.col("n_options") - 1), lambda k: F.concat(F.substring(F.lit("ABCD"), k + 1, F.lit(1)), F.lit(") about "), k.cast("string"), F.lit(".5 seconds")))
    times = F.slice(F.array((F.col("idx") % 7 + 2.5).cast("double"), (F.col("idx") % 7 + 4.5).cast("double")), F.lit(1), F.col("n_times"))
    return rows.withColumns({"options": option, "time_range": times, "person_ids": F.array(*(F.lit(k).cast("long") for k in range(4)))}).drop("n_options", "n_times")


CHECKED = f"""with w as ({WRITTEN.format(conversations='conversations')}), c as (select *, lower(answer_text) low, lower(question) q, len(list_filter(regexp_split_to_array(answer_text, '\\s+'), lambda x: x <> '')) words, case category when 'T1' then 'easy' when 'G2' then 'easy' when 'C1' then 'medium' else 'hard' end difficulty from w)
select video_id, idx, difficulty, case when format = 'open_ended' then answer_text else answer end answer, case when format = 'essay' then 'format' when format = 'mcq' and answer <> 'B' then 'answer' when format = 'mcq' and n_options <> 4 then 'options' when format = 'open_ended' and words < 5 then 'short'
  when regexp_matches(low, 'suggesting|indicating|likely|because|implies|emotion|feeling|probably|seems') then 'banned'
  when len(list_filter(regexp_extract_all(concat(question, ' ', answer_text), 'Person (\\d+)', 1), lambda p: cast(p as bigint) > 3)) > 0 then 'person'
  when substring(category, 1, 1) <> case mode when 'gaze' then 'T' when 'gesture' then 'G' else 'C' end then 'category' when n_times < 2 then 'time_range'
  when mode = 'cross' and not (regexp_matches(q, 'look|gaze|eye contact|attention|watching') and regexp_matches(q, 'point|give|hand|show|reach|gesture')) then 'cross' end reason from c"""


@query(CHECKED)
def f12_checked_questions(spark, sf_dir):
    return questions.checked(_written(spark, sf_dir)).select("video_id", "idx", "difficulty", "answer", "reason")


@query()
def e12_ingest_replies(spark, sf_dir):
    """Checked questions without those that are like an earlier one of the reply: a greedy rule, held against a loop."""
    kept = questions.checked(_written(spark, sf_dir)).where("reason IS NULL").select("video_id", "idx", "mode", "question")
    return questions.drop_alike(kept, ["video_id", "mode"], "idx")


@query(f"with k as ({CHECKED}), m as ({WRITTEN.format(conversations='conversations')}) select k.video_id, mode, count(*) written, count(*) filter (reason is null) valid, sum(count(*) filter (reason is null)) over (partition by k.video_id) as of_video from k join m using (video_id, idx) group by k.video_id, mode")
def a17_reply_report(spark, sf_dir):
    return questions.reply_report(questions.checked(_written(spark, sf_dir)), ["video_id", "mode"])


@query(f"with r as ({WRITTEN.format(conversations='conversations')}), p as (select *, case idx % 9 when 0 then 'prompt_A' when 1 then 'prompt_B' when 2 then 'prompt_B_OE' when 3 then 'prompt_C' when 4 then 'prompt_D' when 5 then 'prompt_D_OE' when 6 then 'prompt_E' when 7 then 'prompt_E_OE' end prompt from r) select video_id, idx, case when prompt in ('prompt_A', 'prompt_B', 'prompt_B_OE') then 'gaze' when prompt in ('prompt_C', 'prompt_D', 'prompt_D_OE') then 'gesture' when prompt is not null then 'cross' end as mode, case when prompt like '%OE' then 'open_ended' when prompt is not null then 'mcq' end format, case when prompt not like '%OE' then n_options end n_options from p")
def f12_of_prompts(spark, sf_dir):
    """Mode and format of questions by the prompt that asked for them, not by what they say."""
    names = F.array(*(F.lit(n) for n in questions.PROMPTS))
    rows = _written(spark, sf_dir).withColumn("prompt", F.get(names, (F.col("idx") % 9).cast("int")))
    return questions.of_prompts(rows).select("video_id", "idx", "mode", "format", F.when(F.col("options").isNotNull(), F.size("options").cast("long")).alias("n_options"))


@query()
def e13_clip_questions(spark, sf_dir):
    """Questions on the clips' clocks. Buffers come from hashes; held against a loop with Python's own patterns."""
    rows = _written(spark, sf_dir).withColumns({"video_id": F.concat(F.lit("v"), F.col("video_id").cast("string")), "length": F.lit(120.0)})
    return questions.clip_questions(rows).withColumns({"options": F.array_join("options", "|"), "time_range": F.array_join(F.col("time_range").cast("array<string>"), ",")})


@query("with t as (select conv_id, turn, case turn % 4 when 0 then '' when 1 then 'Here: ' else '  ' end pre, case turn % 4 when 3 then '' when 1 then ' done.' else ' ' end post from conversations) select conv_id, turn, concat('q', turn) question, case when turn % 3 = 0 then 'A' else 'B' end answer from t")
def x17_parse_replies(spark, sf_dir):
    pre = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, "Here: ").otherwise("  ")
    post = F.when(F.col("turn") % 4 == 3, "").when(F.col("turn") % 4 == 1, " done.").otherwise(" ")
    one = F.array(F.struct(F.concat(F.lit("q"), F.col("turn").cast("string")).alias("question"), F.when(F.col("turn") % 3 == 0, "A").otherwise("B").alias("answer")))
    body = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(one.alias("qa_pairs")))).otherwise(F.to_json(one))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.concat(pre, body, post).alias("reply"))
    return rows.select("conv_id", "turn", F.inline(questions.parse_reply(F.col("reply"), "struct<question:string,answer:string>")))


#: Events of clips of two seconds, so that few and many in a clip both occur.
CLIP = "concat(video_id, '-', cast(cast(floor(start_time/2) as bigint) as varchar(10)))"
ROUTED = f"""select {CLIP} video_id, 'gaze' source, event_type, person_a person, cast(null as varchar(10)) target_type, cast(null as bigint) target_person_id from ({adapters.GAZE_EVENTS})
union all select {CLIP}, 'gesture', gesture_type, initiator_id, target_type, target_person_id from ({adapters.GESTURES})"""


@query(f"""with e as ({adapters.sql(ROUTED)}), p as (select a.video_id, count(*) n from e a join e b using (video_id, person) where a.source = 'gaze' and b.source = 'gesture' group by 1),
c as (select video_id, count(*) filter (source = 'gaze') g, count(*) filter (source = 'gesture') h, count(*) filter (event_type in ('joint_attention', 'attention_capture')) o, count(*) filter (target_type = 'person' and target_person_id is not null) k from e group by 1),
j as (select c.*, coalesce(n, 0) n from c left join p using (video_id))
select video_id, 'prompt_A' prompt from j where g between 1 and 2 union all select video_id, 'prompt_B' from j where g >= 3 union all select video_id, 'prompt_B_OE' from j where g >= 3 and o > 0
union all select video_id, 'prompt_C' from j where h between 1 and 3 union all select video_id, 'prompt_D' from j where h >= 4 union all select video_id, 'prompt_D_OE' from j where h >= 4 and k >= 2
union all select video_id, unnest(['prompt_E', 'prompt_E_OE']) from j where g > 0 and h > 0 and n >= 2""")
def f14_prompt_routes(spark, sf_dir):
    events = _rows(spark, sf_dir, ROUTED)
    pairs = events.where("source = 'gaze'").select("video_id", "person").join(events.where("source = 'gesture'").select("video_id", "person"), ["video_id", "person"])
    return questions.prompt_routes(events, pairs)


@query(f"""select video_id, event_id, printf('Type: %s = %s; time: %.2fs - %.2fs; persons: P%d, P%d', event_type, case event_type when 'sudden_gaze_shift' then 'A person suddenly changed where they''re looking'
when 'joint_attention' then 'Multiple people looking at the same target' when 'gaze_following' then 'One person looks where another person is looking'
when 'attention_capture' then 'One person''s action caused others to look at them' else 'Two people looking at each other' end, start_time, end_time, person_a, person_b) text from ({adapters.sql(EVENTS)})""")
def x35_event_texts(spark, sf_dir):
    return questions.event_texts(_events(spark, sf_dir)).select("video_id", "event_id", "text")
