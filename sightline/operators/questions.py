"""Questions on gaze and gestures by rule, checks of written ones, and questions on clips.

Long rows: events (video_id, event_id, event_type, start_time, end_time, persons), classifications (video_id, event_id,
confirmed, caused_shift, responders), gestures of events (video_id, event_id, gesture_no, gesture_type, initiator_id,
target_type, target_person_id, target_description).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import direction, distance, size_label
from ..functions.text import asks_duration, one_decimal, option_text, shift_times, snap_to_frame
from .features import KEY

#: Kinds of gesture; words that a written answer may not hold; difficulties by category.
GESTURES = ["pointing", "showing", "giving", "reaching"]
BANNED = ["suggesting", "indicating", "likely", "because", "implies", "emotion", "feeling", "probably", "seems"]
DIFFICULTY = {"T1": "easy", "T2": "easy", "T3": "medium", "T4": "medium", "T5": "hard", "T6": "hard", "G1": "easy", "G2": "easy", "G3": "medium", "G4": "medium", "G5": "hard", "G6": "hard", "C1": "medium", "C2": "hard", "C3": "hard", "C4": "hard"}
GAZE_WORDS, GESTURE_WORDS = ["look", "gaze", "eye contact", "attention", "watching"], ["point", "give", "hand", "show", "reach", "gesture"]
PREFIX = {"gaze": "T", "gesture": "G", "cross": "C"}


def _asked(df: DataFrame, kind: str, ident: list, task: str, question: Column, answer: Column, difficulty: str) -> DataFrame:
    text = F.concat_ws("_", F.lit(kind), *(F.col(c).cast("string") for c in ident))
    sub = F.concat(F.lit("NEG_"), "gesture_type") if kind == "NEG" else F.lit(kind)
    return df.select(*KEY, text.alias("question_id"), F.lit("NEG" if kind == "NEG" else kind[0]).alias("category"), sub.alias("subcategory"), F.lit(task).alias("task_type"), question.alias("question"), answer.alias("answer"), F.lit(difficulty).alias("difficulty"), "start_time", "end_time", F.col("persons").cast("array<long>").alias("persons"))


def between() -> Column:
    return F.concat(F.lit("Between "), one_decimal(F.col("start_time")), F.lit("s and "), one_decimal(F.col("end_time")), F.lit("s, "))


def person(c: str) -> Column:
    return F.concat(F.lit("P"), F.col(c).cast("string"))


def yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("no")


def gaze_shifts(rows: DataFrame) -> DataFrame:
    """Direction (unless it stands still) and size of a person's gaze shift from the frame before. rows: pos, frame_idx, ts, person_id, gx, gy."""
    w = Window.partitionBy(*KEY, "person_id").orderBy("pos")
    before = lambda c: F.when(F.col("pos") - F.lag("pos").over(w) == 1, F.lag(c).over(w))
    moved = rows.withColumns({"_x": before("gx"), "_y": before("gy")}).where("gx IS NOT NULL AND gy IS NOT NULL AND _x IS NOT NULL AND _y IS NOT NULL")
    moved = moved.withColumns({"start_time": F.col("ts") - 0.5, "end_time": F.col("ts") + 0.5, "persons": F.array("person_id"), "way": direction(F.col("gx") - F.col("_x"), F.col("gy") - F.col("_y")), "size": size_label(distance(F.col("_x"), F.col("_y"), F.col("gx"), F.col("gy")))})
    at = F.concat(F.lit("At "), one_decimal(F.col("ts")))
    which = _asked(moved.where("way IS NOT NULL"), "A2", ["frame_idx", "person_id"], "classification", F.concat(at, F.lit("s, which direction did "), person("person_id"), F.lit("'s gaze shift?")), F.col("way"), "easy")
    much = _asked(moved, "A3", ["frame_idx", "person_id"], "classification", F.concat(at, F.lit("s, how much did "), person("person_id"), F.lit("'s gaze shift?")), F.col("size"), "easy")
    return which.unionByName(much)


def confirmed_only(events: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed events with what their classification says."""
    return events.join(classes.where("confirmed"), [*KEY, "event_id"])


def not_rejected(events: DataFrame, classes: DataFrame) -> DataFrame:
    """Events that have no classification or a confirmed one."""
    return events.join(classes, [*KEY, "event_id"], "left").where("confirmed IS NULL OR confirmed")


def gesture_questions(events: DataFrame, classes: DataFrame, gestures: DataFrame) -> DataFrame:
    """Who made a gesture, at whom or what, what object it was, and whether it moved the others' gaze."""
    sure = confirmed_only(events, classes)
    each = sure.join(gestures, [*KEY, "event_id"])
    thing = F.col("target_type").isin("object", "location")
    told = F.coalesce(F.col("target_description"), F.lit("")) != ""
    by = ["event_id", "initiator_id"]
    kind = F.col("gesture_type")
    b1 = _asked(each.where("initiator_id IS NOT NULL"), "B1", by, "classification", F.concat(between(), F.lit("who initiated the "), kind, F.lit(" gesture?")), person("initiator_id"), "medium")
    whom = F.concat(between(), F.lit("who is "), person("initiator_id"), F.lit("'s "), kind, F.lit(" directed at?"))
    what = F.concat(between(), F.lit("what is "), person("initiator_id"), F.lit("'s "), kind, F.lit(" directed at?"))
    b2 = _asked(each.where((F.col("target_type") == "person") & F.col("target_person_id").isNotNull()), "B2", by, "classification", whom, person("target_person_id"), "medium")
    b2 = b2.unionByName(_asked(each.where(thing & told), "B2", by, "classification", what, F.col("target_description"), "medium"))
    d1 = _asked(each.where(thing & told), "D1", by, "classification", F.concat(between(), F.lit("what "), F.col("target_type"), F.lit(" is "), person("initiator_id"), F.lit(" "), kind, F.lit(" at?")), F.col("target_description"), "medium")
    some = gestures.groupBy(*KEY, "event_id").agg(F.max(thing).alias("_thing"))
    asked = sure.join(some, [*KEY, "event_id"])
    b3 = _asked(asked, "B3", ["event_id"], "binary", F.concat(between(), F.lit("did any gesture cause others to shift their gaze?")), yes_no(F.col("caused_shift")), "hard")
    d2 = _asked(asked.where("_thing"), "D2", ["event_id"], "binary", F.concat(between(), F.lit("did pointing to an object cause others to shift their gaze?")), yes_no(F.col("caused_shift")), "hard")
    return reduce(DataFrame.unionByName, [b1, b2, b3, d1, d2])


def social_questions(events: DataFrame, classes: DataFrame) -> DataFrame:
    """Whether anyone responded, which pair looks at each other and, where events name a target_id (other than 0), who is looked at."""
    open_ = not_rejected(events, classes)
    c2 = _asked(open_, "C2", ["event_id"], "binary", F.concat(between(), F.lit("did anyone respond with a gaze shift?")), yes_no(F.size("responders") > 0), "easy")
    pair = F.concat(F.lit("P"), F.get("persons", F.lit(0)).cast("string"), F.lit(" and P"), F.get("persons", F.lit(1)).cast("string"))
    c3 = _asked(open_.where((F.col("event_type") == "mutual_gaze") & (F.size("persons") >= 2)), "C3", ["event_id"], "classification", F.concat(between(), F.lit("which pair is engaged in mutual gaze?")), pair, "hard")
    out = c2.unionByName(c3)
    if "target_id" in events.columns:
        looked = open_.where(F.col("event_type").isin("mutual_gaze", "gaze_following") & (F.col("target_id") != 0))
        out = out.unionByName(_asked(looked, "C1", ["event_id"], "classification", F.concat(between(), F.lit("who is being looked at?")), person("target_id"), "medium"))
    return out


def negative_questions(events: DataFrame, classes: DataFrame, gestures: DataFrame) -> DataFrame:
    """For each confirmed event the kinds of gesture that it lacks."""
    found = gestures.groupBy(*KEY, "event_id").agg(F.collect_set("gesture_type").alias("_found"))
    lacks = F.array_except(F.array(*map(F.lit, GESTURES)), F.coalesce("_found", F.array().cast("array<string>")))
    each = confirmed_only(events, classes).join(found, [*KEY, "event_id"], "left").withColumn("gesture_type", F.explode(lacks))
    return _asked(each, "NEG", ["event_id", "gesture_type"], "binary", F.concat(between(), F.lit("did anyone perform a "), F.col("gesture_type"), F.lit(" gesture?")), F.lit("no"), "easy")


def rule_questions(rows: DataFrame, events: DataFrame, classes: DataFrame, gestures: DataFrame) -> DataFrame:
    """All families of questions."""
    return reduce(DataFrame.unionByName, [gaze_shifts(rows), gesture_questions(events, classes, gestures), social_questions(events, classes), negative_questions(events, classes, gestures)])


def balanced_sample(questions: DataFrame, most: int = 100, most_of_difficulty: int | None = None, seed: int = 42) -> DataFrame:
    """At most so many questions of each subcategory (and difficulty), by hashes of their ids."""
    order = [F.xxhash64("question_id", F.lit(seed)), F.col("question_id")]
    if most_of_difficulty is not None:
        w = Window.partitionBy("subcategory", "difficulty").orderBy(*order)
        questions = questions.withColumn("_d", F.row_number().over(w)).where(F.col("_d") <= most_of_difficulty).drop("_d")
        hardness = F.when(F.col("difficulty") == "easy", 0).when(F.col("difficulty") == "medium", 1).otherwise(2)
        order = [hardness, *order]
    w = Window.partitionBy("subcategory").orderBy(*order)
    return questions.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def question_counts(questions: DataFrame) -> DataFrame:
    """Counts by subcategory, by difficulty and in all; what isn't grouped by is null."""
    return questions.groupingSets([["subcategory"], ["difficulty"], []], "subcategory", "difficulty").agg(F.count("*").alias("questions"))


def parse_reply(text: Column, schema: str) -> Column:
    """The array of a written reply: the whole text if it is JSON, else its outermost braces or brackets; of an object its
    first field that is an array. Null if there is none."""
    begins = lambda t, c: F.startswith(F.ltrim(t), F.lit(c))
    array = lambda t: F.when(begins(t, "["), F.from_json(t, f"array<{schema}>"))
    field = lambda t: F.get(F.filter(F.map_values(F.from_json(t, "map<string, string>")), lambda v: begins(v, "[")), F.lit(0))
    cut = lambda p: F.regexp_extract(text, p, 1)
    inner, braces, brackets = field(text), cut(r"(?s)(\{.*\})"), cut(r"(?s)(\[.*\])")
    return F.coalesce(array(text), F.when(begins(text, "{"), array(inner)), F.when(~begins(text, "["), array(field(braces))), array(brackets))


#: What each prompt asks for.
PROMPTS = {
    "prompt_A": ("gaze", "mcq"), "prompt_B": ("gaze", "mcq"), "prompt_B_OE": ("gaze", "open_ended"), "prompt_C": ("gesture", "mcq"), "prompt_D": ("gesture", "mcq"),
    "prompt_D_OE": ("gesture", "open_ended"), "prompt_E": ("cross", "mcq"), "prompt_E_OE": ("cross", "open_ended"),
}


def of_prompts(written: DataFrame) -> DataFrame:
    """written (with the column prompt) whose mode and format are those its prompt asks for, whatever a reply says of itself; open
    questions lose their options. Those of a prompt that isn't known have neither, and fail the check."""
    of = lambda k: reduce(lambda c, x: c.when(F.col("prompt") == x[0], F.lit(x[1][k])), PROMPTS.items(), F.when(F.lit(False), F.lit("")))
    out = written.withColumns({"mode": of(0), "format": of(1)})
    return out.withColumn("options", F.when(F.col("format") == "mcq", F.col("options")))


def checked(written: DataFrame) -> DataFrame:
    """Adds reason (null: valid) and the category's difficulty; see of_prompts() for the format. written: category, format, mode, question, answer,
    answer_text, options, time_range, person_ids; null fields count as empty. Of an open question the answer becomes its text."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    options = F.when(F.col("format") == "mcq", F.coalesce("options", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    low, question = F.lower(text("answer_text")), F.lower(text("question"))
    has = lambda c, words: reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))
    named = F.regexp_extract_all(F.concat_ws(" ", text("question"), text("answer_text"), F.array_join(options, " ")), F.lit(r"Person (\d+)"), F.lit(1))
    unknown = F.exists(named, lambda p: ~F.coalesce(F.array_contains("person_ids", p.cast("long")), F.lit(False))) & (F.size("person_ids") > 0)
    prefix = reduce(lambda c, x: c.when(F.col("mode") == x[0], F.lit(x[1])), PREFIX.items(), F.when(F.lit(False), F.lit("")))
    words = F.size(F.filter(F.split(text("answer_text"), r"\s+"), lambda w: w != ""))
    reason = (
        F.when(~F.coalesce("format", F.lit("")).isin("mcq", "open_ended"), "format")
        .when((F.col("format") == "mcq") & ~text("answer").isin("A", "B", "C", "D"), "answer").when((F.col("format") == "mcq") & (F.size(options) != 4), "options")
        .when((F.col("format") == "open_ended") & (words < 5), "short").when(has(low, BANNED), "banned").when(unknown, "person")
        .when(~F.startswith(text("category"), prefix), "category").when(F.coalesce(F.size("time_range"), F.lit(0)) < 2, "time_range")
        .when((F.col("mode") == "cross") & ~(has(question, GAZE_WORDS) & has(question, GESTURE_WORDS)), "cross")
    )
    level = F.create_map(*(F.lit(x) for kv in DIFFICULTY.items() for x in kv))
    fixed = F.coalesce(F.try_element_at(level, text("category")), F.col("difficulty")) if "difficulty" in written.columns else F.try_element_at(level, text("category"))
    return written.withColumns({"reason": reason, "difficulty": fixed, "answer": F.when(F.col("format") == "open_ended", F.col("answer_text")).otherwise(F.col("answer"))})


def drop_alike(questions: DataFrame, keys: list[str], order: str, most: float = 0.6) -> DataFrame:
    """Drops a question whose words are more alike than `most` to one kept before it, within keys (the questions of one
    reply, some tens): each choice depends on those before."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, kept = [], []
        pdf = pdf.sort_values(order)
        for k, q in enumerate(pdf["question"]):
            words = set((q or "").lower().split())
            if all(len(words & s) / max(len(words | s), 1) <= most for s in seen):
                seen.append(words)
                kept.append(k)
        return pdf.iloc[kept]

    return questions.groupBy(*keys).applyInPandas(keep, questions.schema)


def gesture_counts(gestures: DataFrame) -> DataFrame:
    """Gestures of each kind by video; those without a kind don't count."""
    return gestures.where("gesture_type IS NOT NULL").groupBy(*KEY, "gesture_type").agg(F.count("*").alias("n"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Confirmed and rejected events by video; without a verdict an event counts as rejected."""
    return verdicts.groupBy(*KEY).agg(F.count_if("confirmed").alias("confirmed"), F.count_if(~F.coalesce("confirmed", F.lit(False))).alias("rejected"))


def reply_report(questions: DataFrame, keys: list[str]) -> DataFrame:
    """Questions written and valid of each reply, and of the video in all."""
    out = questions.groupBy(*keys).agg(F.count("*").alias("written"), F.count_if(F.col("reason").isNull()).alias("valid"))
    return out.withColumn("of_video", F.sum("valid").over(Window.partitionBy(*KEY)))


def clip_bounds(start: Column, end: Column, length: Column, key: Column, least: float = 1.0, most: float = 3.0) -> Column:
    """struct(clip_start, clip_end): the range with 1 to 3 seconds more on each side, by hashes of the key, within the video."""
    share = lambda s: F.pmod(F.xxhash64(key, F.lit(s)), F.lit(1000)) / 999.0
    buffer = lambda s: snap_to_frame(least + share(s) * (most - least))
    return F.struct(snap_to_frame(F.greatest(F.lit(0.0), start - buffer(1))).alias("clip_start"), snap_to_frame(F.least(length, end + buffer(2))).alias("clip_end"))


def clip_questions(questions: DataFrame) -> DataFrame:
    """Questions with their times on the clip's clock. questions: video_id, idx, format, question, answer, answer_text,
    options, time_range, length (of the video). Without a range, or with an empty clip, a question is left out."""
    start, end = F.get("time_range", F.lit(0)), F.get("time_range", F.lit(1))
    name = F.format_string("%s_qa%04d", F.col("video_id"), F.col("idx"))
    rows = questions.where(F.coalesce(F.size("time_range"), F.lit(0)) >= 2).withColumn("clip_name", name)
    rows = rows.withColumn("_b", clip_bounds(start, end, F.col("length"), F.col("clip_name"))).select("*", "_b.*").drop("_b").where("clip_end > clip_start")
    offset, open_ = F.col("clip_start"), F.col("format") == "open_ended"
    kept = (F.col("format") == "mcq") & asks_duration(F.col("question"))
    options = F.when(kept, F.col("options")).otherwise(F.transform("options", lambda o: shift_times(o, offset)))
    rows = rows.withColumn("_options", options)
    shifted = lambda c: F.when(open_, shift_times(F.col(c), offset)).otherwise(F.col(c))
    chosen = F.when(F.col("format") == "mcq", option_text(F.col("_options"), F.col("answer")))
    return rows.select(
        *KEY, "clip_name", F.round(offset, 2).alias("clip_offset"), F.round(F.col("clip_end") - offset, 2).alias("clip_duration"), "format", shift_times(F.col("question"), offset).alias("question"),
        shifted("answer").alias("answer"), F.coalesce(chosen, shifted("answer_text")).alias("answer_text"), F.col("_options").alias("options"), F.array(F.round(start - offset, 2), F.round(end - offset, 2)).alias("time_range"),
    )


def prompt_routes(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """video_id, prompt: the prompts that a video's density of events calls for.

    events: video_id, source (gaze or gesture), event_type, target_type, target_person_id; pairs: video_id, a row for each
    pair across both. Null or other sources count for nothing; a video without events has no prompts."""
    gaze, gesture = F.col("source") == "gaze", F.col("source") == "gesture"
    counts = events.groupBy("video_id").agg(
        F.count_if(gaze).alias("g"), F.count_if(gesture).alias("h"), F.count_if(gaze & F.col("event_type").isin("joint_attention", "attention_capture")).alias("open"),
        F.count_if(gesture & (F.col("target_type") == "person") & F.col("target_person_id").isNotNull()).alias("people"),
    )
    n = pairs.groupBy("video_id").agg(F.count("*").alias("n"))
    g, h, both = F.col("g"), F.col("h"), (F.col("g") > 0) & (F.col("h") > 0) & (F.col("n") >= 2)
    rules = {"prompt_A": (g > 0) & (g <= 2), "prompt_B": g > 2, "prompt_B_OE": (g > 2) & (F.col("open") > 0), "prompt_C": (h > 0) & (h <= 3), "prompt_D": h > 3, "prompt_D_OE": (h > 3) & (F.col("people") >= 2), "prompt_E": both, "prompt_E_OE": both}
    names = F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))
    return counts.join(n, "video_id", "left").select("video_id", F.explode(F.array_compact(names)).alias("prompt"))


#: What each kind of event means, as a checker is told.
MEANINGS = {
    "sudden_gaze_shift": "A person suddenly changed where they're looking",
    "joint_attention": "Multiple people looking at the same target",
    "gaze_following": "One person looks where another person is looking",
    "attention_capture": "One person's action caused others to look at them",
    "mutual_gaze": "Two people looking at each other",
}


def event_texts(events: DataFrame) -> DataFrame:
    """Adds text, what a checker is told of an event: kind and meaning (the kind itself if it has none), times, persons.

    events: event_type (null: unknown), start_time, end_time (null: 0), persons (array)."""
    kind = F.coalesce("event_type", F.lit("unknown"))
    meaning = F.coalesce(F.create_map(*(F.lit(x) for kv in MEANINGS.items() for x in kv))[kind], kind)
    seconds = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    people = F.array_join(F.transform("persons", lambda p: F.concat(F.lit("P"), p.cast("string"))), ", ")
    return events.withColumn("text", F.format_string("Type: %s = %s; time: %.2fs - %.2fs; persons: %s", kind, meaning, seconds("start_time"), seconds("end_time"), F.coalesce(people, F.lit(""))))
