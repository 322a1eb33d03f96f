"""Times, names and texts as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal time in a text, and words that ask for a length of time.
TIME = r"(?<![A-Za-z])(\d+\.\d+)(?=\s*(?:s(?:econds?)?|,|\s|and\s|$|\?))"
ASKS_DURATION = r"(?i)\b(?:how\s+(?:much\s+time|long)|time\s+passes|elapsed|delay|duration)\b"
#: Endings of document names by stage, longest first.
STAGES = ["_sam3rf_gaze_features", "_sam3rf_gaze_events", "_gaze_features", "_gaze_events", "_gestures_v2", "_sam3rf_gaze", "_cross_data", "_features", "_gestures", "_events", "_graph", "_gaze", "_qa"]


def parse_time(t: Column) -> Column:
    """Seconds of `19.5`, `M:SS.ss` or `H:MM:SS`; null if a part is no number."""
    parts = F.transform(F.split(F.trim(t), ":"), lambda x: x.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s * 60 + x)


def srt_time(t: Column) -> Column:
    """Seconds of `HH:MM:SS,mmm` (or a stop for the comma); null for anything else."""
    part = lambda k: F.regexp_extract(t, r"^\s*(\d+):(\d+):(\d+)[,.](\d+)", k).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def duration_text(seconds: Column) -> Column:
    """`1h 2m 3s`, without hours or minutes where they and all before are 0."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def snap_down(t: Column) -> Column:
    return F.floor(t * 2) / 2.0


def snap_up(t: Column) -> Column:
    return F.ceil(t * 2) / 2.0


def snap_to_frame(t: Column, fps: float = 2.0) -> Column:
    """The nearest frame's time; of two equally near that of even number."""
    return F.rint(t * fps) / fps


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", x)


def round_tenth(x: Column) -> Column:
    """x to one decimal, the nearer of the double's own value: 0.35 is a little less, so it gives 0.3; ties to even.

    x is split in halves that can be multiplied by 20 without error, so the side of the middle it lies on is known."""
    low = F.floor(F.abs(x) * 10)
    high = F.abs(x).cast("float").cast("double")
    side = (high * 20 - (2 * low + 1)) + (F.abs(x) - high) * 20
    up = F.when(side > 0, 1).when(side < 0, 0).otherwise(low % 2)
    return F.signum(x) * (low + up) / 10.0


def shift_times(text: Column, offset: Column) -> Column:
    """The text with offset taken off each decimal time in it; 0.0 at least, one decimal."""
    moved = F.transform(F.regexp_extract_all(text, F.lit(TIME), F.lit(1)), lambda x: one_decimal(F.greatest(F.lit(0.0), round_tenth(x.cast("double") - offset))))
    return F.array_join(F.zip_with(F.split(text, TIME, -1), F.concat(moved, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def asks_duration(question: Column) -> Column:
    return F.coalesce(F.rlike(question, F.lit(ASKS_DURATION)), F.lit(False))


def option_text(options: Column, answer: Column) -> Column:
    """The option that begins with the answer's letter and a bracket, without both; null if there is none."""
    letter = F.concat(F.upper(F.trim(answer)), F.lit(")"))
    found = F.get(F.filter(F.transform(options, lambda o: F.trim(o)), lambda o: F.startswith(F.upper(o), letter)), F.lit(0))
    return F.trim(F.regexp_replace(found, r"^[A-D]\)\s*", ""))


def persons_text(persons: Column) -> Column:
    """`Person 0`, `Person 0 and Person 1`, `Person 0, Person 1, and Person 2`."""
    each = F.transform(persons, lambda p: F.concat(F.lit("Person "), p.cast("string")))
    n = F.size(persons)
    many = F.concat(F.array_join(F.slice(each, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(each, n - 1))
    return F.when(persons.isNull() | (n == 0), "unknown persons").when(n <= 2, F.array_join(each, " and ")).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-case words of two texts."""
    words = lambda t: F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(F.array_union(words(a), words(b))), F.lit(1))


def segment_name(name: Column) -> Column:
    """struct(video, segment) of `video_007`; a name without number is its own video, number null."""
    number = F.regexp_extract(name, r"^(.+)_(\d{3})$", 2)
    return F.struct(F.when(number != "", F.regexp_extract(name, r"^(.+)_(\d{3})$", 1)).otherwise(name).alias("video"), F.when(number != "", number.try_cast("int")).alias("segment"))


def episode(name: Column) -> Column:
    """struct(season, episode) of `s01e02_...`; nulls if the name has none."""
    part = lambda k: F.regexp_extract(name, r"^s(\d+)e(\d+)", k).try_cast("int")
    return F.struct(part(1).alias("season"), part(2).alias("episode"))


def video_of(path: Column, stages: list[str] = STAGES) -> Column:
    """The video's name of a document's path: without folders, .json and the ending of its stage."""
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(\.mp4)?\.json$", "")
    return F.regexp_replace(name, f"({'|'.join(stages)})$", "")


def plain_path(path: Column) -> Column:
    """A file's path as it is called, as Spark gives it with blanks and other marks written like %20."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def flat_name(path: Column) -> Column:
    """A relative path as one name."""
    return F.translate(path, "/\\", "__")


def dataset_of(path: Column, names: list[str]) -> Column:
    """The first of names that the path holds, else `unknown`."""
    out = F.lit("unknown")
    for n in reversed(names):
        out = F.when(F.contains(path, F.lit(n)), n).otherwise(out)
    return out
