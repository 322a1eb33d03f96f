"""Gaze features of persons, frames and videos.

Input: a row for each video, frame and person with frame_pos, frame_idx, ts, face_detected, the face box fx1..fy2, the
gaze point gx, gy and inout. All windows are within a video, so one hash partitioning by video serves them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import direction_vector, distance

KEY = ["video_id"]
#: Longest gaps, in rows and seconds, that are filled.
LINEAR_GAP, CARRY_GAP, CUT_SECONDS, FACE_JUMP = 3, 10, 3.0, 0.3


def observed(gaze: DataFrame) -> DataFrame:
    """Adds pos (place of the frame in the video), obs_pos (place of the row in the person's own history) and valid (gaze point known and in frame)."""
    valid = F.col("inout").eqNullSafe(True) & F.col("gx").isNotNull() & F.col("gy").isNotNull()
    video, person = Window.partitionBy(*KEY).orderBy("frame_pos"), Window.partitionBy(*KEY, "person_id").orderBy("frame_pos")
    return gaze.repartition(*KEY).withColumns({"pos": F.dense_rank().over(video) - 1, "obs_pos": F.row_number().over(person) - 1, "valid": valid})


def fill_gaps(obs: DataFrame) -> DataFrame:
    """Adds ix, iy, iconf, imethod: the gaze filled over short gaps of a person's history."""
    w = Window.partitionBy(*KEY, "person_id").orderBy("obs_pos")
    point = F.when(F.col("valid"), F.struct("obs_pos", "ts", "gx", "gy"))
    rows = obs.withColumns({"p": F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "n": F.first(point, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    p, n, i = F.col("p"), F.col("n"), F.col("obs_pos")
    gap, place = n.obs_pos - p.obs_pos - 1, i - p.obs_pos
    both, before, after = p.isNotNull() & n.isNotNull(), p.isNotNull(), n.isNotNull()
    method = (
        F.when(F.col("valid"), "measured")
        .when(both & (n.ts - p.ts > CUT_SECONDS), "null_scene_cut").when(both & (gap <= LINEAR_GAP), "linear_interpolation").when(both & (gap <= CARRY_GAP), "carry_forward").when(both, "null_gap_too_long")
        .when(before & (F.col("ts") - p.ts > CUT_SECONDS), "null_scene_cut").when(before & (place <= CARRY_GAP), "carry_forward")
        .when(after & (n.ts - F.col("ts") > CUT_SECONDS), "null_scene_cut").when(after & (n.obs_pos - i <= CARRY_GAP), "carry_backward")
        .otherwise("null_no_valid")
    )
    rows = rows.withColumn("imethod", method)
    m, t = F.col("imethod"), place / (gap + 1)

    def filled(own, a, b):
        return F.when(m == "measured", own).when(m == "linear_interpolation", a + t * (b - a)).when(m == "carry_forward", a).when(m == "carry_backward", b)

    conf = F.when(m == "measured", 1.0).when(m == "linear_interpolation", 1.0 - 0.1 * gap).when(m == "carry_forward", 0.5 * F.exp(-0.2 * place)).when(m == "carry_backward", 0.5 * F.exp(-0.2 * (n.obs_pos - i))).otherwise(0.0)
    return rows.withColumns({"ix": filled(F.col("gx"), p.gx, n.gx), "iy": filled(F.col("gy"), p.gy, n.gy), "iconf": conf}).drop("p", "n")


def velocities(rows: DataFrame) -> DataFrame:
    """Adds velocity and velocity_conf of each own observation but the first (null there); 0 if an end is unknown."""
    w = Window.partitionBy(*KEY, "person_id").orderBy("obs_pos")
    x, y, t, c = (F.lag(k).over(w) for k in ("ix", "iy", "ts", "iconf"))
    known = x.isNotNull() & F.col("ix").isNotNull() & (F.col("ts") > t)
    first = F.col("obs_pos") == 0
    speed = F.when(first, None).when(known, distance(x, y, F.col("ix"), F.col("iy")) / (F.col("ts") - t)).otherwise(0.0)
    return rows.withColumns({"velocity": speed, "velocity_conf": F.when(first, None).when(known, F.least("iconf", c)).otherwise(0.0)})


def frame_rows(rows: DataFrame) -> DataFrame:
    """What a frame shows of each person: x, y, conf, method and frame_velocity.

    The velocity shown at frame position i is that of the person's own observation i, so it drifts once a person was
    absent; 0 at the first frame and beyond the history."""
    own = rows.select(*KEY, "person_id", F.col("obs_pos").alias("pos"), F.col("velocity").alias("_v"))
    out = rows.join(own, [*KEY, "person_id", "pos"], "left")
    face, valid = F.coalesce("face_detected", F.lit(False)), F.col("valid")
    return out.withColumns({
        "x": F.when(face, F.when(valid, F.col("gx")).otherwise(F.col("ix"))), "y": F.when(face, F.when(valid, F.col("gy")).otherwise(F.col("iy"))),
        "conf": F.when(face, F.col("iconf")).otherwise(0.0), "method": F.when(face, F.col("imethod")).otherwise("no_face"), "face": face & F.col("fx1").isNotNull(),
        "frame_velocity": F.when(F.col("pos") > 0, F.coalesce("_v", F.lit(0.0))).otherwise(0.0),
    }).drop("_v")


def features(gaze: DataFrame) -> DataFrame:
    return frame_rows(velocities(fill_gaps(observed(gaze))))


def face_motion(rows: DataFrame) -> DataFrame:
    """Face velocity and scene cuts (the face jumps by more than 0.3) between a person's observations; null if a face is missing."""
    w = Window.partitionBy(*KEY, "person_id").orderBy("obs_pos")
    cx, cy = (F.col("fx1") + F.col("fx2")) / 2, (F.col("fy1") + F.col("fy2")) / 2
    out = rows.withColumns({"cx": cx, "cy": cy})
    jump, dt = distance(F.lag("cx").over(w), F.lag("cy").over(w), F.col("cx"), F.col("cy")), F.col("ts") - F.lag("ts").over(w)
    out = out.withColumns({"face_jump": jump, "_dt": dt})
    return out.withColumns({"is_scene_cut": F.coalesce(F.col("face_jump") > FACE_JUMP, F.lit(False)), "face_velocity": F.when((F.col("face_jump") <= FACE_JUMP) & (F.col("_dt") > 0), F.col("face_jump") / F.col("_dt"))}).drop("_dt")


def person_features(rows: DataFrame) -> DataFrame:
    """Velocity statistics and the spread of the gaze (filled points of confidence over 0.5) of each person."""
    w = Window.partitionBy(*KEY, "person_id")
    good = (F.col("iconf") > 0.5) & F.col("ix").isNotNull()
    gx, gy = F.when(good, F.col("ix")), F.when(good, F.col("iy"))
    rows = rows.withColumns({"_x": gx, "_y": gy, "_mx": F.avg(gx).over(w), "_my": F.avg(gy).over(w)})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*KEY, "person_id").agg(
        F.count("*").alias("track_length"), zero(F.avg("velocity")).alias("mean_velocity"), zero(F.max("velocity")).alias("max_velocity"), zero(F.stddev_pop("velocity")).alias("velocity_std"),
        zero(F.avg("_x")).alias("mean_gaze_x"), zero(F.avg("_y")).alias("mean_gaze_y"), zero(F.stddev_pop(distance(F.col("_x"), F.col("_y"), F.col("_mx"), F.col("_my")))).alias("gaze_spread"),
    )


def frame_features(rows: DataFrame) -> DataFrame:
    """For each frame: persons, faces, the confidence-weighted convergence of the gaze and its centre."""
    w = Window.partitionBy(*KEY, "pos")
    good = F.col("face") & F.col("x").isNotNull() & (F.col("conf") >= 0.3)
    c, x, y = F.when(good, F.col("conf")), F.when(good, F.col("x")), F.when(good, F.col("y"))
    rows = rows.withColumns({"_c": c, "_x": x, "_y": y}).withColumns({"_cx": F.sum(F.col("_x") * F.col("_c")).over(w) / F.sum("_c").over(w), "_cy": F.sum(F.col("_y") * F.col("_c")).over(w) / F.sum("_c").over(w)})
    n = F.count("_c")
    far = F.median(distance(F.col("_x"), F.col("_y"), F.col("_cx"), F.col("_cy")))
    return rows.groupBy(*KEY, "pos").agg(
        F.min("frame_idx").alias("frame_idx"), F.min("ts").alias("ts"), F.count("*").alias("num_persons"), F.count_if("face").alias("num_faces"),
        F.when(n >= 2, F.exp(-3.0 * far) * F.avg("_c")).otherwise(0.0).alias("convergence"), F.max("_cx").alias("center_x"), F.max("_cy").alias("center_y"),
        F.array_sort(F.collect_set(F.when(F.col("face"), F.col("person_id")))).alias("present"),
    )


def plain_convergence(rows: DataFrame) -> DataFrame:
    """For each frame: how close the known gaze points of persons with a face lie together, whatever their confidence; 0 for fewer than two."""
    good = F.col("face") & F.col("x").isNotNull()
    w = Window.partitionBy(*KEY, "pos")
    x, y = F.when(good, F.col("x")), F.when(good, F.col("y"))
    placed = rows.withColumns({"_x": x, "_y": y, "_cx": F.avg(x).over(w), "_cy": F.avg(y).over(w)})
    far = F.median(distance(F.col("_x"), F.col("_y"), F.col("_cx"), F.col("_cy")))
    return placed.groupBy(*KEY, "pos").agg(F.when(F.count("_x") >= 2, F.exp(-3.0 * far)).otherwise(0.0).alias("convergence"))


def frame_times(gaze: DataFrame, sample_fps: float, video_fps: float) -> DataFrame:
    """Adds sampled_ts (place of the frame among those that were sampled, by their rate) and video_ts (the frame's number by the video's rate)."""
    place = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("frame_idx")) - 1
    return gaze.withColumns({"sampled_ts": place / F.lit(sample_fps), "video_ts": F.col("frame_idx") / F.lit(video_fps)})


def anchor_motion(rows: DataFrame) -> DataFrame:
    """Velocity of the gaze's direction from the face, and of the face itself, between a person's observations. rows: of fill_gaps().

    The gaze behind the face at frame position i is that of the person's own observation i, so it drifts once a person was
    absent. Null if a face or gaze is missing on either side, or the face jumps (a scene cut); 0 if no time passes."""
    own = rows.select(*KEY, "person_id", F.col("obs_pos").alias("pos"), F.col("ix").alias("_ax"), F.col("iy").alias("_ay"))
    out = rows.join(own, [*KEY, "person_id", "pos"], "left")
    face = F.coalesce("face_detected", F.lit(False)) & F.col("fx1").isNotNull()
    cx, cy = F.when(face, (F.col("fx1") + F.col("fx2")) / 2), F.when(face, (F.col("fy1") + F.col("fy2")) / 2)
    dx, dy = direction_vector(cx, cy, F.col("_ax"), F.col("_ay"))
    out = out.withColumns({"_cx": cx, "_cy": cy, "dir_x": dx, "dir_y": dy})
    w = Window.partitionBy(*KEY, "person_id").orderBy("obs_pos")
    lag = lambda c: F.lag(c).over(w)
    moved, turned, dt = distance(lag("_cx"), lag("_cy"), F.col("_cx"), F.col("_cy")), distance(lag("dir_x"), lag("dir_y"), F.col("dir_x"), F.col("dir_y")), F.col("ts") - lag("ts")
    out = out.withColumns({"_moved": moved, "_turned": turned, "_dt": dt})
    speed = lambda d: F.when((F.col("_moved") <= FACE_JUMP) & F.col(d).isNotNull(), F.when(F.col("_dt") > 0, F.col(d) / F.col("_dt")).otherwise(0.0))
    return out.withColumns({"anchor_velocity": speed("_moved"), "gaze_dir_velocity": speed("_turned")}).drop("_ax", "_ay", "_cx", "_cy", "_moved", "_turned", "_dt")


def person_table(rows: DataFrame) -> DataFrame:
    """person_features() with the persons' summaries: the shares of their rows with a face and with a gaze in frame. rows: of velocities()."""
    told = person_summary(rows).select(*KEY, "person_id", "face_pct", "inframe_pct")
    return person_features(rows).join(told, [*KEY, "person_id"])


def pair_distances(rows: DataFrame) -> DataFrame:
    """Distances of the gaze points of two persons of a frame, both with a face and confidence of 0.3."""
    good = rows.where(F.col("face") & F.col("x").isNotNull() & (F.col("conf") >= 0.3)).select(*KEY, "pos", "person_id", "x", "y")
    b = good.select(*KEY, "pos", F.col("person_id").alias("person_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    pairs = good.join(b, [*KEY, "pos"]).where("person_id < person_b")
    return pairs.select(*KEY, "pos", F.col("person_id").alias("person_a"), "person_b", distance(F.col("x"), F.col("y"), F.col("xb"), F.col("yb")).alias("distance"))


def video_features(frames: DataFrame) -> DataFrame:
    """Mean and greatest convergence over frames with two faces or more."""
    two = F.when(F.col("num_faces") >= 2, F.col("convergence"))
    return frames.groupBy(*KEY).agg(F.count("*").alias("frames"), F.coalesce(F.avg(two), F.lit(0.0)).alias("mean_convergence"), F.coalesce(F.max(two), F.lit(0.0)).alias("max_convergence"))


def top_velocities(rows: DataFrame, least: float = 0.5, confidence: float = 0.5, n: int = 50) -> DataFrame:
    """The n fastest own observations of each video."""
    w = Window.partitionBy(*KEY).orderBy(F.col("velocity").desc(), "person_id", "obs_pos")
    fast = rows.where((F.col("velocity") > least) & (F.col("velocity_conf") >= confidence))
    return fast.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*KEY, "person_id", "ts", "velocity", "rank")


def person_summary(obs: DataFrame) -> DataFrame:
    """First and last frame, length, and shares of rows with a face and with a gaze in frame, in percent."""
    share = lambda c: F.bround(100.0 * F.count_if(c) / F.count("*"), 1)
    return obs.groupBy(*KEY, "person_id").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.countDistinct("frame_idx").alias("track_length"), share(F.col("face_detected")).alias("face_pct"), share(F.col("valid")).alias("inframe_pct"))


def high_convergence(frames: DataFrame, least: float = 0.7, faces: int = 2) -> DataFrame:
    """Frames of two faces or more whose gaze converges."""
    return frames.where((F.col("convergence") > least) & (F.col("num_faces") >= faces))
