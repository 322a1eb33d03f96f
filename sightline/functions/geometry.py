"""Points, boxes and intervals as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def inside(x: Column, y: Column, box: list[Column], margin: float = 0.02) -> Column:
    """Whether a point is in a box widened by margin, ends included; false if anything is null."""
    return F.coalesce(x.between(box[0] - margin, box[2] + margin) & y.between(box[1] - margin, box[3] + margin), F.lit(False))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two x1, y1, x2, y2 boxes; 0 without area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column, strict: bool = True) -> Column:
    """Whether two intervals share time; not strict: touching counts."""
    return (s1 < e2) & (s2 < e1) if strict else (s1 <= e2) & (s2 <= e1)


def frame_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two frame ranges, both ends counted."""
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    return both / ((e1 - s1 + 1) + (e2 - s2 + 1) - both)


def direction(dx: Column, dy: Column) -> Column:
    """One of eight directions (y grows downwards); null if both parts are under 0.02."""
    angle = F.degrees(F.atan2(dy, dx))
    names = [(22.5, "right"), (67.5, "down-right"), (112.5, "down"), (157.5, "down-left")]
    out = F.when((F.abs(dx) < 0.02) & (F.abs(dy) < 0.02), F.lit(None).cast("string"))
    for top, name in names:
        out = out.when((angle >= top - 45) & (angle < top), name)
    for top, name in ((-22.5, "up-right"), (-67.5, "up"), (-112.5, "up-left")):
        out = out.when((angle >= top - 45) & (angle < top), name)
    return out.otherwise("left")


def size_label(m: Column) -> Column:
    return F.when(m < 0.1, "small").when(m < 0.3, "medium").otherwise("large")


def corners(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """x1, y1, x2, y2 of a box of left, top, width and height."""
    return [x, y, x + w, y + h]


def corners_of_centre(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x - w / 2, y - h / 2, x + w / 2, y + h / 2]


def centre(box: list[Column]) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def pixel(x: Column, size: int) -> Column:
    """A share of the picture's size in whole pixels, cut off."""
    return (x * size).cast("long")


def position_text(box: list[Column], digits: int = 4) -> Column:
    return F.format_string(f"position: [%.{digits}f, %.{digits}f]", *centre(box))


def cosine(a: Column, b: Column, least: float = 1e-8) -> Column:
    """Cosine similarity of two arrays of numbers."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + least)


def direction_vector(ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """From a to b."""
    return bx - ax, by - ay


def in_frame(score: Column, least: float = 0.5) -> Column:
    """Whether a gaze lies in the picture, by the score of a prediction."""
    return score > least


def heat_point(heat: Column, width: int) -> tuple[Column, Column]:
    """Column and row of the first greatest value of a flattened map."""
    at = F.array_position(heat, F.array_max(heat)) - 1
    return at % width, F.floor(at / width)


def sampled(k: Column, fps: float, sample_fps: float) -> Column:
    """The video's frame of the k-th frame sampled, cut off."""
    return F.floor(k * (fps / sample_fps))


def chunks(n: Column, size: int, overlap: int) -> Column:
    """array<struct<chunk, first_frame, last_frame>> (end exclusive) of n frames: each begins overlap frames before the last one's end."""
    step = size - overlap
    last = F.ceil(F.greatest(n - overlap, F.lit(1)) / step) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda c: F.struct(c.alias("chunk"), (c * step).alias("first_frame"), F.least(c * step + size, n.cast("long")).alias("last_frame")))


def split_scene(start: Column, end: Column, longest: float) -> Column:
    """array<struct<start_time, end_time>> of pieces of a scene, each of at most `longest` seconds."""
    pieces = F.sequence(F.lit(0).cast("long"), F.ceil((end - start) / longest) - 1)
    return F.transform(pieces, lambda k: F.struct((start + k * longest).alias("start_time"), F.least(start + (k + 1) * longest, end).alias("end_time")))
