"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is taken in segments, whose features are their distinct hashed n-grams. Each is scaled by the log ratio of its
smoothed frequencies in toxic and other training segments, then a logistic regression is fitted in numpy. A text is as
toxic as its worst segment, so that a long one isn't washed out; in the fit, a toxic text stands for the segment that
the round before found worst. Scores are calibrated on training texts held back from the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, crc_mod, sample_rows
from .features import distinct

SIZES, BITS, SEGMENT = (3, 4, 5), 18, 2_000
#: The classifier is fitted on at most so many labelled rows (those with the smallest hashes of their ids).
MAX_ROWS = 4_000
#: Smoothing, least absolute log-count ratio of a feature that is kept, ridge penalty, steps.
ALPHA, LEAST, RIDGE, STEPS, ROUNDS = 0.5, 0.7, 3e-4, 100, 3


def fit(texts: list[str | None], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the intercept; one class only: its smoothed share for every text."""
    y = np.asarray(labels, "f4")
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 8 or y.min() == y.max():
        return np.zeros(1 << BITS, "f4"), float(np.log(share / (1 - share)))
    seen = np.zeros(1 << BITS, "i4")
    rows, own = [], []
    for d, t in enumerate(texts):
        for r in distinct(t, SIZES, BITS, seen, SEGMENT):
            rows.append(r)
            own.append(d)
    own = np.array(own)
    back = np.arange(len(y)) % 5 == 4  # the texts that calibrate
    used = ~back[own]
    for _ in range(ROUNDS):
        w, b = fit_segments([rows[k] for k in np.flatnonzero(used)], y[own[used]])
        z = np.full(len(y), -np.inf)
        np.maximum.at(z, own, each := np.array([w[r].sum(dtype="f8") for r in rows]) + b)
        used = ~back[own] & ((y[own] == 0) | (each == z[own]))
    s, t = 1.0, 0.0  # Platt's slope and shift, by Newton steps with a ridge towards 1 and 0
    zb, yb = z[back], y[back]
    for _ in range(30):
        r = 1 / (1 + np.exp(-np.clip(s * zb + t, -30, 30)))
        v = r * (1 - r) + 1e-9
        g = np.array([((r - yb) * zb).sum() + (s - 1), (r - yb).sum() + t])
        h = np.array([[(v * zb * zb).sum() + 1, (v * zb).sum()], [(v * zb).sum(), v.sum() + 1]])
        step = np.linalg.solve(h, g)
        s, t = max(0.05, s - step[0]), t - step[1]
    return (s * w).astype("f4"), float(s * b + t)


def fit_segments(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the buckets, log-count ratios included, and the intercept."""
    p, q = np.zeros(1 << BITS, "f4"), np.zeros(1 << BITS, "f4")
    for r, label in zip(rows, y):
        (p if label else q)[r] += 1
    ratio = np.log((p + ALPHA) / (y.sum() + 2 * ALPHA)) - np.log((q + ALPHA) / ((1 - y).sum() + 2 * ALPHA))
    ratio[(np.abs(ratio) < LEAST) | (p + q < 2)] = 0
    kept = [r[ratio[r] != 0] for r in rows]
    at = np.repeat(np.arange(len(kept), dtype="i4"), [len(r) for r in kept])
    cols = np.concatenate(kept).astype("i4")
    x = ratio[cols]
    share = (y.sum() + 1) / (len(y) + 2)
    w, b = np.full(1 << BITS, 1e-2), float(np.log(share / (1 - share)))
    gw, gb = np.full(1 << BITS, 1e-6), 1e-6
    for _ in range(STEPS):
        z = np.bincount(at, weights=x * w[cols], minlength=len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(cols, weights=x * e[at], minlength=1 << BITS) + RIDGE * w
        gw, gb = gw + g * g, gb + e.sum() ** 2
        w, b = w - 0.05 * g / np.sqrt(gw), b - 0.05 * e.sum() / np.sqrt(gb)
    return (w * ratio).astype("f4"), float(b)


def train(docs: DataFrame, labels: DataFrame, held, label_col: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Fits on a bounded sample of the labelled rows where `held` (a column of docs) is not true. One task
    fits the sample; the weights alone come to the driver.

    Of rows of one id that with the least text is taken."""
    named = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("_y"))
    named = named.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    ids = docs.where(F.coalesce(~held, F.lit(False))).select("doc_id").join(named, "doc_id").distinct()
    picked = sample_rows(ids, F.col("doc_id"), max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left_semi").join(F.broadcast(named.join(picked.select("doc_id"), "doc_id", "left_semi")), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("_text"), F.max("_y").alias("_y"))

    def learn(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("doc_id")
        w, b = fit(sample.column("_text").to_pylist(), sample.column("_y").to_numpy())
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "b": [b]})

    got = rows.groupBy(F.lit("all")).applyInArrow(learn, "w binary, b double").collect()
    return (np.frombuffer(got[0].w, "f4"), got[0].b) if got else fit([], np.zeros(0))


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The columns `keep`, score (0 to 1) and predicted (1 from threshold on). Null or empty texts get the score of no n-gram but their ends."""
    names, out = _scored(docs, model, keep, threshold)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "score", "predicted")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score reaches the threshold; same columns, whatever their names.

    A null or empty text has the score of no n-gram but its ends; repeated rows and those of null ids are judged each; an
    empty table gives no rows. Long texts are judged whole, segment by segment."""
    names, out = _scored(docs, model, docs.columns, threshold)
    return out.where("predicted = 0").select(*(F.col(n).alias(c) for c, n in names.items()))


def _scored(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], threshold: float) -> tuple[dict[str, str], DataFrame]:
    batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = {c: f"_k{k}" for k, c in enumerate(keep)}
    source = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names.values())

    def run(it):
        w, b = sent.value
        seen = np.zeros(1 << BITS, "i4")
        for batch in it:
            z = np.array([max(w[r].sum(dtype="f8") for r in distinct(t, SIZES, BITS, seen, SEGMENT)) for t in batch.column("_text").to_pylist()], "f8") + b
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names.values()), pa.array(p), pa.array((p >= threshold).astype("i4"))], [*names.values(), "score", "predicted"])

    return names, source.mapInArrow(run, f"{schema}, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text modulo 3 is 1), score, predicted.

    Learns only from labelled rows that are not held out; no labels, or labels of one class, give every text the
    same score. A null id is not held out and never learnt from; repeated rows are scored each; an empty table
    gives no rows; other columns, clashing names included, are not read.
    """
    held = crc_mod("doc_id", 3) == 1
    model = train(docs, labels, held)
    return score(docs, model, ["doc_id"], threshold).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
