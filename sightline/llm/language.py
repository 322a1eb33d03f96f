"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's vector is the mean of the embeddings of its character n-grams. As everything after the mean is linear, each
bucket's embedding times the output matrix is one row of scores, which is what scoring gathers. A temperature and a
threshold of rejection are calibrated on training texts held back from the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, crc_mod, sample_rows
from .features import blocks

SIZES, BITS, WIDTH = (2, 3), 15, 16
#: The model is fitted on at most so many rows of known language (those with the smallest hashes of their ids).
MAX_ROWS = 3_000
STEPS, BATCH, GRAMS = 500, 64, 96
#: Share of the held-back texts that are right among those not rejected.
WANTED = 0.99


def fit(texts: list[str], langs: list[str]):
    """Languages, scores of each bucket by language (temperature applied), threshold of rejection."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((1 << BITS, 0), "f4"), 1.0
    y = np.array([names.index(x) for x in langs])
    found = [np.concatenate(list(blocks(t, SIZES, BITS))) for t in texts]
    rng = np.random.default_rng(10)
    back = np.arange(len(y)) % 5 == 4 if len(y) >= 20 else np.zeros(len(y), bool)
    rows = np.flatnonzero(~back & np.array([len(g) > 0 for g in found]))
    e, w = (rng.standard_normal((1 << BITS, WIDTH)) * 0.1).astype("f4"), np.zeros((WIDTH, len(names)), "f4")
    w += (rng.standard_normal(w.shape) * 0.1).astype("f4")
    by = [rows[y[rows] == k] for k in range(len(names))]
    by = [b for b in by if len(b)]
    for step in range(STEPS if by else 0):
        rate = 1.0 * (1 - step / STEPS)
        picked = np.array([rng.choice(by[rng.integers(len(by))]) for _ in range(BATCH)])  # languages alike often
        n = rng.integers(4, GRAMS + 1, BATCH)
        idx = np.concatenate([found[r][rng.integers(0, len(found[r]), k)] for r, k in zip(picked, n)]).astype("i8")
        own = np.repeat(np.arange(BATCH), n)
        h = np.add.reduceat(e[idx], np.cumsum(n) - n) / n[:, None]
        z = h @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(BATCH), y[picked]] -= 1
        gh = (p @ w.T / n[:, None]).astype("f4")
        w -= rate * (h.T @ p / BATCH).astype("f4") * 4
        np.subtract.at(e, idx, rate * gh[own])
    table = e @ w
    z = np.array([table[found[r]].mean(0) for r in np.flatnonzero(back) if len(found[r])]).reshape(-1, len(names))
    yb = y[[r for r in np.flatnonzero(back) if len(found[r])]]
    heat, least = 1.0, 0.0

    def sure(t):
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    if len(yb):
        loss = [(-np.log(sure(t)[np.arange(len(yb)), yb] + 1e-12).mean(), t) for t in np.geomspace(0.1, 4, 30)]
        heat = min(loss)[1]
        p = sure(heat)
        top, right = p.max(1), p.argmax(1) == yb
        order = np.argsort(-top)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        least = float(top[order][np.flatnonzero(good >= WANTED).max()]) if (good >= WANTED).any() else 1.0
    return names, (table / heat).astype("f4"), least


def train(docs: DataFrame, held, lang_col: str = "lang", max_rows: int = MAX_ROWS):
    """Fits on a bounded sample of the rows of known language where `held` is not true; the sample alone comes to the driver.

    Of rows of one id that with the least text is taken."""
    usable = F.coalesce(~held, F.lit(False)) & F.col(lang_col).isNotNull() & F.col("text").isNotNull()
    picked = sample_rows(docs.where(usable).select("doc_id").distinct(), F.col("doc_id"), max_rows)
    rows = docs.where(usable).select("doc_id", "text", lang_col).join(F.broadcast(picked), "doc_id", "left_semi")
    got = sorted(rows.groupBy("doc_id").agg(F.min(F.struct("text", lang_col)).alias("r")).select("doc_id", "r.*").collect())
    return fit([r[1] for r in got], [r[2] for r in got])


def predict(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """The columns `keep`, lang_pred, score (the softmax of the language given), rejected (score below the calibrated threshold)."""
    batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = {c: f"_k{k}" for k, c in enumerate(keep)}
    source = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names.values())

    def run(it):
        langs, table, least = sent.value
        for batch in it:
            said, score = [], []
            for t in batch.column("_text").to_pylist():
                if not t or not langs or not any(map(str.isalpha, t)):
                    said.append("und")
                    score.append(0.0)
                    continue
                total, n = np.zeros(len(langs)), 0
                for g in blocks(t, SIZES, BITS):
                    total += table[g].sum(0, dtype="f8")
                    n += len(g)
                z = total / max(n, 1)
                p = np.exp(z - z.max())
                k = int(p.argmax())
                said.append(langs[k])
                score.append(float(p[k] / p.sum()))
            rejected = [s < least or x == "und" for s, x in zip(score, said)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names.values()), pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names.values(), "lang_pred", "score", "rejected"])

    out = source.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "lang_pred", "score", "rejected")


def identify_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text modulo 3 is 1), lang_pred, score, rejected.

    Null, empty and letterless texts are `und` with score 0; so is every text if no row has a known language. A null
    id is not held out and never learnt from; repeated rows are predicted each; an empty table gives no rows; other
    columns are not read.
    """
    model = train(docs, crc_mod("doc_id", 3) == 1)
    return predict(docs, model, ["doc_id"]).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
