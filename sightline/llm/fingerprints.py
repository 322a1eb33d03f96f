"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle of five words is hashed once; the hash's top bits name one of 256 bins, and a bin keeps its least value.
Empty bins borrow from another bin by optimal densification: bin and attempt are hashed to the bin to look at, until
one is found that wasn't empty. The low 8 bits of each bin are kept, and the likeness of two fingerprints is the share
of equal bins, corrected for those equal by chance.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, mix
from .secrets import let

BINS, KEPT_BITS, WORDS = 256, 8, 5
#: Attempts that are looked up in tables; bins still empty then take the bin whose hash with theirs is least.
ATTEMPTS = 4
VALUE_BITS = 63 - BINS.bit_length() + 1
#: Buckets of the order by id: rows of each that are aimed at, and buckets at most.
BUCKET_ROWS, MAX_BUCKETS = 1_000, 20_000


def bins(text: Column) -> Column:
    """array<tinyint> of BINS low-order values; null for a text without words. Words: lower case, cut at ASCII white space."""
    words = F.transform(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))

    def hashes(w):
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))), 1))
        return F.when(n >= WORDS, many).when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(w.cast("array<string>"), " ")), 1)))

    def of(x):
        return F.shiftright(x, VALUE_BITS).cast("int")

    def least(s):
        return F.filter(s, lambda x, i: (i == 0) | (of(x) != of(F.get(s, i - 1))))

    def dense(m):
        gaps = F.transform(m, lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("long"), of(x) - F.when(i == 0, F.lit(-1)).otherwise(of(F.get(m, i - 1))) - 1), F.array(x)))
        return F.concat(F.flatten(gaps), F.array_repeat(F.lit(None).cast("long"), F.lit(BINS - 1) - of(F.element_at(m, -1))))

    def attempt(now, d, t):
        probe = F.array(*map(F.lit, (mix(np.arange(BINS, dtype="u8"), 100 + t) % BINS).tolist()))
        return F.transform(now, lambda v, b: F.coalesce(v, F.get(d, F.get(probe, b))))

    def borrowed(m, d):
        out = d
        for t in range(ATTEMPTS):
            out = attempt(out, d, t)
        rank = lambda b: F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(b, of(x)).alias("h"), x.alias("x"))))["x"]
        return let(out, lambda o: F.when(F.exists(o, lambda v: v.isNull()), F.transform(o, lambda v, b: F.coalesce(v, rank(b)))).otherwise(o))

    low = lambda d: F.transform(d, lambda v: (v.bitwiseAND((1 << KEPT_BITS) - 1) - (1 << KEPT_BITS - 1)).cast("tinyint"))
    full = lambda m: low(let(dense(m), lambda d: borrowed(m, d)))
    return let(let(words, hashes), lambda h: F.when(h.isNotNull(), let(let(F.sort_array(h), least), full)))


def packed(b: Column) -> Column:
    """The bins in hex, two digits each; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(b, lambda v: F.lower(F.substring(F.hex(v.cast("int") + (1 << KEPT_BITS - 1) + 256), 2, 2))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity: the share of equal bins less what chance adds. Two texts without words: 1; one: 0."""
    chance = 1 / (1 << KEPT_BITS)
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / BINS
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint for each row; null text: empty, whose fingerprint is empty."""
    return docs.select(id_col, packed(bins(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("fingerprint"))


def with_next(rows: DataFrame, derived: dict[str, Column], carried: list[str]) -> DataFrame:
    """rows (_id long, _text) and the columns `derived` of them with, for each of `carried`, next_<name> of the row that follows by descending _id, then _text; after the last the first. Null ids come last.

    Rows are dealt to buckets of neighbouring ids; each bucket also gets a copy of the next bucket's first row."""
    spark = rows.sparkSession
    n = rows.count()
    want = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    cuts = []
    if want > 1:
        got = rows.agg(F.percentile_approx("_id", [k / want for k in range(1, want)], max(10_000, 5 * want))).first()[0]
        cuts = sorted({int(x) for x in got or []})
    step = isqrt(len(cuts)) + 1
    chunks = [cuts[k : k + step] for k in range(0, len(cuts), step)]

    def bucket(i: Column) -> Column:
        if not cuts:
            return F.when(i.isNull(), -1).otherwise(0)
        heads = F.array(*(F.lit(c[0]).cast("long") for c in chunks))
        inner = F.array(*(F.array(*(F.lit(x).cast("long") for x in c)) for c in chunks))
        k = F.size(F.filter(heads, lambda c: c <= i))
        return F.when(i.isNull(), -1).when(k == 0, 0).otherwise((k - 1) * step + F.size(F.filter(F.get(inner, k - 1), lambda c: c <= i)))

    dealt = rows.withColumn("_bucket", bucket(F.col("_id")).cast("int")).withColumn("_extra", F.lit(0))
    # MAX_BUCKETS rows at most, of ids only; and then the rows that have them
    top = rows.select("_id").withColumn("_bucket", bucket(F.col("_id")).cast("int")).groupBy("_bucket").agg(F.max("_id").alias("_top"))
    order = Window.orderBy(F.col("_bucket").desc())
    whole = Window.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = top.select("_top", F.col("_bucket").alias("_own"), F.coalesce(F.lag("_bucket").over(order), F.last("_bucket").over(whole)).alias("_to"))
    heads = dealt.join(F.broadcast(before), F.col("_id").eqNullSafe(F.col("_top")) & (F.col("_bucket") == F.col("_own")))
    firsts = heads.groupBy("_to").agg(F.min_by(F.struct(*rows.columns), F.col("_text")).alias("_row")).select(F.col("_to").alias("_bucket"), F.lit(1).alias("_extra"), "_row.*")
    w = Window.partitionBy("_bucket").orderBy("_extra", F.col("_id").desc_nulls_last(), "_text")
    out = dealt.unionByName(firsts).withColumns(derived)
    out = out.select("*", F.lead(F.struct(*carried)).over(w).alias("_next")).where("_extra = 0")
    return out.select(*rows.columns, *derived, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in carried))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (rounded down) replaced by as much of the next document's start. Null text:
    empty. doc_id has to be a whole number (or a text of one: any other stops the job). Null ids come last in the order; equal ids by text; repeated rows follow each other; a table of one row is
    followed by itself; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    both = with_next(rows, {"_bins": bins(F.col("_text"))}, ["_text", "_bins"])
    n = F.length("_text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - tail), F.substring(F.col("next__text"), F.lit(1), tail))
    both = both.select(F.col("_id").alias("doc_id"), n.cast("long").alias("n_chars"), "_bins", "next__bins", edited.alias("_edited"))
    both = both.withColumn("_edited_bins", bins(F.col("_edited")))
    return both.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), packed(F.col("_bins")).alias("fingerprint"), packed(F.col("_edited_bins")).alias("edited_fingerprint"), likeness(F.col("_bins"), F.col("_edited_bins")).alias("near_edited"), likeness(F.col("_bins"), F.col("next__bins")).alias("near_next"))
