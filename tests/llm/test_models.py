"""Fingerprints, classifiers and added secrets beside plain loops over characters, words and bits."""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import features, fingerprints, language, secrets, toxicity
from sightline.llm.common import mix

MASK = (1 << 64) - 1
TEXTS = [None, "", " \n\t ", "one", "One two THREE four", "one two three four five", "a b c d e f g h " * 40, "a b c d e f g h " * 40 + "i", "é ß Ünïcode wörds here and there, ok", "x" * 70_000 + " y z " * 300]


def long_hash(value: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<Q", value & MASK), seed)


def int_hash(value: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<i", value), seed)


def by_hand(text: str | None) -> list[int] | None:
    """Bins of one-permutation MinHash: hash all shingles of five words, keep the least value of each bin, fill empty bins."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    if not words:
        return None
    codes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if len(words) < 5:
        joined = " ".join(str(c - (1 << 64) if c >> 63 else c) for c in codes)
        hashes = [xxhash.xxh64_intdigest(joined.encode(), 42) >> 1]
    else:
        hashes = []
        for k in range(len(codes) - 4):
            h = 42
            for c in codes[k : k + 5]:
                h = long_hash(c, h)
            hashes.append(h >> 1)
    bins: dict[int, int] = {}
    for h in hashes:
        b = h >> fingerprints.VALUE_BITS
        bins[b] = min(bins.get(b, h), h)
    out = []
    for b in range(fingerprints.BINS):
        value = bins.get(b)
        for t in range(fingerprints.ATTEMPTS):
            if value is None:
                value = bins.get(int(mix(np.array([b], "u8"), 100 + t)[0] % np.uint64(fingerprints.BINS)))
        if value is None:
            signed = lambda h: h - (1 << 64) if h >> 63 else h
            value = min((signed(int_hash(o, int_hash(b, 42))), x) for o, x in bins.items())[1]
        out.append(value & 255)
    return out


def test_fingerprints_by_hand(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    hands = {k: by_hand(t) for k, t in enumerate(TEXTS)}
    assert got == {k: "" if b is None else "".join(f"{x:02x}" for x in b) for k, b in hands.items()}
    edits = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    for k, text in enumerate(TEXTS):
        after = TEXTS[k - 1] or ""  # the next by descending id; after the first comes the last
        n = len(text or "") // 3
        edited = by_hand((text or "")[: len(text or "") - n] + after[:n])
        for name, other in (("near_next", hands[(k - 1) % len(TEXTS)]), ("near_edited", edited)):
            a, b = hands[k], other
            want = 1.0 if a is None and b is None else 0.0 if a is None or b is None else max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 256) / (1 - 1 / 256))
            assert edits[k][name] == pytest.approx(want, abs=1e-12), (k, name)


def gram_buckets(text: str | None, sizes: tuple[int, ...], bits: int) -> list[int]:
    points = [ord(c) for c in f" {(text or '').lower()} "]
    out = []
    for n in sizes:
        for k in range(len(points) - n + 1):
            h = n * 0x51ED270B & 0xFFFFFFFF
            for c in points[k : k + n]:
                h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h >> 32 - bits)
    return out


def test_grams_by_hand(monkeypatch):
    for text in TEXTS:
        want = sorted(gram_buckets(text, (2, 3), 15))
        assert sorted(np.concatenate(list(features.blocks(text, (2, 3), 15))).tolist()) == want
        monkeypatch.setattr(features, "BLOCK", 50)
        assert sorted(np.concatenate(list(features.blocks(text, (2, 3), 15))).tolist()) == want
        monkeypatch.undo()


def test_toxicity_by_hand(spark):
    """The score is that of the worst segment's distinct n-grams, weights summed up one by one."""
    rng = np.random.default_rng(3)
    w, b = (rng.standard_normal(1 << toxicity.BITS) * 0.02).astype("f4"), -0.3
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS[:9] + ["word soup " * 900])], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, (w, b), ["doc_id"], 0.5).collect()}
    for r in docs.collect():
        whole = f" {(r.text or '').lower()} "
        tops = []
        for k in range(0, len(whole), toxicity.SEGMENT):
            part = whole[k : k + toxicity.SEGMENT + max(toxicity.SIZES) - 1]
            seen = set()
            for n in toxicity.SIZES:
                for j in range(len(part) - n + 1):
                    h = n * 0x51ED270B & 0xFFFFFFFF
                    for c in part[j : j + n]:
                        h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                        h ^= h >> 15
                    seen.add(h >> 32 - toxicity.BITS)
            tops.append(sum(float(w[x]) for x in seen))
        want = 1 / (1 + np.exp(-(max(tops) + b)))
        assert got[r.doc_id][0] == pytest.approx(want, rel=1e-5) and got[r.doc_id][1] == int(want >= 0.5)


def test_language_by_hand(spark):
    """The prediction is the softmax of the mean of the n-grams' scores."""
    rng = np.random.default_rng(4)
    table = rng.standard_normal((1 << language.BITS, 3)).astype("f4") * 3
    docs = spark.createDataFrame(list(enumerate(TEXTS + ["12 ½ ² !"])), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language.predict(docs, (["a", "b", "c"], table, 0.5), ["doc_id"]).collect()}
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id] == ("und", 0.0, True)
            continue
        g = gram_buckets(r.text, language.SIZES, language.BITS)
        z = [sum(float(table[x, k]) for x in g) / len(g) for k in range(3)]
        p = np.exp(np.array(z) - max(z))
        p /= p.sum()
        assert got[r.doc_id][0] == "abc"[int(p.argmax())] and got[r.doc_id][1] == pytest.approx(p.max(), rel=1e-4)
        assert got[r.doc_id][2] == bool(p.max() < 0.5)


def test_added_secrets_equal_regex(spark):
    """The kinds that the method adds, by each rule's own pattern over whole texts."""
    parts = ["ghp_" + "a1B2" * 9, "gho_" + "x" * 36, "ghp_short", "xoxb-1234567890-ab", "xoxz-1234567890", "eyJhbGci.eyJzdWIi.c2ln_-x", "eyJhbGci.c2ln", "AKIA" + "Z" * 16, "password: hunter22222", "0a" * 16]
    texts = [f"see {p}, or{q} {p}" for p in parts for q in parts] + [None, "", "eyJ" * 2000, "ghp_" + "b" * 5000]
    docs = spark.createDataFrame([(k % 90, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.spans) for r in secrets.scan_secrets(docs).collect())
    added = [r for r in secrets.RULES if r.kind not in ("assign", "access", "hex")]
    assert {r.kind for r in added} >= {"github", "slack", "jwt"}
    spans = lambda s: {x for x in (s or "").split(",") if x.split(":")[0] in {r.kind for r in added}}
    want = sorted(((k % 90, sorted(f"{r.kind}:{m.start()}:{m.end()}" for r in added for m in re.finditer(r.pattern, t or "", re.A))) for k, t in enumerate(texts)), key=str)
    assert sorted(((i, sorted(spans(s))) for i, s in got), key=str) == want


def test_toxicity_is_not_fitted_in_the_driver(spark, monkeypatch):
    """The driver gets the weights of the labelled rows, not the rows; no rows: the weights of none."""
    rows = [(k, f"you {'nasty awful' if k % 2 else 'kind gentle'} person number {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    want = toxicity.fit([t for _, t in rows], np.array([k % 2 for k in range(60)]))
    empty = toxicity.train(docs, labels.where("false"), F.lit(False))
    assert not empty[0].any() and empty[1] == 0.0
    driver, fit = os.getpid(), toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *x: 1 / 0 if os.getpid() == driver else fit(*x))
    w, b = toxicity.train(docs, labels, F.lit(False))
    assert (w == want[0]).all() and b == want[1]
