"""The attention model beside plain loops; the memory of rare words beside a count by hand."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sightline.llm import attention, scoring

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(0)
    rows = [r.integers(0, 9, 90) for _ in range(40)]
    ids, at = np.concatenate(rows), np.arange(41) * 90
    count = np.bincount(ids, minlength=12)
    key, n = attention.pair_counts(attention.numbers(count), ids, at)
    pairs = np.zeros((attention.BEGIN + 1) * (attention.KEPT + 1), "i8")
    pairs[key] = n
    t = attention.Tables.of(count, pairs.reshape(attention.BEGIN + 1, -1))
    trainer = attention.Trainer(attention.start(), t.own, t.after)
    trainer.take(*attention.picked_windows(t.number[ids], at, np.arange(40).astype("u8"), 1, 0)[:2])
    assert trainer.windows == 40 * 3 and trainer.steps == 3
    return trainer.p, t, rows


def test_probabilities_sum_to_one(model):
    p, t, rows = model
    start = rows[0][:70]
    whole = np.stack([np.append(start, k) for k in range(12)])
    got = attention.score(p, t, whole.ravel(), np.arange(13) * 71)[np.arange(1, 13) * 71 - 1]
    assert abs(np.exp(got).sum() - 1) < 1e-3  # numbers that no token has keep what smoothing gives them


def test_score_equals_a_loop_over_tokens(model):
    p, t, rows = model
    ids = np.concatenate([rows[0], rows[1][:5], rows[2][:33]])
    at = np.array([0, 90, 95, 128])
    got, want = attention.score(p, t, ids, at), []
    bias = np.clip(p["b"].ravel(), -10, 10)
    for a, z in zip(at[:-1], at[1:]):
        x = [attention.BEGIN, *t.number[ids[a:z]]]
        for k in range(z - a):
            first = max(0, k // attention.SCORED * attention.SCORED - attention.LEAD)  # the window's first place
            e = p["e"][x[first : k + 1]].astype("f8")
            s = e @ p["k"] @ (p["e"][x[k]] @ p["q"]) / math.sqrt(attention.WIDTH) + bias[np.arange(k - first, -1, -1)]
            w = np.exp(s) / np.exp(s).sum()
            h = w @ (e @ p["v"])
            logit = p["u"] @ h + t.after[x[k]]
            want.append((logit - np.log(np.exp(logit).sum()))[t.own[x[k + 1]]] + t.within[x[k], x[k + 1]] + t.rest[ids[a + k]])
    assert np.allclose(got, want, atol=2e-3)


def test_picked_windows_are_those_of_the_line(model):
    _, t, rows = model
    now = t.number[np.concatenate([rows[0], rows[1][:5], rows[2][:64]])]
    at = np.array([0, 90, 95, 159])
    line = attention.Line.of(now, at)
    goal = np.full(len(line.inputs), -1)
    goal[line.place] = now
    where = line.starts[:, None] + np.arange(attention.WINDOW)
    x, y, _ = attention.picked_windows(now, at, np.arange(3).astype("u8"), 1, 0)
    real = goal[where[:, attention.LEAD :]] >= 0
    assert (y == goal[where[:, attention.LEAD :]]).all() and (x == line.inputs[where]).all() and real.sum() == len(now)
    each = [attention.picked_windows(now, at, np.arange(3).astype("u8"), 3, k)[0] for k in range(3)]
    assert sum(map(len, each)) == len(x)


def test_gradient_equals_differences(model):
    p, t, rows = model
    p = {k: v.astype("f8") for k, v in p.items()}
    line = attention.Line.of(t.number[np.concatenate(rows[:3])], np.arange(4) * 90)
    goal = np.full(len(line.inputs), -1)
    goal[line.place] = t.own[t.number[np.concatenate(rows[:3])]]
    where = line.starts[:, None] + np.arange(attention.WINDOW)
    x, y = line.inputs[where], goal[where[:, attention.LEAD :]].ravel()

    def loss(p):
        h = attention._attend(x, attention._views(p))[-1].reshape(-1, attention.WIDTH)
        z = h @ p["u"].T + t.after[x[:, attention.LEAD :].ravel()]
        return -np.mean((z - np.log(np.exp(z).sum(1, keepdims=True)))[y >= 0, y[y >= 0]])

    g = attention.Trainer(p, t.own, t.after).gradient(x, y)
    for name, at in (("u", (3, 5)), ("q", (1, 2)), ("k", (4, 0)), ("v", (7, 7)), ("e", (2, 6)), ("e", (attention.BEGIN, 1)), ("b", (0, 3))):
        old, p[name][at] = p[name][at], p[name][at] + 1e-5
        up = loss(p)
        p[name][at] = old - 1e-5
        down = loss(p)
        p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_memory_of_rare_words(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(30)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in scoring.score_texts(docs, TOKENIZER).collect()}
    monkeypatch.setattr(scoring, "RECALL", 0.0)
    plain = {r.doc_id: r.score for r in scoring.score_texts(docs, TOKENIZER).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    pairs, single = Counter(), Counter()
    for i, t in rows:
        w = t.split() + [" "]
        if not held(i):
            pairs.update(zip(w, w[1:]))
            single.update(w[:-1])
    for i, t in rows:
        w, own = t.split() + [" "], 0 if held(i) else 1
        known = sum(single[a] - own * w.count(a) > 0 for a in w[:-1])
        again = sum(pairs[a, b] - own > 0 for a, b in zip(w, w[1:]))
        # each word after one that is known from elsewhere: raised to a fifth of the share at least, or down by 0.8
        if not known:
            assert abs(got[i].score - plain[i]) < 1e-6
        elif again == known:
            assert got[i].score > plain[i] + 20
        assert got[i].n_known == sum(single[a] > 0 for a in w[:-1]) + 1
    assert sum(got[i].score > plain[i] + 20 for i, _ in rows) >= 10


def test_memory_by_hand(spark, monkeypatch):
    """The mixture itself: each word after a rare word that other training texts know, a text's own occurrences left out."""
    rows = [(i, t) for i, t in enumerate(["abcdef ghijkl abcdef ghijkl", "abcdef ghijkl", "abcdef mnopqr", "abcdef ghijkl zzz", "mnopqr abcdef"])] + [(None, "abcdef stu"), (9, "abcdef"), (50, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    logs = {}
    monkeypatch.setattr(scoring, "RECALL", 1e-9)
    plain = {r.doc_id: r.score for r in scoring.score_texts(docs, TOKENIZER).collect()}
    # what the model gives each word comes from texts that are cut after it: the end is a unit of its own
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    monkeypatch.setattr(scoring, "RECALL", 0.2)
    got = {r.doc_id: r.score for r in scoring.score_texts(docs, TOKENIZER).collect()}
    units = {i: t.split() + [" "] for i, t in rows}
    for i, w in units.items():
        shares = []
        for a, b in zip(w, w[1:]):
            c = sum(x == a for j, v in units.items() if j != i and not held(j) for x in v[:-1])
            both = sum((x, y) == (a, b) for j, v in units.items() if j != i and not held(j) for x, y in zip(v, v[1:]))
            if c:
                shares.append(both / c)
        logs[i] = shares
        # a word that never followed elsewhere is lowered by log10 0.8; one that did is raised to a fifth of its share at least
        low = sum(math.log10(0.8) for s in shares)
        assert got[i] >= plain[i] + low - 1e-6
        if not any(shares):
            assert abs(got[i] - plain[i] - low) < 1e-6
    assert any(any(s) for s in logs.values()) and any(s and not any(s) for s in logs.values())


def test_partitioning_makes_no_difference(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = ({r.doc_id: r.score for r in scoring.score_texts(docs.repartition(n), TOKENIZER).collect()} for n in (1, 7))
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 0.01


def test_schedule():
    for n in (0, 1, 300, 24_000, 50_000, 2_000_000, 10_000_000, 10**9):
        rounds, every, shards = scoring.schedule(n)
        assert 2 <= rounds <= scoring.MOST_ROUNDS and (every == 1 or n / every * rounds >= min(n, scoring.LEAST_WINDOWS) * 0.9)
        assert n / every / shards < 2.1 * scoring.SHARD_WINDOWS
    assert scoring.schedule(10**9)[0:2] == (2, 64) and scoring.schedule(10_000_001)[0] == 2


def test_pieces_hold_every_window_once(model):
    _, t, rows = model
    r = np.random.default_rng(1)
    ids = [rows[0], r.integers(0, 9, 1), r.integers(0, 9, 5_000), rows[1][:64], r.integers(0, 9, scoring.PIECE * attention.SCORED + 1)]
    now, at = t.number[np.concatenate(ids)], np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    cut, h, lead = scoring.pieces(now, at, np.arange(len(ids)).astype("u8"))
    assert len(cut) > len(ids) and max(map(len, cut)) // 2 <= (scoring.PIECE + 2) * attention.SCORED
    got = Counter()
    for a in range(0, len(cut), 3):  # in whatever company
        part = [np.frombuffer(x, "<u2").astype("i4") for x in cut[a : a + 3]]
        x, goal = scoring.piece_windows(np.concatenate(part), np.concatenate([[0], np.cumsum([len(p) for p in part])]), h[a : a + 3], lead[a : a + 3])
        got.update((p.tobytes(), q.tobytes()) for p, q in zip(x.astype("i4"), goal.astype("i4")))
    x, goal, _ = attention.picked_windows(now, at, np.arange(len(ids)).astype("u8"), 1, 0)
    assert got == Counter((p.tobytes(), q.tobytes()) for p, q in zip(x.astype("i4"), goal.astype("i4")))


def test_training_has_no_switch_by_size(spark, monkeypatch):
    """Small and large tables are learnt from alike: what told them apart has no bearing on scores."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r.doc_id: r.score for r in scoring.score_texts(docs, TOKENIZER).collect()}
    monkeypatch.setattr(scoring, "LEAST_WINDOWS", 1)
    monkeypatch.setattr(scoring, "MOST_ROUNDS", 2)
    got = {r.doc_id: r.score for r in scoring.score_texts(docs, TOKENIZER).collect()}
    assert got.keys() == whole.keys() and max(abs(got[k] - whole[k]) for k in got) < 0.01


def test_a_step_makes_no_large_arrays(model):
    """A step writes over what the ones before made: new arrays of its size cost more than what is put into them."""
    p, t, rows = model
    now = t.number[np.concatenate(rows)]
    x, goal, _ = attention.picked_windows(now, np.arange(41) * 90, np.arange(40).astype("u8"), 1, 0)
    trainer = attention.Trainer(p, t.own, t.after)
    x, goal = x[: attention.STEP_WINDOWS], np.where(goal >= 0, t.own[goal], -1)[: attention.STEP_WINDOWS].ravel()
    trainer.step(x, goal)
    tracemalloc.start()
    trainer.step(x, goal)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20  # the logits of a step alone are 983,040 bytes


def test_steps_equal_plain_adam(model, monkeypatch):
    """Whatever the blocks, and where what is seen has to be scaled down as well as where bounds show that it hasn't."""
    _, t, rows = model
    x, goal, _ = attention.picked_windows(t.number[np.concatenate(rows)], np.arange(41) * 90, np.arange(40).astype("u8"), 1, 0)
    goal = np.where(goal >= 0, t.own[goal], -1)
    for times in (1.0, 20.0):
        start = {k: v.astype("f8") * (times if k in "qkvu" else 1) for k, v in attention.start().items()}
        views, some = attention._views(start), np.array([attention.PAD, 3, attention.OTHER])
        assert (attention._query_scale(start) < 1) == (times > 1) and np.allclose(attention._outward(start), start["u"]) == (times == 1)
        ask, seen, bias, u = attention.Trainer(start, t.own, t.after).tables(some)
        assert all(np.allclose(*both, atol=1e-6) for both in ((ask, views[0][some]), (seen, views[1][some]), (bias, views[2]), (u, attention._outward(start))))
        found = []
        for block in (1, 5, 48):
            monkeypatch.setattr(attention, "BLOCK", block)
            trainer, plain = attention.Trainer(start, t.own, t.after), {k: v.copy() for k, v in start.items()}
            first, second = ({k: np.zeros_like(v) for k, v in plain.items()} for _ in range(2))
            for n in range(1, 4):
                a = slice((n - 1) * 40, n * 40)
                g = {k: v.copy() for k, v in attention.Trainer(plain, t.own, t.after).gradient(x[a], goal[a].ravel()).items()}
                trainer.step(x[a], goal[a].ravel())
                for k, v in plain.items():
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.98 * second[k] + 0.02 * g[k] ** 2
                    v -= attention.RATE * n / 10 / (1 - 0.9**n) * first[k] / (np.sqrt(second[k] / (1 - 0.98**n)) + 1e-8)
            assert all(np.allclose(trainer.p[k], plain[k], atol=1e-7) for k in plain)
            found.append(trainer.p)
        assert all(np.allclose(found[0][k], f[k], atol=1e-7) for f in found for k in f)
