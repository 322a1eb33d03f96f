"""The prefix trie against loops over all prefixes, and its parentheses against a stack."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sightline.llm import trie
from sightline.llm.common import NOT_SPACE

SCHEMA = "conv_id long, turn long, role string, text string, words string"


def by_loop(rows: list[tuple]) -> list[tuple]:
    turns: dict[int, list] = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, digest, role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = int(np.fix(c / 20)) * 20
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members: dict[tuple, list] = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in members}
    out = []
    for p, own_members in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(NOT_SPACE, q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(own_members) if built[c] == p)
        up = min(members[p[:-1]]) if p else None
        out.append((min(own_members), len(p), up, len(own_members), children[p], sum(children[q] == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows: list[tuple], most: int) -> list[tuple]:
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted((tuple(x) for x in trie.prefix_trie(table, most).collect()), key=str)


@pytest.mark.parametrize("most", [12, 60, trie.SHARD])
def test_against_loop(spark, most):
    r = random.Random(most)
    rows = []
    for c in r.sample(range(-45, 400), 160):
        kind = r.random()
        if kind < 0.3:  # one very common conversation
            texts = ["very common", "one two  three", "four"]
        else:
            texts = [r.choice(["a", "b c", "", None, "d\te f", "é è"]) for _ in range(r.choice([1, 1, 2, 3, 5, 9]))]
        rows += [(c, r.choice([k, k, None]) if kind > 0.9 else k, r.choice(["user", "assistant", None]) if kind > 0.5 else "user", x) for k, x in enumerate(texts)]
    rows += [(7, None, "user", "again")] * 2 + [(None, 0, "user", "no id")] + [(401, k, "user", f"long {k}") for k in range(80)]
    assert found(spark, rows, most) == by_loop(rows)


def test_shorter_conversations_end_on_spines(spark):
    """Paths that begin one another, in shards of four: ends and leaves of nodes that many shards share."""
    rows = [(c, k, "user", "same") for c in range(20 * 60, 20 * 60 + 60) for k in range(1 + c % 5)]
    assert found(spark, rows, 4) == by_loop(rows)


def test_empty_table_and_only_turnless(spark):
    assert found(spark, [], 10) == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    assert found(spark, [(c, 0, None, None)], 10) == by_loop([(c, 0, None, None)])


def test_find_close():
    r = random.Random(1)
    for n, block in ((1, 4), (5, 4), (300, 4), (3000, 16), (3000, 256)):
        signs, depth, left = [], 0, n
        while left or depth:
            up = left and (not depth or r.random() < r.choice([0.4, 0.6]))
            signs.append(1 if up else -1)
            depth += signs[-1]
            left -= bool(up)
        stack, want = [], {}
        for k, x in enumerate(signs):
            if x > 0:
                stack.append(k)
            else:
                want[stack.pop()] = k
        opens = np.flatnonzero(np.array(signs) > 0)
        assert trie.find_close(np.array(signs, "i1"), opens, block).tolist() == [want[k] for k in opens.tolist()]
