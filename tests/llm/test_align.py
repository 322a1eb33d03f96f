"""Alignment of two tokenizers against encoding each text whole, and counting by loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import public_tokenizers
import pyarrow as pa

from sightline.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"abzé ß.,'  \n\t\r\x0b\x1c\x85\xa0　  ▁𝄞中文éÉ123<s>[]()-_\"!?", "'s", "'re", "hello", " world", "..", "</s>", "<|endoftext|>", "<0x0A>", "\n\n", "é", "St.", "a.", "b,", "²."]


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(A, B)


def whole(al: align.Aligner, text: str | None):
    """(n_a, n_b, groups, pairs) of a text encoded at once, by a walk over the ends of both."""
    if not text:
        return 0, 0, "", []
    raw, letters = (" " + text).encode(), align.byte_letters()
    ids_a, ids_b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text, return_type=int)
    bytes_a = [bytes(letters[c] for c in al.a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if al.b.is_byte(k) else p.replace("▁", " ").encode() for k in ids_b for p in [al.b.id_to_piece(k)]]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return 0, 0, "", []
    groups, pairs, now_a, now_b, i, j, at_a, at_b = [], [], [], [], 0, 0, 0, 0
    while i < len(ids_a) or j < len(ids_b):
        if at_a <= at_b:
            at_a += len(bytes_a[i])
            now_a.append(ids_a[i])
            i += 1
        else:
            at_b += len(bytes_b[j])
            now_b.append(ids_b[j])
            j += 1
        if at_a == at_b:
            groups.append(f"{','.join(map(str, now_a))}|{','.join(map(str, now_b))}")
            pairs.append((now_a[-1], now_b[-1]))
            now_a, now_b = [], []
    return len(ids_a), len(ids_b), ";".join(groups), pairs


def test_chunks_against_whole_texts(aligner):
    r = random.Random(3)
    texts = [None, "", " ", "\n", ".", " .", "  ", "a", "▁", "a" * 5000, "word " * 3000] + ["".join(r.choice(PARTS) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    found = aligner.align(pa.array(texts))
    for k, text in enumerate(texts):
        n_a, n_b, groups, pairs = whole(aligner, text)
        codes = found["codes"][found["bounds"][k] : found["bounds"][k + 1]].tolist()
        assert (found["n_a"][k], found["n_b"][k], found["n_groups"][k]) == (n_a, n_b, len(pairs)), text
        assert found["sha"][k] == (groups and hashlib.sha256(groups.encode()).hexdigest()), text
        assert codes == [a * aligner.size_b + b for a, b in pairs], text


def test_spans_agree_where_they_are_wide_enough(aligner):
    """Coarse cuts give the ends themselves but inside characters spread over tokens."""
    new = [" plain", " wörld", "\nfoo", " 𝄞中x", "."]
    coded = [w.encode() for w in new]
    at = align.np.cumsum([0, *map(len, coded)])
    a, b = aligner.spans(new, align.np.frombuffer(b"".join(coded), "u1"), at)
    assert a.whole.all() and b.whole.all()
    for x in (a, b):
        for k in range(len(new)):
            assert x.ends[x.chunk == k][-1] == at[k + 1]
            assert (align.np.diff(x.ends[x.chunk == k]) > 0).all()


@pytest.mark.parametrize("most", [align.MAX_PAIRS, 0])
def test_query_against_loops(spark, aligner, most):
    r = random.Random(9)
    rows = [(k if k % 7 else None, "".join(r.choice(PARTS) for _ in range(r.randint(1, 30))), k) for k in range(60)] + [(1, None, 0), (1, "", 0), (3, "same again.", 0), (3, "same again.", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long")
    want, counts = [], Counter()
    for i, text, _ in rows:
        want.append((i, *whole(aligner, text)))
        counts.update(want[-1][4])
    best = {b: max(n for (_, y), n in counts.items() if y == b) for _, b in counts}
    want = sorted((str(i), n_a, n_b, len(p), len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), g and hashlib.sha256(g.encode()).hexdigest()) for i, n_a, n_b, g, p in want)
    got = sorted((str(x[0]), *x[1:]) for x in align.align_tokenizers(docs, A, B, max_pairs=most).collect())
    assert got == want


def test_empty_table(spark):
    assert align.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
