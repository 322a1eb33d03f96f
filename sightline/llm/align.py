"""Alignment of two tokenizers' tokens: where both end together, a text's tokens fall into groups.

A text is cut where neither tokenizer joins what is left and right of the cut (a single blank or line feed between
characters that aren't white, a comma or stop that ends a word), so that a worker encodes distinct chunks only. In a
chunk, the character offsets of the byte-level tokenizer and the spans of the piece tokenizer are coarse cuts. A span
is wrong inside a character that is spread over several tokens: there the bytes that tokens decode to refine it.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, save

#: Chunks that a Python worker keeps, in two generations of half as many; longer ones than KEPT_CHARS aren't kept.
KEPT, KEPT_CHARS = 600_000, 64
#: Distinct pairs of ids whose counts are broadcast at most (13 bytes each); beyond that they are joined by Spark.
MAX_PAIRS = 4_000_000
_aligners: dict[tuple[str, str], "Aligner"] = {}


def byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, others are moved up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(moved)}


@dataclass
class Vocabulary:
    """Bytes of all ids in a row: id k has pool[at[k] : at[k + 1]]."""

    pool: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> "Vocabulary":
        return cls(np.frombuffer(b"".join(entries), "u1"), np.cumsum([0, *map(len, entries)]))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.at[ids + 1] - self.at[ids]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes(ids)
        return self.pool[np.repeat(self.at[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]


@dataclass
class Tokens:
    """Tokens of several chunks in a row: ids, the chunk of each, and where each ends in the bytes of all chunks;
    whole: whether the chunk's tokens decode to its bytes."""

    ids: np.ndarray
    chunk: np.ndarray
    ends: np.ndarray
    whole: np.ndarray

    def only(self, chunks: np.ndarray) -> "Tokens":
        kept = chunks[self.chunk]
        return Tokens(self.ids[kept], self.chunk[kept], self.ends[kept], self.whole)


def refined(ids: np.ndarray, chunk: np.ndarray, coarse: np.ndarray, words: Vocabulary, raw: np.ndarray, at: np.ndarray) -> Tokens:
    """coarse: where each token ends in raw by its tokenizer's span; kept where the span is as wide as the token's bytes."""
    size, first = words.sizes(ids), np.searchsorted(chunk, np.arange(len(at)))
    total = np.concatenate([[0], np.cumsum(size)])
    decoded = total[1:] - total[first[chunk]] + at[chunk]
    begin = np.concatenate([[0], coarse[:-1]]) if len(coarse) else coarse
    begin[first[:-1][first[:-1] < len(ids)]] = at[:-1][first[:-1] < len(ids)]
    ends = np.where(coarse - begin == size, coarse, decoded)
    whole = (total[first[1:]] - total[first[:-1]] == np.diff(at)) & (first[1:] > first[:-1])
    same = np.ones(len(ids), bool) & whole[chunk]
    kept = ids[same]
    n = words.sizes(kept)
    differ = words.decode(kept) != raw[np.repeat((decoded - size)[same] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    whole[np.repeat(chunk[same], n)[differ]] = False
    # a span that is wide enough may still lie aside, where those before it were wrong
    return Tokens(ids, chunk, np.where(ends == decoded, ends, decoded), whole)


class Aligner:
    """What a Python worker knows of chunks: (number of A tokens, of B tokens, codes of the linked id pairs, groups), or None
    for a chunk whose tokens don't decode to it."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        n = self.a.get_vocab_size(with_added_tokens=True)
        special = {k: t.content.encode() for k, t in self.a.get_added_tokens_decoder().items()}
        self.words_a = Vocabulary.of([special[k] if k in special else bytes(letters[c] for c in self.a.id_to_token(k)) for k in range(n)])
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(self.size_b)]
        self.words_b = Vocabulary.of([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        self.before = [self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")]
        # where no piece joins what a cut would part
        self.blanks = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.stops = not any(q in ".," and o.isascii() and o.isalpha() for p in pieces for o, q in zip(p, p[1:]))
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The chunks of texts (none null or empty), each with a blank before it: text k has those from bounds[k] to bounds[k + 1]."""
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        at = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], "u1")[at[0] : at[-1]]
        at = at - at[0]
        mark = np.zeros(len(raw), bool)
        mark[at[:-1]] = mark[self.cuts(raw, at)] = True
        starts = np.flatnonzero(mark)
        chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, at[-1]).astype("i8")), pa.py_buffer(raw)])
        return chunks.dictionary_encode(), np.append(np.searchsorted(starts, at[:-1]), len(starts))

    def cuts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not self.blanks:
            return at[:-1]
        white = WHITE[raw]
        for k in np.flatnonzero(WHITE_FIRST[raw]).tolist():
            for mark in WHITE_MARKS:
                if raw[k : k + len(mark)].tobytes() == mark:
                    white[k : k + len(mark)] = True
        inner = np.ones(len(raw), bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        spot = np.flatnonzero(inner & ((raw == 32) | (raw == 10)))
        spot = spot[~white[spot - 1] & ~white[spot + 1]]
        if not self.stops:
            return spot
        closed = np.zeros(len(raw) + 1, bool)
        closed[spot] = closed[at[1:]] = True
        stop = np.flatnonzero(((raw == 44) | (raw == 46)) & closed[1:])
        stop = stop[np.isin(stop, at[:-1], invert=True)]
        return np.concatenate([spot, stop[LETTER[raw[stop - 1]]]])

    def spans(self, new: list[str], raw: np.ndarray, at: np.ndarray) -> tuple[Tokens, Tokens]:
        found = self.a.encode_batch(new, add_special_tokens=False)
        ids = [e.ids for e in found]
        count = np.fromiter(map(len, ids), "i8", len(ids))
        chunk = np.repeat(np.arange(len(new)), count)
        ends = np.fromiter((z for e in found for _, z in e.offsets), "i8", int(count.sum()))
        # character offsets of a chunk to bytes of all chunks
        chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        a = refined(np.fromiter(chain.from_iterable(ids), "i8", len(ends)), chunk, chars[np.searchsorted(chars, at[:-1])[chunk] + ends], self.words_a, raw, at)
        # the piece tokenizer puts a blank before its input; a chunk without one comes after a line feed, which joins nothing
        blank = np.fromiter((w[0] == " " for w in new), bool, len(new))
        found = self.b.encode([w[1:] if x else "\n" + w for w, x in zip(new, blank.tolist())], return_type="offset_mapping", return_bytes=True, num_threads=1)
        drop = np.where(blank, 0, 2)
        if any(f["ids"][:2] != self.before for f, x in zip(found, blank.tolist()) if not x):
            raise ValueError("the piece tokenizer joins the blank it adds to a line feed")
        ids = [f["ids"][d:] for f, d in zip(found, drop.tolist())]
        count = np.fromiter(map(len, ids), "i8", len(ids))
        chunk = np.repeat(np.arange(len(new)), count)
        ends = np.fromiter((z for f, d in zip(found, drop.tolist()) for _, z in f["offsets"][d:]), "i8", int(count.sum()))
        b = refined(np.fromiter(chain.from_iterable(ids), "i8", len(ends)), chunk, (at[:-1] + np.where(blank, 1, -1))[chunk] + ends, self.words_b, raw, at)
        return a, b

    def learn(self, new: list[str]) -> dict[str, tuple | None]:
        coded = [w.encode() for w in new]
        at = np.cumsum([0, *map(len, coded)])
        a, b = self.spans(new, np.frombuffer(b"".join(coded), "u1"), at)
        whole = a.whole & b.whole
        a, b = a.only(whole), b.only(whole)
        near = np.searchsorted(b.ends, a.ends)
        last_a = np.flatnonzero(np.append(b.ends, -1)[near] == a.ends)
        last_b, both = near[last_a], a.ends[last_a]
        codes = (a.ids[last_a] * self.size_b + b.ids[last_b]).astype("<u4" if len(self.words_a.at) * self.size_b < 1 << 32 else "<u8")
        step, codes = codes.itemsize, codes.tobytes()
        text_a, text_b = list(map(str, a.ids.tolist())), list(map(str, b.ids.tolist()))
        groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip([0, *(last_a[:-1] + 1).tolist()], (last_a + 1).tolist(), [0, *(last_b[:-1] + 1).tolist()], (last_b + 1).tolist())]
        bounds = np.searchsorted(both, at, side="right").tolist()
        n_a, n_b = np.bincount(a.chunk, minlength=len(new)).tolist(), np.bincount(b.chunk, minlength=len(new)).tolist()
        return {w: (n_a[k], n_b[k], codes[bounds[k] * step : bounds[k + 1] * step], ";".join(groups[bounds[k] : bounds[k + 1]]).encode()) if ok else None for k, (w, ok) in enumerate(zip(new, whole.tolist()))}

    def known(self, chunks: list[str]) -> list[tuple | None]:
        missing, out = object(), []
        for w in chunks:
            x = self.young.get(w, missing)
            if x is missing and (x := self.old.get(w, missing)) is not missing:
                self.young[w] = x
            out.append(x)
        unknown = [k for k, x in enumerate(out) if x is missing]
        for k in range(0, len(unknown), 20_000):
            part = unknown[k : k + 20_000]
            found = self.learn([chunks[i] for i in part])
            for i in part:
                out[i] = found[chunks[i]]
                if len(chunks[i]) <= KEPT_CHARS:
                    self.young[chunks[i]] = out[i]
        if len(self.young) > KEPT // 2:
            self.young, self.old = {}, self.young
        return out

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """For each text (null: none) n_a, n_b, n_groups, groups_sha256, and its links' codes, in a row, with their bounds."""
        n = len(texts)
        out = {k: np.zeros(n, "i8") for k in ("n_a", "n_b", "n_groups")} | {"sha": [""] * n, "codes": np.zeros(0, "i8"), "bounds": np.zeros(n + 1, "i8")}
        held = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
        if not len(held):
            return out
        words, bounds = self.cut(texts.take(pa.array(held)))
        entries = self.known(words.dictionary.to_pylist())
        which = words.indices.to_numpy().astype("i8")
        bad = np.fromiter((e is None for e in entries), bool, len(entries))
        good = np.diff(np.concatenate([[0], np.cumsum(bad[which])])[bounds]) == 0
        entries = [e or (0, 0, b"", b"") for e in entries]
        kind = "<u4" if len(self.words_a.at) * self.size_b < 1 << 32 else "<u8"
        links = np.fromiter((len(e[2]) for e in entries), "i8", len(entries)) // np.dtype(kind).itemsize
        for name, numbers in (("n_a", np.fromiter((e[0] for e in entries), "i8", len(entries))), ("n_b", np.fromiter((e[1] for e in entries), "i8", len(entries))), ("n_groups", links)):
            out[name][held] = np.diff(np.concatenate([[0], np.cumsum(numbers[which])])[bounds]) * good
        groups, order, at = [e[3] for e in entries], which.tolist(), bounds.tolist()
        for k, (i, ok) in enumerate(zip(held.tolist(), good.tolist())):
            if ok:
                out["sha"][i] = hashlib.sha256(b";".join([groups[j] for j in order[at[k] : at[k + 1]]])).hexdigest()
        own = which[np.repeat(good, np.diff(bounds))]
        pool, start = np.frombuffer(b"".join([e[2] for e in entries]), kind), np.cumsum(links) - links
        count = links[own]
        out["codes"] = pool[np.repeat(start[own] - np.cumsum(count) + count, count) + np.arange(count.sum())].astype("i8")
        out["bounds"] = np.concatenate([[0], np.cumsum(out["n_groups"])])
        return out


#: White space as either tokenizer's rules may see it: ASCII bytes, and the UTF-8 of the other characters of Unicode's property.
WHITE, WHITE_FIRST, LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
WHITE[[*range(9, 14), *range(28, 33)]] = True
WHITE_MARKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
WHITE_FIRST[[m[0] for m in WHITE_MARKS]] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def vocabulary_of(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def groups_of(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's tokens aligned: row (a number of its own), id_col, n_a, n_b, n_groups, groups_sha256 and codes, the id pairs
    (A id x size of B + B id) of the tokens that end together, in order."""
    batches(docs.sparkSession, 500)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(rows):
        known, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in rows:
            x, n = known.align(batch.column("_text")), batch.num_rows
            codes = pa.ListArray.from_arrays(pa.array(x["bounds"].astype("i4")), pa.array(x["codes"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column("_id"), *(pa.array(x[k]) for k in ("n_a", "n_b", "n_groups")), pa.array(x["sha"], pa.string()), codes], ["row", "_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes"])
            row += n

    return source.mapInArrow(run, f"row long, _id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, codes array<long>").withColumnRenamed("_id", id_col)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """code, n (links of the pair in all texts), best (whether no pair of the same B id has more)."""
    pairs = aligned.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    pairs = save(pairs, "pairs")
    most = pairs.groupBy((F.col("code") % size_b).alias("b")).agg(F.max("n").alias("most"))
    return save(pairs.withColumn("b", F.col("code") % size_b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def by_broadcast(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    found = pairs.orderBy("code").toArrow()
    table = aligned.sparkSession.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("code", "n", "best")))
    kept = [f for f in aligned.schema if f.name != "codes"]
    names = [f.name for f in kept] + ["n_best", "count_sum"]

    def run(rows):
        code, n, best = table.value
        for batch in rows:
            codes = batch.column("codes")
            at = codes.offsets.to_numpy()
            spot = np.searchsorted(code, codes.values.to_numpy()[at[0] : at[-1]])
            sums = [pa.array(np.diff(np.append(0, np.cumsum(x[spot], dtype="i8"))[at - at[0]])) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *sums], names)

    return aligned.mapInArrow(run, T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))


def by_join(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    links = aligned.select("row", F.explode("codes").alias("code")).groupBy("row", "code").agg(F.count(F.lit(1)).alias("times"))
    sums = links.join(pairs, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return aligned.drop("codes").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """How the tokens of two tokenizers fall together in each text: A of byte-level BPE (read with a blank before the text), B of
    sentencepiece with byte fallback, which puts that blank there itself.

    Returns id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256. A null or empty text, and one whose
    tokens of A or B don't decode to it, has no tokens: zeros and an empty string. Repeated rows, and equal or null ids, are
    texts of their own and each counts; an empty table gives no rows; columns other than the two named are not read. Every
    common end links exactly one token of A with one of B, as no token is empty: n_links equals n_groups.

    The tokens are written once with their links. Counts of up to max_pairs distinct id pairs are broadcast; beyond that
    texts' pairs are joined with them. Both ways give the same result.
    """
    aligned = save(groups_of(docs, path_a, path_b, id_col, text_col), "aligned")
    pairs = pair_counts(aligned, vocabulary_of(path_b))
    few = pairs.limit(max_pairs + 1).count() <= max_pairs
    out = by_broadcast(aligned, pairs) if few else by_join(aligned, pairs)
    return out.select(id_col, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
