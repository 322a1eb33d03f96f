"""Packing by concatenate and cut: two-pass prefix sums give global offsets, fixed windows cut them.

Pass 1 turns each text into token ids and writes them with the running sum inside its partition. The
partition totals (a row for each partition) are summed up into the partitions' global offsets. Pass 2 cuts
each document at multiples of the sequence length; a document that crosses a boundary gives several pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, batches, hashes_of, save, split_words

#: Words whose ids a Python worker keeps; beyond that the half that was used least is forgotten and encoded again.
CACHED_WORDS = 1_000_000
_coders: dict[str, "WordCoder"] = {}


@dataclass
class Encoded:
    """Ids of a batch of texts in a row: text k has ids[at[k] : at[k + 1]]; sizes: the number of ids of each
    word; words and bounds: as split_words() gives them; hashes: of the distinct words."""

    ids: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    words: pa.DictionaryArray
    bounds: np.ndarray
    hashes: np.ndarray


class WordCoder(WordTable):
    """Ids of texts for a tokenizer that lower-cases, and never joins characters across ASCII white space.

    So a text's ids are its words' ids in a row. Only distinct words that this worker hasn't met are encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.size = self.coder.get_vocab_size(with_added_tokens=True)
        super().__init__("<u2" if self.size <= 1 << 16 else "<u4", CACHED_WORDS)

    def learn(self, new: list[str], hashes: np.ndarray) -> None:
        # a comma or stop after a letter is a piece of its own
        split = np.fromiter((w.endswith((".", ",")) and w[-2:-1].isascii() and w[-2:-1].isalpha() for w in new), bool, len(new))
        marked = [new[k] for k in np.flatnonzero(split).tolist()]
        plain = list({w[:-1] for w in marked}.union(".,").difference(new))
        own = hashes_of(plain)
        unknown = np.flatnonzero(self.find(own) < 0)
        plain = [plain[k] for k in unknown.tolist()] + [new[k] for k in np.flatnonzero(~split).tolist()]
        own = np.concatenate([own[unknown], hashes[~split]])
        for k in range(0, len(plain), 20_000):
            found = [e.ids for e in self.coder.encode_batch_fast(plain[k : k + 20_000], add_special_tokens=False)]
            count = np.fromiter(map(len, found), "i4", len(found))
            self.add(own[k : k + 20_000], np.fromiter(chain.from_iterable(found), self.kind, int(count.sum())), count)
        parts = np.stack([self.find(hashes_of([w[:-1] for w in marked])), self.find(hashes_of([w[-1] for w in marked]))], 1)
        place, count = self.gather(parts.ravel())
        self.add(hashes[split], self.pool[place], count.reshape(-1, 2).sum(1, dtype="i4"))

    def encode(self, texts: pa.Array) -> Encoded:
        # A-Z may be lower-cased first, as the tokenizer does; but not in what may be a special token
        words, bounds = split_words(texts, as_is="<|")
        place, sizes, hashes = self.of(words)
        return Encoded(self.pool[place], np.concatenate([[0], np.cumsum(sizes, dtype="i8")])[bounds], sizes, words, bounds, hashes)


def coder(path: str) -> WordCoder:
    """One for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def forget_words() -> None:
    """Frees what a worker keeps for its coders."""
    _coders.clear()


def blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary rows values[at[k] : at[k + 1]]."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype("i8")), pa.py_buffer(values)]).cast(pa.binary())


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens.

    Returns id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids (array<int>). Every
    document's ids, followed by end_id, lie in exactly one piece each. Only the last sequence can be short. A null or
    empty text is one end_id; repeated rows and equal or null ids are documents of their own; an empty table gives no
    rows; columns other than the two named are not read.
    """
    spark = docs.sparkSession
    batches(spark, 1000)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def tokenise(rows):
        part, run = TaskContext.get().partitionId(), 0
        words = coder(tokenizer)
        for batch in rows:
            found = words.encode(batch.column("_text"))
            at = found.at + np.arange(len(found.at))
            n = np.diff(at)
            ids = blobs(np.insert(found.ids, found.at[1:], end_id), at)
            before = run + at[:-1]
            run += int(at[-1])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), ids, pa.array(n), pa.array(np.full(len(n), part, "i4")), pa.array(before)], ["_id", "ids", "n", "at", "before"])

    tokens = save(source.mapInArrow(tokenise, f"_id {id_type}, ids binary, n long, at int, before long"), "tokens")
    totals = tokens.groupBy("at").agg(F.sum("n").alias("n"))
    #: a row for each partition of the input, so its size is bounded by what the driver keeps of them anyway
    base = totals.select("at", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("base"))

    def cut(rows):
        for batch in rows:
            n, first = batch.column("n").to_numpy(), batch.column("first").to_numpy()
            # a document's pieces begin at its start and at each multiple of length within it
            pieces = (first + n - 1) // length - first // length + 1
            own = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[own] // length + k
            begin, end = np.maximum(sequence * length, first[own]), np.minimum((sequence + 1) * length, (first + n)[own])
            start = begin - first[own]
            parts, now, ids = [], -1, None
            for o, a, z in zip(own.tolist(), start.tolist(), (end - first[own]).tolist()):
                if o != now:
                    raw = batch.column("ids")[o].as_py()
                    now, ids = o, np.frombuffer(raw, f"<u{len(raw) // n[o]}").astype("<u4")
                parts.append(ids[a:z])
            crc = np.fromiter((zlib.crc32(x) for x in parts), "i8", len(parts))
            columns = [batch.column("_id").take(pa.array(own)), *map(pa.array, (start, end - begin, crc, n[own], sequence, begin - sequence * length))]
            names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - begin)]).astype("i4")), pa.array(np.concatenate(parts).astype("i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = tokens.join(F.broadcast(base), "at").select("_id", "ids", "n", (F.col("base") + F.col("before")).alias("first"))
    schema = f"_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return placed.mapInArrow(cut, schema).withColumnRenamed("_id", id_col)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id and ids of whole sequences, padded to length unless they hold a power of two of tokens.

    A sequence has `length` tokens at most, so its group is bounded."""
    joined = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    return joined.withColumn("ids", F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - n))))
