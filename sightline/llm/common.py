"""What the operators of this subpackage share: the shared folder, held-out folds, bounded samples."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root

#: The pattern of a word: a run of anything but ASCII white space (bytes.split() cuts alike).
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows of ids or hashes that are broadcast at most.
SMALL_ROWS = 500_000


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/sightline/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table of few bytes a row, to be broadcast if it has no more than `rows` rows; else Spark chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def batches(spark: SparkSession, rows: int = 500) -> None:
    """Keeps Arrow batches small, as texts may be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def crc_of(value) -> int:
    return zlib.crc32(str(value).encode())


def sample_rows(df: DataFrame, key, rows: int) -> DataFrame:
    """The rows with the smallest hashes of key: the same rows at any partitioning."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mixer (multiply, xor, shift) of unsigned longs."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(31))


_SPACED = np.arange(256, dtype="u1")
_SPACED[[9, 10, 11, 12, 13]] = 32
_LOWER = _SPACED.copy()
_LOWER[65:91] += 32


def split_words(texts: pa.Array, lower: bool = True, as_is: str | None = None) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a batch of texts, cut at ASCII white space: all in a row, with their distinct forms numbered by Arrow,
    and bounds: text k has the words from bounds[k] to bounds[k + 1]. Null: empty.

    lower: A-Z are lower-cased, but for texts that hold `as_is`."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, "u1")[at[0] : at[-1]] if data is not None else np.zeros(0, "u1")
    at = at - at[0]
    spaced = (_LOWER if lower else _SPACED)[raw]
    if lower and as_is is not None and (held := pc.match_substring(texts, as_is).to_numpy(zero_copy_only=False)).any():
        own = np.repeat(held, np.diff(at))
        spaced[own] = _SPACED[raw[own]]
    spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(spaced)])
    parts = pc.split_pattern(spaced, " ")
    words, bounds = parts.flatten().dictionary_encode(), parts.offsets.to_numpy().astype("i8")
    # what is between two blanks, or a blank and an end, is no word
    code = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    if code >= 0:
        found = words.indices.to_numpy()
        kept = found != code
        found = found[kept]
        words = pa.DictionaryArray.from_arrays(pa.array(found - (found > code)), pa.concat_arrays([words.dictionary.slice(0, code), words.dictionary.slice(code + 1)]))
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    return words, bounds


def hashes_of(words: list[str]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))


class WordTable:
    """What a Python worker knows of words: for each a row of numbers, laid one after the other in a pool.

    Words are known by 64-bit hashes, kept in order, at some 40 bytes a word; a new word among a million is taken for
    another with a chance of 5e-14. A subclass says in learn() what a new word's numbers are. Of more than `most` words
    the half used least is forgotten."""

    def __init__(self, kind: np.dtype, most: int):
        self.kind, self.most = np.dtype(kind), most
        self.forget()

    def forget(self) -> None:
        self.size_known, self.keys, self.rows = 0, np.zeros(0, "u8"), np.zeros(0, "i4")
        self.pool, self.filled = np.zeros(1 << 16, self.kind), 0
        self.start, self.count, self.uses = np.zeros(1 << 16, "i8"), np.zeros(1 << 16, "i4"), np.zeros(1 << 16, "i8")

    def learn(self, new: list[str], hashes: np.ndarray) -> None:
        raise NotImplementedError

    def add(self, hashes: np.ndarray, numbers: np.ndarray, count: np.ndarray) -> None:
        """Hashes of new words with their numbers, one after the other, and how many of them are each word's."""
        n, m = self.size_known, len(hashes)
        while n + m > len(self.start):
            self.start, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.uses))
        while self.filled + len(numbers) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(numbers)] = numbers
        self.start[n : n + m] = self.filled + np.cumsum(count) - count
        self.count[n : n + m] = count
        self.filled += len(numbers)
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.keys, hashes[order])
        self.keys, self.rows = np.insert(self.keys, at, hashes[order]), np.insert(self.rows, at, n + order)
        self.size_known = n + m

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in the pool of words' numbers in a row, and how many are each word's."""
        count = self.count[rows]
        ends = np.cumsum(count, dtype="i8")
        place = np.repeat(self.start[rows] - ends + count, count)
        place += np.arange(len(place))
        return place, count

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word, -1 if it isn't known."""
        out = np.full(len(hashes), -1, "i8")
        if len(self.keys):
            order = np.argsort(hashes)  # neighbours are found near each other
            sought = hashes[order]
            near = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
            same = self.keys[near] == sought
            out[order[same]] = self.rows[near[same]]
        return out

    def trim(self) -> None:
        n = self.size_known
        kept = np.sort(np.argsort(-self.uses[:n], kind="stable")[: self.most // 2])
        place, count = self.gather(kept)
        keys = np.empty(n, "u8")
        keys[self.rows] = self.keys
        keys, uses, numbers = keys[kept], self.uses[kept], self.pool[place]
        self.forget()
        self.add(keys, numbers, count)
        self.uses[: len(keys)] = uses // 2

    def of(self, words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """gather() of all words of a batch, in order, and the hashes of the distinct ones; only these are looked up."""
        if self.size_known > self.most:
            self.trim()
        distinct, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        hashes = hashes_of(distinct)
        rows = self.find(hashes)
        if len(unknown := np.flatnonzero(rows < 0)):
            self.learn([distinct[k] for k in unknown.tolist()], hashes[unknown])
            rows[unknown] = self.find(hashes[unknown])
        self.uses[rows] += np.bincount(at, minlength=len(rows))
        return *self.gather(rows[at]), hashes
