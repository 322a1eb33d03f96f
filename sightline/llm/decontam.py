"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so a question asked again with other values keeps its
template. Windows of template tokens are hash-joined with those of the benchmark; where enough of an item's windows
are found, the slots must map consistently: one value of the item to one value of the document and back.

A text's windows are made in its task. Only those whose hash falls in a bucket that some window of the benchmark has
(a bitmap of fixed size) leave it, with the values of their slots, for the join.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, batches, counted, save, split_words

#: Template tokens of a window; an item with fewer is one window of its own length.
WINDOW = 8
#: Least share of an item's template tokens within windows found, and least literal tokens among them unless the item is
#: there word for word; an item of fewer words is only found where it is the whole text.
COVERAGE, LITERALS, WORDS = 0.6, 3, 3
#: Least share of slots that must agree with a one-to-one mapping of values.
CONSISTENT = 0.8
#: Bits of a window's hash that number its bucket.
BUCKET_BITS = 22
#: Words that a Python worker keeps.
CACHED_WORDS = 100_000

NUMBER = re.compile(r"^[+-]?[$€£]?\d+(?:[.,:/]\d+)*%?$")
MEASURE = re.compile(r"^([+-]?[$€£]?\d+(?:[.,]\d+)*)([A-Za-z°µ]{1,5})$")
TRIM = re.compile(r"^[^\w$€£+-]+|[^\w%°]+$")
#: Units of measure.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years metre metres meter meters kilometre kilometres kilometer kilometers gram grams kilogram kilograms litre litres liter liters mile miles foot feet inch inches pound pounds dollar dollars cent cents euro euros degree degrees percent mph kmh kwh w kw v".split())
NUMERALS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
N, NAME, UNIT = "<number>", "<name>", "<unit>"


def pieces(word: str) -> tuple[tuple[str, str], ...]:
    """Template tokens (token, value) of a word; a literal's value is ''. A capital letter makes a name, at the start of a
    sentence too, as names stand there as well."""
    core = word if word.isalpha() else TRIM.sub("", word)
    if not core:
        return ()
    low = core.lower()
    number = not core.isalpha() and (core[0].isdigit() or core[0] in "+-$€£")
    if number and NUMBER.match(core) or low in NUMERALS:
        return ((N, low),)
    if number and (m := MEASURE.match(core)) and m[2].lower() in UNITS:
        return ((N, m[1]), (UNIT, m[2].lower()))
    if low in UNITS and len(low) > 2:
        return ((UNIT, low),)
    return ((NAME, low),) if core[0].isupper() and len(core) > 1 else ((low, ""),)


def code(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


class Templates(WordTable):
    """Template tokens of texts, as hashes; values of slots by their place in the pool. Of names or numbers in a row one
    token is made, with all their values."""

    RUNS = np.array([code(N), code(NAME)], "u8")

    def __init__(self):
        super().__init__("u8", CACHED_WORDS)

    def forget(self) -> None:
        super().forget()
        self.values: dict[int, str] = {}

    def trim(self) -> None:
        self.forget()

    def learn(self, new: list[str], hashes: np.ndarray) -> None:
        found = [pieces(w) for w in new]
        flat = [x for tokens in found for x in tokens]
        self.values.update((self.filled + k, v) for k, (_, v) in enumerate(flat) if v)
        self.add(hashes, np.fromiter((code(t) for t, _ in flat), "u8", len(flat)), np.fromiter(map(len, found), "i4", len(found)))

    def lay(self, texts: pa.Array) -> "Laid":
        words, bounds = split_words(texts, lower=False)
        place, sizes, _ = self.of(words)
        at = np.concatenate([[0], np.cumsum(sizes, dtype="i8")])[bounds]
        codes = self.pool[place]
        first = np.ones(len(codes), bool)
        first[1:] = (codes[1:] != codes[:-1]) | ~np.isin(codes[1:], self.RUNS)
        first[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.append(np.flatnonzero(first), len(codes))
        return Laid(codes[starts[:-1]], np.searchsorted(starts, at), place, starts, self.values)


class Laid:
    """Codes of a batch of texts in a row; text k has codes[at[k] : at[k + 1]]."""

    def __init__(self, codes, at, place, starts, values):
        self.codes, self.at, self.place, self.starts, self._values = codes, at, place, starts, values

    def value(self, k: int) -> str:
        """A token's value, '' for a literal."""
        return " ".join([v for p in self.place[self.starts[k] : self.starts[k + 1]].tolist() if (v := self._values.get(p))])


def rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` codes."""
    n = len(codes) - size + 1
    if n < 1 or size < 1:
        return np.zeros(0, "u8")
    h = np.full(n, size, "u8")
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def agreement(pairs: list[tuple[str, str]]) -> float:
    """Share of the pairs (item value, text value) that agree with a one-to-one mapping of values."""
    there, back = defaultdict(Counter), defaultdict(Counter)
    for a, b in pairs:
        there[a][b] += 1
        back[b][a] += 1
    agree = sum(1 for a, b in pairs if there[a].most_common(1)[0][0] == b and back[b].most_common(1)[0][0] == a)
    return agree / len(pairs) if pairs else 1.0


def met_offsets(ps: dict[int, np.ndarray], ds: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (text position less item position) at which windows of both sides meet, in order, and how many meet at each.

    ps and ds: by hash the windows' positions in the item and in the text. Pairs of windows are counted, not kept."""
    low = -max(int(p.max()) for p in ps.values())
    counts = np.zeros(max(int(d.max()) for d in ds.values()) - low + 1, "i8")
    for h, d in ds.items():
        few, many, sign = (ps[h], d, 1) if len(ps[h]) <= len(d) else (d, ps[h], -1)
        for x in few.tolist():
            counts[sign * (many - x) - low] += 1
    at = np.flatnonzero(counts)
    return at + low, counts[at]


class Cells:
    """Text positions that each item position can lie on, by the windows that hold both. Item positions in the same windows
    (a template that repeats within itself) share theirs."""

    def __init__(self, ps: dict[int, np.ndarray], ds: dict[int, np.ndarray], size: int, length: int):
        windows: list[int | None] = [None] * length
        for h, at in ps.items():
            for p in at.tolist():
                windows[p] = h
        alike: dict[tuple, list[int]] = defaultdict(list)
        for p in range(length):
            held = tuple((k, windows[p - k]) for k in range(min(size, p + 1)) if windows[p - k] is not None)
            if held:
                alike[held].append(p)
        self.classes = [(np.array(at), np.unique(np.concatenate([ds[h] + k for k, h in held]))) for held, at in alike.items()]

    def lay(self, o: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Item positions in order, and for each the text position whose offset is nearest to o, among offsets from low to high."""
        at, to = [], []
        for p, d in self.classes:
            k = np.searchsorted(d, p + o)
            right, left = d[np.minimum(k, len(d) - 1)] - p, d[np.maximum(k - 1, 0)] - p
            after, before = (k < len(d)) & (right <= high), (k > 0) & (left >= low)
            chosen = np.where(before & (~after | (o - left <= right - o)), left, right)
            known = after | before
            at.append(p[known])
            to.append((p + chosen)[known])
        at, to = np.concatenate(at), np.concatenate(to)
        order = np.argsort(at)
        return at[order], to[order]


def judged(ps: dict[int, np.ndarray], ds: dict[int, np.ndarray], slots: list[str], values: dict[int, str], words: int, length: int) -> tuple | None:
    """(coverage, windows, slots, changed slots, consistency) of the best way that an item with `slots` lies on a text of
    `length` tokens, or None. ps and ds: see met_offsets(), of the same hashes; values: the text's slots by position.

    Offsets hang together within half the item's length. Each is judged by itself, and with the positions that it lacks taken
    from the nearest of its run, as words may be put in or left out between windows. Those at which most windows meet come
    first; a run ends once nothing in it can be better, so a template that repeats within itself is laid once or twice."""
    size, best = min(WINDOW, len(slots)), None
    if len(slots) != length and words < WORDS:
        return None
    offsets, counts = met_offsets(ps, ds)
    cells = Cells(ps, ds, size, len(slots))
    starts = np.flatnonzero(np.diff(offsets, prepend=offsets[0] - len(slots) - 3) > max(2, len(slots) // 2))
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(offsets)]):
        for k in (a + np.lexsort((offsets[a:z], -counts[a:z]))).tolist():
            o = int(offsets[k])
            at, to = cells.lay(o, int(offsets[a]), int(offsets[z - 1]))
            bound = (len(at) / len(slots), 1.0, 0)
            if best and best[0] >= bound:
                break
            own = to - at == o
            used = np.searchsorted(offsets, np.unique(to - at))
            for windows, p, d in ((counts[k], at[own], to[own]), (counts[used].sum(), at, to)):
                pairs = [(slots[x], values[y]) for x, y in zip(p.tolist(), d.tolist()) if slots[x]]
                share, consistent = len(p) / len(slots), agreement(pairs)
                changed = sum(1 for x, y in pairs if x != y)
                if share < COVERAGE or consistent < CONSISTENT:
                    continue
                if len(p) - len(pairs) < min(LITERALS, len(slots)) and not (share == 1.0 and changed == 0):
                    continue
                rank = (share, consistent, -changed)
                if best is None or rank > best[0]:
                    best = rank, (share, int(windows), len(pairs), changed, consistent)
    return best and best[1]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A written table: item (a number of the row and form), item_id, slots, words, size, p, hash: a row for each window.

    An item has two forms, as it is and in lower case, where there are no names. Rows of null id or text are left out."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(it):
        forms = Templates()
        for batch in it:
            texts = batch.column("_text").to_pylist()
            for form, given in enumerate((texts, [t.lower() for t in texts])):
                laid = forms.lay(pa.array(given, pa.string()))
                out: list[list] = [[] for _ in range(7)]
                for k, row in enumerate(batch.column("_row").to_pylist()):
                    a, z = int(laid.at[k]), int(laid.at[k + 1])
                    if a == z or form and given[k] == texts[k]:
                        continue
                    size = min(WINDOW, z - a)
                    slots, words = [laid.value(x) for x in range(a, z)], len(given[k].split())
                    for p, h in enumerate(rolled(laid.codes[a:z], size).view("i8").tolist()):
                        for column, x in zip(out, (2 * row + form, k, slots, words, size, p, h)):
                            column.append(x)
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(x, t) for x, t in zip(out, kinds)]
                columns[1] = batch.column("_id").take(columns[1])
                yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "slots", "words", "size", "p", "hash"])

    return save(rows.mapInArrow(run, f"item long, item_id {kind}, slots array<string>, words long, size long, p long, hash long"), "benchmark")


def matches(source: DataFrame, windows: DataFrame) -> DataFrame:
    """source (_row, _id, _text) against the benchmark's windows: _row, _id, item_id, coverage, windows, slots, changed_slots, consistency."""
    spark = source.sparkSession
    kind, item_kind = source.schema["_id"].dataType.simpleString(), windows.schema["item_id"].dataType.simpleString()
    # items of few words are looked for in texts of their own length only; a bitmap for each size of window, of either kind
    lone = (F.col("words") < WORDS).alias("lone")
    bucket = F.shiftrightunsigned("hash", 64 - BUCKET_BITS)
    maps = windows.select("size", lone, (bucket + 1).alias("b")).groupBy("size", "lone", F.bitmap_bucket_number("b").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    # at most 2 ** BUCKET_BITS bits for each size and kind, and at most 2 * WINDOW of these
    sieves = {}
    for r in maps.toLocalIterator():
        sieve = sieves.setdefault((r["size"], r["lone"]), np.zeros((1 << BUCKET_BITS) // 8, "u1"))
        bits = np.frombuffer(r["bits"], "u1")
        sieve[(r["part"] - 1) * len(bits) : r["part"] * len(bits)] = bits[: len(sieve)]
    sent = spark.sparkContext.broadcast(sieves)

    def run(it):
        forms = Templates()
        for batch in it:
            laid = forms.lay(batch.column("_text"))
            n = np.diff(laid.at)
            out: list[list] = [[] for _ in range(6)]
            for (size, lone), sieve in sent.value.items():
                h = rolled(laid.codes, size)
                b = h >> np.uint64(64 - BUCKET_BITS)
                hit = np.flatnonzero((sieve[b >> np.uint64(3)] >> (b & np.uint64(7)).astype("u1")) & 1)
                own = np.searchsorted(laid.at, hit, "right") - 1
                within = (hit + size == laid.at[own + 1]) & (hit == laid.at[own]) if lone else hit + size <= laid.at[own + 1]
                for x, k in zip(hit[within].tolist(), own[within].tolist()):
                    for column, v in zip(out, (k, size, int(h[x].view("i8")), x - int(laid.at[k]), int(n[k]), [laid.value(y) for y in range(x, x + size)])):
                        column.append(v)
            at = pa.array(out[0], pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(at), batch.column("_id").take(at), *(pa.array(x, t) for x, t in zip(out[1:], kinds))], ["_row", "_id", "size", "hash", "d", "length", "values"])

    found = source.mapInArrow(run, f"_row long, _id {kind}, size long, hash long, d long, length long, values array<string>")
    # a row for each window of the text, however often the item has it; a window that is looked for in two ways comes twice
    met = found.join(windows.select("item", "size", "hash").distinct(), ["hash", "size"])
    # one document and one item
    each = met.groupBy("_row", "item").agg(F.first("_id").alias("_id"), F.first("length").alias("length"), F.collect_list(F.struct("hash", "d", "values")).alias("found"))
    items = windows.groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("slots").alias("own"), F.first("words").alias("words"), F.collect_list(F.struct("hash", "p")).alias("windows"))
    whole = f"_row long, _id {kind}, item_id {item_kind}, coverage double, windows long, slots long, changed_slots long, consistency double"

    def by_hash(rows: list[dict], at: str) -> dict[int, np.ndarray]:
        out: dict[int, set] = defaultdict(set)
        for x in rows:
            out[x["hash"]].add(x[at])
        return {h: np.array(sorted(v)) for h, v in out.items()}

    def judge(it):
        for batch in it:
            at, rows = [], []
            for k, (hits, held, own, words, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("found", "windows", "own", "words", "length")))):
                values = {x["d"] + j: v for x in hits for j, v in enumerate(x["values"])}
                ds = by_hash(hits, "d")
                row = judged({h: p for h, p in by_hash(held, "p").items() if h in ds}, ds, own, values, words, length)
                if row:
                    at.append(k)
                    rows.append(row)
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in ("_row", "_id", "item_id")), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["_row", "_id", "item_id", "coverage", "windows", "slots", "changed_slots", "consistency"])

    return each.join(items, "item").mapInArrow(judge, whole)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document row and benchmark item whose template it holds: id_col, item_id, coverage, windows, slots, changed_slots, consistency.

    changed_slots above 0: the item asked again with other values. An item that is there word for word counts whatever it
    is made of. Null or empty texts hold nothing; null and equal ids give rows of their own; an empty benchmark or table
    gives no rows; items of equal ids give one row, the best; item ids of any type; columns other than those named are
    not read. Very long texts are taken whole.
    """
    batches(docs.sparkSession, 1000)
    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = matches(source, benchmark_windows(benchmark))
    columns = ["coverage", "consistency", "changed_slots", "windows", "slots"]
    best = F.max(F.struct("coverage", "consistency", (-F.col("changed_slots")).alias("changed_slots"), "windows", "slots")).alias("best")
    out = found.groupBy("_row", "item_id").agg(F.first("_id").alias(id_col), best)
    chosen = {c: F.col(f"best.{c}") for c in columns} | {"changed_slots": -F.col("best.changed_slots")}
    return out.select(id_col, "item_id", *(chosen[c].alias(c) for c in ("coverage", "windows", "slots", "changed_slots", "consistency")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item; same columns. What a text holds depends on nothing else, so equal texts go
    together, and null and equal ids are safe."""
    batches(docs.sparkSession, 1000)
    key = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    source = docs.select(F.monotonically_increasing_id().alias("_row"), key.alias("_id"), F.col(text_col).cast("string").alias("_text"))
    gone = save(matches(source, benchmark_windows(benchmark)).select(F.col("_id").alias("_sha")).distinct(), "leaks")
    own = [f"_c{k}" for k in range(len(docs.columns))]
    kept = docs.toDF(*own).withColumn("_sha", F.sha2(F.coalesce(F.col(own[docs.columns.index(text_col)]).cast("string"), F.lit("")), 256))
    return kept.join(counted(gone), "_sha", "left_anti").select(*(F.col(o).alias(c) for o, c in zip(own, docs.columns)))
