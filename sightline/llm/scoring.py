"""Language-model scores of whole texts: a causal self-attention model on subword ids, beside a unigram base of words.

All training texts are counted: words, subwords, pairs of subwords. The attention is fitted to every window of every training
text once, whatever the table's size: pieces of texts are dealt by hash to rounds and shards, each shard fits the parameters
to its windows, and Spark averages the shards' parameters, so that nothing depends on how the texts are partitioned. A memory of the corpus is mixed
in: after a word that is rare, the words that followed it in other training texts. Counts of frequent words are broadcast (their number is bounded); rare ones meet by a shuffle. Texts are cut
into words and subwords once, in a table that counting, training and scoring read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import attention
from .common import batches, crc_of, hashes_of, mix, save, split_words
from .packing import blobs, coder, forget_words

#: Fewer than HOT_WORDS words can each be more than one part in HOT_WORDS of all words; of these the ones that occur
#: more than RARE_COUNT times are broadcast, any other word is counted by a shuffle. Words that occur RARE_COUNT times at most
#: have a part in the memory.
HOT_WORDS, RARE_COUNT = 1 << 22, 32
#: A shard has about SHARD_WINDOWS windows of a round. The others are of schedule(), which training doesn't use any more.
EVERY, LEAST_WINDOWS, ROUNDS, MOST_ROUNDS, SHARD_WINDOWS = 64, 98_304, 2, 8, 12_288
#: Each window is fitted in one of TURNS rounds. Pieces of texts that are dealt have PIECE windows at most.
TURNS, PIECE = 4, 32
#: Weight of the memory after a rare word that is known from elsewhere.
RECALL = 0.2
#: Texts that are laid out in windows at once.
SLICE = 200
#: Entries of a task's count before it is passed on.
FLUSH = 400_000
#: Hash of the end; no word holds a blank.
END = xxhash.xxh64_intdigest(b" ") - (1 << 64 if xxhash.xxh64_intdigest(b" ") >= 1 << 63 else 0)
FOLD, HELD = 7, 2


def held(doc_id) -> bool:
    return doc_id is not None and crc_of(doc_id) % FOLD == HELD


def _held(ids: pa.Array) -> np.ndarray:
    return np.fromiter(map(held, ids.to_pylist()), bool, len(ids))


def _hashes(words: pa.Array) -> np.ndarray:
    return hashes_of(words.to_numpy(zero_copy_only=False).tolist()).view("i8")


def _summed(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum"), ("learnt", "sum")])
    return found.rename_columns(["word", "n", "learnt"]).cast(pa.schema([("word", pa.int64()), ("n", pa.int64()), ("learnt", pa.int64())]))


def count_words(source: DataFrame) -> DataFrame:
    """word (hash; END for the ends), n (in all rows), learnt (in training rows)."""

    def run(it):
        parts, rows = [], 0
        for batch in it:
            out = _held(batch.column("_id"))
            words, bounds = split_words(batch.column("_text"))
            at = words.indices.to_numpy()
            learnt = ~np.repeat(out, np.diff(bounds))
            size = len(words.dictionary)
            columns = _hashes(words.dictionary), np.bincount(at, minlength=size), np.bincount(at[learnt], minlength=size)
            parts.append(pa.table({"word": np.append(columns[0], END), "n": np.append(columns[1], len(out)), "learnt": np.append(columns[2], (~out).sum())}))
            rows += size
            if rows > FLUSH:
                yield from _summed(parts).to_batches()
                parts, rows = [], 0
        if parts:
            yield from _summed(parts).to_batches()

    found = source.mapInArrow(run, "word long, n long, learnt long")
    return save(found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt")), "words")


def prepared(source: DataFrame, tokenizer: str, frequent: tuple[np.ndarray, np.ndarray], ends: int, floor: float) -> DataFrame:
    """A written table of each row: _row, _id, held_out, n_tokens; known and base of its frequent words and end; ids
    (binary) with the end, whose id follows the tokenizer's; of each rare word its hash and that of the word or end that
    follows (pairs), and the span of what follows in the ids (spans), both binary."""
    spark = source.sparkSession
    sent = spark.sparkContext.broadcast(frequent)
    kind = source.schema["_id"].dataType.simpleString()

    def run(it):
        keys, counts = sent.value
        c = coder(tokenizer)
        for batch in it:
            texts, n = batch.column("_text"), len(batch)
            found = c.encode(texts)
            at = found.at + np.arange(n + 1)
            words, bounds, hashes = found.words, found.bounds, found.hashes.view("i8")
            if pc.any(pc.match_substring(texts, "<|")).as_py():  # cut alike, but not in lower case
                words, bounds = split_words(texts)
                hashes = _hashes(words.dictionary)
            place = words.indices.to_numpy()
            near = np.searchsorted(keys, hashes)
            same = np.append(keys, 0)[near] == hashes if len(keys) else np.zeros(len(hashes), bool)
            count = np.where(same, np.append(counts, 0)[near], -1)
            log = np.where(count >= 0, np.log10((np.maximum(count, 0) + 1) / floor), 0.0)[place]
            count = count[place]
            own = np.repeat(np.arange(n), np.diff(bounds))
            base = np.bincount(own, weights=log, minlength=n) + np.log10((ends + 1) / floor)
            known = np.bincount(own, weights=count > 0, minlength=n).astype("i8") + (ends > 0)
            # units: the words and the end of each text
            sizes = np.insert(found.sizes, bounds[1:], 1)
            last = np.cumsum(sizes, dtype="i8")
            units = np.insert(hashes[place], bounds[1:], END)
            rare = np.flatnonzero(count < 0)
            owner = own[rare]
            here = rare + owner
            pairs = np.stack([units[here], units[here + 1]], 1)
            spans = np.stack([last[here] - at[owner], last[here + 1] - at[owner]], 1).astype("<u4")
            cuts = np.searchsorted(owner, np.arange(n + 1))
            ids = np.insert(found.ids.astype(_kind(c.size)), found.at[1:], c.size)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), pa.array(_held(batch.column("_id"))), pa.array(np.diff(bounds) + 1), pa.array(known), pa.array(base), blobs(ids, at), blobs(pairs, cuts * 2), blobs(spans, cuts * 2)], PREPARED)

    source = source.withColumn("_row", F.monotonically_increasing_id())
    return save(source.mapInArrow(run, f"_row long, _id {kind}, held_out boolean, n_tokens long, known long, base double, ids binary, pairs binary, spans binary"), "prepared")


PREPARED = ["_row", "_id", "held_out", "n_tokens", "known", "base", "ids", "pairs", "spans"]


def _kind(size: int) -> str:
    return "<u2" if size < 1 << 16 else "<u4"


def _flat(column: pa.Array, kind: str, wide: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Values of binary rows in a row, and where each begins; `wide` values count as one."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), "i8", len(rows)))]) // (np.dtype(kind).itemsize * wide)


def _texts(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    ids, at = _flat(batch.column("ids"), _kind(size))
    return ids.astype("i4"), at


def _totals(found: DataFrame, size: int) -> np.ndarray:
    """Sums of (key, n) with keys below size, as an array."""
    table = found.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, "i8")
    out[table.column("key").to_numpy()] = table.column("n").to_numpy()
    return out


def count_tokens(tokens: DataFrame, size: int) -> attention.Tables:
    """Tables over all training texts. The driver gets as many counts as there are token ids and pairs of numbers, at most."""

    def single(it):
        forget_words()
        n = np.zeros(size + 1, "i8")
        for batch in it:
            n += np.bincount(_texts(batch, size)[0], minlength=size + 1)
        key = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n[key])], ["key", "n"])

    count = _totals(tokens.mapInArrow(single, "key long, n long"), size + 1)
    number = tokens.sparkSession.sparkContext.broadcast(attention.numbers(count))
    width, height = attention.KEPT + 1, attention.BEGIN + 1

    def double(it):
        n = np.zeros(width * height, "i4")
        for batch in it:
            ids, at = _texts(batch, size)
            if len(at) > 1:
                key, c = attention.pair_counts(number.value, ids, at)
                n[key] += c.astype("i4")
        key = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n[key].astype("i8"))], ["key", "n"])

    pairs = _totals(tokens.mapInArrow(double, "key long, n long"), width * height)
    return attention.Tables.of(count, pairs.reshape(height, width))


def schedule(windows: int) -> tuple[int, int, int]:
    """(rounds, one window in how many is taken in a round, shards) for so many windows of training texts. Training took few
    windows of large tables by it, and takes all of them now; it is here for its test alone."""
    goal = max(ROUNDS * windows // EVERY, LEAST_WINDOWS)
    taken = max(1, min(windows, goal // ROUNDS))
    rounds = ROUNDS if taken < windows else max(ROUNDS, min(MOST_ROUNDS, -(-goal // taken)))
    return rounds, max(1, windows // taken), max(1, round(taken / SHARD_WINDOWS))


def pieces(now: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts of numbers cut every PIECE windows: each piece's numbers, its hash (of the text's hash `own` and its place), and how
    many windows before its own it repeats, for their context."""
    n, length = np.diff(at), PIECE * attention.SCORED
    parts = -(-n // length)
    owner = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    lead = np.where(k > 0, -(-(attention.LEAD + 1) // attention.SCORED), 0)
    first, last = at[owner] + k * length - lead * attention.SCORED, at[owner] + np.minimum((k + 1) * length, n[owner])
    now = now.astype("<u2")
    return [now[a:z].tobytes() for a, z in zip(first.tolist(), last.tolist())], mix(own[owner] + k.astype("u8") * np.uint64(0x9E3779B97F4A7C15), 5), lead


def piece_windows(now: np.ndarray, at: np.ndarray, h: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and goals of the pieces' own windows, in order of the windows' hashes."""
    x, goal, order = attention.picked_windows(now, at, h, 1, 0)
    w = -(-np.diff(at) // attention.SCORED)
    k = np.arange(len(x)) - np.repeat(np.cumsum(w) - w, w)
    chosen = np.flatnonzero(k >= np.repeat(lead, w))
    chosen = chosen[np.argsort(order[chosen], kind="stable")]
    return x[chosen], goal[chosen]


def train(tokens: DataFrame, t: attention.Tables, size: int) -> dict[str, np.ndarray]:
    """Rounds of local training and averaging, weighted by the windows taken; the average is made by Spark, row by row.

    tokens: ids and own, a hash of each text. Each window is fitted once; only the number of shards follows from the size."""
    p, width, step = attention.start(), attention.WIDTH, np.dtype(_kind(size)).itemsize
    windows = tokens.agg(F.coalesce(F.sum(F.ceil(F.length("ids") / step / attention.SCORED)), F.lit(0))).first()[0]
    shards = max(1, round(int(windows) / TURNS / SHARD_WINDOWS))
    names = list(p)
    sums = [F.sum(F.col("row")[k] * F.col("weight")).alias(f"s{k}") for k in range(width)]
    number = tokens.sparkSession.sparkContext.broadcast(t.number)

    def deal(it):
        forget_words()
        for batch in it:
            ids, at = _texts(batch, size)
            rows, h, lead = pieces(number.value[ids], at, batch.column("own").to_numpy().view("u8"))
            turn, shard = (h % np.uint64(TURNS)).astype("i4"), (h // np.uint64(TURNS) % np.uint64(shards)).astype("i4")
            yield pa.RecordBatch.from_arrays([pa.array(turn), pa.array(shard), pa.array(h.view("i8")), pa.array(lead.astype("i4")), pa.array(rows, pa.binary())], ["turn", "shard", "h", "lead", "now"])

    dealt = save(tokens.mapInArrow(deal, "turn int, shard int, h long, lead int, now binary"), "pieces")
    for turn in range(TURNS):
        sent = tokens.sparkSession.sparkContext.broadcast((p, t.own, t.after))

        def fit(shard: pa.Table) -> pa.Table:
            params, own, after = sent.value
            trainer = attention.Trainer(params, own, after)
            shard = shard.sort_by([("h", "ascending"), ("now", "ascending")])
            now, at = _flat(shard.column("now").combine_chunks(), "<u2")
            trainer.take(*piece_windows(now.astype("i4"), at, shard.column("h").to_numpy().view("u8"), shard.column("lead").to_numpy()))
            parts = []
            for k, name in enumerate(names):
                row = trainer.p[name].astype("f8")
                n = len(row)
                columns = [pa.array(np.full(n, k, "i4")), pa.array(np.arange(n, dtype="i4")), pa.array(np.full(n, float(trainer.windows))), pa.FixedSizeListArray.from_arrays(pa.array(row.ravel()), width).cast(pa.list_(pa.float64()))]
                parts.append(pa.table(columns, ["name", "at", "weight", "row"]))
            return pa.concat_tables(parts)

        found = dealt.where(F.col("turn") == turn).groupBy("shard").applyInArrow(fit, "name int, at int, weight double, row array<double>")
        mean = found.groupBy("name", "at").agg(F.sum("weight").alias("weight"), *sums).toArrow()
        if not len(mean):
            continue
        values = np.stack([mean.column(f"s{k}").to_numpy() for k in range(width)], 1) / mean.column("weight").to_numpy()[:, None]
        name, at = mean.column("name").to_numpy(), mean.column("at").to_numpy()
        p = {x: old.copy() for x, old in p.items()}
        for k, x in enumerate(names):
            p[x][at[name == k]] = values[name == k]
    return p


def score_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Learns from rows whose crc32 of the id as text is not 2 modulo 7 (a null id is learnt from). The score is the sum
    over subwords and the end of log10 probabilities by the attention model; of a word that follows a rare word known
    from elsewhere it is that of the mixture of model and memory, in which a text's own occurrences don't count.
    Null text: empty, one end token. Repeated rows count and are scored each; no training rows: counts of zero; an empty
    table gives no rows; columns other than the two named are not read. Very long texts are scored whole, window by
    window.
    """
    spark = docs.sparkSession
    batches(spark, 1000)
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    by_word = count_words(source)
    n_rows, n_all, n_kinds = (int(x) for x in by_word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("learnt"), F.lit(0)), F.count_if(F.col("learnt") > 0)).first())
    floor = float(n_all + n_kinds + 1)
    hot = by_word.where((F.col("n") * HOT_WORDS > n_rows) & (F.col("n") > RARE_COUNT)).select("word", "learnt").orderBy("word").toArrow()
    ends = by_word.where(F.col("word") == END).select("learnt").first()
    ready = prepared(source, tokenizer, (hot.column("word").to_numpy(), hot.column("learnt").to_numpy()), int(ends[0]) if ends else 0, floor)
    size = coder(tokenizer).size
    tokens = ready.where("NOT held_out").select("ids", F.xxhash64("_id", "ids").alias("own"))
    t = count_tokens(tokens.select("ids"), size)
    sent = spark.sparkContext.broadcast((train(tokens, t, size), t))
    names = ["_row", "word", "next", "logp", "learnt", "id", "held_out", "n_tokens", "known", "base", "score"]

    def run(it):
        forget_words()
        p, t = sent.value
        for batch in it:
            rows, out, n = batch.column("_row").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False), len(batch)
            ids, at = _texts(batch, size)
            logp = [attention.score(p, t, ids[x[0] : x[-1]], x - x[0]) for k in range(0, n, SLICE) if len(x := at[k : k + SLICE + 1])]
            upto = np.concatenate([[0], np.cumsum(np.concatenate(logp), dtype="f8")]) / np.log(10) if logp else np.zeros(1)
            pairs, cuts = _flat(batch.column("pairs"), "<i8", 2)
            spans = _flat(batch.column("spans"), "<u4")[0].reshape(-1, 2)
            own = np.repeat(np.arange(n), np.diff(cuts))
            follows = upto[at[own] + spans[:, 1]] - upto[at[own] + spans[:, 0]]
            m = len(own)
            pairs = pairs.reshape(-1, 2)
            rare = [rows[own], np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), follows, ~out[own]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rare), pa.nulls(m, batch.schema.field("_id").type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names)
            # the row of each text; its number stands for a word, as nothing follows
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(rows), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(np.zeros(n, bool)), *(batch.column(c) for c in ("_id", "held_out", "n_tokens", "known", "base")), pa.array(upto[at[1:]] - upto[at[:-1]])], names)

    schema = f"_row long, word long, next long, logp double, learnt boolean, id {kind}, held_out boolean, n_tokens long, known long, base double, score double"
    flat = ready.mapInArrow(run, schema)
    # how often a rare word, and this word after it, occur in training texts, and how often in this text itself, which doesn't
    # count; texts' own rows have no `next`. One exchange by word serves all four, and one sort the first three
    flat = flat.repartition("word")
    for name, keys in (("own_both", ["word", "next", "_row"]), ("both", ["word", "next"]), ("c", ["word"])):
        flat = flat.withColumn(name, F.count_if("learnt").over(Window.partitionBy(*keys)))
    flat = flat.withColumn("n", F.count("next").over(Window.partitionBy("word"))).withColumn("own", F.count_if("learnt").over(Window.partitionBy("word", "_row")))
    word = F.col("next").isNotNull()
    elsewhere = F.col("c") - F.col("own")
    mixed = F.log10((1 - RECALL) * F.pow(F.lit(10.0), F.col("logp")) + RECALL * (F.col("both") - F.col("own_both")) / elsewhere) - F.col("logp")
    more = F.sum(F.when(word & (elsewhere > 0) & (F.col("n") <= RARE_COUNT), mixed).otherwise(0.0))
    out = flat.groupBy("_row").agg(
        F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), (F.max("known") + F.count_if(word & (F.col("c") > 0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.max("base") + F.sum(F.when(word, F.log10((F.col("c") + 1) / F.lit(floor))).otherwise(0.0))).alias("base_score"), (F.max("score") + more).alias("score"),
    )
    return out.drop("_row")
