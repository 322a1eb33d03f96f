"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are sorted, so a trie node is a range of them. Pairs of nodes are walked down together bit by bit,
with the number of bits that differ so far; a pair is given up once that exceeds the error budget.

To deal the trie out, each fingerprint is rotated so that every block of it leads once: two fingerprints within
`budget` bits agree in at least one of budget + 1 blocks, so node pairs need only be started at equal first
blocks. A first block that holds a large share of the rows is split by its next bits into node pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, counted, mix, save

#: A first block with more rows than this, and than one part in HOT_PARTS of all rows, is split by SUB_BITS bits.
HOT_ROWS, HOT_PARTS, SUB_BITS = 2_000, 20_000, 6
#: Node pairs with so few leaf pairs are compared at once; frontiers are cut to so many node pairs.
LEAF, FRONTIER = 64, 200_000
#: Pairs of members that are compared at once.
LEAVES = 2_000_000
#: Estimated pairs count as sure from SURE above the threshold on, as doubtful from CHECKED below it; both are checked.
SURE, CHECKED = 0.14, 0.15
#: Words of 64 bits by which a trie estimates its pairs, others in each trie.
ESTIMATED = 4
#: Shingles are counted in so many buckets (a power of 2), to put rare ones first.
BUCKET_BITS = 19


def shingles(text: str | None, size: int) -> list[bytes]:
    """The word shingles of a text, A-Z lower-cased, repeats included; fewer words: the whole sequence; none: []."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[k:] for k in range(size)))]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64-bit hashes, any number of columns: for each column the bits that over half of the rows have."""
    n, total = len(hashes), 0
    for k in range(0, n, 1 << 15):
        part = np.ascontiguousarray(hashes[k : k + (1 << 15)].astype(">u8"))
        total = total + np.unpackbits(part.view("u1").reshape(len(part), -1), axis=1).sum(0, dtype="i8")
    return np.packbits(total * 2 > n).view(">u8").astype("u8")


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    found = shingles(text, size)
    return int(majority(np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in found), "u8", len(found)).reshape(-1, 1))[0]) if found else 0


def cut(leaves: np.ndarray) -> np.ndarray:
    """Node pairs (a, b, c, d), those with more than LEAVES pairs of members cut into some with fewer."""
    rows = np.maximum(1, LEAVES // np.maximum(leaves[:, 3] - leaves[:, 2], 1))
    parts = -(-(leaves[:, 1] - leaves[:, 0]) // rows)
    out = np.repeat(leaves, parts, axis=0)
    k = np.arange(len(out)) - np.repeat(np.cumsum(parts) - parts, parts)
    step = np.repeat(rows, parts)
    out[:, 0] += k * step
    out[:, 1] = np.minimum(out[:, 1], out[:, 0] + step)
    return out


def trie_pairs(codes: np.ndarray, starts: list[tuple[int, int, int, int, int]], bit: int, budget: int):
    """Pairs of indices (i, j) of codes within budget bits, in chunks. starts: node pairs (a, b, c, d, differing bits so far), whose members are sorted and agree above `bit`; a == c for a node with itself."""
    stack = [(np.array(starts, "i8").reshape(-1, 5), bit)]
    ones_at: dict[int, np.ndarray] = {}
    while stack:
        front, bit = stack.pop()
        if len(front) > FRONTIER:
            stack += [(front[k : k + FRONTIER], bit) for k in range(0, len(front), FRONTIER)]
            continue
        a, b, c, d, diff = front.T
        small = ((b - a) * (d - c) <= LEAF) | (bit < 0)
        if small.any():
            leaves = cut(front[small, :4])
            for part in np.array_split(leaves, max(1, int(((leaves[:, 1] - leaves[:, 0]) * (leaves[:, 3] - leaves[:, 2])).sum()) // LEAVES)):
                a, b, c, d = part.T
                n = (b - a) * (d - c)
                own = np.repeat(np.arange(len(part)), n)
                k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                i, j = a[own] + k // (d - c)[own], c[own] + k % (d - c)[own]
                keep = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
                if keep.any():
                    yield i[keep], j[keep]
        front = front[~small]
        if not len(front):
            continue
        if bit not in ones_at:
            ones_at[bit] = np.concatenate([[0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1)).astype("i8")])
        ones = ones_at[bit]
        a, b, c, d, diff = front.T
        m, n = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = a == c
        new = np.concatenate([np.stack(x, 1) for x in ((a, m, c, n, diff), (m, b, n, d, diff), (a, m, n, d, diff + 1))] + [np.stack((m, b, c, n, diff + 1), 1)[~same]])
        stack.append((new[(new[:, 1] > new[:, 0]) & (new[:, 3] > new[:, 2]) & (new[:, 4] <= budget)], bit - 1))


class Forest:
    """Union-find over indices of one batch."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (r != self.up[r]).any():
            r = self.up[r]
        self.up[x] = r
        return r

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Joins pairs in order; the places of those that weren't joined before."""
        new = []
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                new.append(k)
        return np.array(new, "i8")


def trie_links(codes: DataFrame, bits: int, budget: int, alike=None, more=lambda t: F.array().cast("array<long>")) -> DataFrame:
    """Links between nodes by self-joins of tries: (u, v, weight), in each task a spanning forest of what it finds.

    codes: node long, codes array<long> (for each trie a code in the top `bits` bits), more array<long>. alike: a
    function of two arrays of rows of more(t), columns of longs that the t-th trie gets, that gives each pair's weight; those of 1 count before the others, greater
    weights before lesser ones, those of 0 not at all. Without it all pairs within the budget weigh 1.
    """
    widths = [bits // (budget + 1) + (k < bits % (budget + 1)) for k in range(budget + 1)]

    def views(code):
        def turn(r):
            shift = sum(widths[:r])
            if not shift:
                return code
            top = F.shiftright(F.lit(-1 << (64 - bits)), 0)
            return F.shiftleft(code, shift).bitwiseOR(F.shiftrightunsigned(code, bits - shift)).bitwiseAND(top)

        return F.array(*(F.struct(F.lit(r).alias("r"), turn(r).alias("code")) for r in range(budget + 1)))

    rows = codes.select("node", F.posexplode("codes").alias("t", "c")) if alike is None else codes.select("node", "more", F.posexplode("codes").alias("t", "c"))
    rows = rows.select("node", more(F.col("t")).alias("more"), "t", F.inline(views(F.col("c"))))
    first = F.expr(f"shiftrightunsigned(code, CASE r {' '.join(f'WHEN {r} THEN {64 - w}' for r, w in enumerate(widths))} END)")
    rows = rows.withColumn("block", first)
    counts = rows.groupBy("t", "r", "block").count()
    total = F.broadcast(counts.agg(F.sum("count").alias("total")))
    # at most HOT_PARTS blocks can hold more than one part in HOT_PARTS of all rows
    hot = counts.join(total).where((F.col("count") > HOT_ROWS) & (F.col("count") > F.col("total") / HOT_PARTS)).select("t", "r", "block", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), ["t", "r", "block"], "left")
    masks = [m for m in range(1 << SUB_BITS) if m.bit_count() <= budget]
    sub = F.expr(f"shiftrightunsigned(shiftleft(code, CASE r {' '.join(f'WHEN {r} THEN {w}' for r, w in enumerate(widths))} END), {64 - SUB_BITS})").cast("int")
    rows = rows.withColumn("sub", sub)
    whole = F.array(F.struct(F.lit(-1).alias("x"), F.lit(-1).alias("y")))
    split = F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(F.least(F.col("sub"), F.col("sub").bitwiseXOR(m)).alias("x"), F.greatest(F.col("sub"), F.col("sub").bitwiseXOR(m)).alias("y")))
    rows = rows.select("t", "r", "block", "code", "node", "more", F.inline(F.when(F.col("hot"), split).otherwise(whole)))
    key = ["t", "r", "block", "x", "y"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "code", "node")

    def work(table: pa.Table):
        cols = [table.column(k).to_numpy() for k in key]
        code = table.column("code").to_numpy().view("u8")
        node = table.column("node").to_numpy()
        new = np.zeros(len(node), bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        to = np.append(at[1:], len(node))
        keep = to - at > 1
        at, to = at[keep], to[keep]
        if not len(at):
            return
        more = table.column("more").combine_chunks()
        width = len(more.values) // len(more) if len(more) else 0
        more = more.values.to_numpy().view("u8").reshape(len(node), width)
        certain, forest = Forest(len(node)), Forest(len(node))  # by links that weigh 1, by all
        starts: dict[int, list] = {}
        for a, b in zip(at.tolist(), to.tolist()):
            r, x, y = int(cols[1][a]), int(cols[3][a]), int(cols[4][a])
            if x == y:
                starts.setdefault(63 - widths[r], []).append((a, b, a, b, 0))
            else:
                side = (code[a:b] << np.uint64(widths[r])) >> np.uint64(64 - SUB_BITS)
                m = a + int(np.searchsorted(side, y))
                if a < m < b:
                    starts.setdefault(63 - widths[r] - SUB_BITS, []).append((a, m, m, b, (x ^ y).bit_count()))
        out: list[tuple] = []
        for bit, pairs in starts.items():
            for i, j in trie_pairs(code, pairs, bit, budget):
                for k in range(0, len(i), 200_000):
                    p, q = i[k : k + 200_000], j[k : k + 200_000]
                    apart = (certain.roots(p) != certain.roots(q)) & (node[p] != node[q])
                    p, q = p[apart], q[apart]
                    w = np.ones(len(p)) if alike is None or not len(p) else alike(more[p], more[q])
                    for chosen, trees in ((w >= 1, (certain, forest)), ((w > 0) & (w < 1), (forest,))):
                        order = np.flatnonzero(chosen)[np.argsort(-w[chosen], kind="stable")]
                        for tree in trees[::-1]:
                            joined = order[tree.join(p[order], q[order])]
                        out.append((node[p[joined]], node[q[joined]], w[joined]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["u", "v", "weight"])

    def walk(it):
        kept, rows_kept = [], 0
        for batch in it:
            kept.append(batch)
            rows_kept += len(batch)
            if rows_kept < 30_000:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            cols = [table.column(k).to_numpy() for k in key]
            last = np.ones(len(table), bool)
            for c in cols:
                last &= c == c[-1]
            end = len(table) - int(last.sum())
            if end:
                yield from work(table.slice(0, end).combine_chunks())
                table = pa.Table.from_batches(table.slice(end).to_batches())
            kept, rows_kept = table.to_batches(), 0 if end else -len(table)
        if kept:
            yield from work(pa.Table.from_batches(kept).combine_chunks())

    return rows.mapInArrow(walk, "u long, v long, weight double")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): for every node of a link the smallest node that can be reached. Large-star and small-star in turns.

    A node's smallest neighbour is found by an aggregate and joined back, so no task gathers a node's neighbours; each
    round is written to the shared folder."""
    now = save(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:  # each round at least halves what is left of a chain
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        up = large.join(low, "u")
        small = up.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = save(small, name)
        many = now.groupBy("u").count().where("count > 1").limit(1).count()
        if not many and not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42, budget: int = 2) -> DataFrame:
    """For each document: id_col, fingerprint (16 hex digits), component_id (the smallest id that can be reached by links).

    Equal fingerprints are one node, so copies aren't expanded into pairs. Null or empty text: fingerprint zero, linked
    like any other; a null id stays a row, and names a component only if no other id does; repeated rows stay; an empty
    table gives no rows; columns other than the two named are not read.
    """
    batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def prints(it):
        for batch in it:
            codes = np.array([fingerprint(x, size, seed) for x in batch.column("_text").to_pylist()], "u8")
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(codes.view("i8"))], ["_id", "node"])

    marked = save(source.mapInArrow(prints, f"_id {kind}, node long"), "fingerprints")
    nodes = marked.groupBy("node").agg(F.min("_id").alias("low"))
    links = trie_links(nodes.select("node", F.array("node").alias("codes"), F.array().cast("array<long>").alias("more")), 64, budget)
    roots = components(links)
    named = nodes.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return marked.join(named, "node").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, keep: list[str], text_col: str, size: int, tables: int, seed: int) -> DataFrame:
    """A written table of each row: _row (its number), node (hash of its text), more (tables/2 words of SimHash bits and
    the number of distinct shingles), _text, and the columns `keep` as _k0, _k1 ..."""
    batches(docs.sparkSession)
    names = [f"_k{k}" for k in range(len(keep))]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    words = tables // 2

    def prints(it):
        for batch in it:
            nodes, mores = [], []
            for x in batch.column("_text").to_pylist():
                found = set(shingles(x, size))
                h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in found), "u8", len(found))
                wide = majority(np.stack([mix(h, k) for k in range(words)], 1)) if found else np.zeros(words, "u8")
                nodes.append(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7))
                mores.append(np.append(wide, np.uint64(len(found))).view("i8"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), batch.column("_text"), pa.array(np.array(nodes, "u8").view("i8")), pa.array(mores, pa.list_(pa.int64()))], [*names, "_text", "node", "more"])

    schema = ", ".join([*(f"{n} {source.schema[n].dataType.simpleString()}" for n in names), "_text string, node long, more array<long>"])
    return save(source.mapInArrow(prints, schema).withColumn("_row", F.monotonically_increasing_id()), "sketches")


def estimate(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of rows (words of SimHash bits, size of the set): the share of bits that differ gives
    the angle between the sets."""
    apart = np.bitwise_count(p[:, :-1] ^ q[:, :-1]).sum(1) / (64.0 * (p.shape[1] - 1))
    a, b = p[:, -1].astype("f8"), q[:, -1].astype("f8")
    common = np.cos(np.pi * apart) * np.sqrt(a * b)
    return common / np.maximum(a + b - common, 1)


def shingle_set(text: str, size: int, seed: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in set(shingles(text, size))), "u8"))


def rarest(found: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's hashes, in one order for all sets (by their buckets' counts, then by hash), that two sets of this
    similarity have one in common: such sets share similarity * size at least, of either's size."""
    n = len(found)
    order = np.lexsort((found, counts[(found >> np.uint64(64 - BUCKET_BITS)).astype("i8")]))
    return found[order[: n - int(np.ceil(similarity * n - 1e-9)) + 1]] if n else found


def shared_pairs(token: np.ndarray, root: np.ndarray, size: np.ndarray, at: np.ndarray, similarity: float):
    """Pairs (i, j) of rows with one token, but other roots, in chunks; rows are sorted by token and root. Left out are pairs
    whose sizes, or what comes after the token (the at-th of each set), rule out the similarity."""
    n = len(token)
    new = np.ones(n, bool)
    new[1:] = token[1:] != token[:-1]
    other = new.copy()
    other[1:] |= root[1:] != root[:-1]
    ends = lambda starts: np.append(np.flatnonzero(starts)[1:], n)[np.cumsum(starts) - 1]
    first, last = ends(other), ends(new)
    upto = np.cumsum(last - first)
    k = 0
    while k < n:
        to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + LEAVES, "right")))
        count = last[k:to] - first[k:to]
        i = np.repeat(np.arange(k, to), count)
        j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        least, most = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        common = np.minimum(size[i] - at[i], size[j] - at[j])
        keep = (least >= similarity * most - 1e-9) & (common >= similarity / (1 + similarity) * (least + most) - 1e-9)
        if keep.any():
            yield i[keep], j[keep]
        k = to


def candidates(marked: DataFrame, groups: DataFrame, size: int, seed: int, similarity: float) -> DataFrame:
    """(u, v): all pairs of nodes of other groups that can have the similarity, by a join of their rarest shingles.

    How often shingles occur decides their order alone, which is the same for all texts, so no pair is lost by it; frequent
    ones (a line that many texts have) come last and aren't joined by, unless a text has little else."""
    spark = marked.sparkSession
    texts = marked.select("node", "_text")

    def count(it):
        n = np.zeros(1 << BUCKET_BITS, "i8")
        for batch in it:
            for x in batch.column("_text").to_pylist():
                np.add.at(n, (shingle_set(x, size, seed) >> np.uint64(64 - BUCKET_BITS)).astype("i8"), 1)
        key = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype("i4")), pa.array(n[key])], ["key", "n"])

    found = texts.select("_text").mapInArrow(count, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS, "i8")
    counts[found.column("key").to_numpy()] = found.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(counts)

    def some(it):
        for batch in it:
            sets = [shingle_set(x, size, seed) for x in batch.column("_text").to_pylist()]
            rows = [rarest(x, sent.value, similarity).view("i8") for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.fromiter(map(len, sets), "i4", len(sets))), pa.array(rows, pa.list_(pa.int64()))], ["node", "size", "tokens"])

    own = texts.mapInArrow(some, "node long, size int, tokens array<long>").groupBy("node").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    own = own.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", F.posexplode("tokens").alias("at", "token"))
    own = own.repartition("token").sortWithinPartitions("token", "root", "node")

    def work(table: pa.Table):
        token, node, root, n, at = (table.column(c).to_numpy() for c in ("token", "node", "root", "size", "at"))
        for i, j in shared_pairs(token, root, n, at, similarity):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["u", "v"])

    def walk(it):
        kept, rows = [], 0
        for batch in it:
            kept.append(batch)
            rows += len(batch)
            if rows < 30_000:
                continue
            table = pa.Table.from_batches(kept)
            token = table.column("token").to_numpy()
            end = int(np.flatnonzero(token != token[-1])[-1]) + 1 if (token != token[-1]).any() else 0
            if end:
                yield from work(table.slice(0, end))
            kept = table.slice(end).combine_chunks().to_batches()
            rows = 0 if end else -len(table)
        if kept:
            yield from work(pa.Table.from_batches(kept))

    return own.mapInArrow(walk, "u long, v long").distinct()


def checked_pairs(pairs: DataFrame, nodes: DataFrame, marked: DataFrame, size: int, seed: int, similarity: float) -> DataFrame:
    """Of pairs (u, v) of nodes (each with the _row of one of its texts) those whose sets of shingles have the similarity."""
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    chosen = save(nodes.select("node", "_row").join(asked, "node", "left_semi"), "asked")
    texts = marked.select("_row", "_text").join(counted(chosen), "_row")

    def sets(it):
        for batch in it:
            found = [shingle_set(x, size, seed).view("i8") for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "set"])

    own = save(texts.mapInArrow(sets, "node long, set array<long>"), "sets")
    side = lambda c: own.select(F.col("node").alias(c), F.col("set").alias(f"{c}_set"))
    common = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(common >= similarity * (F.size("u_set") + F.size("v_set") - common)).select("u", "v")


def alike_nodes(marked: DataFrame, tables: int, size: int, seed: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes that are linked to others: no link is lost, and each is checked by sets of shingles.

    The tries find most links; of these each node's likeliest ones are checked. Between the groups that they make, pairs that
    the tries may have missed are found by a join of rarest shingles, which is exact."""
    words = tables // 2
    nodes = save(marked.groupBy("node").agg(F.min("more").alias("more"), F.min("_row").alias("_row")).where(F.col("more")[words] > 0), "nodes")
    halves = F.flatten(F.transform(F.slice("more", 1, words), lambda x: F.array(x.bitwiseAND(F.lit(-1 << 32)), F.shiftleft(x, 32))))
    sure, least = min(similarity + SURE, 1.0), similarity - CHECKED

    def weight(p, q):
        j = estimate(p, q)
        return np.where(j >= sure, 1.0, np.where(j >= least, np.minimum(j, 0.999), 0.0))

    def some(t):
        """The words after that which has the trie's own code, and the size of the set."""
        return F.array(*(F.get("more", (F.floor(t / 2) + 1 + k) % words) for k in range(min(ESTIMATED, words))), F.get("more", F.lit(words)))

    links = save(trie_links(nodes.select("node", halves.alias("codes"), "more"), 32, 2, weight, some), "links")
    # the likeliest link of each node, and that to a lesser node: few links that hold most of a group together
    low = links.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"), "weight")
    high = low.select(F.col("y").alias("x"), F.col("x").alias("y"), "weight")
    best = lambda rows: rows.groupBy("x").agg(F.max_by("y", F.struct("weight", "y")).alias("y")).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    likely = save(best(low).unionByName(best(low.unionByName(high))).distinct(), "likely")
    true = save(checked_pairs(likely, nodes, marked, size, seed, similarity), "true")
    more = save(candidates(marked, components(true, "sure"), size, seed, similarity), "candidates")
    return components(true.unionByName(checked_pairs(more, nodes, marked, size, seed, similarity)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, tables: int = 20, seed: int = 42) -> DataFrame:
    """Groups of documents alike by their word shingles: id_col, node (hash of the text), group (the smallest node reached).

    Texts are linked if their sets of shingles have the similarity; a group is all that can be reached by links. Near copies of
    similarity 0.8 differ in about 10 of 64 SimHash bits, too many for one trie. So each text has `tables` SimHashes of 32
    bits, each in a trie of its own with a budget of 2 bits. What these find is checked by shingles, and what they miss is
    found by a join of the rarest shingles, so that no link is lost. Equal texts are one node. Texts without words are one
    group only if equal.
    Null text: empty; null and equal ids are rows of their own; an empty table gives no rows; other columns aren't read.
    """
    marked = sketches(docs, [id_col], text_col, size, tables, seed)
    return marked.select("_k0", "node").join(alike_nodes(marked, tables, size, seed, similarity), "node", "left").select(F.col("_k0").alias(id_col), "node", F.coalesce("root", "node").alias("group"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, tables: int = 20, seed: int = 42) -> DataFrame:
    """docs with one row of each group of near_copies(): that with the smallest id, a null id last; same columns.

    A null text counts as an empty one; repeated rows are copies; an empty table gives no rows; other
    columns, whatever their names, are handed on. Long texts are taken whole."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    kept = [n for k, n in enumerate(names) if k != text_at]
    plain = docs.toDF(*names)
    marked = sketches(plain.withColumn("_null", F.col(names[text_at]).isNull()), [*kept, "_null"], names[text_at], size, tables, seed)
    given = {n: F.col(f"_k{k}") for k, n in enumerate([*kept, "_null"])}
    given[names[text_at]] = F.when(~given.pop("_null"), F.col("_text")).cast(docs.schema[text_col].dataType)
    light = marked.select("_row", "node", given[names[at]].alias("_id")).join(alike_nodes(marked, tables, size, seed, similarity), "node", "left")
    first = light.groupBy(F.coalesce("root", "node").alias("group")).agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first"))
    dropped = save(light.select("_row").join(first.select(F.col("first._row").alias("_row")), "_row", "left_anti"), "dropped")
    return marked.join(counted(dropped), "_row", "left_anti").select(*(given[n].alias(c) for n, c in zip(names, docs.columns)))
