"""Prefix trie of conversations: balanced parentheses in shards, merged along their spines.

A conversation's path is its turns' digests in a row. Paths are sorted over the cluster, so that the members of every
node lie together, and cut into shards of bounded size. A shard writes its trie as balanced parentheses. Blocks of
their excess, with a tree of minima over them, find each node's closing parenthesis, which ends its subtree; ranks
count the leaf pairs in between, and differences of cumulative sums give what is saved. Only nodes on the first or
the last path of a shard (its spines) can have members in other shards: these are kept open, with what their closed
children add up to, and go through the same steps as paths of the next level, until one shard holds all that is open.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, save

#: Hexadecimal digits of a turn's digest.
DIGITS = 32
#: Nodes of paths (turns and roots) in a shard; at least four paths, so that each level has fewer.
SHARD = 200_000
BLOCK = 256
NONE = np.iinfo("i8").max
EMPTY = hashlib.sha256(b"").hexdigest()
VALUES = ("n", "least", "children", "leaves", "saved", "words")
SCHEMA = "kind string, key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, path string, " + ", ".join(f"{v} array<long>" for v in VALUES)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.string()] * 3 + [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.int64())] * len(VALUES)


def find_close(signs: np.ndarray, opens: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Where each opening parenthesis (+1 in signs, -1 closes) is closed: the first later place where the excess is less by one.

    Looked for in the place's own block, then up and down a tree of the blocks' least excesses, then in the block found."""
    excess = np.cumsum(signs, dtype="i8")
    blocks = -(-len(signs) // block)
    padded = np.full(blocks * block, NONE)
    padded[: len(signs)] = excess
    levels = [padded.reshape(blocks, block).min(1)]
    while len(levels[-1]) > 1:
        low = levels[-1] if len(levels[-1]) % 2 == 0 else np.append(levels[-1], NONE)
        levels.append(low.reshape(-1, 2).min(1))
    aim, out = excess[opens] - 1, np.full(len(opens), -1, "i8")

    def scan(which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Looks for what is sought from `at` to the end of its block; returns those that aren't there."""
        missed, at = [], at.copy()
        while len(which):
            over = (at % block == 0) & (at != first[which])
            missed.append(which[over])
            which, at = which[~over], at[~over]
            hit = padded[np.minimum(at, len(padded) - 1)] <= aim[which]
            out[which[hit]] = at[hit]
            which, at = which[~hit], at[~hit] + 1
        return np.concatenate(missed) if missed else which

    first = np.full(len(opens), -1, "i8")
    left = scan(np.arange(len(opens)), opens + 1)
    node, level = opens[left] // block, np.zeros(len(left), "i8")
    climbing = np.arange(len(left))
    for k, low in enumerate(levels):
        side = node[climbing] + 1
        hit = (node[climbing] % 2 == 0) & (side < len(low)) & (low[np.minimum(side, len(low) - 1)] <= aim[left[climbing]])
        node[climbing[hit]], level[climbing[hit]] = side[hit], k
        climbing = climbing[~hit]
        node[climbing] //= 2
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(level == k)
        node[down] *= 2
        node[down] += levels[k - 1][node[down]] > aim[left[down]]
        level[down] = k - 1
    first[left] = node * block
    scan(left, first[left])
    return out


@dataclass
class Items:
    """Paths in order, with values of each of their nodes, from the root on, one after the other."""

    paths: list[bytes] = field(default_factory=list)
    values: dict[str, list[np.ndarray]] = field(default_factory=lambda: {v: [] for v in VALUES})
    nodes: int = 0

    def add(self, path: bytes, values: dict[str, np.ndarray]) -> None:
        self.paths.append(path)
        for v in VALUES:
            self.values[v].append(values[v])
        self.nodes += len(values["n"])

    def full(self, most: int) -> bool:
        return self.nodes >= most and len(self.paths) >= 4


def keys_of(path: bytes) -> list[str]:
    """A key for each node of a path, from the root on."""
    h, out = hashlib.sha256(), []
    for k in range(0, len(path) + DIGITS, DIGITS):
        out.append(h.copy().hexdigest())
        h.update(path[k : k + DIGITS])
    return out


def grow(items: Items, leaves_known: bool, closed: bool) -> pa.RecordBatch:
    """The trie of a shard: a row of kind `node` for each node that no other shard shares, `path` for those that stay open, and
    on the first level (leaves_known false) `ends` for the conversations that end at open nodes. closed: no other shard follows."""
    paths = items.paths
    length = np.fromiter((len(p) // DIGITS for p in paths), "i8", len(paths))
    first = np.cumsum(length + 1) - length - 1  # the root's place of each path
    turns = np.frombuffer(b"".join(paths), f"S{DIGITS}") if length.any() else np.zeros(0, f"S{DIGITS}")
    begin = np.cumsum(length) - length
    # turns that a path has in common with the one before
    common = np.zeros(len(paths), "i8")
    common[1:] = least = np.minimum(length[1:], length[:-1])
    own = np.repeat(np.arange(1, len(paths)), least)
    k = np.arange(len(own)) - np.repeat(np.cumsum(least) - least, least)
    differ = np.flatnonzero(turns[begin[own - 1] + k] != turns[begin[own] + k])
    np.minimum.at(common, own[differ], k[differ])
    # places (a path's root and turns): a node is new where it isn't shared with the path before; its number is its rank among opens
    path = np.repeat(np.arange(len(paths)), length + 1)
    depth = np.arange(len(path)) - first[path]
    new = (depth > common[path]) | (path == 0)
    number = np.cumsum(new) - 1
    order = np.argsort(depth, kind="stable")
    at = np.maximum.accumulate(np.where(new[order], np.arange(len(order)), 0))
    node = np.empty(len(path), "i8")
    node[order] = number[order[at]]
    spot = np.flatnonzero(new)
    n = len(spot)
    parent = np.where(depth[spot] > 0, node[spot - 1], -1)
    values = {v: np.concatenate(items.values[v]) for v in VALUES}
    total = {v: np.zeros(n, "i8") for v in VALUES}
    for v in ("n", "children", "leaves", "saved"):
        np.add.at(total[v], node, values[v])
    total["least"] = np.full(n, NONE)
    np.minimum.at(total["least"], node, values["least"])
    words = values["words"][spot]
    # parentheses: between two paths what the first has alone is closed and what the second has alone is opened
    runs = np.zeros(2 * len(paths) + 1, "i8")
    runs[2:-1:2] = length[:-1] - common[1:]
    runs[1::2] = length - common + (np.arange(len(paths)) == 0)
    runs[-1] = length[-1] + 1
    signs = np.repeat(np.where(np.arange(len(runs)) % 2 == 1, 1, -1).astype("i1"), runs)
    opens = np.flatnonzero(signs > 0)
    close = find_close(signs, opens)
    after = np.arange(n) + (close - opens + 1) // 2  # the number after those of a node's subtree
    leaf = (close == opens + 1) & (total["children"] == 0)
    below = {}
    for name, each in (("leaves", leaf + total["leaves"]), ("saved", (total["n"] - 1) * words + total["saved"])):
        sums = np.append(0, np.cumsum(each))
        below[name] = sums[after] - sums[:n]
    children = total["children"] + np.bincount(parent[1:], minlength=n)

    open_ = np.zeros(n, bool)
    spines = [] if closed else [node[path == k] for k in dict.fromkeys((0, len(paths) - 1))]
    for s in spines:
        open_[s] = True
    names = {x: key for k, s in zip(dict.fromkeys((0, len(paths) - 1)), spines) for x, key in zip(s.tolist(), keys_of(paths[k]))}
    if leaves_known:
        for k in range(len(paths)):  # few paths: those that are open still
            names |= dict(zip(node[path == k].tolist(), keys_of(paths[k])))
    # conversations that end at a node: equal paths are neighbours, in order of their ids
    ends: dict[int, str] = {}
    if not leaves_known:
        last = node[first + length]
        cuts = np.append(np.flatnonzero(np.diff(last, prepend=-1)), len(paths))
        ids = values["least"][first].tolist()
        ends = {int(last[a]): ",".join(map(str, ids[a:z])) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())}

    rows: dict[str, list] = {x: [] for x in NAMES}

    def put(kind: str, count: int, **columns) -> None:
        for x in NAMES:
            rows[x] += [kind] * count if x == "kind" else list(columns.get(x, [None] * count))

    done = np.flatnonzero(~open_)
    up = parent[done]
    known = (up >= 0) & ~open_[up]
    put(
        "node", len(done), key=[names.get(x) if leaves_known else None for x in done.tolist()],
        parent_key=[names[x] if x >= 0 and not y else None for x, y in zip(up.tolist(), known.tolist())],
        conv_id=total["least"][done].tolist(), depth=depth[spot][done].tolist(),
        parent_conv_id=[x if y else None for x, y in zip(total["least"][up].tolist(), known.tolist())],
        n_convs=total["n"][done].tolist(), n_children=children[done].tolist(), n_leaves=below["leaves"][done].tolist(), saved_tokens=below["saved"][done].tolist(),
        ends=[None if leaves_known else hashlib.sha256(ends[x].encode()).hexdigest() if x in ends else EMPTY for x in done.tolist()],
    )
    # what open nodes' closed children add up to
    hung = done[(up >= 0) & ~known]
    for name, each in (("children", np.ones(n, "i8")), ("leaves", below["leaves"]), ("saved", below["saved"])):
        np.add.at(total[name], parent[hung], each[hung])
    total["words"] = words
    told = np.zeros(n, bool)
    for k, s in zip(dict.fromkeys((0, len(paths) - 1)), spines):
        out = {v: np.where(told[s], NONE if v == "least" else 0, total[v][s]) for v in VALUES} | {"words": words[s]}
        told[s] = True
        put("path", 1, path=[paths[k].decode()], conv_id=[int(values["least"][first[k]])], **{v: [x.tolist()] for v, x in out.items()})
    held = [x for x in ends if open_[x]]
    put("ends", len(held), key=[names[x] for x in held], conv_id=[int(ends[x].split(",", 1)[0]) for x in held], ends=[ends[x] for x in held])
    return pa.RecordBatch.from_arrays([pa.array(rows[x], t) for x, t in zip(NAMES, TYPES)], NAMES)


def grown(paths: DataFrame, leaves_known: bool, closed: bool, most: int) -> DataFrame:
    """grow() for each shard of a sorted table: path, conv_id, words and, once leaves are known, the other values."""

    def run(rows):
        items = Items()
        for batch in rows:
            columns = {x: batch.column(x) for x in batch.schema.names}
            at = columns["words"].offsets.to_numpy()
            flat = {v: columns[v].values.to_numpy(zero_copy_only=False) for v in VALUES if v in columns}
            for k, (path, conv) in enumerate(zip(columns["path"].to_pylist(), columns["conv_id"].to_pylist())):
                values = {v: x[at[k] : at[k + 1]] for v, x in flat.items()}
                if not leaves_known:
                    size = len(values["words"])
                    values |= {"n": np.ones(size, "i8"), "least": np.full(size, conv)} | dict.fromkeys(("children", "leaves", "saved"), np.zeros(size, "i8"))
                items.add(path.encode(), values)
                if not closed and items.full(most):
                    yield grow(items, leaves_known, closed)
                    items = Items()
        if items.paths:
            yield grow(items, leaves_known, closed)

    return paths.mapInArrow(run, SCHEMA)


def rebuilt(turns: DataFrame, block: int = 20) -> DataFrame:
    """conv_id, path and words of each conversation: the first h turns of the first of its block of ids, then its own after its
    first h, where h is the checksum of its id modulo 4."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGITS)
    each = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(NOT_SPACE)).cast("long").alias("words"))
    own = save(each.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))), lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns")), "turns")
    heads = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(heads, "base", "left").withColumn("h", h)
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    mine = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    whole = joined.select("conv_id", F.concat(head, mine).alias("turns"))
    return whole.select("conv_id", F.array_join("turns.digest", "").alias("path"), F.concat(F.array(F.lit(0).cast("long")), F.col("turns.words")).alias("words"))


def hashed(ends: DataFrame) -> DataFrame:
    """key, and the digest of its conversations' ids, which come in parts, in order; only a running digest is kept of them."""

    def run(rows):
        key, h = None, None
        for batch in rows:
            out = []
            for k, part in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if h is not None:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["key", "ends"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "ends"])

    return ends.select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key string, ends string")


def prefix_trie(turns: DataFrame, most: int = SHARD) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    turns: conv_id (whole numbers), turn, role and text, in any order; other columns are not read. A conversation's rows are
    ordered by turn (null first), rows of one turn by the digest of role and text. Null role or text: empty. Rows without
    conv_id belong to no conversation. `%` is that of SQL: it has the sign of the id. An empty table has no nodes.

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is one row of 40 bytes a turn; texts aren't shuffled. most: nodes of paths in a shard. Each level leaves
    two paths of a shard, so a few levels do for any number of conversations; the last one is a single shard.
    """
    spark = turns.sparkSession
    level, nodes, paths, before = 0, None, rebuilt(turns), NONE
    ends = None
    while True:
        if level == 0:
            sorted_ = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
            made = save(grown(sorted_, False, False, most), "trie")
            nodes, ends = made.where("kind = 'node'"), made.where("kind = 'ends'")
        else:
            n, size = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("n")), F.lit(0))).first()
            if n == 0:
                break
            last = size <= most or n > before / 2
            dealt = paths.repartition(1) if last else paths.repartitionByRange(max(1, min(size // most, n // 8)), "path", "conv_id")
            made = save(grown(dealt.sortWithinPartitions("path", "conv_id"), True, last, most), "trie")
            nodes, before = nodes.unionByName(made.where("kind = 'node'")), n
            if last:
                break
        paths = made.where("kind = 'path'").select("path", "conv_id", *VALUES)
        level += 1
    shared = save(nodes.where("key is not null").select("key", F.col("conv_id").alias("up")).join(hashed(ends).withColumnRenamed("ends", "sha"), "key", "left"), "spines")
    # nodes on spines get their ends, nodes under spines their parents
    out = nodes.join(shared.select(F.col("key").alias("parent_key"), "up"), "parent_key", "left").join(shared.select("key", "sha"), "key", "left")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", "sha", F.lit(EMPTY)).alias("ends_sha256"))
