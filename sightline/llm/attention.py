"""A causal self-attention model of subword classes, in numpy.

One attention layer over embedded subword ids with a learnt bias by distance. What it sees, with a table of class counts
after the last token, predicts the next token's class; the token within its class comes from counts of token pairs. All
tables are counts over the whole training corpus, the attention is fitted by many workers whose parameters are averaged.
Long sequences are cut into overlapping windows: each window gives SCORED tokens a context of WINDOW - SCORED tokens at
least, and every token is scored in exactly one window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .common import mix

WINDOW, SCORED, WIDTH = 64, 32, 32
LEAD = WINDOW - SCORED
#: The most frequent tokens have numbers of their own; of these the first OWN are classes of their own.
KEPT, CLASSES, OWN = 2048, 160, 80
OTHER, BEGIN, PAD, NUMBERS = KEPT, KEPT + 1, KEPT + 2, KEPT + 3
#: Pseudo-counts: of classes after a token, of tokens in a class after a token, of each token that has no number.
AFTER, PAIR, RARE = 20.0, 4.0, 0.05
#: Windows of a step, step size, largest size of an attention score and of a class's logit.
STEP_WINDOWS, RATE, MOST = 48, 4e-3, 60.0
#: Windows and parameters that a step works on at once, few enough for a processor's cache; windows of a product of matrices.
BLOCK, STRIP, GROUP = 24, 1 << 14, 4
#: Numbers in the large array that others are cut from.
POOL = 1 << 22


def numbers(count: np.ndarray) -> np.ndarray:
    """For each token id its number by frequency, or OTHER."""
    order = np.argsort(-count, kind="stable")[:KEPT]
    order = order[count[order] > 0]
    out = np.full(len(count), OTHER, "i4")
    out[order] = np.arange(len(order))
    return out


@dataclass
class Tables:
    """What is counted: number and (log) share among tokens without number of each token id; class of each number; log
    probabilities of classes after a number, and of numbers within their class after a number."""

    number: np.ndarray
    rest: np.ndarray
    own: np.ndarray
    after: np.ndarray
    within: np.ndarray | None = None

    @classmethod
    def of(cls, count: np.ndarray, pairs: np.ndarray) -> "Tables":
        """count: of token ids. pairs: counts of (number before, number), BEGIN + 1 by KEPT + 1."""
        number = numbers(count)
        free = number == OTHER
        rest = np.where(free, np.log((count + RARE) / ((count + RARE)[free].sum() if free.any() else 1.0)), 0.0).astype("f4")
        total = pairs.sum(0, dtype="f8")
        own = _classes(pairs)
        seen = np.zeros((BEGIN + 1, CLASSES))
        order = np.argsort(own, kind="stable")
        first = np.searchsorted(own[order], np.arange(CLASSES))
        filled = np.bincount(own, minlength=CLASSES) > 0
        seen[:, filled] = np.add.reduceat(pairs[:, order].astype("f8"), first[filled], axis=1)
        base = np.where(filled, (seen.sum(0) + 0.5) / (seen.sum() + 0.5 * filled.sum()), 1e-30)
        after = np.log((seen + AFTER * base) / (seen.sum(1, keepdims=True) + AFTER))
        share = total + 1e-6
        share /= np.bincount(own, weights=share, minlength=CLASSES)[own]
        within = pairs.astype("f4")
        within += (PAIR * share).astype("f4")
        within /= (seen[:, own] + PAIR).astype("f4")
        np.log(within, out=within)
        return cls(number, rest, own, np.concatenate([after, np.log(base)[None]]).astype("f4"), within)


def _classes(pairs: np.ndarray) -> np.ndarray:
    """A class for each number and OTHER (the last class): frequent ones alone, others by the tokens around them."""
    own = np.full(KEPT + 1, CLASSES - 1)
    own[:OWN] = np.arange(OWN)
    rest = np.arange(OWN, KEPT)
    sides = [x for side in (pairs[:KEPT, :KEPT], pairs[:KEPT, :KEPT].T) for x in (side[OWN:, :OWN], side[OWN:, OWN:].sum(1, keepdims=True))]
    near = np.concatenate(sides, 1).astype("f8")
    weight = near.sum(1)
    near = np.sqrt((near + near.sum(0) / max(near.sum(), 1) * 4) / (weight[:, None] + 8))
    centre = near[np.linspace(0, len(rest) - 1, CLASSES - OWN - 1).astype(int)]
    for _ in range(12):
        best = ((centre**2).sum(1) - 2 * near @ centre.T).argmin(1)
        total = np.bincount(best, weights=weight, minlength=len(centre))
        new = np.stack([np.bincount(best, weights=weight * c, minlength=len(centre)) for c in near.T], 1)
        centre = np.where(total[:, None] > 0, new / np.maximum(total, 1e-9)[:, None], centre)
    own[rest] = OWN + best
    return own


def pair_counts(number: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of pairs in texts of token ids; a key is number before * (KEPT + 1) + number."""
    now = number[ids]
    key = _before(now, at).astype("i8") * (KEPT + 1) + now
    n = np.bincount(key)
    found = np.flatnonzero(n)
    return found, n[found]


def _before(now: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number before each token; texts have one token at least."""
    out = np.empty_like(now)
    out[1:] = now[:-1]
    out[at[:-1]] = BEGIN
    return out


@dataclass
class Line:
    """Texts laid out for windows: inputs; the place of each token's prediction; starts of windows."""

    inputs: np.ndarray
    place: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, now: np.ndarray, at: np.ndarray) -> "Line":
        n = np.diff(at)
        w = -(-n // SCORED)
        long = LEAD + w * SCORED
        base = np.cumsum(long) - long
        place = np.repeat(base + LEAD - at[:-1], n) + np.arange(len(now))
        inputs = np.full(int(long.sum()), PAD, "i4")
        inputs[place] = _before(now, at)
        owner = np.repeat(np.arange(len(n)), w)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w)
        return cls(inputs, place, base[owner] + k * SCORED)


_I, _J = np.arange(LEAD, WINDOW)[:, None], np.arange(WINDOW)[None, :]
GAP = np.clip(_I - _J, 0, WINDOW - 1)
FUTURE = np.where(_J > _I, -1e9, 0).astype("f4")


class Room:
    """Arrays that are written over at each step, cut from one large one: new ones would cost more than what is put into them,
    and numpy asks for huge pages for large arrays alone."""

    def __init__(self, kind):
        self.kind, self.held, self.free = kind, {}, np.zeros(0, kind)

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            whole = -(-size // 16) * 16  # a line of the cache
            if len(self.free) < whole:
                self.free = np.zeros(max(whole, POOL), self.kind)
            self.held[name], self.free = self.free[:whole], self.free[whole:]
        return self.held[name][:size].reshape(shape)

    def copy(self, name: str, values: np.ndarray) -> np.ndarray:
        out = self(name, *values.shape)
        out[...] = values
        return out


def start(seed: int = 4) -> dict[str, np.ndarray]:
    """Parameters before any training; each has WIDTH columns."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(WIDTH)).astype("f4")
    return {"e": draw(NUMBERS, WIDTH) * 1.7, "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH), "u": draw(CLASSES, WIDTH) * 0.1, "b": np.zeros((WINDOW // WIDTH, WIDTH), "f4")}


def _views(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries and of keys and values for each number, and the bias by place.

    A query's last part is 1 and meets a key part that hides PAD; a value's last part is 1 and sums up the weights."""
    n = len(p["e"])
    q, k = p["e"] @ p["q"] / np.float32(np.sqrt(WIDTH)), p["e"] @ p["k"]
    q *= _scale(q, k)
    hidden = np.zeros((n, 1), "f4")
    hidden[PAD] = -1e4
    one = np.ones((n, 1), "f4")
    return np.concatenate([q, one], 1), np.concatenate([k, hidden, p["e"] @ p["v"], one], 1), np.clip(p["b"].ravel(), -10, 10)[GAP] + FUTURE


def _scale(q: np.ndarray, k: np.ndarray) -> float:
    """What keeps products of rows of q and of k within MOST."""
    top = np.sqrt((q * q).sum(1).max() * (k * k).sum(1).max())
    return min(1.0, MOST / max(top, 1e-9))


def _query_scale(p: dict[str, np.ndarray]) -> float:
    return _scale(p["e"] @ p["q"] / np.float32(np.sqrt(WIDTH)), p["e"] @ p["k"])


def _outward(p: dict[str, np.ndarray]) -> np.ndarray:
    """The output rows, kept so small that no class gets more than MOST from what is seen, a mean of values."""
    return p["u"] * np.float32(_scale(p["e"] @ p["v"], p["u"]))


def _attend(x: np.ndarray, views, room=None):
    """Queries, keys and values, unscaled weights and their sums, and what the scored places of windows x see."""
    room, m = room or Room(views[0].dtype), len(x)
    q = np.take(views[0], x[:, LEAD:], axis=0, out=room("q", m, SCORED, WIDTH + 1), mode="clip")
    kv = np.take(views[1], x, axis=0, out=room("kv", m, WINDOW, 2 * WIDTH + 2), mode="clip")
    a = np.matmul(q, kv[:, :, : WIDTH + 1].transpose(0, 2, 1), out=room("a", m, SCORED, WINDOW))
    a += views[2]
    np.exp(a, out=a)
    h = np.matmul(a, kv[:, :, WIDTH + 1 :], out=room("h", m, SCORED, WIDTH + 1))
    total = h[:, :, WIDTH:].copy()
    h /= total
    return q, kv, a, total, h[:, :, :WIDTH]


def _logits(h: np.ndarray, u: np.ndarray, after: np.ndarray, last: np.ndarray, room) -> np.ndarray:
    """Logits of the classes after each scored place, whose own number is last; u by columns in a row, with which it is faster."""
    z = np.matmul(h, u, out=room("z", *last.shape, CLASSES))
    z += np.take(after, last, axis=0, out=room("after", *z.shape), mode="clip")
    return z


def score(p: dict[str, np.ndarray], t: Tables, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log probability of each token of texts ids[at[k] : at[k + 1]]."""
    now = t.number[ids]
    line, views = Line.of(now, at), _views(p)
    goal = np.full(len(line.inputs), -1, "i4")
    goal[line.place] = t.own[now]
    out, reach = np.zeros(len(line.inputs), "f4"), np.arange(WINDOW)
    room = Room(np.dtype("f4"))
    u, after, one = np.ascontiguousarray(_outward(p).T), room.copy("table", t.after), np.ones(CLASSES, "f4")
    for k in range(0, len(line.starts), STEP_WINDOWS):
        where = line.starts[k : k + STEP_WINDOWS, None] + reach
        x, scored = np.take(line.inputs, where), where[:, LEAD:]
        z = _logits(_attend(x, views, room)[-1], u, after, x[:, LEAD:], room).reshape(-1, CLASSES)
        picked = z[np.arange(len(z)), np.take(goal, scored).ravel()]
        np.exp(z, out=z)
        out[scored] = (picked - np.log(z @ one)).reshape(scored.shape)
    return out[line.place] + t.within[_before(now, at), now] + t.rest[ids]


def picked_windows(now: np.ndarray, at: np.ndarray, own: np.ndarray, every: int, turn: int | list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of the windows whose turn it is (or one of these), one in `every` by the texts' hashes `own`, the numbers that their scored places
    predict (-1 where a text has ended), and the windows' own hashes. Only these windows are laid out."""
    w = -(-np.diff(at) // SCORED)
    owner = np.repeat(np.arange(len(w)), w)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w)
    h = mix(own[owner].astype("u8") + k.astype("u8") * np.uint64(0x9E3779B97F4A7C15), 9)
    turns = np.flatnonzero(np.isin(h % np.uint64(every), np.atleast_1d(turn).astype("u8") % np.uint64(every)))
    owner = owner[turns]
    place = (k[turns] * SCORED - LEAD)[:, None] + np.arange(WINDOW)  # in the text
    end, begin = np.diff(at)[owner][:, None], at[owner][:, None]
    inside = (place >= 0) & (place < end)
    x = np.where(inside, now[np.clip(begin + place - 1, 0, max(len(now) - 1, 0))], PAD)
    x[place == 0] = BEGIN
    goal = np.where(inside, now[np.clip(begin + place, 0, max(len(now) - 1, 0))], -1)[:, LEAD:]
    return x, goal, h[turns]


class Trainer:
    """Fits parameters to windows by Adam. Parameters, gradients and what Adam keeps lie in a row each; `p` are views."""

    def __init__(self, p: dict[str, np.ndarray], own: np.ndarray, after: np.ndarray, rate: float = RATE):
        self.rate, self.steps, self.windows = rate, 0, 0
        self.room = Room(p["e"].dtype)
        self.own, self.after = own, self.room.copy("table", after)
        self.all = self.room.copy("all", np.concatenate([v.ravel() for v in p.values()]))
        self.slope, self.first, self.second, self.change = (self.room.copy(x, np.zeros_like(self.all)) for x in ("slope", "first", "second", "change"))
        self.p, self.g = _cut(self.all, p), _cut(self.slope, p)

    def take(self, x: np.ndarray, goal: np.ndarray) -> None:
        """Windows in order, as picked_windows() gives them."""
        goal = np.where(goal >= 0, self.own[goal], -1)
        for k in range(0, len(x), STEP_WINDOWS):
            self.step(x[k : k + STEP_WINDOWS], goal[k : k + STEP_WINDOWS].ravel())

    def tables(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """_views() of these numbers' rows alone, and _outward(). Their scales hang on all numbers; these are only gone through
        where bounds of the norms don't show that the scales are 1."""
        p, n = self.p, len(rows)
        e, u = p["e"], p["u"]
        far = np.sqrt(np.einsum("ij,ij->i", e, e).max())
        q, k, v = (far * _norm(p[x]) for x in "qkv")
        scale = _query_scale(p) if q * k / np.sqrt(WIDTH) > MOST else 1.0
        out = _outward(p) if v * np.sqrt(np.einsum("ij,ij->i", u, u).max()) > MOST else u
        near = e[rows]
        ask, seen = self.room("ask", n, WIDTH + 1), self.room("seen", n, 2 * WIDTH + 2)
        np.matmul(near, p["q"] * e.dtype.type(scale / np.sqrt(WIDTH)), out=ask[:, :WIDTH])
        np.matmul(near, p["k"], out=seen[:, :WIDTH])
        np.matmul(near, p["v"], out=seen[:, WIDTH + 1 : -1])
        ask[:, WIDTH] = seen[:, -1] = 1
        seen[:, WIDTH] = np.where(rows == PAD, -1e4, 0)
        return ask, seen, np.clip(p["b"].ravel(), -10, 10)[GAP] + FUTURE, out

    def gradient(self, x: np.ndarray, goal: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of the mean loss of real goals; written over by the next call."""
        p, g, room = self.p, self.g, self.room
        count = np.bincount(x.ravel(), minlength=NUMBERS)
        rows = np.flatnonzero(count)
        rows = rows[np.argsort(count[rows], kind="stable")]
        place = np.zeros(NUMBERS, "i2")
        place[rows] = np.arange(len(rows))
        near = place[x]
        *views, u = self.tables(rows)
        real = goal >= 0
        goal, share = np.where(real, goal, 0), (real / max(1, real.sum())).astype(u.dtype)
        one, columns, d = np.ones(CLASSES, u.dtype), np.ascontiguousarray(u.T), room("d", len(x), WINDOW, 3 * WIDTH)
        d[:, :LEAD, :WIDTH] = 0  # nothing is asked there
        self.slope[:] = 0
        by_gap = np.zeros((SCORED, WINDOW), u.dtype)
        for b in range(0, len(x), BLOCK):
            m = len(near[b : b + BLOCK])
            to = slice(b * SCORED, (b + m) * SCORED)
            q, kv, a, total, h = _attend(near[b : b + BLOCK], views, room)
            z = _logits(h, columns, self.after, x[b : b + m, LEAD:], room)
            np.exp(z, out=z)  # a class's logit is MOST at most
            # shares are z over their sums, by which what is short is divided
            flat = z.reshape(-1, CLASSES)
            whole = flat @ one
            flat[np.arange(len(flat)), goal[to]] -= whole
            less = (share[to] / whole).reshape(m, SCORED, 1)
            part = SCORED if m % GROUP else GROUP * SCORED
            g["u"] += np.matmul(z.reshape(-1, part, CLASSES).transpose(0, 2, 1), (h * less).reshape(-1, part, WIDTH)).sum(0)
            dh = room("dh", m, SCORED, WIDTH + 1)
            np.multiply(np.matmul(z, u, out=room("zu", m, SCORED, WIDTH)), less / total, out=dh[:, :, :WIDTH])
            # the last part takes from each slope of a weight their mean by weights
            np.negative(np.einsum("bij,bij->bi", dh[:, :, :WIDTH], h), out=dh[:, :, WIDTH])
            ds = np.matmul(dh, kv[:, :, WIDTH + 1 :].transpose(0, 2, 1), out=room("ds", m, SCORED, WINDOW))
            ds *= a
            by_gap += ds.sum(0)
            np.matmul(ds, kv[:, :, :WIDTH], out=d[b : b + m, LEAD:, :WIDTH])
            np.matmul(ds.transpose(0, 2, 1), q[:, :, :WIDTH], out=d[b : b + m, :, WIDTH : 2 * WIDTH])
            np.matmul(a.transpose(0, 2, 1), dh[:, :, :WIDTH], out=d[b : b + m, :, 2 * WIDTH :])
        sums = self.by_row(near, count[rows], d.reshape(-1, 3 * WIDTH))
        slopes, less = p["e"][rows].T @ sums, u.dtype.type(1 / np.sqrt(WIDTH))
        g["q"][:], g["k"][:], g["v"][:] = slopes[:, :WIDTH] * less, slopes[:, WIDTH : 2 * WIDTH], slopes[:, 2 * WIDTH :]
        g["e"][rows] = sums @ np.concatenate([p["q"] * less, p["k"], p["v"]], 1).T
        g["b"][:] = np.bincount(GAP.ravel(), weights=(by_gap * (FUTURE == 0)).ravel(), minlength=WINDOW).reshape(g["b"].shape)
        return g

    def by_row(self, near: np.ndarray, count: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of values by row; rows are in order of their counts, so those of equal counts are added up at once."""
        order = np.argsort(near.ravel(), kind="stable")  # small numbers: by digits
        values = np.take(values, order, axis=0, out=self.room("sorted", *values.shape), mode="clip")
        out = self.room("sums", len(count), values.shape[1])
        first = np.flatnonzero(np.diff(count, prepend=0))
        at, one = 0, np.ones((1, int(count[-1])), values.dtype)
        for a, z, c in zip(first.tolist(), [*first[1:].tolist(), len(count)], count[first].tolist()):
            np.matmul(one[:, :c], values[at : at + (z - a) * c].reshape(z - a, c, -1), out=out[a:z, None])
            at += (z - a) * c
        return out

    def step(self, x: np.ndarray, goal: np.ndarray) -> None:
        self.steps += 1
        self.windows += len(x)
        self.gradient(x, goal)
        n = self.steps
        # means of slopes and of their squares are kept as sums, without the factors of 0.1 and 0.02
        wide = np.sqrt(0.02 / (1 - 0.98**n))
        rate = self.rate * min(1, n / 10) * 0.1 / (1 - 0.9**n) / wide
        for k in range(0, len(self.all), STRIP):
            p, g, first, second, t = (v[k : k + STRIP] for v in (self.all, self.slope, self.first, self.second, self.change))
            first *= 0.9
            first += g
            second *= 0.98
            second += np.multiply(g, g, out=t)
            np.sqrt(second, out=t)
            t += 1e-8 / wide
            np.divide(first, t, out=t)
            t *= rate
            p -= t


def _cut(row: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Views of a row in the shapes of p."""
    ends = np.cumsum([v.size for v in p.values()]).tolist()
    return {k: row[z - v.size : z].reshape(v.shape) for (k, v), z in zip(p.items(), ends)}


def _norm(m: np.ndarray) -> float:
    """No less than the largest singular value, and little more."""
    m = m.astype("f8")
    m = m.T @ m
    return float(np.sqrt(np.sqrt(np.linalg.norm(m @ m))))
