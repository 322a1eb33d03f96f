"""Decontamination beside a plain loop over documents, items and offsets."""

import random
import time
from collections import defaultdict

import numpy as np

from sightline.llm import decontam, queries


def template(text):
    """Tokens and values of a text, names and numbers in a row as one."""
    out = []
    for w in (text or "").encode().split():
        for t, v in decontam.pieces(w.decode()):
            if out and out[-1][0] == t and t in (decontam.N, decontam.NAME):
                out[-1] = (t, out[-1][1] + " " + v)
            else:
                out.append((t, v))
    return out


def by_hand(found, slots, values, words, length):
    """All ways to lay an item on a text, from pairs (item position, text position) of windows; the first of the best."""
    size, best = min(decontam.WINDOW, len(slots)), None
    if len(slots) != length and words < decontam.WORDS:
        return None
    at = defaultdict(list)
    for p, d in found:
        at[d - p].append(p)
    groups = []
    for o in sorted(at):
        if not groups or o - groups[-1][-1] > max(2, len(slots) // 2):
            groups.append([])
        groups[-1].append(o)
    for group in groups:
        covers = {o: {p + k for p in at[o] for k in range(size)} for o in group}
        for o in sorted(group, key=lambda o: (-len(at[o]), o)):
            near = {p: p + min((x for x in group if p in covers[x]), key=lambda x: (abs(x - o), x)) for p in set().union(*covers.values())}
            for windows, lies in ((len(at[o]), {p: p + o for p in covers[o]}), (sum(len(at[x]) for x in {d - p for p, d in near.items()}), near)):
                pairs = [(slots[p], values[d]) for p, d in sorted(lies.items()) if slots[p]]
                share, consistent, changed = len(lies) / len(slots), decontam.agreement(pairs), sum(a != b for a, b in pairs)
                literal = len(lies) - len(pairs) >= min(decontam.LITERALS, len(slots)) or share == 1 and not changed
                if share >= decontam.COVERAGE and consistent >= decontam.CONSISTENT and literal and (best is None or (share, consistent, -changed) > best[0]):
                    best = (share, consistent, -changed), (share, windows, len(pairs), changed, consistent)
    return best and best[1]


def loop(docs, items):
    got = {}
    for i, text in docs:
        d = template(text)
        for j, item in items:
            best = None
            for form in dict.fromkeys((item or "", (item or "").lower())):
                b = template(form)
                size = min(decontam.WINDOW, len(b))
                found = [(p, k) for p in range(len(b) - size + 1) for k in range(len(d) - size + 1) if size and [x for x, _ in b[p : p + size]] == [x for x, _ in d[k : k + size]]]
                row = found and by_hand(found, [v for _, v in b], dict(enumerate(v for _, v in d)), len(form.split()), len(d))
                if row and (best is None or (row[0], row[4], -row[3], row[1]) > (best[0], best[4], -best[3], best[1])):
                    best = row
            if best:
                got[i, j] = best
    return got


def told(rows):
    return {(r.doc_id, r.item_id): (r.coverage, r.windows, r.slots, r.changed_slots, r.consistency) for r in rows}


def test_equals_a_loop(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "a", "ran", "far", "Bob", "Ann", "Mary", "12", "7", "km", "3kg", "two", "when", "of", "it.", "-", "so,"])
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([1, 2, 4, 8, 9, 14, 30])))) for k in range(40)] + [("null", None), ("none", " . ")]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(60)))) for k in range(60)] + [(100, None), (101, "")]
    for k, (_, t) in enumerate(items[:40]):
        docs.append((200 + k, f"so it {t} far"))
        docs.append((300 + k, t.lower()))
        docs.append((400 + k, t.replace("Bob", "Zed").replace("12", "99")))
    want = loop(docs, items[:-2])
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, item_id string, _row string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert told(decontam.contaminated(frame, bench).collect()) == want and len(want) > 60
    kept = [r.doc_id for r in decontam.decontaminate(frame, bench).collect()]
    assert sorted(kept) == sorted({i for i, _ in docs} - {i for i, _ in want})
    assert decontam.decontaminate(frame, bench).columns == frame.columns


def test_items_of_any_make_up(spark):
    items = [("numbers", "12 7 99 4 5 6"), ("sum", "What is 12 + 30 ?"), ("names", "Alice has 12 apples. Bob has 5. Carol takes 3. How many are left?"), ("one", "apples"), ("twenty", "A train took twenty five minutes to reach Mary Ann at the old mill")]
    texts = {1: "so 12 7 99 4 5 6 it is", 2: "asked: What is 12 + 30 ? Well", 3: "Dave has 99 apples. Eve has 7. Zed takes 1. How many are left?", 4: "many apples here", 5: "apples", 6: "A train took 12 minutes to reach Alice at the old mill", 7: "12 7 98 4 5 6", 8: "alice has 12 apples. bob has 5. carol takes 3. how many are left?"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = told(decontam.contaminated(docs, spark.createDataFrame(items, "item_id string, text string")).collect())
    assert set(got) == {(1, "numbers"), (2, "sum"), (3, "names"), (5, "one"), (6, "twenty"), (8, "names")}
    assert got[3, "names"][3] > 0 and got[2, "sum"][3] == 0 and got[6, "twenty"][3] == 2


def test_ties_repeats_and_long_texts(spark):
    item = "If the old man of the sea gives Alice 12 apples then how many are there"
    long = "x " * 200_000 + item + " y" * 1000
    docs = spark.createDataFrame([(1, item), (1, item), (None, item), (2, long), (3, item + " " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (2, item)], "item_id long, text string")
    rows = decontam.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in rows) == sorted([(1, 1), (1, 2)] * 2 + [(0, 1), (0, 2), (2, 1), (2, 2), (3, 1), (3, 2)])
    assert decontam.decontaminate(docs, bench).count() == 0 and decontam.decontaminate(docs, bench.where("false")).count() == 5


def test_verbatim_passages_of_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, " ".join((r.text or "").split())) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, " ".join(r.text.split())) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = {(i, j) for i, t in docs for j, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontaminate(spark, d).collect()}
    assert want and want <= got and len(got) < 2 * len(want)


def test_texts_that_repeat_themselves(spark):
    """Linear in the text, whatever meets what: a word over and over, with and without slots, and short items."""
    items = [("yes", "yes " * 1000), ("no", "yes " * 500 + "no"), ("the", "the"), ("cats", "3 cats ran " * 40), ("two", "the end")]
    texts = ["yes " * 20_000, "yes " * 1200 + "no", "the " * 20_000, "the", " ".join(f"{k % 7} cats ran" for k in range(2000)), "so the end is near", "the end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    began = time.time()
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert time.time() - began < 60
    assert got == {(0, "yes"), (0, "no"), (1, "yes"), (1, "no"), (3, "the"), (6, "two")} | ({(4, "cats")} & got)


def test_judged_as_by_hand():
    rng = random.Random(4)
    for _ in range(400):
        words = rng.choice([["a"], ["a", "b"], ["a", "b", "c", "<number>"]])
        item, text = ([rng.choice(words) for _ in range(rng.randint(8, 24))] for _ in "it")
        text = text + item[: rng.randint(0, 24)] + [rng.choice(words) for _ in range(rng.randint(0, 9))] + item[rng.randint(0, 9) :]
        slots, values = ([rng.choice("12") if t == "<number>" else "" for t in x] for x in (item, text))
        found, ps, ds = [], defaultdict(list), defaultdict(list)
        for p in range(len(item) - 7):
            ps[hash(tuple(item[p : p + 8]))].append(p)
        for d in range(len(text) - 7):
            if (h := hash(tuple(text[d : d + 8]))) in ps:
                ds[h].append(d)
                found += [(p, d) for p in ps[h]]
        if found:
            want = by_hand(found, slots, dict(enumerate(values)), 9, len(text))
            assert decontam.judged({h: np.array(ps[h]) for h in ds}, {h: np.array(x) for h, x in ds.items()}, slots, dict(enumerate(values)), 9, len(text)) == want
