"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query on trigrams is derived: an AND of ORs of trigram sets that any
match must hold. The index has a posting (trigram, row key) for each trigram that some rule asks for; postings are
intersected with an aggregate by row key, and a rule runs its expression only on the rows that are left. Rules without
mandatory trigrams scan every row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, save


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The kinds asked for. A whole match of 32 or 16 characters is the same as a longer run of the class,
#: as a match takes the run from its start; the first rule's group is tested after the match, as a match that fails
#: uses up its characters.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
#: What redact() takes out: a private key goes with its body, up to its END line or, if that is missing, the text's end.
HIDDEN = [replace(r, pattern=r.pattern + r"[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|(?![\s\S]))") if r.kind == "pem" else r for r in RULES]
#: More alternatives than this aren't spelt out; the part of the expression then asks for nothing.
SPELT = 64


def _spelt(items) -> set[str] | None:
    """All strings that a sequence of an expression's parts can match, if they are few."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            one = {chr(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            one = {chr(x) for _, x in arg}
        elif name == "SUBPATTERN":
            one = _spelt(arg[3])
        elif name == "BRANCH":
            each = [_spelt(x) for x in arg[1]]
            one = None if None in each else set().union(*each)
        elif name == "MAX_REPEAT" and arg[1] == 1:
            one = _spelt(arg[2])
            one = one if one is None or arg[0] else one | {""}
        else:
            return None
        if one is None or len(out) * len(one) > SPELT:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of lower-case trigram sets, each of which a matching text must hold; empty: no trigram is mandatory."""
    runs, now = [], []
    for item in _parser.parse(pattern):
        if _spelt([item]) is None or _spelt([*now, item]) is None:
            runs.append(now)
            now = [] if _spelt([item]) is None else [item]
        else:
            now = [*now, item]
    query = []
    for run in [*runs, now]:
        sets = {frozenset(s.lower()[k : k + 3] for k in range(len(s) - 2)) for s in _spelt(run) or ()}
        if sets and frozenset() not in sets:
            query.append(sorted((a for a in sets if not any(b < a for b in sets)), key=sorted))
    return query


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def candidates(keyed: DataFrame, rules: list[Rule]) -> DataFrame:
    """_key and _rules: the rules whose trigram query a row meets. keyed: _key, _text."""
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in asked.values() for alts in q for one in alts for g in one})
    low = F.lower("_text")
    held = keyed.select("_key", low.alias("_low"))
    postings = held.select("_key", F.explode(F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams)))).alias("gram"))
    parts = [(g, kind, k, a, 1 << p, (1 << len(one)) - 1) for kind, q in asked.items() for k, alts in enumerate(q) for a, one in enumerate(alts) for p, g in enumerate(sorted(one))]
    # a row for each trigram of the rules: fixed, whatever the data
    wanted = keyed.sparkSession.createDataFrame(parts, "gram string, kind string, part int, alternative int, bit long, full long")
    met = postings.join(F.broadcast(wanted), "gram").groupBy("_key", "kind", "part", "alternative").agg(F.bit_or("bit").alias("bits"), F.max("full").alias("full")).where("bits = full")
    need = F.create_map(*(x for k, q in asked.items() for x in (F.lit(k), F.lit(len(q)))))
    return met.groupBy("_key", "kind").agg(F.countDistinct("part").alias("n")).where(F.col("n") == need[F.col("kind")]).groupBy("_key").agg(F.collect_set("kind").alias("_rules"))


def _spans(rule: Rule, order: int) -> Column:
    """array<struct<start, rank, kind, stop>> of a rule's matches in _text, in code points."""
    pattern = F.lit(rule.pattern)
    found = F.struct(F.regexp_extract_all("_text", pattern, F.lit(0)).alias("m"), F.regexp_extract_all("_text", pattern, F.lit(rule.group)).alias("g"), F.split("_text", rule.pattern, -1).alias("between"))

    def place(x):
        step = F.zip_with(F.slice(x["between"], 1, F.size(x["m"])), x["m"], lambda b, m: F.struct(F.length(b).alias("skip"), F.length(m).alias("n")))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

        def add(s, p):
            start = s["at"] + p["skip"]
            return F.struct((start + p["n"]).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), (start + p["n"]).alias("stop")))).alias("out"))

        ends = F.aggregate(step, begin, add)["out"]
        kept = F.zip_with(ends, x["g"], lambda e, g: F.when(F.length(g) >= rule.least, F.struct(e["start"].alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), e["stop"].alias("stop"))))
        return F.array_compact(kept)

    return let(found, place)


NONE = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def find_secrets(docs: DataFrame, keep: list[str], rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` and spans: array<struct<start, rank, kind, stop>> by start, then rank in the list of rules; code points, stop exclusive.

    Null text: empty, no spans. Null and equal ids, repeated rows: each row keeps its own spans. An empty table gives
    no rows. Long texts are scanned whole. Columns not named are not read; names that clash with span fields may be kept.
    """
    rules = rules or RULES
    names = {c: f"_k{k}" for k, c in enumerate(keep)}
    source = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # the key only finds candidates: texts that share it by chance are verified in vain
    keyed = source.withColumn("_key", F.xxhash64(*([next(iter(names.values()))] if names else []), "_text"))
    held = save(candidates(keyed.select("_key", "_text"), rules), "candidates")
    found = keyed.join(counted(held), "_key", "left")
    full = [r.kind for r in rules if not trigram_query(r.pattern)]
    each = [F.when(F.lit(True) if r.kind in full else F.coalesce(F.array_contains("_rules", r.kind), F.lit(False)), _spans(r, k)).otherwise(F.array().cast(NONE)) for k, r in enumerate(rules)]
    return found.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("_text").alias("_scanned"), F.array_sort(F.concat(*each)).alias("spans"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans (text) for each row; see find_secrets."""
    found = find_secrets(docs, [id_col], text_col=text_col).select(id_col, "spans")
    base = [k for k, r in enumerate(RULES) if r.base]
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long")
    counts = [count(k).alias(f"n_{RULES[k].kind}") for k in base]
    return found.select(id_col, *counts, F.sha2(told(F.filter("spans", lambda x: x["rank"] <= max(base))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with each span (overlapping ones joined) replaced by mark in text, and n_chars brought up to date where there is such a column.

    All rows stay, repeated ones and those of null or equal ids too; a null or empty text stays as it is; an empty table gives
    no rows; other columns, whatever their names, are handed on. Long texts are scanned whole."""
    cols = docs.columns
    own = {c: f"_c{k}" for k, c in enumerate(cols)}
    found = find_secrets(docs.toDF(*own.values()), list(own.values()), HIDDEN, own["text"])

    def step(s, x):
        out = s["out"]
        skip = F.substring(F.col("_scanned"), s["at"] + 1, x["start"] - s["at"])
        fresh = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(out, skip, F.lit(mark))).otherwise(out).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("_scanned"), s["at"] + 1, F.length("_scanned"))))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col(own["text"]))
    new = {"text": text} | ({"n_chars": F.when(F.size("spans") > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))} if "n_chars" in cols else {})
    return found.select(*(new.get(c, F.col(own[c])).alias(c) for c in cols))
