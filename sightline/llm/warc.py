"""WARC archives: written by Spark's text writer, read back with boundary-chain verification.

A task that reads part of an archive takes every magic line it meets as a candidate record and emits its offset and
that of its successor, worked out from the header's length. Pointer jumping from the start of each file then keeps the
records that the chain reaches; a magic line inside a payload is never reached, and belongs to the record around it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, new_path, save

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
#: Bytes of payload that a file is aimed at.
FILE_BYTES = 64 << 20
#: Digits of a length beyond which no record can be.
MOST_DIGITS = 15
LENGTH = re.compile(rb"(?i)(?:^|\r\n)Content-Length: *(\d+)")
LENGTH_FIRST, LENGTH_LATER = re.compile(rb"(?i)Content-Length: *(\d+)"), re.compile(rb"(?i)\r\nContent-Length: *(\d+)")
FIELD = re.compile(rb"([A-Za-z-]+): *([^\r\n]*)")


LOWEST = -(1 << 62)  # stands for a null id


def digest(payload: Column) -> Column:
    """SHA-1 in base 32: eight times five hexadecimal digits as four digits of base 32, in that alphabet."""
    fours = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def number(digits: bytes | str) -> int | None:
    """A length told in a header; None if no record could be so long."""
    digits = digits.lstrip(b"0" if isinstance(digits, bytes) else "0")
    return int(digits or 0) if len(digits) <= MOST_DIGITS else None


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0, date: str | None = None) -> None:
    """A record for each row, in gzip-compressed files of about FILE_BYTES (one member a file, as Spark's text writer has
    it). date: of all records, by default now. Of rows with equal payloads of at least `least`
    bytes that with the largest id (of equal ids that with the largest url, of equal urls any one) is a response, the
    others are revisits without payload.

    Null body: an empty payload. Null url: no target. A null id counts as the smallest. Empty table: no records.

    Payloads are not shuffled unless the digests that occur more than once are too many for Spark to broadcast.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    source = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), body.alias("_body"))
    source = source.withColumns({"_digest": digest(F.col("_body").cast("binary")), "_bytes": F.octet_length("_body").cast("long"), "_o": F.coalesce("_id", F.lit(LOWEST)), "_u": F.coalesce("_url", F.lit(""))})
    same = source.where(F.col("_bytes") >= least).groupBy("_digest", "_o", "_u").agg(F.count("*").alias("c"))
    last = save(same.groupBy("_digest").agg(F.max(F.struct("_o", "_u", "c")).alias("_last"), F.sum("c").alias("n")).where("n > 1").drop("n"), "copies")
    rows = source.join(last, "_digest", "left")
    chosen = (F.col("_last._o") == F.col("_o")) & (F.col("_last._u") == F.col("_u"))
    tied = F.coalesce(chosen & (F.col("_last.c") > 1), F.lit(False))
    records = rows.where(~tied).withColumn("_again", F.coalesce(~chosen, F.lit(False)))
    if not last.where("_last.c > 1").isEmpty():  # repeated rows: one is kept with its number, which gives the revisits
        one = rows.where(tied).dropDuplicates(["_digest"])
        records = records.unionByName(one.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_last.c")))).withColumn("_again", F.col("k") > 1).drop("k"))
    again = F.col("_again")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    urn = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    refers = F.when(again & (F.col("_last._o") > LOWEST), urn(F.col("_last._o")))
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = F.concat(
        F.lit(MAGIC.decode()), F.lit(f"WARC-Date: {date}\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("_id"))),
        line("WARC-Target-URI", F.regexp_replace("_url", "[\\x00-\\x20\\x7f]", "%20")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")),
        line("WARC-Payload-Length", F.col("_bytes").cast("string")), line("WARC-Refers-To", refers), line("Content-Length", F.when(again, 0).otherwise(F.col("_bytes")).cast("string")),
    )
    records = records.select(F.concat(head, F.lit("\r\n"), F.when(again, "").otherwise(F.col("_body"))).alias("value"))
    n, total = source.agg(F.count("*"), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", max(1_000, FILE_BYTES * n // max(total, 1))).text(path)


def between(spark: SparkSession, path: str) -> DataFrame:
    """What lies between the magic lines: file, block (start of the split), size, raw."""
    # the archives are read twice and must be split alike, whatever executors are there
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.shuffle.partitions"))
    batches(spark, 200)
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.octet_length("value").cast("long").alias("size"), F.col("value").cast("binary").alias("raw"))


class Heads:
    """Headers of the candidates of a split, whatever their length. Those that go on beyond the next magic line share one
    buffer, as they all end at the same place."""

    def __init__(self):
        self.text, self.scanned, self.waiting = bytearray(), 0, []

    def add(self, row: list, start: bytes) -> None:
        """A candidate and what follows its magic line, up to its first END; row[4] of each candidate that ends there is set."""
        if self.waiting:
            self.text += MAGIC
        self.waiting.append((len(self.text), row))
        self.text += start
        while self.waiting:
            end = self.text.find(END, max(self.scanned, self.waiting[0][0]))
            if end < 0:
                self.scanned = max(0, len(self.text) - len(END) + 1)
                return
            k = bisect_left(self.waiting, end + 1, key=lambda x: x[0])
            self.close(self.waiting[:k], end)
            self.waiting = self.waiting[k:]
        self.text, self.scanned = bytearray(), 0

    def close(self, ready: list[tuple[int, list]], end: int) -> None:
        lines = list(LENGTH_LATER.finditer(self.text, ready[0][0], end))
        at = [m.start() for m in lines]
        for begin, row in ready:
            k = bisect_left(at, begin)
            found = LENGTH_FIRST.match(self.text, begin, end) or (lines[k] if k < len(lines) else None)
            length = number(found[1]) if found else None
            if length is not None:
                row[4] = end - begin + len(END) + length + len(END)

    def leave(self) -> None:
        """At a split's end: row[5] of each candidate whose header goes on beyond it is what was seen of the header."""
        for begin, row in self.waiting:
            row[5] = bytes(self.text[begin:])


def runs(files: list, blocks: list, sizes: list, state: list) -> list[int]:
    """Offset of each piece in its split; state (place, next offset) goes from batch to batch of a task."""
    out = []
    for file, block, size in zip(files, blocks, sizes):
        if state[0] != (file, block):
            state[:] = (file, block), 0
        out.append(state[1])
        state[1] += size + len(MAGIC)
    return out


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each magic line: file, block, run (offset of what follows it, in its split), at (offset of the magic
    line in the file), size, next (offset of the successor; null if the header can't be read). No payloads."""
    names = ["file", "block", "run", "size", "step", "begun"]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.binary()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def walk(it):
        state, place, heads = [None, 0], None, Heads()
        rows: list[list] = []
        for batch in it:
            file, block, size, raw = (batch.column(c).to_pylist() for c in ("file", "block", "size", "raw"))
            for f, b, s, run, start in zip(file, block, size, runs(file, block, size, state), raw):
                if place != (f, b):
                    heads.leave()
                    place, heads = (f, b), Heads()
                row = [f, b, run, s, None, None]
                rows.append(row)
                heads.add(row, start)
            if rows and not heads.waiting:
                yield table(rows)
                rows = []
        heads.leave()
        if rows:
            yield table(rows)

    pieces = starts(spark, path)
    found = save(pieces.mapInArrow(walk, "file string, block long, run long, size long, step long, begun binary"), "candidates")
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    base = blocks.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("base"))
    begin = F.col("base") + F.col("run")
    opened = found.where("begun IS NOT NULL").select("file", "block", "run", "begun")
    found = found.drop("begun")
    if not opened.isEmpty():
        found = found.join(closed(opened, pieces).withColumnRenamed("step", "_step"), ["file", "block", "run"], "left").withColumn("step", F.coalesce("step", "_step")).drop("_step")
    return save(found.join(base, ["file", "block"]).select("file", "block", "run", (begin - len(MAGIC)).alias("at"), "size", (begin + F.col("step")).alias("next")), "marks")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """between(), with each piece cut after its first END, found byte by byte; a piece that has none may be the middle of a header."""
    text = F.col("raw").cast("string")
    head = F.substring_index(text, END.decode(), 1)
    head = F.when(F.octet_length(head) < F.octet_length(text), F.concat(head, F.lit(END.decode()))).otherwise(head)
    return between(spark, path).withColumn("raw", head.cast("binary"))


def closed(opened: DataFrame, pieces: DataFrame) -> DataFrame:
    """(file, block, run, step) of candidates whose header goes on beyond their split: it ends with what the splits after
    it begin with. opened: file, block, run, begun."""

    def lead(it):
        place, text, ended = None, bytearray(), False
        for batch in it:
            for f, b, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "raw"))):
                if place != (f, b):
                    if place:
                        yield pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]]), pa.array([bytes(text)])], ["file", "block", "lead"])
                    place, text, ended = (f, b), bytearray(), False
                if not ended:
                    text += MAGIC + raw
                    ended = END in raw
        if place:
            yield pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]]), pa.array([bytes(text)])], ["file", "block", "lead"])

    leads = pieces.join(opened.select("file").distinct(), "file", "left_semi").mapInArrow(lead, "file string, block long, lead binary")

    def close(heads: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
        later, out = later.sort_values("block"), []
        for h in heads.itertuples():
            text, row = bytearray(h.begun), [None] * 5
            for x in later.itertuples():
                if END in text:
                    break
                if x.block > h.block:
                    text += x.lead
            if END in text:
                one = Heads()
                one.add(row, bytes(text))
            out.append((h.file, h.block, h.run, row[4]))
        return pd.DataFrame(out, columns=["file", "block", "run", "step"]).astype({"step": "Int64"})

    # a file's splits begin with headers or parts of payloads: as many short texts as the file has splits
    return opened.groupBy("file").cogroup(leads.groupBy("file")).applyInPandas(close, "file string, block long, run long, step long")


def reached(marks: DataFrame) -> DataFrame:
    """(file, at) of the candidates that the chain from offset 0 of their file reaches. marks: file, at, next.

    In each round the reached set takes one step along the pointers, and the pointers are joined with themselves,
    so they jump twice as far: as many rounds as the logarithm of the longest chain."""
    jump = save(marks.where("at >= 0 AND next IS NOT NULL").select("file", "at", "next"), "jumps")
    # bounded by the largest number of candidates in one file
    most = jump.groupBy("file").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    seen = marks.where("at = 0").select("file", "at")
    for _ in range(max(1, int(most)).bit_length()):
        seen = save(seen.unionByName(seen.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))).distinct(), "reached")
        jump = save(jump.join(jump.select("file", F.col("at").alias("next"), F.col("next").alias("then")), ["file", "next"]).select("file", "at", F.col("then").alias("next")), "jumps")
    return seen.join(marks.select("file", "at"), ["file", "at"], "left_semi")


def joined(pieces: DataFrame) -> DataFrame:
    """Records that hold magic lines, put together from their pieces: file, own, raw."""
    bound = F.array_sort(F.collect_list(F.struct("at", "raw")))
    rest = F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    magic = F.lit(bytearray(MAGIC))
    return pieces.groupBy("file", "own").agg(bound.alias("p")).select("file", "own", F.aggregate(rest, F.col("p")[0]["raw"], lambda s, x: F.concat(s, magic, x["raw"])).alias("raw"))


FIELDS = {"record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "declared_digest": pa.string(), "declared_bytes": pa.int64(), "refers_to": pa.string(), "payload": pa.binary()}
SCHEMA = "record_id string, url string, record_type string, declared_digest string, declared_bytes long, refers_to string, payload binary"


def parse(raw: bytes, whole: bool = False) -> tuple | None:
    """FIELDS of what follows a magic line; None if its header can't be read, it is cut short or (whole) anything follows the record."""
    head = raw.find(END)
    found = LENGTH.search(raw[:head]) if head >= 0 else None
    if not found:
        return None
    start, length = head + len(END), number(found[1])
    if length is None or start + length > len(raw) or whole and start + length + len(END) != len(raw):
        return None
    x = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in FIELD.findall(raw[:head])}
    declared = x.get("warc-payload-length", "")
    return x.get("warc-record-id"), x.get("warc-target-uri"), x.get("warc-type"), x.get("warc-payload-digest"), number(declared) if declared.isdecimal() and number(declared) is not None else length, x.get("warc-refers-to"), raw[start : start + length]


def batch_of(records: list[tuple], more: dict | None = None) -> pa.RecordBatch:
    more = more or {}
    columns = zip(*records) if records else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([*more.values(), *(pa.array(c, k) for c, k in zip(columns, FIELDS.values()))], [*more, *FIELDS])


def read_warc(spark: SparkSession, path: str, payload: dict[str, Column] | None = None) -> DataFrame:
    """record_id, url, record_type, declared_digest, declared_bytes, refers_to, payload of each record that the chain reaches.

    payload: columns to derive from those, in place of `payload`; they are worked out where a record is read, so that
    its payload need not be shuffled to meet the offsets reached.
    A file that is cut short gives the records up to the cut. No files with records: no rows.
    """
    derived = [c.alias(n) for n, c in (payload or {"payload": F.col("payload")}).items()]
    told = [c for c in FIELDS if c != "payload"]
    marks = candidates(spark, path)
    kept = reached(marks.select("file", "at", "next")).withColumn("real", F.lit(True))
    # the record that each candidate lies in: offsets of one archive file only
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owner = marks.join(kept, ["file", "at"], "left").withColumn("own", F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(w)).where("own IS NOT NULL")
    alone = F.expr(f"coalesce(at = own AND next = at + {len(MAGIC)} + size, false)").alias("alone")
    owner = save(owner.select("file", "block", "run", "at", "own", alone), "owners")
    rest = save(owner.where("NOT alone").drop("alone"), "pieces")

    def placed(batch, state):
        file, block, size = (batch.column(c) for c in ("file", "block", "size"))
        return {"file": file, "block": block, "run": pa.array(runs(file.to_pylist(), block.to_pylist(), size.to_pylist(), state), pa.int64())}

    def read(it):
        state = [None, 0]
        for batch in it:
            at = placed(batch, state)
            found = [parse(x, whole=True) for x in batch.column("raw").to_pylist()]
            on = pa.array([x is not None for x in found], pa.bool_())
            yield batch_of([x for x in found if x is not None], {k: v.filter(on) for k, v in at.items()})

    def cut(it):
        state = [None, 0]
        for batch in it:
            at = placed(batch, state)
            yield pa.RecordBatch.from_arrays([*at.values(), batch.column("raw")], [*at, "raw"])

    def bound(it):
        for batch in it:
            yield batch_of([x for raw in batch.column("raw").to_pylist() if (x := parse(raw)) is not None])

    # the archives once more, so that payloads are not stored between; offsets are broadcast only if Spark finds them small
    whole = between(spark, path).mapInArrow(read, f"file string, block long, run long, {SCHEMA}").select("file", "block", "run", *told, *derived)
    records = whole.join(owner.where("alone").select("file", "block", "run"), ["file", "block", "run"]).drop("file", "block", "run")
    if not rest.isEmpty():
        pieces = between(spark, path).mapInArrow(cut, "file string, block long, run long, raw binary").join(rest, ["file", "block", "run"])
        records = records.unionByName(joined(pieces).select("raw").mapInArrow(bound, SCHEMA).select(*told, *derived))
    return records


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified: pages written as archives and read back.

    payload_bytes and payload_digest of a response are worked out from the payload read; a revisit has those of its
    header. verified: header and payload agree. page_id has to be a whole number (or a text of one: any other stops the job);
    null and equal ids are pages of their own; null html: empty; an empty table gives no rows; other columns are not read."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)

    own, full = F.col("record_type") == "response", F.regexp_replace("declared_digest", "^sha1:", "")
    seen = {"_digest": F.when(own, digest(F.col("payload"))).otherwise(full), "_bytes": F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("declared_bytes"))}
    back = read_warc(spark, path, seen)
    verified = F.coalesce((F.col("_digest") == full) & (F.col("_bytes") == F.col("declared_bytes")), F.lit(False))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return back.select(number("record_id").alias("page_id"), F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), verified.alias("verified"))
