"""Chat formatting by a grammar that reads back: turns are marked by control strings, and what a text holds of them is escaped.

A turn is rendered with its texts as they are and read back by a strict parser. Where what comes back is not the turn,
the part in conflict is escaped and the turn is read again, until both are identical. A turn's marks close themselves, so
turns that read back alone do so in a row.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches


class Malformed(ValueError):
    """A text that the grammar doesn't derive."""


@dataclass(frozen=True)
class Template:
    """turn := opening role middle text closing. reserved: control strings that no turn uses, but that no text may hold either.

    Escaping puts a backslash after the first character of a control string, and one more where there are some already."""

    opening: str
    middle: str
    closing: str
    reserved: tuple[str, ...] = ()

    def __post_init__(self):
        if len({self.opening, self.middle, self.closing, *self.reserved}) != 3 + len(self.reserved):
            raise ValueError("the control strings must differ")
        for a in self.controls:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"a control string has two characters at least and no backslash: {a!r}")
            for b in self.controls:
                if a != b and a in b or any(b.startswith(a[k:]) for k in range(1, len(a))):
                    raise ValueError(f"the control strings {a!r} and {b!r} can overlap")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.opening, self.middle, self.closing, *self.reserved

    @cached_property
    def control(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.controls)))

    @cached_property
    def likeness(self) -> re.Pattern:
        """A control string with any number of backslashes after its first character."""
        return re.compile("|".join(f"(?<={re.escape(c[0])})(?=\\\\*{re.escape(c[1:])})" for c in self.controls))

    @cached_property
    def escaped(self) -> re.Pattern:
        return re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in self.controls))

    def escape(self, text: str) -> str:
        return self.likeness.sub("\\\\", text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub("", text) if "\\" in text else text

    def render(self, role: str, text: str) -> str:
        return f"{self.opening}{role}{self.middle}{text}{self.closing}"

    def read(self, formatted: str) -> tuple[list[tuple[str, str]], str]:
        """All whole turns at the start of a text, unescaped, and what is left, the start of a turn or nothing."""
        turns, at, end, parts, due = [], 0, 0, [], (self.opening, self.middle, self.closing)
        for m in self.control.finditer(formatted):
            if m[0] != due[len(parts)] or not parts and m.start() != at:
                raise Malformed(f"{m[0]!r} at {m.start()}, where {due[len(parts)]!r} was due")
            if parts:
                parts.append(self.unescape(formatted[at : m.start()]))
            else:
                parts.append("")
            at = m.end()
            if len(parts) == 3:
                turns.append((parts[1], parts[2]))
                parts, end = [], at
        return turns, formatted[end:]

    def format(self, role: str, text: str) -> tuple[str, int, int]:
        """The formatted turn, and from where to where in it the text lies."""
        for r, t in ((role, text), (role, self.escape(text)), (self.escape(role), text), (self.escape(role), self.escape(text))):
            out = self.render(r, t)
            try:
                if self.read(out) == ([(role, text)], ""):
                    at = len(self.opening) + len(r) + len(self.middle)
                    return out, at, at + len(t)
            except Malformed:
                pass
        raise Malformed(f"no form of this turn reads back: {role!r}")


INSTRUCT = Template("[INST]", "[/INST]", "</s>", ("<s>",))
MESSAGES = Template("<|im_start|>", "<|im_sep|>", "<|im_end|>", ("<|endoftext|>",))


def format_turns(turns: DataFrame, template: Template = INSTRUCT, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each turn formatted, where it stands: conv_id, turn, role, formatted, loss_start and loss_end (code points of the loss mask
    in `formatted`, equal where there is none). A conversation's text is its turns' in a row.

    Null role or text: empty. Other columns than conv_id, turn, role and text are not read; an empty table gives no rows."""
    batches(turns.sparkSession, 1000)
    source = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = dict(source.dtypes)

    def run(rows):
        for batch in rows:
            roles = batch.column("role").to_pylist()
            made = [template.format(r, t) for r, t in zip(roles, batch.column("text").to_pylist())]
            ends = [z if r in loss_roles else a for r, (_, a, z) in zip(roles, made)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64()), pa.array(ends, pa.int64())], ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"])

    return source.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, formatted string, loss_start long, loss_end long")


def conversation_texts(formatted: DataFrame) -> DataFrame:
    """conv_id, text (all its turns formatted) and loss_spans, as a training job reads them: a conversation has to fit a row."""
    rows = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "formatted", "loss_start", "loss_end"))).alias("rows"))
    before = F.transform("rows", lambda _, k: F.aggregate(F.slice("rows", F.lit(1), k), F.lit(0).cast("long"), lambda n, x: n + F.length(x["formatted"])))
    placed = F.zip_with("rows", before, lambda x, n: F.struct((x["loss_start"] + n).alias("start"), (x["loss_end"] + n).alias("end")))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda x: x["formatted"]), "").alias("text"), F.filter(placed, lambda x: x["end"] > x["start"]).alias("loss_spans"))


class Reader:
    """Reads one conversation's text as it comes; keeps digests and the start of an unfinished turn only."""

    def __init__(self, template: Template):
        self.template, self.rest = template, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, text: str, start: int, end: int) -> None:
        """The next part of the text, and the loss mask in it."""
        found, self.rest = self.template.read(self.rest + text)
        for role, said in found:
            self.turns.update(f"{role}\n{said}\n".encode())
        masked = self.template.unescape(text[start:end])
        self.loss.update(masked.encode())
        self.n_turns, self.loss_chars, self.chars = self.n_turns + len(found), self.loss_chars + len(masked), self.chars + len(text)

    def result(self) -> tuple:
        if self.rest:
            raise Malformed("a conversation ends within a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the formatted conversations say: conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn),
    loss_chars, loss_sha256 (all text under the loss mask, unescaped) and formatted_chars.

    A conversation's rows are read in order of turn (null first), rows of one turn in that of their formatted texts; rows of null
    conv_id are one conversation. They stream through a task that keeps digests only, however long the conversation is."""
    kind = dict(formatted.dtypes)["conv_id"]
    dealt = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(rows):
        now, reader, id_type, out = None, None, None, []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], id_type), *(pa.array([x[k] for x in out], pa.string() if k in (2, 4) else pa.int64()) for k in range(1, 6))], names)
            out.clear()
            return batch

        for batch in rows:
            id_type = batch.schema.field("conv_id").type
            for conv, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if reader is None or conv != now:
                    if reader is not None:
                        out.append((now, *reader.result()))
                    now, reader = conv, Reader(template)
                reader.feed(text, start, end)
            if out:
                yield flush()
        if reader is not None:
            out.append((now, *reader.result()))
            yield flush()

    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
