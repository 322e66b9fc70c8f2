"""Chat formatting: a finite-state machine over roles checks turn order while a declarative template turns each
turn into text segments with loss flags.

Control strings inside texts are escaped: where the first character of the template's start or end, any number of
backslashes and its second character follow each other, one more backslash goes after the first, so that the two
stand together only where the template put them; taking one backslash off gives the text back.

Rows: turns are formatted in the order of turn (null first), then role and text for ties; repeated rows are
turns of their own. A null role or text counts as empty. Rows without conv_id form one conversation. A
conversation with an order that the machine doesn't allow is formatted all the same and marked invalid. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    learned: frozenset[str] = frozenset({"assistant"})
    #: From a state (the last role, "" at the start) to the roles that may follow; those of `last` may end.
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant", "tool"}),
        }
    )
    last: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        marks = sorted({x[:2] for x in (self.start, self.end)})
        if any(len(x) < 2 or "\\" in x for x in marks):
            raise ValueError("start and end need two characters first that aren't backslashes")
        either = lambda extra: re.compile("|".join(f"{re.escape(x[0])}{extra}(?=\\\\*{re.escape(x[1])})" for x in marks))
        object.__setattr__(self, "_control", either(""))
        object.__setattr__(self, "_escaped", either(r"\\"))

    def escape(self, text: str) -> str:
        return self._control.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][:-1], text)

    def escape_role(self, role: str) -> str:
        role = role.replace("%", "%25")
        for c in dict.fromkeys(self.after_role):
            role = role.replace(c, f"%{ord(c):02X}") if c not in "%25" else role
        return self.escape(role)

    def unescape_role(self, role: str) -> str:
        role = self.unescape(role)
        for c in dict.fromkeys(self.after_role):
            role = role.replace(f"%{ord(c):02X}", c) if c not in "%25" else role
        return role.replace("%25", "%")

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's segments, each with its loss flag."""
        return [(self.start + self.escape_role(role) + self.after_role, False), (self.escape(text), role in self.learned), (self.end, False)]

    def allows(self, before: str, role: str) -> bool:
        return role in self.follows.get(before, ())

    def read(self, segments: list[tuple[str, bool]]) -> tuple[str, str, str]:
        """Role, text and text under the loss mask, from one turn's formatted segments."""
        whole = "".join(s for s, _ in segments)
        head, _, body = whole[len(self.start) :].partition(self.after_role)
        text = self.unescape(body[: len(body) - len(self.end)])
        return self.unescape_role(head), text, "".join(self.unescape(s) for s, loss in segments if loss)


SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: conv_id, turn, segments (text, loss), in_order (this turn may follow the one before).
    Each partition is read as a stream, in order; only the last role is kept between rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (object(), "")
        for x in batches:
            segments, in_order = [], []
            for conv, role, text in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist()):
                before = last[1] if conv == last[0] else ""
                in_order.append(template.allows(before, role))
                segments.append([{"text": s, "loss": loss} for s, loss in template.segments(role, text)])
                last = (conv, role)
            yield pa.record_batch([x.column(0), x.column(1), pa.array(segments, SEGMENTS), pa.array(in_order, pa.bool_())], names=["conv_id", "turn", "segments", "in_order"])

    kinds = dict(conversations.dtypes)
    return _sorted(conversations).mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, segments array<struct<text:string,loss:boolean>>, in_order boolean")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, from the rows of format_turns in their partitions and order: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, valid. Digests grow turn by turn, so a conversation
    of any length needs the memory of one turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        now: list | None = None
        done: list[tuple] = []

        def closed() -> None:
            if now is not None:
                conv, n, turns, chars, loss, formatted, ok, role = now
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, ok and role in template.last))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 7
            done.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=names)

        for x in batches:
            kind = x.schema.field(0).type
            for conv, segments, in_order in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist()):
                if now is None or now[0] != conv:
                    closed()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""]
                role, text, learned = template.read([(s["text"], s["loss"]) for s in segments])
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now[3] += len(learned)
                now[4].update(learned.encode("utf-8", "surrogatepass"))
                now[5] += sum(len(s["text"]) for s in segments)
                now[6] &= in_order
                now[7] = role
            if len(done) > 5000:
                yield out()
        closed()
        if done:
            yield out()

    kind_of = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(run, f"conv_id {kind_of}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
