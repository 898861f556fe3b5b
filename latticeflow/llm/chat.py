"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

The template gives each role an opening and a closing mark and says whether its text carries loss.  Texts
can hold the template's control strings; a backslash after the first character of each such occurrence
(and after each backslash) breaks them, so that marks are only marks, and reading back undoes it.

Defined cases: null text and null role are empty; a role that the template doesn't know is written with its
name in the ``other`` marks; turns are ordered by number (null first), then role, then text, so that ties
and repeated rows, which all stay, have a fixed order; a conversation with a null id is one conversation;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RoleMarks:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, and the role changes that are in order; ``start`` and ``end`` are the machine's ends.

    Marks must begin with ``<`` or ``[``, hold these characters nowhere else, hold no backslash, and none may
    be the beginning of another; so no text and mark can make a mark together.
    """

    roles: dict[str, RoleMarks] = field(
        default_factory=lambda: {
            "system": RoleMarks("<|system|>", "<|end_system|>"),
            "user": RoleMarks("[INST]", "[/INST]"),
            "assistant": RoleMarks("<|reply|>", "</s>", loss=True),
        }
    )
    other: RoleMarks = RoleMarks("<|turn|>", "<|end_turn|>")
    name_end: str = "<|says|>"
    begin: str = "<s>"
    moves: tuple[tuple[str, str], ...] = (("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"), ("assistant", "end"))

    def __post_init__(self):
        marks = self.marks
        for m in marks:
            if m[0] not in "<[" or re.search(r"[<\[\\]", m[1:]) or sum(x.startswith(m) for x in marks) != 1:
                raise ValueError(f"the mark {m!r} is ambiguous")

    @property
    def marks(self) -> list[str]:
        return [self.begin, self.name_end, *(x for r in [*self.roles.values(), self.other] for x in (r.opening, r.closing))]

    def escape(self, text: Column) -> Column:
        firsts = "|".join(f"{re.escape(m[0])}(?={_java(m[1:])})" for m in self.marks)
        return F.regexp_replace(text, F.lit(rf"\\|{firsts}"), F.lit(r"$0\\"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(r"([\\<\[])\\"), F.lit("$1"))


def _java(text: str) -> str:
    return "".join(c if c.isalnum() else rf"\x{{{ord(c):x}}}" for c in text)


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: ``valid`` (the role machine's answer), ``n_turns`` and ``segments``, an array of
    structs (text, loss) whose texts joined make the formatted conversation."""
    t = template or Template()
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("row"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in t.moves])
    name = lambda role: F.when(role.isin(list(t.roles)), role).otherwise("other")
    step = lambda state, row: F.when(F.array_contains(allowed, F.concat(state, F.lit(">"), name(row["role"]))), name(row["role"])).otherwise("error")
    state = F.aggregate("rows", F.lit("start"), step)
    valid = F.array_contains(allowed, F.concat(state, F.lit(">end")))

    def turn(row: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
        body = t.escape(row["text"])
        made = F.array(seg(F.concat(F.lit(t.other.opening), t.escape(row["role"]), F.lit(t.name_end)), False), seg(body, t.other.loss), seg(F.lit(t.other.closing), False))
        for role, m in t.roles.items():
            made = F.when(row["role"] == role, F.array(seg(F.lit(m.opening), False), seg(body, m.loss), seg(F.lit(m.closing), False))).otherwise(made)
        return made

    first = F.array(F.struct(F.lit(t.begin).alias("text"), F.lit(False).alias("loss")))
    return chats.select("conv_id", F.size("rows").cast("long").alias("n_turns"), F.coalesce(valid, F.lit(False)).alias("valid"), F.concat(first, F.flatten(F.transform("rows", turn))).alias("segments"))


def formatted(found: DataFrame) -> DataFrame:
    """Adds ``text``, the formatted conversation, to what :func:`segments` returns."""
    return found.withColumn("text", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(text: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation as an array of structs (role, text)."""
    t = template or Template()
    closings = [r.closing for r in [*t.roles.values(), t.other]]
    bodies = F.split(F.substring(text, F.lit(len(t.begin) + 1), F.length(text)), "|".join(map(_java, closings)))
    turns = F.slice(bodies, F.lit(1), F.size(bodies) - 1)

    def turn(x: Column) -> Column:
        rest = lambda n: F.substring(x, F.lit(n + 1), F.length(x))
        named = rest(len(t.other.opening))
        at = F.instr(named, t.name_end)
        made = F.struct(t.unescape(F.substring(named, F.lit(1), at - 1)).alias("role"), t.unescape(F.substring(named, at + len(t.name_end), F.length(named))).alias("text"))
        for role, m in t.roles.items():
            made = F.when(F.startswith(x, F.lit(m.opening)), F.struct(F.lit(role).alias("role"), t.unescape(rest(len(m.opening))).alias("text"))).otherwise(made)
        return made

    return F.transform(turns, turn)


def digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted output says, read back from it: turns, loss text, and their digests."""
    t = template or Template()
    done = formatted(segments(turns, t))
    back = done.withColumn("turns", read_back(F.col("text"), t))
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.withColumn("loss_text", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(spoken).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"), "valid"
    )
