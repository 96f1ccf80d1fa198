"""Chat formatting: a declarative template, a machine over roles, segments with loss flags.

The template names its marks, the roles a turn may follow and the roles whose
text is trained on. The machine walks a conversation's roles, tells whether the
order is valid and where it breaks, and the formatter emits segments, each with
its own loss flag; the conversation is their concatenation. Control strings
inside texts are escaped, so marks stand for turns only, and parsing gives every
turn back unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessio.llm.base import text_of

START = "start"
OUTPUTS = ("n_turns", "valid", "broken_at", "segments", "formatted")


@dataclass(frozen=True)
class Template:
    """open + role + gap + text + close for each turn; follows maps a state to the roles allowed next."""

    open: str = "<|im_start|>"
    gap: str = "\n"
    close: str = "<|im_end|>\n"
    #: Every control string begins with this; it never occurs in an escaped text.
    control: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )


CHAT = Template()


def escaped(text: Column, template: Template = CHAT) -> Column:
    r"""Backslash becomes \b, and the control prefix's second half goes behind \p."""
    head, tail = template.control[:1], template.control[1:]
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit(head + tail), F.lit(head + "\\p"))


def unescaped(text: Column, template: Template = CHAT) -> Column:
    head, tail = template.control[:1], template.control[1:]
    return F.replace(F.replace(text, F.lit(head + "\\p"), F.lit(head + tail)), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column, template: Template = CHAT) -> Column:
    return F.replace(escaped(role, template), F.lit(template.gap), F.lit("\\n"))


def unescaped_role(role: Column, template: Template = CHAT) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit(template.gap)), template)


def broken_at(roles: Column, template: Template = CHAT) -> Column:
    """Index of the first turn that may not follow the one before it; -1 if the order is valid."""
    pairs = [f"{a}\x00{b}" for a, after in template.follows.items() for b in after]

    def step(state: Column, role: Column) -> Column:
        allowed = F.concat_ws("\x00", state["last"], role).isin(*pairs)
        return F.struct(
            role.alias("last"),
            (state["i"] + 1).alias("i"),
            F.when((state["bad"] < 0) & ~allowed, state["i"]).otherwise(state["bad"]).alias("bad"),
        )

    begin = F.struct(F.lit(START).alias("last"), F.lit(0).alias("i"), F.lit(-1).alias("bad"))
    return F.aggregate(roles, begin, step, lambda s: s["bad"])


def format_chats(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid, broken_at, segments, formatted.

    Turns go by turn, nulls first, ties by role and then text; repeated rows are
    turns of their own. Null roles and texts are empty. Conversations of an
    invalid order are formatted as well and say where they break. segments is an
    array of (text, loss): a turn gives its opening, its escaped text and its
    closing, and loss is true for texts of the loss roles alone.
    """
    turn = F.struct("turn", text_of("role").alias("role"), text_of("text").alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segments_of(t: Column) -> Column:
        role = escaped_role(t["role"], template)
        return F.array(
            F.struct(F.concat(F.lit(template.open), role, F.lit(template.gap)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    bad = broken_at(F.transform("turns", lambda t: t["role"]), template)
    parts = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), bad.alias("broken_at"), F.flatten(F.transform("turns", segments_of)).alias("segments"))
    return parts.select(
        "conv_id",
        "n_turns",
        (F.col("broken_at") < 0).alias("valid"),
        "broken_at",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def parsed_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, _quoted(template.close)), lambda b: b != "")

    def turn_of(block: Column) -> Column:
        body = F.substr(block, F.lit(len(template.open) + 1))
        at = F.instr(body, template.gap)
        return F.struct(
            unescaped_role(F.substr(body, F.lit(1), at - 1), template).alias("role"),
            unescaped(F.substr(body, at + len(template.gap)), template).alias("text"),
        )

    return F.transform(blocks, turn_of)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
