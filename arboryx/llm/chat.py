"""Chat formatting by a declarative template, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns are written and which of them carry loss.

    A turn is ``open`` + role + ``head`` + text + ``close``. Inside roles and texts each character
    of ``specials`` is followed by a backslash, so no control string can occur there; reading back
    drops the backslash after each of them. ``moves`` is the finite-state machine: state -> role ->
    next state; a role without a move is a violation and leaves the state as it is.
    """

    open: str = "[TURN "
    head: str = "]\n"
    close: str = "</s>\n"
    specials: str = "[]<>\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def __post_init__(self):
        for control in (self.open, self.head, self.close):
            if not control or control[0] not in self.specials or ESCAPE in control:
                raise ValueError(f"a control string must begin with one of {self.specials!r} and hold no backslash: {control!r}")
        if len({self.open[0], self.head[0], self.close[0]}) < 3 or ESCAPE not in self.specials:
            raise ValueError("control strings must begin with different characters; the backslash is special itself")

    @property
    def _class(self) -> str:
        return "([" + "".join("\\" + c for c in self.specials) + "])"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._class, "$1\\\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._class + r"\\", "$1")


def _literal(pattern: str) -> str:
    return "".join(c if c.isalnum() or c == "\n" else "\\" + c for c in pattern)


def format_chat(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: (conv, n_turns, formatted, segments, valid, first_violation).

    ``segments`` is array<struct<text, loss>>: their texts joined are ``formatted``; loss is true
    for the text of a loss role alone, not for its marks. ``valid``: the machine accepts the order
    of roles and ends in a final state; ``first_violation`` is the index of the first turn without
    a move (null: none). Nothing is dropped for being invalid.

    Turns are ordered by turn, then role, then text, nulls first; equal rows each count. A null
    text is empty, a null role is the role ''. Rows without a conversation id form one of their own.
    """
    t = template or Template()
    row = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    sorted_turns = F.array_sort(F.collect_list(row), _by_turn)
    moves = F.create_map(*[F.lit(x) for s, to in t.moves.items() for r, nxt in to.items() for x in (f"{s}\x00{r}", nxt)])
    start = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))

    def step(acc, x):
        to = moves[F.concat(acc["state"], F.lit("\x00"), x["role"])]
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"),
            (acc["i"] + 1).alias("i"),
            F.coalesce(acc["bad"], F.when(to.isNull(), acc["i"])).alias("bad"),
        )

    def segments(x):
        mark = F.concat(F.lit(t.open), t.escape(x["role"]), F.lit(t.head))
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(t.escape(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    return (
        turns.groupBy(conv)
        .agg(sorted_turns.alias("_turns"))
        .withColumn("_end", F.aggregate("_turns", start, step))
        .withColumn("segments", F.flatten(F.transform("_turns", segments)))
        .select(
            conv,
            F.size("_turns").cast("long").alias("n_turns"),
            F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
            "segments",
            (F.col("_end.bad").isNull() & F.col("_end.state").isin(*t.final)).alias("valid"),
            F.col("_end.bad").alias("first_violation"),
        )
    )


def _by_turn(x, y):
    """Comparison of two turn structs: turn, role, text, nulls first."""

    def cmp(a, b):
        return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)

    first, second, third = (cmp(x[k], y[k]) for k in ("turn", "role", "text"))
    return F.when(first != 0, first).when(second != 0, second).otherwise(third)


def read_chat(formatted: Column, template: Template | None = None) -> Column:
    """The turns in a formatted conversation, as array<struct<role, text>>: the inverse of format_chat."""
    t = template or Template()
    parts = F.split(formatted, _literal(t.close))
    body = F.slice(parts, 1, F.size(parts) - 1)

    def one(s):
        marked = F.substr(s, F.lit(len(t.open) + 1))
        at = F.instr(marked, t.head)
        return F.struct(
            t.unescape(F.substr(marked, F.lit(1), at - 1)).alias("role"),
            t.unescape(F.substr(marked, at + len(t.head))).alias("text"),
        )

    return F.transform(body, one)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    t = template or Template()
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])))
