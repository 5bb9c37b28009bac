"""Chat formatting: a role automaton, a declarative template and loss flags.

A conversation is the rows of one conv_id ordered by turn. A finite-state
machine over the roles checks the order of turns; the template gives each turn
a head and a tail around its escaped text, and each piece is a segment with a
loss flag. Escaping percent-encodes the characters that control strings are
made of, so no text can forge a turn mark and it can be undone exactly. A role of the
input that reads like a display name gets a mark that no escaped text contains.

Defined results
- null text counts as empty, null role as the empty role; unknown roles are formatted under their own name, carry no loss and make the conversation invalid.
- rows that share conv_id and turn are ordered by role, then text; repeated rows are repeated turns; null turns come first.
- a null conv_id is a conversation of its own.
- an empty table gives an empty result; other input columns are ignored.
The turns of one conversation form one text and so one row; nothing else is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, which roles are learned from, and which order of roles is valid."""

    head: str = "### "
    head_end: str = ": "
    tail: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    #: state -> roles that may follow, each with the next state
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)
    #: '%' must be first here and is undone last.
    escapes: tuple[tuple[str, str], ...] = (("%", "%25"), ("#", "%23"), ("<", "%3C"), (":", "%3A"))
    #: Before a role that is some other role's display name.
    as_is: str = "%="

    def __post_init__(self) -> None:
        if len(set(self.names.values())) < len(self.names):
            raise ValueError("two roles have one display name")

    def shown(self, name: str) -> str:
        for a, b in self.escapes:
            name = name.replace(a, b)
        return name


DEFAULT = Template()


def escape(c: Column, template: Template = DEFAULT) -> Column:
    for a, b in template.escapes:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, template: Template = DEFAULT) -> Column:
    for a, b in reversed(template.escapes):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _role_name(role: Column, template: Template) -> Column:
    """The escaped display name, from which _role reads the role back."""
    out = F.when(role.isin(*template.names.values()), F.concat(F.lit(template.as_is), escape(role, template))).otherwise(escape(role, template))
    for a, b in template.names.items():
        out = F.when(role == a, F.lit(template.shown(b))).otherwise(out)
    return out


def _role(name: Column, template: Template) -> Column:
    out = unescape(F.when(F.startswith(name, F.lit(template.as_is)), F.substr(name, F.lit(len(template.as_is) + 1))).otherwise(name), template)
    for a, b in template.names.items():
        out = F.when(name == template.shown(b), F.lit(a)).otherwise(out)
    return out


def _valid(roles: Column, template: Template) -> Column:
    def move(state: Column, role: Column) -> Column:
        out = F.lit("error")
        for s, to in template.moves.items():
            for r, t in to.items():
                out = F.when((state == s) & (role == r), F.lit(t)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), move).isin(*template.final)


def format_chats(df: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, valid, segments array<struct<text, loss>>, formatted."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column) -> Column:
        name = _role_name(t["role"], template)
        return F.array(
            F.struct(F.concat(F.lit(template.head), name, F.lit(template.head_end)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.tail).alias("text"), F.lit(False).alias("loss")),
        )

    return (
        turns.withColumn("segments", F.flatten(F.transform("turns", pieces)))
        .withColumn("valid", _valid(F.col("turns.role"), template))
        .select("conv_id", "valid", "segments", F.array_join("segments.text", "").alias("formatted"))
    )


def parse_chats(df: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Reads format_chats output back: adds turns array<struct<role, text>> from the formatted text and loss_text from the segments."""
    marks = F.split(F.col("formatted"), _quoted(template.tail))

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.head) + 1))
        end = F.instr(body, template.head_end)
        role = _role(F.substring(body, F.lit(1), end - 1), template)
        return F.struct(role.alias("role"), unescape(F.substr(body, end + len(template.head_end)), template).alias("text"))

    full = F.slice(marks, F.lit(1), F.size(marks) - 1)  # after the last mark there is nothing
    learned = F.filter("segments", lambda s: s["loss"])
    return df.withColumn("turns", F.transform(full, turn)).withColumn("loss_text", F.array_join(F.transform(learned, lambda s: unescape(s["text"], template)), ""))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"
