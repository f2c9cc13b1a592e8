"""Chat formatting, in DataFrame operations only: a state machine over roles and a declarative template.

Every turn becomes three segments: an opening mark, the escaped text, a closing mark; only the texts of roles
that the template marks for loss carry the loss flag.  Escaping puts a backslash behind the first character
of every control string inside a text (behind any backslashes that stand there already), so no text can hold
a mark, and taking one backslash out of each such place gives the text back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role: (opening mark, closing mark, loss).  Other roles are written between OTHER's marks, with their name.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
#: state>role: the next state.  A conversation is valid if every turn has a transition and it ends in one of ENDS.
MOVES = {"start>system": "system", "start>user": "user", "system>user": "user", "user>assistant": "assistant", "assistant>user": "user"}
ENDS = ("assistant",)


def control_strings(template: dict = TEMPLATE) -> list[str]:
    return [*(m for o, c, _ in template.values() for m in (o, c)), *OTHER]


def _inner(template: dict) -> str:
    heads = sorted({m[0] for m in control_strings(template)})
    return f"([{re.escape(''.join(heads))}])(\\\\*)({'|'.join(re.escape(m[1:]) for m in control_strings(template))})"


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    return F.regexp_replace(text, _inner(template), r"$1$2\\$3")


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    return F.regexp_replace(text, _inner(template).replace(r"(\\*)", r"(\\*)\\"), "$1$2$3")


def format_chats(rows: DataFrame, template: dict = TEMPLATE, moves: dict = MOVES, ends=ENDS) -> DataFrame:
    """One row per conv_id: formatted, segments (text, loss), n_turns, valid, first_bad (turn number from 0).

    Rows stand in order of turn, then role and text (nulls first); null roles and texts count as empty;
    repeated rows are turns of their own; rows without conv_id form one conversation.  Conversations whose
    turn order the state machine refuses are formatted all the same, with valid false.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    table = F.create_map(*(F.lit(x) for kv in moves.items() for x in kv))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(-1).alias("bad"))

    def move(at, t):
        to = F.try_element_at(table, F.concat(at.state, F.lit(">"), t.role))
        bad = F.when((at.bad < 0) & to.isNull(), at.n).otherwise(at.bad)
        return F.struct(F.coalesce(to, t.role).alias("state"), (at.n + 1).alias("n"), bad.alias("bad"))

    def marks(t, end):
        out = F.lit(OTHER[2]) if end else F.concat(F.lit(OTHER[0]), escape(t.role, template), F.lit(OTHER[1]))
        for role, mark in template.items():
            out = F.when(t.role == role, F.lit(mark[end])).otherwise(out)
        return out

    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    trained = [r for r, m in template.items() if m[2]]
    cut3 = lambda t: F.array(piece(marks(t, 0), F.lit(False)), piece(escape(t.text, template), t.role.isin(trained)), piece(marks(t, 1), F.lit(False)))
    walked = grouped.select("conv_id", F.aggregate("turns", start, move).alias("end"), F.flatten(F.transform("turns", cut3)).alias("segments"))
    bad = F.when(F.col("end.bad") >= 0, F.col("end.bad")).when(~F.col("end.state").isin(*ends), F.col("end.n"))
    return walked.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments",
                         F.col("end.n").cast("long").alias("n_turns"), bad.isNull().alias("valid"), bad.alias("first_bad"))


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    forms = [f"{re.escape(o)}(?s:.*?){re.escape(c)}" for o, c, _ in template.values()]
    forms.append("(?s:.*?)".join(map(re.escape, OTHER)))
    found = F.regexp_extract_all(formatted, F.lit("|".join(forms)), F.lit(0))

    def turn(whole):
        inside = F.substring_index(F.substring(whole, F.lit(len(OTHER[0]) + 1), F.length(whole) - len(OTHER[0]) - len(OTHER[2])), OTHER[1], 1)
        skip = F.length(inside) + len(OTHER[0]) + len(OTHER[1])
        role, text = unescape(inside, template), F.substring(whole, skip + 1, F.length(whole) - skip - len(OTHER[2]))
        for name, (o, c, _) in template.items():
            here = F.startswith(whole, F.lit(o))
            role = F.when(here, F.lit(name)).otherwise(role)
            text = F.when(here, F.substring(whole, F.lit(len(o) + 1), F.length(whole) - len(o) - len(c))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    return F.transform(found, turn)


def loss_text(segments: Column, template: dict = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text, template)), "")
