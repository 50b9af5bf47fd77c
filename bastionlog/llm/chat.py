"""Chat formatting by a declarative template; DataFrame functions only.

A template names its control strings, the roles whose texts are learnt, and the turn order as a table of
a finite-state machine over roles. A conversation becomes text segments with a loss flag each: what opens
the turn, the text, what closes it. Control strings inside roles and texts are escaped so that the
formatted text alone gives the turns back.

Cases: null texts and null roles are empty. Turns come in order of turn, nulls first; ties by role, then
text. Repeated rows are turns of their own. A null conv_id is a conversation like others. Conversations
that break the turn order are formatted too and carry ``valid`` false. Columns other than conv_id, turn,
role and text are not looked at.

A conversation's output is one text, so one group holds it whole; nothing else is gathered in a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, learnt roles and turn order; state 0 is the start, a missing move is an error."""

    open: str = "### "
    head_end: str = ": "
    close: str = "</turn>\n"
    #: What stands for parts of texts, plain one first. In every escaped text a backslash is followed by a
    #: letter that says what it stands for, and neither ``open`` nor ``close`` is left.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\e"), ("</turn>", "<\\t/turn>"), ("##", "#\\h#"))
    role_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    learnt: tuple[str, ...] = ("assistant",)
    order: dict[tuple[int, str], int] = field(
        default_factory=lambda: {(0, "system"): 1, (0, "user"): 2, (1, "user"): 2, (2, "assistant"): 3, (3, "user"): 2}
    )
    final: tuple[int, ...] = (2, 3)


TEMPLATE = Template()


def escaped(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def valid_order(roles: Column, template: Template) -> Column:
    """Run the machine over an array of roles."""
    moves = F.create_map(*(F.lit(x) for (state, role), to in template.order.items() for x in (f"{state} {role}", to)))
    step = lambda state, role: F.coalesce(F.element_at(moves, F.concat_ws(" ", state.cast("string"), role)), F.lit(-1))
    return F.aggregate(roles, F.lit(0), step).isin(*template.final)


def segments(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): conv_id, valid, segments (text, loss)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    of_turn = lambda t: F.array(
        segment(
            F.concat(F.lit(template.open), escaped(t["role"], template.escapes + template.role_escapes), F.lit(template.head_end)),
            F.lit(False),
        ),
        segment(escaped(t["text"], template.escapes), t["role"].isin(*template.learnt)),
        segment(F.lit(template.close), F.lit(False)),
    )
    return turns.select(
        "conv_id",
        valid_order(F.transform("turns", lambda t: t["role"]), template).alias("valid"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = TEMPLATE) -> Column:
    """array<struct(role, text)> from a formatted conversation alone."""
    pieces = F.split(text, f"\\Q{template.close}\\E", -1)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    begin = len(template.open) + 1

    def turn(piece: Column) -> Column:
        mark = F.locate(template.head_end, piece)
        role = piece.substr(F.lit(begin), mark - begin)
        said = piece.substr(mark + len(template.head_end), F.char_length(piece))
        return F.struct(
            unescaped(role, template.escapes + template.role_escapes).alias("role"),
            unescaped(said, template.escapes).alias("text"),
        )

    return F.transform(whole, turn)


def learnt_text(turns: Column, template: Template = TEMPLATE) -> Column:
    """What is learnt of turns read back from a formatted text: the learnt roles' texts, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"].isin(*template.learnt)), lambda t: t["text"]), "")


def flagged_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """The segments with a loss flag, unescaped, nothing between: the same as ``learnt_text`` of what is read back."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescaped(s["text"], template.escapes)), "")


def conversation_digests(made: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What a reader of the formatted text alone finds: conv_id, n_turns, digests of turns and learnt text, lengths;
    and ``valid`` of the segments."""
    read = (
        made.select("conv_id", "valid", formatted(F.col("segments")).alias("whole"))
        .select("*", read_turns(F.col("whole"), template).alias("turns"))
        .select("*", learnt_text(F.col("turns"), template).alias("learnt"))
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("whole").cast("long").alias("formatted_chars"),
        "valid",
    )


def probe(spark: SparkSession) -> DataFrame:
    """A conversation whose texts hold control strings."""
    hard = "\\### Assistant: </turn> ok"
    return spark.sql("SELECT -7L AS conv_id, i AS turn, element_at(array('user', 'assistant'), i + 1) AS role, :t AS text FROM (SELECT explode(array(0, 1)) AS i)", {"t": hard})
