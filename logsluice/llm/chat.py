"""Chat formatting: conversations as one text each, proved by reparsing it.

Grammar of a formatted conversation, with ``name`` and ``body`` escaped::

    conversation = turn*
    turn         = "### " name ": " body "</turn>" "\\n"

A role of ROLE_NAMES has its own name; any other role is the hex digits of its text after "=". A
body holds no control string of CONTROL; a backslash escapes the character after it. Text is escaped only where it has to be: each turn is rendered
plainly and reparsed; where that gives back another turn, the control strings in it are broken
up by backslashes; where that still does not, backslashes are doubled, too. The last form cannot
hold a control string and always reads back.

Everything is DataFrame expressions: the turns are rendered row by row and one shuffle brings
a conversation's turns together, as its text is one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", "</turn>\n"
ROLE_NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
#: What no escaped text holds.
CONTROL = ("###", "</turn>")


def _plain(text: Column) -> Column:
    return text


def _broken_up(text: Column) -> Column:
    """A backslash inside each control string."""
    return F.replace(F.regexp_replace(text, "#(?=##)", "#\\\\"), F.lit("</turn>"), F.lit("<\\/turn>"))


def _doubled(text: Column) -> Column:
    return _broken_up(F.replace(text, F.lit("\\"), F.lit("\\\\")))


FORMS = (_plain, _broken_up, _doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_name(role: Column) -> Column:
    own = F.concat(F.lit("="), F.hex(role.cast("binary")))
    return reduce(lambda rest, r: F.when(role == r, ROLE_NAMES[r]).otherwise(rest), ROLE_NAMES, own)


def _role(name: Column) -> Column:
    own = F.decode(F.unhex(F.substring(name, 2, 1 << 30)), "UTF-8")
    return reduce(lambda rest, r: F.when(name == ROLE_NAMES[r], r).otherwise(rest), ROLE_NAMES, own)


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: role, text as escaped, text, and where the body starts in its turn."""

    def turn(frame: Column) -> Column:
        name = F.substring_index(F.substring(frame, len(HEAD) + 1, 1 << 30), COLON, 1)
        start = F.char_length(name) + len(HEAD) + len(COLON)
        body = F.substr(frame, start + 1)
        return F.struct(
            _role(name).alias("role"), body.alias("body"), unescape(body).alias("text"), start.alias("start")
        )

    frames = F.split(formatted, END)
    return F.transform(F.slice(frames, F.lit(1), F.size(frames) - 1), turn)


def _frame(name: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), name, F.lit(COLON), body, F.lit(END))


def _reads_back(frame: Column, role: Column, text: Column) -> Column:
    turns = parse(frame)
    clean = reduce(Column.__and__, (~F.contains(turns[0]["body"], F.lit(c)) for c in CONTROL))
    return (F.size(turns) == 1) & (turns[0]["role"] == role) & (turns[0]["text"] == text) & clean


def render_turns(turns: DataFrame, role: str = "role", text: str = "text", into: str = "frame") -> DataFrame:
    """Each row's turn as text, in the plainest form that reads back; a null role or text is empty."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    frame = _frame(_role_name(r), FORMS[-1](t))
    # A form is only tried where it can differ from the one before it.
    clashing = F.contains(t, F.lit("\\")) | reduce(
        Column.__or__, (F.contains(t, F.lit(c)) for c in CONTROL)
    )
    tried = frame
    for form in reversed(FORMS[:-1]):
        this = _frame(_role_name(r), form(t))
        tried = F.when(_reads_back(this, r, t), this).otherwise(tried)
    return turns.withColumn(into, F.when(clashing, tried).otherwise(_frame(_role_name(r), t)))


def format_conversations(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans``, ``round_trip``.

    Rows go by turn, nulls first; rows of one turn by role and text, so that repeated rows have
    one order. ``loss_spans`` are the assistant bodies as (turn, start, length), counted in
    code points from the start of their turn. ``round_trip`` tells whether the whole text reads
    back as its turns. Rows without a conversation form one. Other columns are not carried.
    """
    rendered = render_turns(
        turns.select(
            F.col(conversation).alias("conv_id"),
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
    )
    rows = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "frame"))).alias("rows"))
    whole = rows.withColumn("formatted", F.array_join(F.col("rows")["frame"], ""))
    parsed = whole.withColumn("parsed", parse(F.col("formatted")))
    pair = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    numbered = F.transform("parsed", lambda x, i: F.struct(i.alias("turn"), x["start"].alias("start"), F.char_length(x["body"]).alias("length"), x["role"].alias("role")))
    spans = F.transform(
        F.filter(numbered, lambda x: x["role"] == "assistant"),
        lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["length"].alias("length")),
    )
    return parsed.select(
        "conv_id",
        "formatted",
        spans.alias("loss_spans"),
        (F.transform("parsed", pair) == F.transform("rows", pair)).alias("round_trip"),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    frames = F.split(formatted, END)
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(F.get(frames, s["turn"]), s["start"] + 1, s["length"]))), ""
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of ``format_conversations``, taken from its text and mask alone."""
    turns = parse(F.col("formatted"))
    digest_input = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = formatted.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return loss.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(digest_input.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
