r"""Chat formatting with a grammar that is read back: render, reparse, compare, escape until identical.

Grammar (one conversation)::

    conversation = turn*
    turn         = "<turn " role [" esc"] ">\n" body "</turn>\n"

A body ends at the first ``</turn>`` line, so a text that holds control strings
may not come back.  Every turn is first rendered as it is and parsed; where the
turns found aren't the one that went in, the body is escaped (``\`` to ``\s``,
``<`` to ``\l``) and the header says so.  The whole conversation is then parsed
and compared again, and if anything still differs all its turns are escaped,
which leaves no control string in any body.  Roles are always escaped.

The training mask is the list of character spans of the bodies whose role
trains.  A conversation is one string, so all its turns meet in one row; nothing
else is grouped.

Defined cases: null text and null role are empty; turns are ordered by turn (null
last), then role and text; repeated turns stay; a null conversation id is a
conversation of its own; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _escape_role(x: Column) -> Column:
    return F.replace(F.replace(F.replace(escape(x), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n")), F.lit(" "), F.lit("\\_"))


def _unescape_role(x: Column) -> Column:
    for a, b in (("\\_", " "), ("\\n", "\n"), ("\\g", ">")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return unescape(x)


def render(role: Column, text: Column, escaped: bool) -> Column:
    return F.concat(F.lit("<turn "), _escape_role(role), F.lit(" esc>\n" if escaped else ">\n"), escape(text) if escaped else text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; null where it isn't of the grammar."""
    parts = F.split(formatted, END, -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.char_length(head) + 2)
        flagged = head.endswith(" esc>")
        role = F.substr(head, F.lit(7), F.char_length(head) - F.when(flagged, 11).otherwise(7))
        good = head.startswith("<turn ") & head.endswith(">") & (F.char_length(head) < F.char_length(p))
        return F.when(good, F.struct(_unescape_role(role).alias("role"), F.when(flagged, unescape(body)).otherwise(body).alias("text")))

    return F.when(F.element_at(parts, -1) == "", F.transform(turns, turn))


def format_conversations(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trains: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: id, formatted string, loss spans (start, length in characters) and the turns read back."""
    rows = turns.select(
        F.col(f"`{id}`").alias("id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    plain = parse(render(F.col("role"), F.col("text"), False))
    rows = rows.withColumn("safe", F.coalesce(plain == F.array(F.struct("role", "text")), F.lit(False)))
    rows = rows.withColumn("shown", F.when(F.col("safe"), render(F.col("role"), F.col("text"), False)).otherwise(render(F.col("role"), F.col("text"), True)))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text", "shown"))).alias("t"))
    whole = whole.withColumn("first", F.array_join(F.transform("t", lambda x: x["shown"]), ""))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    whole = whole.withColumn("same", F.coalesce(parse(F.col("first")) == source, F.lit(False)))
    whole = whole.withColumn("shown", F.transform("t", lambda x: F.when(F.col("same"), x["shown"]).otherwise(render(x["role"], x["text"], True))))
    whole = whole.withColumn("formatted", F.when(F.col("same"), F.col("first")).otherwise(F.array_join("shown", "")))
    whole = whole.select("id", "formatted", parse(F.col("formatted")).alias("turns"), F.zip_with("shown", "t", lambda s, x: F.struct(F.char_length(s).alias("n"), F.char_length(F.substring_index(s, "\n", 1)).alias("head"), x["role"].isin(*trains).alias("loss"))).alias("sizes"))
    starts = F.aggregate(
        F.col("sizes"),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["n"]).alias("at"),
            F.when(x["loss"], F.array_append(a["spans"], F.struct((a["at"] + x["head"] + 1).alias("start"), (x["n"] - x["head"] - 1 - len(END)).alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return whole.select("id", "formatted", "turns", starts.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, read from the formatted string and unescaped where its turn's header says so."""

    def one(s: Column) -> Column:
        body = F.substr(formatted, s["start"], s["length"])
        flagged = F.substr(formatted, s["start"] - 6, F.lit(6)) == " esc>\n"
        return F.when(flagged, unescape(body)).otherwise(body)

    return F.array_join(F.transform(spans, one), "")
