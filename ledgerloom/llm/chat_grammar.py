r"""Chat formatting with a grammar round trip (operator 5), in DataFrame functions only.

The grammar:  conversation := turn*        turn := "<s>" role "\n" text "</s>"

A role has no "%", "<" or line feed: these are written %25, %3C and %0A. The parser splits at "</s>", takes the role up to the
first line feed, and takes one backslash out of every "<" backslashes "s>" or "<" backslashes "/s>" in a text. Rendering first
leaves texts as they are, parses the result and compares the turns with the source; where they differ, it renders again with
one backslash put into each such sequence, which the parser always undoes. Texts without conflict are thus never changed.

Defined cases: turns are ordered by (turn, role, text) with null turns first, so repeated rows are repeated turns; a null role
or text is the empty one; a null conv_id is a conversation; an empty conversation can't occur, no rows give no rows; other
columns are ignored. A conversation is one value: its text and its digest need all its turns in one place, so memory grows with
the longest conversation, not with the number of conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "<s>"
END = "</s>"
_PUT = r"<(\\*)(/?s>)"
_TAKE = r"<\\(\\*)(/?s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PUT, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.when(text.rlike(_TAKE), F.regexp_replace(text, _TAKE, "<$1$2")).otherwise(text)


def _role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column, escaped: bool) -> Column:
    """Turns, an array of structs (role, text), as one string."""
    one = lambda x: F.concat(F.lit(TURN), _role(x["role"]), F.lit("\n"), escape(x["text"]) if escaped else x["text"], F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation; of a string that isn't one, something that no source equals."""
    parts = F.split(formatted, END, -1)
    turns = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(x: Column) -> Column:
        at = F.locate("\n", x)
        return F.struct(_unrole(x.substr(F.lit(len(TURN) + 1), at - len(TURN) - 1)).alias("role"), unescape(x.substr(at + 1, F.length(x))).alias("text"))

    return F.transform(turns, one)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, escaped) per conversation of rows (conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    each = rows.select("conv_id", "turn", text("role"), text("text")).groupBy("conv_id").agg(turns.alias("t"))
    each = each.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    each = each.withColumn("plain", render(F.col("turns"), False))
    each = each.withColumn("same", F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)))
    return each.select("conv_id", F.when(F.col("same"), F.col("plain")).otherwise(render(F.col("turns"), True)).alias("formatted"), (~F.col("same")).alias("escaped"))


def read_back(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, turns, loss_text, formatted): the turns parsed and all text under the loss mask, that of trained_role."""
    parsed = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    under = F.transform(F.filter("turns", lambda x: x["role"] == trained_role), lambda x: x["text"])
    return parsed.select("conv_id", "turns", F.array_join(under, "").alias("loss_text"), "formatted")
