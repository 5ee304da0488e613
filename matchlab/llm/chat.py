"""Chat formatting with a grammar round trip (DataFrame functions only).

A turn is rendered as ``### Role: text`` + newline + ``</turn>`` + newline. The
control strings of this grammar are the role headers and ``</turn>``. A control
string right after one or more backslashes is text, and one of those backslashes
is the escape. Each turn is rendered as it is, read back by the parser and
compared with its source; a turn that differs is escaped and compared again.
The whole conversation is then parsed once more and must equal its source.

Defined cases: a null text is empty; a null role is the empty role; roles other
than user, assistant, system and tool are URL-encoded as ``role=...``. Rows go
by turn (null first); ties by role, then text; repeated rows are turns of their
own. A null conversation id is one conversation. An empty table gives no rows.
Extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("user", "assistant", "system", "tool")
CONTROL = r"(?:### (?:User|Assistant|System|Tool|role=[^\s:]*): |</turn>)"
TOKEN = r"(?<!\\)" + CONTROL
END = "\n</turn>\n"


def header(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    label = F.when(role.isin(*ROLES), F.initcap(role)).otherwise(F.concat(F.lit("role="), F.url_encode(role)))
    return F.concat(F.lit("### "), label, F.lit(": "))


def escape(text: Column) -> Column:
    """One more backslash before every control string, with those it has already."""
    return F.regexp_replace(text, r"(\\*)(" + CONTROL + ")", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)(" + CONTROL + ")", "$1$2")


def cut(rendered: Column) -> Column:
    """A rendered text at its control strings: array<struct<token, after>>, the first with an
    empty token and what precedes the first control string."""
    tokens = F.concat(F.array(F.lit("")), F.regexp_extract_all(rendered, F.lit(TOKEN), F.lit(0)))
    return F.arrays_zip(tokens.alias("token"), F.split(rendered, TOKEN, -1).alias("after"))


def turns(pieces: Column) -> Column:
    """The turns of a text that was ``cut``, as array<struct<role, text, body>>; null if it
    doesn't follow the grammar. ``body`` is the text as it stands, escaped."""
    right = F.forall(F.transform(pieces, lambda x, i: F.when(i == 0, x["after"] == "")
                                 .when(i % 2 == 1, x["token"].startswith("### ") & x["after"].endswith("\n"))
                                 .otherwise((x["token"] == "</turn>") & (x["after"] == "\n"))), lambda x: x)

    def role(head):
        label = F.regexp_extract(head, r"^### (.*): $", 1)
        return F.when(label.startswith("role="), F.url_decode(F.substring(label, 6, 2**31 - 1))).otherwise(F.lower(label))

    def turn(x):
        body = F.left(x["after"], F.char_length(x["after"]) - 1)
        return F.struct(role(x["token"]).alias("role"), unescape(body).alias("text"), body.alias("body"))

    return F.when((F.size(pieces) % 2 == 1) & right, F.transform(F.filter(pieces, lambda x, i: i % 2 == 1), turn))


def parse(rendered: Column) -> Column:
    """``turns`` of a rendered conversation."""
    return turns(cut(rendered))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_escaped (turns that needed an
    escape), loss_spans, the assistant bodies as [start, end) code points of
    ``formatted``, and turns, what the parser reads back from it. Fails if that isn't the
    source.

    A conversation is gathered into one row, as its one output text is; the
    number of conversations, not their size, is what a cluster spreads."""
    t = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("_turn"),
                    F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # the pieces are a column of their own, so that each text is searched once
    t = t.withColumn("_cut", cut(F.concat(header(F.col("_role")), F.col("_text"), F.lit(END))))
    same = F.array(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_text").alias("body")))
    t = t.withColumn("_plain", turns(F.col("_cut")).eqNullSafe(same)).drop("_cut")
    t = t.withColumn("_body", F.when(F.col("_plain"), F.col("_text")).otherwise(escape(F.col("_text"))))
    t = t.withColumn("_shown", F.concat(header(F.col("_role")), F.col("_body"), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    t = t.withColumn("_n", F.row_number().over(order))
    length = F.char_length("_shown")
    t = t.withColumn("_to", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END))
    span = F.struct((F.col("_to") - F.char_length("_body")).alias("start"), F.col("_to").alias("end"))
    g = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("_n", "_shown", "_role", "_text"))).alias("_t"),
        F.sum((~F.col("_plain")).cast("long")).alias("n_escaped"),
        F.array_sort(F.collect_list(F.when(F.col("_role") == "assistant", span))).alias("loss_spans"))
    formatted = F.array_join(F.transform("_t", lambda x: x["_shown"]), "")
    source = F.transform("_t", lambda x: F.struct(x["_role"].alias("role"), x["_text"].alias("text")))
    g = g.select("conv_id", formatted.alias("formatted"), "n_escaped", "loss_spans", source.alias("_source"))
    g = g.withColumn("_cut", cut(F.col("formatted"))).withColumn("turns", turns(F.col("_cut")))
    back = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    checked = F.when(back == F.col("_source"), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("not read back as its source: conversation "), F.col("conv_id").cast("string"))))
    return g.select("conv_id", checked.alias("formatted"), "n_escaped", "loss_spans", "turns")
