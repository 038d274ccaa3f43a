r"""Chat formatting with a grammar round trip, in SQL functions only.

A turn is rendered as ``### Label: body\n</turn>\n``. Label is User, Assistant, System or Tool, or ``=`` and the role
itself with ``\ : #`` and line ends escaped. The parser is deterministic: it splits at the terminator, reads the label
up to the first ``: ``, refuses a body that holds an unescaped control string (``### `` or ``</turn>``) and takes one
backslash from every escaped one. Each turn is first rendered as it is and parsed again; where the turn that comes
back differs from the source, its control strings get one more backslash. The whole conversation is parsed once more
and must be identical to its source, or the query fails.

Nulls: a null role or text counts as empty; rows with a null conv_id form a conversation of their own. Turns with equal
numbers are ordered by role, then text; repeated rows stay. Columns other than the four are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "\n</turn>\n"
KNOWN = ("user", "assistant", "system", "tool")
CONTROL = r"(### |</turn>)"
HEADER = r"(?s)^### (User|Assistant|System|Tool|=[^:#\n\r]*): (.*)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + CONTROL, "$1$2")


_ROLE = (("\\", "\\b"), (":", "\\c"), ("#", "\\h"), ("\n", "\\n"), ("\r", "\\r"))


def label_of(role: Column) -> Column:
    own = role
    for a, b in _ROLE:
        own = F.replace(own, F.lit(a), F.lit(b))
    return F.when(role.isin(*KNOWN), F.initcap(role)).otherwise(F.concat(F.lit("="), own))


def role_of(label: Column) -> Column:
    # every backslash of a label starts an escape of two characters, so the order of replacement is safe
    own = F.substr(label, F.lit(2))
    for a, b in (*_ROLE[1:], _ROLE[0]):
        own = F.replace(own, F.lit(b), F.lit(a))
    return F.when(F.startswith(label, F.lit("=")), own).otherwise(F.lower(label))


def render(label: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), label, F.lit(": "), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>; an entry is null where a segment is no turn."""
    parts = F.split(formatted, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(s: Column) -> Column:
        body = F.regexp_extract(s, HEADER, 2)
        good = s.rlike(HEADER) & ~body.rlike(r"(?<!\\)" + CONTROL)
        return F.when(good, F.struct(role_of(F.regexp_extract(s, HEADER, 1)).alias("role"), unescape(body).alias("text")))

    return F.transform(parts, turn)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted string, loss_spans array<struct<start, end>>): a row for each conversation.

    loss_spans are the places (code points, end exclusive) of the assistant's bodies in ``formatted``.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("label", label_of(F.col("role")))
    same = F.coalesce(parse(render(F.col("label"), F.col("text"))) == F.array(F.struct("role", "text")), F.lit(False))
    t = t.withColumn("body", F.when(same, F.col("text")).otherwise(escape(F.col("text"))))
    t = t.withColumn("part", render(F.col("label"), F.col("body")))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("till", F.sum(F.char_length("part").cast("long")).over(w))
    end = F.col("till") - len(END)
    span = F.when(F.col("label") == "Assistant", F.struct((end - F.char_length("body")).alias("start"), end.alias("end")))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("till", "part", "role", "text", span.alias("span")))).alias("ts"))
    formatted = F.array_join(F.transform("ts", lambda x: x["part"]), "")
    spans = F.filter(F.transform("ts", lambda x: x["span"]), lambda s: s.isNotNull())
    c = c.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), F.transform("ts", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    c = c.withColumn("turns", parse(F.col("formatted")))
    checked = F.when(F.coalesce(F.col("turns") == F.col("source"), F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("round trip differs in conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return c.select("conv_id", checked.alias("formatted"), "loss_spans")


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted text and its loss spans."""
    d = formatted.withColumn("turns", parse(F.col("formatted")))
    d = d.withColumn("loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""))
    every = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
