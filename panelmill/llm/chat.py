"""Operator 7: chat formatting with a grammar round trip. DataFrame functions only.

Grammar: ``conversation = turn*``, ``turn = "### " role ": " text "</turn>" "\\n"``; within role and text
``\\x`` stands for ``x`` (a backslash that ends them, for itself), and neither holds an unescaped ``"### "``. The
parser rejects what the grammar does not produce. Every turn is first rendered as it is and parsed; where the
parse is not exactly the source turn, its control strings and backslashes are escaped. The whole
conversation is then parsed again; should it still differ, every turn is escaped, and a last difference is an error.

Results: the formatted text, the loss mask (character spans of the assistants' texts) and, for checks,
the turns read back from the formatted text.

Defined cases: a null role or text counts as empty; turns order by ``turn`` (nulls first), ties by role
and text, so repeated rows are repeated turns; an empty table gives no rows; extra columns are ignored.
One conversation is one row, so it must fit a task, as its formatted text must fit one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, COLON, END = "### ", ": ", "</turn>\n"


def escape_text(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(text, F.lit("### "), F.lit("#\\## "))


def escape_role(role: Column) -> Column:
    return F.replace(escape_text(role), F.lit(COLON), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?s:(.))", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: ``array<struct<role, text, start, length>>``; start and length, in code
    points, are the place of the (still escaped) text. Null for what the grammar does not produce."""
    pieces = F.split(formatted, r"</turn>\n", -1)
    parts = F.slice(pieces, 1, F.size(pieces) - 1)
    well_formed = (F.element_at(pieces, -1) == "") & F.forall(
        parts, lambda p: F.startswith(p, F.lit(HEAD)) & (F.instr(p, COLON) > 0) & (F.instr(F.substr(p, F.lit(2)), HEAD) == 0)
    )

    def turn(part: Column) -> Column:
        colon = F.instr(part, COLON)
        body = F.substr(part, colon + len(COLON))
        return F.struct(
            unescape(F.substr(part, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)).alias("role"),
            unescape(body).alias("text"),
            (colon + len(COLON) - 1).alias("start"),
            F.length(body).alias("length"),
            F.length(part).alias("whole"),
        )

    turns = F.transform(parts, turn)
    # start so far counts from the turn's own beginning: add the lengths of the turns before it
    ends = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda so_far, t: F.struct((so_far.at + t.whole + len(END)).alias("at"), F.concat(so_far.all, F.array(so_far.at)).alias("all")),
        lambda so_far: so_far.all,
    )
    return F.when(well_formed, F.zip_with(turns, ends, lambda t, at: F.struct(t.role.alias("role"), t.text.alias("text"), (t.start + at).alias("start"), t.length.alias("length"))))


def _turns(column: str) -> Column:
    return F.transform(column, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv id, ``formatted``, ``loss_spans`` (start and length in code points) and
    ``recovered`` (role, text and span of each turn, read back from ``formatted``)."""
    rows = df.select(
        F.col(conv_col).alias("_conv"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("_role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    plain = render(F.col("_role"), F.col("_text"))
    escaped = render(escape_role(F.col("_role")), escape_text(F.col("_text")))
    # What a turn needs to parse back: no terminator within, no colon before its own, no escape to undo.
    back = parse(F.col("_plain"))
    alike = F.coalesce((F.size(back) == 1) & (back[0].role == F.col("_role")) & (back[0].text == F.col("_text")), F.lit(False))
    suspect = F.contains(F.col("_text"), F.lit("\\")) | F.contains(F.col("_text"), F.lit("</turn>")) | F.contains(F.col("_text"), F.lit(HEAD)) | F.col("_role").rlike(r"[\\:#<]")
    rows = rows.withColumn("_plain", plain).withColumn(
        "_line", F.when(~suspect, F.col("_plain")).when(alike, F.col("_plain")).otherwise(escaped)
    )
    whole = rows.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_turn", F.col("_role").alias("role"), F.col("_text").alias("text"), "_line"))).alias("_rows"))
    whole = whole.withColumn("_first", F.array_join(F.transform("_rows", lambda t: t["_line"]), ""))
    whole = whole.withColumn("_back", parse(F.col("_first")))
    same = F.coalesce(_turns("_back") == _turns("_rows"), F.lit(False))
    all_escaped = F.array_join(F.transform("_rows", lambda t: render(escape_role(t.role), escape_text(t.text))), "")
    whole = whole.withColumn("formatted", F.when(same, F.col("_first")).otherwise(all_escaped))
    whole = whole.withColumn("recovered", F.when(same, F.col("_back")).otherwise(parse(F.col("formatted"))))
    failed = F.raise_error(F.lit("a formatted conversation does not parse back to its turns")).cast(T.StringType())
    whole = whole.withColumn("formatted", F.when(F.coalesce(_turns("recovered") == _turns("_rows"), F.lit(False)), F.col("formatted")).otherwise(failed))
    masked = F.filter("recovered", lambda t: t.role == loss_role)
    return whole.select(
        F.col("_conv").alias(conv_col),
        "formatted",
        F.transform(masked, lambda t: F.struct(t.start.alias("start"), t.length.alias("length"))).alias("loss_spans"),
        "recovered",
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under a loss mask, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s.start + 1, s.length))), "")
