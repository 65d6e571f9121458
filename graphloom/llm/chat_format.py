"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered between the marks of its role; any other role is written out
in a header. The rendered text is parsed again by one regular expression and the
recovered turns are compared with the source. A conversation that does not come
back identical has control strings or backslashes in its texts: it is rendered
again with a backslash before each backslash and after the first character of
each control string, and must then come back identical, or the job fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (role, mark before, mark after); fixed values of the template.
MARKS = [
    ("system", "<<SYS>>", "<</SYS>>"),
    ("user", "[INST]", "[/INST]"),
    ("assistant", "<s>", "</s>"),
]
HEADER = ("<|", "|>")
HEADER_END = "<|/|>"
CONTROL = [m for _, a, b in MARKS for m in (a, b)] + [*HEADER, HEADER_END]

#: One turn of rendered text: groups 1 to 3 are texts of the known roles, 4 and 5 another role and its text.
TURN = r"(?s)<<SYS>>(.*?)<</SYS>>|\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|<\|(.*?)\|>(.*?)<\|/\|>"


def escape(text: Column) -> Column:
    """Backslashes doubled, and each control string broken by a backslash after its first character."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(text, r"([<\[|])(?=<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|/\|>|\||>)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render_turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(HEADER[0]), role, F.lit(HEADER[1]), text, F.lit(HEADER_END))
    for known, before, after in MARKS:
        out = F.when(role == known, F.concat(F.lit(before), text, F.lit(after))).otherwise(out)
    return out


def _parts(turns: Column, coded: bool) -> Column:
    code = escape if coded else (lambda c: c)
    known = [r for r, _, _ in MARKS]
    return F.transform(turns, lambda t: _render_turn(F.when(t.role.isin(known), t.role).otherwise(code(t.role)), code(t.text)))


def parse(rendered: Column) -> Column:
    """The turns of a rendered text, as array<struct<role, text>>; texts are unescaped."""

    def turn(part):
        piece = [F.regexp_extract(part, TURN, i) for i in range(1, 6)]
        role, text = unescape(piece[3]), piece[4]
        for i, (known, before, _) in enumerate(MARKS):
            role = F.when(part.startswith(before), F.lit(known)).otherwise(role)
            text = F.when(part.startswith(before), piece[i]).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(rendered, F.lit(TURN), F.lit(0)), turn)


def _identical(rendered: Column, turns: Column) -> Column:
    """Whether parsing gives the turns back and leaves nothing over."""
    return (parse(rendered) == turns) & (F.regexp_replace(rendered, TURN, "") == "")


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, escaped, turns, loss_spans.

    `turns` are read back from `formatted`. `loss_spans` are (start, length) in
    code points of each assistant text as it stands in `formatted`, so escaped
    where `escaped` holds. A null text or role counts as empty; rows without
    conversation id form a conversation of their own; rows with the same turn
    number are ordered by role and text, rows without one come first; repeated rows
    are turns each. A conversation is put together in one row, so its texts, of any
    length, are held by one task. Other columns do not matter. An empty table gives
    an empty result.
    """
    source = (
        rows.select(
            F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
        .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
        .select("conv_id", F.transform("rows", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("source"))
    )
    plain = source.withColumn("parts", _parts(F.col("source"), coded=False)).withColumn("formatted", F.array_join("parts", ""))
    tried = plain.withColumn("escaped", ~_identical(F.col("formatted"), F.col("source")))
    parts = F.when(F.col("escaped"), _parts(F.col("source"), coded=True)).otherwise(F.col("parts"))
    coded = tried.withColumn("parts", parts).withColumn("formatted", F.when(F.col("escaped"), F.array_join("parts", "")).otherwise(F.col("formatted")))
    checked = coded.withColumn(
        "turns",
        F.when(~F.col("escaped") | _identical(F.col("formatted"), F.col("source")), parse(F.col("formatted")))
        .otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))),
    )
    open_mark, close_mark = next((len(a), len(b)) for r, a, b in MARKS if r == "assistant")
    walked = F.aggregate(
        F.zip_with("parts", "source", lambda p, t: F.struct(F.length(p).alias("n"), (t.role == "assistant").alias("loss"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc.at + x.n).alias("at"),
            F.when(x.loss, F.concat(acc.spans, F.array(F.struct((acc.at + open_mark).alias("start"), (x.n - open_mark - close_mark).alias("length"))))).otherwise(acc.spans).alias("spans"),
        ),
        lambda acc: acc.spans,
    )
    return checked.select("conv_id", "formatted", "escaped", "turns", walked.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start + 1, s.length))), "")
