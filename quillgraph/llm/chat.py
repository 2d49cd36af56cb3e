"""Chat formatting with Spark expressions only: sorted turn structs, merged turns, escapes and a loss mask.

Template of a merged turn: ``<|turn|>role<|text|>part<|join|>part<|end|>`` and a line feed. Texts and roles are
escaped first: a backslash becomes ``\\b`` and ``<`` becomes ``\\l``, so no control string can occur inside them and
plain splits read the output back. Adjacent turns of one role are merged into one marked turn whose parts stay
apart by ``<|join|>``; reading back gives the rows as they were.

Defined cases: null text and null role count as empty; a null turn comes first; ties of turn are ordered by role,
then text (both escaped); rows with a null conversation id form one conversation; repeated rows are turns of their own; columns
beside the four named ones are ignored; an empty table gives no rows. A conversation is one output row, so its
text has to fit into one row, as the format itself demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, JOIN, END = "<|turn|>", "<|text|>", "<|join|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv, formatted string, loss_spans array<struct<start int, length int>>: code points of formatted that a loss
    counts, which are the texts of the roles in learn, without any control string."""
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    roles = F.array(*[escape(F.lit(r)) for r in learn])
    n = F.size("ts")
    # each row as (head, body, tail): the head opens a turn or joins it to the one before, the tail ends it
    at = lambda i: F.element_at("ts", i)
    parts = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.when((i > 1) & (at(F.greatest(i - 1, F.lit(1)))["role"] == at(i)["role"]), F.lit(JOIN)).otherwise(F.concat(F.lit(TURN), at(i)["role"], F.lit(TEXT))).alias("head"),
            at(i)["text"].alias("body"),
            F.when((i < n) & (at(F.least(i + 1, n))["role"] == at(i)["role"]), F.lit("")).otherwise(F.lit(END)).alias("tail"),
            F.array_contains(roles, at(i)["role"]).alias("learn"),
        ),
    )
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return (
        turns.select("conv_id", parts.alias("parts"))
        .select(
            "conv_id",
            F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
            F.transform("parts", lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), F.length(p["tail"]).alias("t"), p["learn"].alias("learn"))).alias("sizes"),
        )
        .select(
            "conv_id",
            "formatted",
            F.aggregate(
                "sizes",
                start,
                lambda acc, s: F.struct(
                    (acc["pos"] + s["h"] + s["b"] + s["t"]).alias("pos"),
                    F.when(s["learn"], F.concat(acc["spans"], F.array(F.struct((acc["pos"] + s["h"]).alias("start"), s["b"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
                ),
                lambda acc: acc["spans"],
            ).alias("loss_spans"),
        )
    )


def read_conversations(formatted: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and the columns in keep: the rows as they were before formatting, read from the text alone."""
    marked = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.size(F.split("formatted", r"<\|turn\|>")))

    def rows(m: Column) -> Column:
        both = F.split(m, r"<\|text\|>")
        body = F.regexp_replace(F.element_at(both, 2), r"<\|end\|>\n$", "")
        return F.transform(F.split(body, r"<\|join\|>"), lambda t: F.struct(unescape(F.element_at(both, 1)).alias("role"), unescape(t).alias("text")))

    return formatted.select("conv_id", F.flatten(F.transform(marked, rows)).alias("turns"), *keep)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
