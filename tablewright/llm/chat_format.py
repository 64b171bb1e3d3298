"""Relational chat formatting: Spark expressions only.

The rows of a conversation are collected as (turn, role, text) structs and
sorted; adjacent turns of one role are merged under one header; the pieces are
concatenated.  Every mark begins with ``<|``.  Inside roles and texts a
backslash goes between ``<`` and ``|`` (one more, if there are some already),
so no mark can occur there and the original comes back exactly.

    <|turn|>ROLE<|text|>TEXT<|text|>TEXT of the same role<|end|>

A loss mask covers the texts of the trained role, not the marks.

Null texts and roles are empty strings; a null conversation id is one
conversation; rows of equal turn are ordered by role, then text; repeated rows
are turns of their own; a null turn comes first.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def _mark(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        header = F.concat(F.lit(TURN), escape(t["role"]))
        opening = F.when(i == 0, header).when(before != t["role"], F.concat(F.lit(END), header)).otherwise(F.lit(""))
        return F.concat(opening, F.lit(TEXT), escape(t["text"]))

    return turns.select("conv_id", F.concat(F.array_join(F.transform("turns", piece), ""), F.lit(END)).alias("formatted"))


def read_back(df: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """From (conv_id, formatted): turns as they were before merging, and the
    texts under the loss mask."""
    blocks = F.split("formatted", _mark(END), -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    parts = F.transform(blocks, lambda b: F.split(b, _mark(TEXT), -1))
    merged = F.transform(parts, lambda p: F.struct(
        unescape(F.substring(p[0], len(TURN) + 1, 2147483647)).alias("role"),
        F.transform(F.slice(p, 2, F.size(p) - 1), unescape).alias("texts")))
    return df.select("conv_id", "formatted", merged.alias("merged"), (
        F.filter(merged, lambda m: m["role"] == trained_role)).alias("trained"))


def digest(back: DataFrame) -> DataFrame:
    lines = F.flatten(F.transform("merged", lambda m: F.transform(m["texts"], lambda t: F.concat(m["role"], F.lit("\n"), t, F.lit("\n")))))
    loss = F.array_join(F.flatten(F.transform("trained", lambda m: m["texts"])), "")
    return (back.select("conv_id", "formatted", F.size("merged").cast("long").alias("n_merged"), lines.alias("lines"), loss.alias("loss"))
            .select("conv_id", F.size("lines").cast("long").alias("n_turns"), F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"), "n_merged"))
