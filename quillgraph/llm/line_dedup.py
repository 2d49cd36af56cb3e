"""Removal of lines that are exact or near copies of earlier lines, by an exact set-similarity join of lines.

A line's set holds its distinct words (runs of anything but ASCII white space, A-Z lower-cased). A line goes where an
earlier line of any document, or of its own, has a set with Jaccard similarity of at least num / den; earlier means
a smaller (id, hash of the text, line number). Lines without words are left as they are.

Defined cases: a null text stays null and has no lines; a null id sorts after all others; rows that repeat both id
and text are one document listed again and get one result; rows that share an id only are told apart by their texts;
columns are handed on as they are, whatever their names, and the two counts are added under names that the table
doesn't have yet (n_lines and n_removed, with underscores before them as needed); an empty table gives an empty one.
Texts and lines are taken whole, whatever their length; a task holds one text, or about 1 MB of shorter ones, at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import bytewords as W
from quillgraph.llm.common import stored
from quillgraph.llm.setjoin import linked, with_keys

LAST = (1 << 63) - 1


def line_sets(raw: np.ndarray, off: np.ndarray, unique: bool):
    starts, ends, _ = W.find_words(raw, off)
    loff, roff = W.split_lines(raw, off)
    woff = np.searchsorted(starts, loff)
    sets, so = W.hash_words(raw, starts, ends), woff
    if unique:
        sets, so = W.unique_sets(sets, so)
    lines = np.arange(len(loff) - 1)
    row = np.searchsorted(roff, lines, side="right") - 1
    used = np.flatnonzero(np.diff(so) > 0)
    return sets, np.concatenate([so[used], so[-1:]]), row[used], (lines - roff[row])[used]


def removed_lines(docs: DataFrame, id_col: str, text_col: str, num: int, den: int) -> DataFrame:
    """(p1, p2, lines array<long>) of the documents that lose lines."""
    rows = keyed(docs, id_col, text_col).select("p1", "p2", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    items, nodes, links = linked(rows, line_sets, num, den, signed=True)
    best = links.groupBy("k").agg(F.min(F.struct("p1", "p2", "p3")).alias("b"))
    late = nodes.select("k", "w", F.struct("p1", "p2", "p3").alias("own")).join(best, "k", "left").select("k", "own", F.coalesce(F.col("b") < F.col("own"), F.lit(False)).alias("all"), "w").where("w > 1 or all")
    gone = with_keys(items, stored(late, "late"), "w").where(F.col("all") | (F.struct("p1", "p2", "p3") != F.col("own")))
    return gone.groupBy("p1", "p2").agg(F.collect_set("p3").alias("lines"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a struct of all columns, numbered), p1 and p2 (a document's place), text."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, key = F.col(f"c{names.index(text_col)}"), F.col(f"c{names.index(id_col)}").cast("long")
    others = [f"c{i}" for i, c in enumerate(names) if c != text_col]
    return plain.select(F.struct(F.lit(0).alias("none"), *others).alias("row"), F.coalesce(key, F.lit(LAST)).alias("p1"), F.xxhash64(text, key.isNull()).alias("p2"), text.alias("text"))


def counts_of(docs: DataFrame) -> tuple[str, str]:
    """The names under which dedup_lines adds the numbers of lines and of removed lines."""
    out = []
    for c in ("n_lines", "n_removed"):
        while c in docs.columns:
            c = "_" + c
        out.append(c)
    return out[0], out[1]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 90, den: int = 100) -> DataFrame:
    """docs with the texts that are left, n_lines (lines of the old text with a word or without) and
    n_removed, under the names of counts_of."""
    gone = removed_lines(docs, id_col, text_col, num, den)

    @F.pandas_udf("string")
    def cut(text: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for t, drop in zip(text, lines):
            if t is None:
                out.append(None)
                continue
            drop = set(drop.tolist())
            kept = [x for i, x in enumerate(t.split("\n")) if i not in drop]
            out.append("\n".join(kept))
        return pd.Series(out)

    cut = cut.asNondeterministic()  # it runs once, whatever filters come after it
    every = keyed(docs, id_col, text_col).join(gone, ["p1", "p2"], "left")
    hit = F.col("lines").isNotNull()
    feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    every = every.select(
        "row",
        F.when(hit, cut(F.when(hit, F.col("text")), F.when(hit, F.col("lines")))).otherwise(F.col("text")).alias("text"),
        F.coalesce(feeds + F.when(F.col("text").endswith("\n") | (F.col("text") == ""), 0).otherwise(1), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return every.select(*[F.col("text") if c == text_col else F.col(f"row.c{i}") for i, c in enumerate(docs.columns)], "n_lines", "n_removed").toDF(*docs.columns, *counts_of(docs))
