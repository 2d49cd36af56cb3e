"""N-gram Jaccard join of documents: rare-first prefix, length, positional and suffix filters, one check per pair.

Words are runs of anything but ASCII white space, with A-Z lower-cased; a document's set holds its distinct k-word
shingles, or its whole word sequence where it has fewer words. Shingles are compared as 64-bit hashes.

Defined cases: null or wordless texts have empty sets and no links; a null id sorts after all others and is null in
the result; rows that repeat an id are documents of their own; equal texts are one node of the join, counted by
their number; other columns are ignored; an empty table gives no rows. Texts are taken whole, whatever their length; a
task holds the shingles of one text, or of about 1 MB of shorter ones, at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import bytewords as W
from quillgraph.llm.common import stored
from quillgraph.llm.components import components
from quillgraph.llm.setjoin import linked, with_keys

LAST = (1 << 63) - 1


def shingle_sets(k: int):
    def extract(raw: np.ndarray, off: np.ndarray, unique: bool):
        starts, ends, woff = W.find_words(raw, off)
        sets, so = W.shingles(W.hash_words(raw, starts, ends), woff, k)
        if unique:
            sets, so = W.unique_sets(sets, so)
        n = len(off) - 1
        return sets, so, np.arange(n), np.zeros(n, np.int64)

    return extract


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row per document: doc_id, n_shingles, n_similar (documents with den * intersection >= num * union), and
    component_id, the smallest id that links reach."""
    none = F.col(id_col).cast("long").isNull()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("p1"), none.cast("long").alias("p2"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items, nodes, links = linked(rows, shingle_sets(k), num, den)
    component = groups(nodes, links)
    degree = links.groupBy("k").agg(F.sum("w").alias("far"))
    own = F.struct("p1", "p2")
    known = nodes.where("w > 1").select("k", "w", own.alias("own")).join(degree, "k", "full").join(component, "k", "left")
    known = stored(known.select("k", F.coalesce("w", F.lit(1)).alias("w"), (F.coalesce("w", F.lit(1)) - 1 + F.coalesce("far", F.lit(0))).alias("n_similar"), F.coalesce("component", "own").alias("component")), "known")
    # documents without words share one key, which the join needn't see
    found = with_keys(items.where("n > 0"), known, "w", "left").select(own.alias("own"), "n", "n_similar", F.coalesce("component", own).alias("component"))
    found = found.unionByName(items.where("n = 0").select(own.alias("own"), "n", F.lit(0).cast("long").alias("n_similar"), own.alias("component")))
    shown = lambda c: F.when(c["p2"] == 0, c["p1"])
    return found.select(shown(F.col("own")).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), shown(F.col("component")).alias("component_id"))


def groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(k, component): of nodes with links the smallest position (p1, p2) that links reach."""
    roots = components(links.select(F.col("k").alias("u"), F.col("root").alias("v")))
    lowest = roots.join(nodes.select(F.col("k").alias("node"), F.struct("p1", "p2").alias("own")), "node").groupBy("root").agg(F.min("own").alias("component"))
    return roots.join(lowest, "root").select(F.col("node").alias("k"), "component")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of linked documents: the one with the smallest id (null last), then the smallest
    hash of the text; of rows that agree in both, one. Documents without words all stay. Columns are handed on."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, key = F.col(f"c{names.index(text_col)}"), F.col(f"c{names.index(id_col)}").cast("long")
    keyed = plain.withColumns({"p1": F.coalesce(key, F.lit(LAST)), "p2": F.xxhash64(text, key.isNull())})
    items, nodes, links = linked(keyed.select("p1", "p2", F.coalesce(text, F.lit("")).alias("text")), shingle_sets(k), num, den)
    known = nodes.select("k", "w", F.struct("p1", "p2").alias("own")).join(groups(nodes, links), "k", "left").where("w > 1 or component is not null")
    known = stored(known.select("k", "w", F.coalesce("component", "own").alias("first")), "known")
    place = F.struct("p1", "p2")
    of = with_keys(items.where("n > 0"), known, "w").groupBy("p1", "p2").agg(F.count("*").alias("rows"), F.first("first").alias("first"))
    marks = stored(of.select("p1", "p2", F.when(place != F.col("first"), "drop").when(F.col("rows") > 1, "once").alias("mark")).where("mark is not null"), "marks")
    kept = keyed.join(marks, ["p1", "p2"], "left_anti").select(*plain.columns)
    repeated = marks.where("mark = 'once'")
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, ["p1", "p2"]).dropDuplicates(["p1", "p2"]).select(*plain.columns))
    return kept.toDF(*names)
