"""The flagship's tables: texts are read and cut once, and vectors computed once, where they are used."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions import vectors
from quillgraph.functions.chunking import chunk_text, chunks
from quillgraph.operators import retrieval
from quillgraph.plans import retrieval_queries

SF = "/root/testdata/sf0.001"
ODD = [
    "", "A real sentence.\nMenu\n\n\n\nAnother.", "HOME\r\nhome \x0b\n home \nHome  \nhome x\nhomes\n home", "Opt out\nopt\U0001f600out\nOPTOUT\noptional output\noptxyout", "gdpr\u0085compliant\nGDPR-compliant\ngdprcompliant",
    "privаcy policy\nThe Privacy Policy of us\nKeep: cooKie policy\nſubſcribe now\nsubscribe\nſubscribe", "search...\nsearch..\nSearch\n   \n\t\r\nlast \r", "\n\nx\n", "İ skip to content", "a\rsubscribe now\rb", "home  \nhome    ", " ", "view all\nview all latest\n view all latest x",
]


def test_stripped_in_python_as_in_the_jvm(spark):
    frame = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    rows = frame.select("t", T.strip_boilerplate(F.col("t")).alias("s"), chunk_text(F.col("t"), strip=True).alias("c")).collect()
    assert {r["t"]: T.stripped_text(r["t"]) for r in rows} == {r["t"]: r["s"] for r in rows}
    assert all(list(r["c"]) == chunks(r["s"]) for r in rows)


def test_words_of_many_texts_are_looked_at_once_with_the_same_vectors():
    texts = [*ODD, None, "one two two", "two one, one-two two"]
    want = np.array([vectors.hash_vector(t, {}) for t in texts])
    assert np.allclose(vectors.hash_vectors(texts), want, atol=1e-12)


def test_search_tokens_of_ascii_and_other_texts(spark):
    rows = spark.createDataFrame([("Ab-1 c",), ("Ångström Ab",), ("",), (None,)], "t string").select(T.search_tokens(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == [["ab", "1", "c"], ["angstrom", "ab"], [], None]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_texts_are_read_once_and_vectors_computed_once(spark):
    chunk_table, records, acl, _ = retrieval_queries.corpus(spark, SF)
    for df in (chunk_table, records, acl):
        assert not any("documents" in f for f in df.inputFiles())
    asked = spark.createDataFrame([("q", "x", [1.0] + [0.0] * 255)], "query_id string, user_id string, vector array<double>")
    plan = retrieval.knn(chunk_table, asked, 3, acl)._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in x for x in plan.splitlines()) == 1
    plan = chunk_table.select("point_id", "content")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
