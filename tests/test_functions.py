"""Text, name, chunk, extraction and vector functions."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import chunking, extraction, names, scores, vectors
from quillgraph.functions import text as T


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "a,ta,b,tb,want",
    [
        ("Acme", "ORG", "Acme, Inc.", "ORG", (True, "equal")),
        ("Dr. Sarah Chen", "PERSON", "Sarah Chen", "PERSON", (True, "equal")),
        ("IBM", "ORG", "International Business Machines", "ORG", (True, "acronym")),
        ("Brightwater", None, "Brigthwater", None, (True, "typo")),
        ("cat", None, "car", None, (False, "none")),
        ("Sarah", "PERSON", "Sarah Chen", "PERSON", (True, "containment")),
        ("Sarah", "CONCEPT", "Sarah Chen", "CONCEPT", (False, "none")),
        ("Bob Smith", "PERSON", "Robert Smith", "PERSON", (True, "equal")),
        ("Bob Smith", "PERSON", "Robert Jones", "PERSON", (False, "none")),
        ("Bob", "ORG", "Robert", "ORG", (False, "none")),
        ("Jordan", "PERSON", "Jordan", "LOCATION", (False, "none")),
        ("Dept. of Energy", "ORG", "Department of Energy", "ORG", (True, "equal")),
        ("Barnes & Noble", "ORG", "Barnes and Noble", "ORG", (True, "equal")),
        ("", None, "x", None, (False, "none")),
    ],
)
def test_names(a, ta, b, tb, want):
    found = names.match(a, ta, b, tb)
    assert (found[0], found[2]) == want
    assert names.match(b, tb, a, ta)[0] == want[0]
    if want[0]:  # what matches shares a blocking key
        kinds = [names.bucket(t) for t in (ta, tb)]
        shared = next((k for k in kinds if k != "generic"), "generic")
        assert want[1] == "typo" or set(names.lookup_keys(a, shared)) & set(names.index_keys(b, shared)) or set(names.lookup_keys(b, shared)) & set(names.index_keys(a, shared))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edit_distance(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert names.osa(a, b, 9) == d[-1][-1]
    assert names.osa(a, b, 1) == min(2, d[-1][-1])


def test_text(spark):
    x = spark.createDataFrame([("  ## **Hello**   World ",), ("> - 1) item `x`",), ("Accept",), ("We value your privacy policy",), ("",)], "t string")
    rows = x.select(T.clean_line(F.col("t")), T.is_boilerplate(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("Hello World", False), ("item x", False), ("Accept", True), ("We value your privacy policy", True), ("", True)]
    lit = lambda s: F.lit(s)
    assert one(spark, T.slugify(lit("Sarah O'Chen & Co. Ünï"))) == "sarah-o-chen-co-n"
    assert one(spark, T.strip_boilerplate(lit("A real sentence.\nMenu\n\n\n\nAnother."))) == "A real sentence.\nAnother."  # blank lines count as boilerplate
    assert one(spark, T.sanitize(lit("é​‮x\x07\ty"))) == "éx\ty"
    assert one(spark, T.label(lit("  a \t b\n\n\n\nc "))) == "a b\n\nc"
    assert one(spark, T.best_passage(lit("Cookie policy here. The launch is in May! Numbers rise."), F.array(lit("launch"), lit("may")))) == "The launch is in May!"
    assert one(spark, T.best_passage(lit("Subscribe\nMenu"), F.array(lit("x")))) == ""
    assert one(spark, T.search_terms(lit("Größe £50 a x1 naïve x1"))) == ["größe", "£50", "x1", "naïve", "x1"]
    assert one(spark, T.search_tokens(lit("Größe £50 a-x1 NAÏVE nai\u0308ve 漢字 Ωμ"))) == ["große", "50", "a", "x1", "naive", "naive", "漢字", "ωμ"]
    assert one(spark, T.intent(lit("What do I love most?")))[:] == ("user", "love")
    assert one(spark, T.intent(lit("tell me"))) is None
    assert one(spark, T.predicate_matches(lit("partners_with"), lit("partner")))
    assert one(spark, T.asks_preference(lit("do I like tea"))) and not one(spark, T.asks_preference(lit("does Google love AI")))
    assert one(spark, T.wrap_untrusted(lit("a b"), lit(""), F.lit(2), True)) == '<untrusted_memory id="2" source="untitled">\na▁b\n</untrusted_memory>'
    assert one(spark, T.clean_source(lit("docs/2024-roadmap_deadbeef99.md"))) == "roadmap"
    assert one(spark, T.declines(lit("I don't know."))) and not one(spark, T.declines(lit("Paris")))
    assert one(spark, T.is_binary(F.lit(bytearray(b"ab\0c")))) and not one(spark, T.is_binary(F.lit(bytearray(b"\x30\x03"))))
    assert one(spark, T.importance(F.lit(2), F.lit(10), F.lit(1), lit("We decided to launch"))) == 2.24
    assert one(spark, scores.when_ms(lit("2024-01-02"), 5)) == 1704153600000 and one(spark, scores.when_ms(lit("17"), 5)) == 17 and one(spark, scores.when_ms(lit("soon"), 5)) == 5


def test_chunks():
    assert chunking.chunks("PRICING TIERS\n\nThe basic tier costs ten a month. It is enough for most people who write a little each day.") == ["PRICING TIERS The basic tier costs ten a month. It is enough for most people who write a little each day."]
    lines = "\n".join(f"Headline number {i} says something of its own." for i in range(5))
    assert chunking.chunks(lines) == lines.split("\n")
    long = "word " * 300
    assert all(len(c) <= 512 for c in chunking.chunks(long)) and "".join(chunking.chunks(long)).replace(" ", "") == "word" * 300
    assert chunking.chunks("") == [] and chunking.chunks(None) == [] and chunking.chunks("Short title") == ["Short title"]


@settings(max_examples=100, deadline=None)
@given(st.text("ab .!\n", max_size=400))
def test_chunks_lose_nothing(text):
    squeeze = lambda s: re.sub(r"\s+", "", s)
    got = chunking.chunks(text, 60, 20)
    assert squeeze("".join(got)) == squeeze(text) and all(c.strip() for c in got)


def test_extraction(spark):
    ents, rels = extraction.extract("Sarah Chen works at Meta.\nMeta acquired Oculus VR.")
    typed = {(a, p, b) for a, b, p, c in rels if c == 0.6}
    assert typed == {("sarah-chen", "works_at", "meta"), ("meta", "acquired", "oculus-vr")}
    assert {e[0] for e in ents} >= {"sarah-chen", "meta", "oculus-vr"}
    _, rels = extraction.extract("Mel (7 May 2023): I went to Japan last week. I love it")
    assert ("mel", "japan", "visited", 0.5) in rels and not any(r[2] == "likes" for r in rels)
    assert not any(c == 0.5 for *_, c in extraction.extract("I went to nowhere special")[1])
    row = spark.createDataFrame([("Ann manages Bob.",), (None,)], "t string").select(extraction.extract_knowledge("t").alias("k")).collect()
    assert [r["type"] for r in row[0]["k"]["relations"]] == ["relates_to", "manages"] and row[1]["k"]["entities"] == []


def test_vectors(spark):
    texts = ["", "a", "running run runner", "new york city", "new york"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: np.array(r["v"]) for r in frame.select("i", vectors.hash_embedding("t").alias("v")).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], vectors.hash_vector(t, {}), atol=1e-6) and (not t or math.isclose(np.linalg.norm(got[i]), 1, abs_tol=1e-5))
    assert got[3] @ got[4] > 0.6 > got[2] @ got[4]
    assert one(spark, vectors.fnv1a(F.lit("a"))) == 0xE40C292C and one(spark, vectors.content_hash(F.lit("a"))) == np.base_repr(0xE40C292C, 36).lower()
    assert one(spark, vectors.sparse(F.lit("x y x"))) == {vectors._fnv("w:x") % 256: 2, vectors._fnv("w:y") % 256: 1}
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, a)) == 1 and one(spark, vectors.cosine(a, b)) == 0
    assert one(spark, vectors.normalized(a)) == [0.6, 0.8]
    q = one(spark, vectors.quantized(a))
    assert q["codes"] == [95, 127] and math.isclose(q["scale"], 4 / (127 * 5))
