"""Resolution of names against all pairs in plain Python."""

import random

from quillgraph.functions import names
from quillgraph.operators import resolve


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, label string, type string, seq long")


def brute(rows):
    """Directed (id, other) that share a blocking key or have equal forms, and match."""
    out = set()
    for i, a, ta, _ in rows:
        for j, b, tb, _ in rows:
            if i != j:
                ok, score, why = names.match(a or "", ta, b or "", tb)
                met = why == "equal" and score == 1 or set(names.lookup_keys(a or "", names.bucket(ta))) & set(names.index_keys(b or "", names.bucket(tb)))
                if ok and met:
                    out.add((i, j, score, why))
    return out


def grouped(rows, pairs):
    root = {r[0]: r[0] for r in rows}
    for i, j, *_ in pairs:
        a, b = root[i], root[j]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    first = {}
    for i, _, _, seq in sorted(rows, key=lambda r: (r[3], r[0])):
        first.setdefault(root[i], i)
    return {i: first[root[i]] for i in root}


def test_resolution_equals_all_pairs(spark):
    r = random.Random(5)
    words = "bob robert jim james smith smyth smit acme acmee inc co the of dr international business machines ibm dept department energy".split()
    rows = [(f"i{k:03d}", " ".join(r.choice(words) for _ in range(r.randint(1, 4))).title(), r.choice(["PERSON", "ORG", "CITY", "", None]), k // 2) for k in range(220)]
    rows += [("w1", "IBM", "ORG", 9), ("w2", "International Business Machines", "", 8), ("w3", "ibm, inc", None, 7)]
    rows += [("x1", None, "ORG", 1), ("x2", "", None, 2), ("x3", "!!", "PERSON", 3), ("x4", "!!", "PERSON", 4)]
    s, want = table(spark, rows), brute(rows)
    assert {why for *_, why in want} == {"equal", "acronym", "typo", "containment"}
    assert {tuple(x) for x in resolve.matches(s, s).collect()} == want
    assert {x["id"]: x["canonical"] for x in resolve.canonicalise(s).collect()} == grouped(rows, want)
    best = {}
    for i, j, score, _ in want:
        best[i] = min(best.get(i, (0, "~")), (-score, j))
    assert {x["id"]: x["canonical"] for x in resolve.best_match(s, s).collect()} == {i: j for i, (_, j) in best.items()}


def test_names_under_a_common_word(spark):
    """More than 2000 entities under one word: equal forms, typos and containment still meet."""
    rows = [(f"s{k:05d}", f"Smith {chr(97 + k % 26)}{k:05d}q", "PERSON", 100 + k) for k in range(2300)]
    rows += [("z1", "Acme", "ORG", 1), ("z2", "Acme, Inc.", "ORG", 2)] + [(f"a{k:05d}", f"Acme {k:05d}{chr(97 + k % 26) * 3}x", "ORG", 5000 + k) for k in range(2300)]
    rows += [("p1", "John Smithers-Acme Smith", "PERSON", 3), ("p2", "Jon Smithers-Acme Smith", "PERSON", 4), ("q1", "Acme Smithers Worldwide", "ORG", 5), ("q2", "Acme Smitherz Worldwide", "ORG", 6)]
    got = {x["id"]: x["canonical"] for x in resolve.canonicalise(table(spark, rows)).collect()}
    assert got["z1"] == got["z2"] == "z1"
    assert got["p1"] == got["p2"] == "p1" and got["q1"] == got["q2"] == "q1"
    new = table(spark, [("n", "Smith", "PERSON", 0)]).drop("seq")
    assert resolve.best_match(new, table(spark, rows).drop("seq")).collect()[0]["canonical"] == "p1"


def test_keys_grow_with_the_length_of_names():
    """A name's keys: once a key per blocking key and character, some hundreds."""
    for kind in ("PERSON", "ORG", None):
        c = names.name_class("Customer#000000001 abcd1234 of UNITED STATES", kind)
        assert len(c["near"]) + len(c["far"]) < 30 and len(c["texts"]) <= 3


def test_one_edit_equals_the_distance():
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(400)]
    words += [w[:i] + x + w[j:] for w in words[:60] for i in range(len(w) + 1) for j in (i, i + 1) for x in ("", "c")]
    for a in words[:400]:
        for b in r.sample(words, 60):
            assert names.within_one(a, b) == (names.osa(a, b, 1) <= 1)
