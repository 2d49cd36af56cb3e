"""The n-gram join and line dedup against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import line_dedup, ngram_jaccard


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))) for _ in range(300)]
    shared = " ".join(r.choice(vocabulary) for _ in range(60))
    texts = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(3, 150))]
        text = " ".join(words)
        texts.append(text)
        if i % 3 == 0:
            texts.append(shared + "\n" + text)
        for _ in range(r.choice([0, 0, 1, 6])):
            copy = list(words)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else "\n".join(" ".join(copy[j : j + 20]) for j in range(0, len(copy), 20)))
    texts += [None, "", " \n\t ", "one", "One", "one two", "ü ñ ß 漢字", "ü ñ ß 漢字", "x " * 3000, "y" * 9000, texts[0], texts[0]]
    return texts


def sets(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_ngram_join_equals_brute_force(spark):
    texts = corpus()
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in ngram_jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string, k string")).collect()}
    s = {i: sets(t) for i, t, _ in rows}
    links = {i: [j for j in s if j != i and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])] for i in s}
    for i in s:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (out[i]["n_shingles"], out[i]["n_similar"], out[i]["component_id"]) == (len(s[i]), len(links[i]), min(seen)), texts[(i - 1) // 3]
    assert any(len(x) > 3 for x in links.values())


def test_large_groups_are_split_into_blocks(spark, monkeypatch):
    from quillgraph.llm import setjoin

    monkeypatch.setattr(setjoin, "CELL", 300)
    test_ngram_join_equals_brute_force(spark)


def test_line_dedup_equals_brute_force(spark):
    texts = corpus()
    rows = [(i, t, i) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int").drop("n_lines"), num=80).collect()}
    earlier = []
    for i, t, _ in rows:
        if t is None:
            assert out[i]["text"] is None and out[i]["n_lines"] == 0
            continue
        kept, gone = [], 0
        for line in t.split("\n"):
            s = {w for x in sets(line, 1) for w in x}
            if s and any(100 * len(s & e) >= 80 * len(s | e) for e in earlier):
                gone += 1
            else:
                kept.append(line)
            if s:
                earlier.append(s)
        assert (out[i]["text"], out[i]["n_removed"]) == ("\n".join(kept), gone)
    assert sum(r["n_removed"] for r in out.values()) > 20


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, token string")
    assert ngram_jaccard.similar_documents(empty).count() == 0
    assert line_dedup.dedup_lines(empty).columns == ["doc_id", "text", "token", "n_lines", "n_removed"]
    assert line_dedup.dedup_lines(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, "A b c"), (5, "A b c"), (5, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_similar"], r["component_id"]) for r in ngram_jaccard.similar_documents(odd).collect())
    assert got == [(-1, 3, 5), (-1, 3, 5), (5, 0, 5), (5, 3, 5), (5, 3, 5)]
    left = sorted((r["doc_id"] or -1, r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(odd.dropna()).collect())
    assert left == [(5, "A b c", 0), (5, "A b c", 0)]


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 2), (2, 3), (9, 8), (3, 7), (7, 10)], {1: 1, 2: 1, 3: 1, 7: 1, 10: 1, 9: 8, 8: 8}), ([(i, i + 1) for i in range(50)], {i: 0 for i in range(51)})])
def test_components(spark, edges, want):
    from quillgraph.llm.components import components

    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_dense_runs_and_split_tokens_give_the_same(spark, monkeypatch):
    """Families compared by members, tokens split into blocks, cells into pairs of blocks."""
    from quillgraph.llm import setjoin

    monkeypatch.setattr(setjoin, "DENSE", 0)
    monkeypatch.setattr(setjoin, "RUN", 3)
    test_ngram_join_equals_brute_force(spark)
    test_line_dedup_equals_brute_force(spark)
    monkeypatch.setattr(setjoin, "CELL", 300)
    test_ngram_join_equals_brute_force(spark)
    test_line_dedup_equals_brute_force(spark)


def test_a_large_family_is_counted_without_pairs(spark, monkeypatch):
    """1,500 near copies, all different: what leaves the runs grows with the rows, not with the pairs."""
    from quillgraph.llm import setjoin

    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(1500):
        copy = list(base)
        for _ in range(r.randint(1, 2)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    seen = []
    plain = setjoin.candidates
    monkeypatch.setattr(setjoin, "candidates", lambda *a: seen.append(out := plain(*a)) or out)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["n_similar"] for x in ngram_jaccard.similar_documents(docs).collect()}
    hashed = [{hash(x) for x in sets(t)} for t in texts]
    for i in r.sample(range(1500), 40):
        assert got[i] == sum(100 * len(hashed[i] & h) >= 80 * len(hashed[i] | h) for h in hashed) - 1
    assert sum(got.values()) > 500_000 and seen[0].count() < 60 * len(texts)


def test_one_of_each_group(spark):
    far = " ".join(f"v{i}" for i in range(30))
    rows = [(7, "a b c d e f g", 1), (None, "A b c d e f g", 2), (7, "a b c d e f g", 3), (9, "a b c d e f g", 4), (None, None, 5), (None, "", 6), (3, far, 7), (None, far + " w", 8), (8, None, 9), (7, "other words", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `p1` int").withColumnRenamed("p1", "a `b`.c")
    kept = ngram_jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    left = sorted(x[2] for x in kept.collect())
    assert left in ([1, 5, 6, 7, 9, 10], [3, 5, 6, 7, 9, 10])
    assert ngram_jaccard.one_of_each_group(docs.limit(0)).count() == 0


def test_clashing_names_and_largest_ids(spark):
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(top, "a b c\na b c", 1, 2), (None, "a b c", 3, 4)], "doc_id long, text string, n_lines int, n_removed int")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed", "_n_lines", "_n_removed"]
    assert sorted(tuple(r)[1:] for r in out.collect()) == [("", 3, 4, 1, 1), ("a b c", 1, 2, 2, 1)] or sorted(tuple(r)[1:] for r in out.collect()) == [("", 1, 2, 2, 2), ("a b c", 3, 4, 1, 0)]
    got = sorted((r["doc_id"] or -1, r["n_similar"], r["component_id"]) for r in ngram_jaccard.similar_documents(docs.withColumn("text", F.lit("q r s t u"))).collect())
    assert got == [(-1, 1, top), (top, 1, top)]
