"""Chat formatting, license scans, tokenizers and the classifier on small fixtures."""

import random
import re
import zlib

import numpy as np
import pytest

from quillgraph.llm import bpe, chat, licenses, quality, repair

P = pytest.importorskip("public_tokenizers")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def texts():
    r = random.Random(3)
    alphabet = "abcdeÄéßñΣİ漢字🙂 ́  \n\t\x1c\x85\xa0'.,!12"
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(200)]
    out += [None, "", " ", "\n\n", "a" * 4000, "ab " * 3000, "It's we'll I'd  \n x", "<|endoftext|> <|startoftext|>", "Straße, café. NAÏVE. é", "\0 a b"]
    return out + out[:3]


def docs(spark, rows=None):
    rows = [(i * 7 - 50, t, "src", i) for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, k0 long")


def test_repair_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    monkeypatch.setattr(repair, "BLOCK", 3000)
    d = docs(spark)
    folder, shards = repair.store_tokens(d.repartition(3), WORD)
    got = repair.read_shards(spark, folder, shards).orderBy("doc_id").collect()
    at = 0
    for row, (i, text, *_) in zip(got, sorted((tuple(r) for r in d.collect()))):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert tuple(row) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    ids = {r["doc_id"]: r["ids"] for r in repair.read_shards(spark, folder, shards, digest=False).collect()}
    assert sum(map(len, ids.values())) == at
    some = next(b for s in shards for b in repair.blocks(folder, s["path"]) if b.head["rules"])
    for i, key in enumerate(some.doc_ids.tolist()):
        for a, b in ((0, None), (1, 3), (2, 40), (len(ids[key]) - 1, len(ids[key]))):
            assert some.tokens(i, a, b).tolist() == ids[key][a:b]
    assert some.head["symbols"] < some.head["tokens"]


def test_repair_odd_tables(spark):
    for rows in ([], [(None, "a b", "", 1), (None, None, "", 2), (4, "x", "", 3), (4, "x", "", 3)]):
        folder, shards = repair.store_tokens(docs(spark, rows), WORD)
        got = repair.read_shards(spark, folder, shards).collect()
        assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == ([] if not rows else [(-1, 1), (-1, 3), (4, 2), (4, 2)])


def test_other_tokenizers_go_to_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    table = repair.WordTable(path)
    assert not table.wordwise and repair.WordTable(WORD).wordwise
    t = Tokenizer.from_file(path)
    d = docs(spark)
    folder, shards = repair.store_tokens(d, path)
    got = sorted((r["doc_id"], r["ids"]) for r in repair.read_shards(spark, folder, shards, digest=False).collect())
    assert got == sorted((r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in d.collect())


def test_repair_rules():
    r = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (3000, 3), (3000, 400)):
        ids = r.integers(0, top, n)
        last = r.random(n) < 0.02
        if n:
            last[-1] = True
        sym, rules, ends = repair.pack(ids, last, least=4)
        counts: dict = {}
        for a, b, e in zip(sym[:-1].tolist(), sym[1:].tolist(), ends[:-1].tolist()):
            if not e and a != b:
                counts[a, b] = counts.get((a, b), 0) + 1
        assert not counts or max(counts.values()) < 4  # no frequent pair is left
        flat, start, size = repair.expansions(rules)
        out = np.concatenate([np.zeros(0, int), *([s] if s < 1 << 20 else flat[start[s - (1 << 20)] :][: size[s - (1 << 20)]] for s in sym)])
        assert (out == ids).all() and ends.sum() == last.sum()
        cuts = set(np.flatnonzero(last).tolist())
        at = 0
        for s, e in zip(sym, ends):
            at += 1 if s < 1 << 20 else int(size[s - (1 << 20)])
            assert (at - 1 in cuts) == e


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE), special_tokens={})
    d = docs(spark)
    got = bpe.decode(bpe.encode(d, BYTE, P.PATTERN, keep=("doc_id", "k0")), BYTE, keep=("doc_id", "k0")).collect()
    want = {r["k0"]: r["text"] or "" for r in d.collect()}
    assert len(got) == len(want)
    for r in got:
        assert r["ids"] == e.encode_ordinary(want[r["k0"]])
        assert bytes(r["decoded"]) == want[r["k0"]].encode()
    assert bpe.decode(bpe.encode(docs(spark, []), BYTE, P.PATTERN), BYTE).count() == 0


def test_chat_round_trip(spark):
    r = random.Random(4)
    bits = ["<|turn|>", "<|end|>\n", "<|join|>", "<|text|>", "\\", "\\l", "\\b", "<", "a", "\n", "é", " "]
    rows = [(c, i, r.choice(["user", "assistant", None, "sys<|text|>"]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 6))), "x") for c in (1, 2, 3, None) for i in range(r.randint(1, 9))]
    rows += rows[-2:]
    done = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")).cache()
    back = {x["conv_id"]: [(t["role"], t["text"]) for t in x["turns"]] for x in chat.read_conversations(done).collect()}
    loss = {x[0]: x[1] for x in done.select("conv_id", chat.loss_texts(done["formatted"], done["loss_spans"])).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((t, (role or ""), (text or "")) for i, t, role, text, _ in rows if i == c), key=lambda x: x[0])
        assert back[c] == [x[1:] for x in own]
        assert loss[c] == [x[2] for x in own if x[1] == "assistant"]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_conversations(chat.format_conversations(empty)).count() == 0


def test_licenses(spark):
    mit = re.sub(r"\{\{\d+\}\}", "2020 someone", licenses.TEMPLATES["mit-text"]).replace("[[", "").replace("]]", "")
    less = re.sub(r"\[\[.*?\]\]", "", licenses.TEMPLATES["mit-text"])
    rows = [
        (1, "x Licensed under the MIT License, under the mit license", {"mit"}, {"mit-notice"}),
        (2, "Apache License, Version 2.0; licensed under the Apache License Version 2.0", {"apache-2"}, {"apache-2-notice"}),
        (3, mit.title(), set(), {"mit-text"}),
        (4, less.upper(), set(), {"mit-text"}),
        (5, less.replace("free of charge", "for a charge"), set(), set()),
        (6, "Copyright (c) 2020 by Some One. All rights reserved", set(), set()),
        (10, "This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", set(), {"gpl-header"}),
        (11, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", {"apache-2"}, {"apache-2-header", "apache-2-notice"}),
        (7, "CC BY-NC", {"cc-by-nc"}, set()),
        (8, None, set(), set()),
        (9, "under the mit", set(), set()),
        (None, "", set(), set()),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(r[0], r[1], "z") for r in rows], "doc_id long, text string, labels string")).collect()}
    for i, text, base, more in rows:
        words = licenses.words_of(text or "")
        at = [j for p in licenses.PHRASES for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert set(r["base_labels"]) == base and set(r["labels"]) == base | more, text
        assert r["score"] == (max(licenses.weight_of(licenses.TEMPLATES[t]) for t in more) if more else 0.5 if base else 0.0)
    with pytest.raises(ValueError):
        licenses.Automaton("[[a]] {{3}}")
    # optional and replaceable regions at the start may be missing
    found = licenses.scan(spark.createDataFrame([(1, "x a b"), (2, "b c"), (3, "c")], "doc_id long, text string"), templates={"t": "[[x a]] {{2}} b c"}, phrases={})
    assert {r["doc_id"]: r["labels"] for r in found.collect()} == {1: [], 2: ["t"], 3: []}
    assert licenses.scan(docs(spark, [])).count() == 0


def test_automata_equal_regular_expressions():
    r = random.Random(8)

    def template(depth=0):
        parts = []
        for _ in range(r.randint(1, 4)):
            x = r.random()
            parts.append(r.choice("ab") if x < 0.6 or depth > 1 else "{{%d}}" % r.randint(0, 2) if x < 0.75 else "[[" + template(depth + 1) + "]]")
        return " ".join(parts)

    for _ in range(300):
        t = "a " + template()
        m, e = licenses.Automaton(t), re.compile(licenses.regex_of(t))
        for _ in range(20):
            words = ["a"] + [r.choice("abc") for _ in range(r.randint(0, 8))]
            assert m.accepts(licenses.hash_of(words).tolist()) == bool(e.match(" ".join(words) + " ")), (t, words)


def test_scores_equal_a_dense_discriminant(spark):
    """The same densities from a plain computation over all labelled rows at once."""
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice("abcdefg,.! ") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 80))) * (1 + i % 2) + "\n" * (i % 5), "", i) for i in range(400)]
    y = {i: int(r.random() < 0.4 + 0.3 * (i % 2)) for i in range(0, 400, 2)} | {i: 1 for i in range(1, 60, 2)}
    d = docs(spark, rows)
    x = {f["doc_id"]: np.array(f["x"]) for f in quality.features(d).collect()}
    got = {s["doc_id"]: s["score"] for s in quality.scored(d, spark.createDataFrame([*y.items()], "doc_id long, quality int")).collect()}
    learn = [i for i in y if zlib.crc32(str(i).encode()) % 4 != 2]
    data = [np.stack([x[i] for i in learn if y[i] == c]) for c in (0, 1)]
    pooled = sum((z - z.mean(0)).T @ (z - z.mean(0)) for z in data) / len(learn)

    def density(v, z):
        s = 0.7 * np.cov(z.T, bias=True) + 0.3 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        e = v - z.mean(0)
        return -0.5 * e @ np.linalg.solve(s, e) - 0.5 * np.linalg.slogdet(s)[1]

    prior = np.log((len(data[1]) + 1) / (len(data[0]) + 1))
    for i, v in x.items():
        want = 1 / (1 + np.exp(-np.clip((density(v, data[1]) - density(v, data[0])) / quality.TEMPER + prior, -30, 30)))
        assert abs(got[i] - want) < 2e-6


def test_a_score_of_just_the_bound_is_accepted(spark, monkeypatch):
    rows = [(i, "a b", "", i) for i in range(8)]
    lab = spark.createDataFrame([(0, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    score = quality.scored(docs(spark, rows), lab).first()["score"]
    monkeypatch.setattr(quality, "ACCEPT", score)
    assert {x["predicted"] for x in quality.scored(docs(spark, rows), lab).collect()} == {1}
    assert quality.kept_documents(docs(spark, rows), lab).count() == 8


def test_quality(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(5, 60))]
        good = r.random() < 0.7
        rows.append((i, " ".join(words) + "." if good else "!! ".join(words).upper(), "", i))
        labels.append((i, int(good)))
    rows += [(1000, None, "", 0), (1001, "", "", 0), (None, "a b", "", 0), (5, rows[5][1], "", 0)]
    labels += [(3, None), (None, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.scored(docs(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    held = [x for x in got if x["held_out"]]
    truth = dict(labels[:600])
    assert all(zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2 for x in held) and len(held) > 90
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held if x["doc_id"] in truth) >= 0.97 * len(held)
    kept = quality.kept_documents(docs(spark, rows), lab)
    assert kept.columns == ["doc_id", "text", "ids", "k0"]
    assert kept.count() == sum(x["predicted"] for x in got)
    assert {x["score"] for x in quality.scored(docs(spark, rows[:5]), lab.limit(0)).collect()} == {0.5}
    assert quality.scored(docs(spark, []), lab).count() == 0
