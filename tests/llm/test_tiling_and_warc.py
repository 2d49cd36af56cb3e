"""String tiling against a plain version of the algorithm; archives and the external merge."""

import base64
import hashlib
import random
import re

import numpy as np

from quillgraph.llm import tiling, warc


def plain_tiles(item, text, least):
    """Greedy string tiling as published, quadratic."""
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and free_i[i + n] and free_t[t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, t)]
                elif n == best and n >= least:
                    found.append((i, t))
        if best < least:
            return out
        for i, t in found:
            if all(free_i[i : i + best]) and all(free_t[t : t + best]):
                free_i[i : i + best] = free_t[t : t + best] = [False] * best
                out.append((i, t, best))


def test_tiles_cover_as_much_as_the_plain_algorithm():
    r = random.Random(1)
    for _ in range(300):
        item = [r.randint(1, r.choice([3, 30])) for _ in range(r.randint(1, 60))]
        text = [r.randint(1, 30) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 4)):
            a = r.randrange(len(item))
            text += item[a : a + r.randint(1, 50)] + [99]
        got = tiling.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        want = plain_tiles(item, text, 3)
        for i, t, n in got:
            assert item[i : i + n] == text[t : t + n] and n >= 3
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got)
        assert len({x for _, t, n in got for x in range(t, t + n)}) == sum(n for *_, n in got)
        if len(set(item)) == len(item):  # without repeats the tiles are the same
            assert sorted(got) == sorted(want)


def test_planted_passages(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 60)))) for i in range(30)] + [(97, None), (98, "a b"), (None, "one two three four five six")]
    docs, want = [], set()
    for d in range(200):
        words = [word() for _ in range(r.randint(0, 300))]
        if d % 3 == 0:
            i, text = r.choice(items[:30])
            parts = text.split()
            third = len(parts) // 3
            how = d % 4
            if how == 1:  # another order
                parts = parts[2 * third :] + ["zz"] + parts[:third] + ["yy", "xx"] + parts[third : 2 * third]
            elif how == 2:
                parts = [p.upper() + "," for p in parts]
            elif how == 3:  # a third only
                parts = parts[:third]
            a = r.randint(0, len(words))
            words[a:a] = parts
            if how != 3:
                want.add((d, i))
        docs.append((d, " ".join(words), "x"))
    docs += [(None, None, ""), (500, "", ""), (501, "One, two; three\nFOUR five six seven", "")]
    want.add((501, None))
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = tiling.contaminated(frame, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
    assert all(0.6 <= x["coverage"] <= 1 for x in got)
    clean = tiling.clean_documents(frame, bench)
    assert clean.columns == frame.columns
    assert {x["doc_id"] for x in clean.collect()} == {d for d, *_ in docs} - {d for d, _ in want}


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK", 700)
    test_planted_passages(spark)


def test_empty_tables(spark):
    docs, bench = (spark.createDataFrame([], k) for k in ("doc_id long, text string", "item_id long, text string"))
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert tiling.contaminated(docs, some).count() == 0
    assert tiling.contaminated(some.withColumnRenamed("item_id", "doc_id"), bench).count() == 0
    assert tiling.clean_documents(some, bench).count() == 1


def test_loser_tree():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((r.randint(0, 9), r.randint(0, 9)) for _ in range(r.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(y for x in runs for y in x)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string, key string")


def test_archives(spark):
    r = random.Random(4)
    rows = [(i * 3, r.choice(["http://WWW.b.org/x?y=%20 1", "https://a.com/", "", None, "http://é.de/ü\r\n", "not a url", "http://[bad"]), r.choice(["", None, "same", "<p>é漢</p>\r\n\r\n" * 50, f"own {i}"]), "", "") for i in range(120)]
    rows += [(None, "http://a.com/", "lonely", "", ""), (7, "u", "z" * 300_000, "", ""), (7, "u", "z" * 300_000, "", "")]
    for fan in (64, 2):
        folder = warc.shared_dir(spark, "warc-test")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        runs = warc.write_archives(pages(spark, rows), folder)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert len(runs) > 2
        index = warc.merge_index(spark, runs, folder, fan=fan, rows_each=20)
        assert len(index) >= 2
        got = warc.captures(spark, index, folder, payloads=True).orderBy("position").collect()
        assert [x["position"] for x in got] == list(range(len(rows)))
        order = [(x["url_key"], x["ts"], -1 if x["page_id"] is None else x["page_id"]) for x in got]
        assert order == sorted(order)
        by = {}
        for p, _, html, *_ in rows:
            by.setdefault(html or "", []).append(-1 if p is None else p)
        want = {}
        for p, url, html, *_ in rows:
            data = (html or "").encode()
            top = max(by[html or ""])
            own = -1 if p is None else p
            want[p] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own == top else "revisit", None if own == top else top, data if own == top else None)
        for x in got:
            assert (x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], None if x["payload"] is None else bytes(x["payload"])) == want[x["page_id"]]
    assert re.fullmatch(r"org,b\)/x\?y=%20 1", warc.url_key("http://WWW.b.org/x?y=%20 1"))


def test_no_pages(spark):
    folder, index = warc.archive(pages(spark, []))
    assert warc.captures(spark, index, folder).count() == 0


def test_short_and_frequent_items(spark):
    """Items of fewer words than a seed stand in a row or not at all; a seed may be in many items and places."""
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "Gamma!"), (3, ""), (4, None), (5, "one two three four five")] + [(100 + i, "the same four words " * 3 + f"then {i}") for i in range(200)], "item_id long, text string")
    d = spark.createDataFrame([(1, "x ALPHA, beta y"), (2, "alpha x beta"), (3, "gamma"), (4, None), (5, ""), (6, "two three four five one"), (7, "the same four words " * 3000), (8, "alpha"), (None, "alpha beta")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in tiling.contaminated(d, bench).collect()}
    assert {x for x in got if x[0] != 7} == {(1, 1), (None, 1), (3, 2), (6, 5)}
    assert {i for a, i in got if a == 7} == {100 + i for i in range(200)}
    assert {r["doc_id"] for r in tiling.clean_documents(d, bench).collect()} == {2, 4, 5, 8}


def test_runs_of_a_fixed_size_and_given_times(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 7)
    rows = [(i, f"http://a.org/{i % 3}", f"page {i % 11}", 10_000 - i * 60) for i in range(60)] + [(60, None, None, None), (61, "http://a.org/x", "y", 1 << 62)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at long").repartition(2)
    folder, index = warc.archive(df, time_col="at")
    assert len(warc.write_archives(df, warc.shared_dir(spark, "again"), time_col="at")) >= 8
    got = warc.captures(spark, index, folder).orderBy("position").collect()
    assert [(x["url_key"], x["ts"], x["page_id"]) for x in got] == sorted((warc.url_key(u or ""), t or 0, p) for p, u, _, t in rows)
