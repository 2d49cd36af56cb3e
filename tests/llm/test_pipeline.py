"""Every stage of the pipeline against plain Python, on its own input."""

import os
import re

import pytest

import corpus_pipeline as C

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark):
    docs = C.table(spark, SF, "documents")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in C.table(spark, SF, "labels").collect()}

    def step(i, frame):
        out = C.stored(C.STAGES[i][1](spark, frame, SF), f"test{i}")
        return out, {r["doc_id"]: r for r in out.collect()}

    frame, kept = step(0, docs)
    assert frame.columns == columns
    right = sum((i in kept) == bool(q) for i, q in labels.items())
    assert right >= 0.97 * len(labels)
    assert all(kept[i] == before[i] for i in kept)

    before = kept
    frame, kept = step(1, frame)
    assert frame.columns == columns
    seen = []
    for i in sorted(before):
        left, lost = [], 0
        for line in (before[i]["text"] or "").split("\n"):
            s = set(words(line))
            if s and any(100 * len(s & e) >= 90 * len(s | e) for e in seen):
                lost += 1
            else:
                left.append(line)
            if s:
                seen.append(s)
        if lost and not "\n".join(left).strip(" "):
            assert i not in kept
        else:
            assert kept[i]["text"] == "\n".join(left) and kept[i]["n_chars"] == (len(kept[i]["text"]) if lost else before[i]["n_chars"])

    before = kept
    frame, kept = step(2, frame)
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(r["text"])) else set() for i, r in before.items()}
    root = {i: i for i in before}
    for i in sorted(before):
        for j in sorted(before):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert set(kept) == {i for i in before if root[i] == i}

    before = kept
    frame, kept = step(3, frame)
    items = [r["text"] for r in C.table(spark, SF, "benchmark").collect()]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    held = {i for i, r in before.items() if any(plain(t) in plain(r["text"] or "") for t in items)}
    assert not held & set(kept) and len(set(before) - set(kept) - held) <= 0.05 * len(before)

    before = kept
    frame, kept = step(4, frame)
    import tiktoken

    from quillgraph.llm import bpe

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert set(kept) == set(before)
    assert all(r["ids"] == e.encode_ordinary(before[i]["text"] or "") and r["n_tokens"] == len(r["ids"]) and r["text"] == (before[i]["text"] or "") for i, r in kept.items())


def test_run(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"] and 0 < out.count() < 200


def test_odd_documents(spark, tmp_path):
    """Nulls, repeats, ties, long texts and clashing columns through every stage."""
    C.table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    C.table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    known = {r["doc_id"]: r["text"] for r in C.table(spark, SF, "documents").join(C.table(spark, SF, "labels").where("quality = 1"), "doc_id").collect()}
    good = max(known.values(), key=len)
    other = sorted((t for t in known.values() if len(t) > 300), key=hash)[0]
    rows = [(1, good, 1), (1, good, 2), (None, good, 3), (None, other, 4), (None, None, 5), (2, None, 6), (2, "", 7), (3, (other + "\n") * 300, 8)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), n, n, n) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars int, n_lines int, n_removed int, mark int")
    frame = docs
    for i, (name, stage) in enumerate(C.STAGES):
        for odd in (frame, docs.limit(0)):
            out = C.stored(stage(spark, odd, str(tmp_path)), f"odd{i}")
            assert i == 4 or out.columns == docs.columns
            if odd is not frame:
                assert out.count() == 0
            else:
                result = out
        if i == 2:
            marks = [r["mark"] for r in C.STAGES[2][1](spark, docs, str(tmp_path)).collect()]
            assert sum(m in (1, 2) for m in marks) == 1 and 3 not in marks and {5, 6, 7} <= set(marks)
        frame = result
