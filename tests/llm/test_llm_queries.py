"""The queries of this package against DuckDB or the whole texts themselves."""

import glob
import hashlib
import os
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from quillgraph.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
P = pytest.importorskip("public_tokenizers")


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in Q.table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet({glob.glob(f'{SF}/{t}.parquet*')!r})")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    common = sorted(want.columns)
    text = lambda v: "" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    def plain(frame):
        frame = frame[common].astype(object)
        return sorted(tuple(map(text, r)) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))

    assert plain(got) == plain(want)


def test_token_queries(spark):
    import tiktoken
    from tokenizers import Tokenizer

    from quillgraph.llm.bpe import read_ranks

    docs = documents(spark)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at = 0
    got = {r["doc_id"]: r for r in Q.op1_repair_tokens(spark, SF).collect()}
    for i in sorted(docs):
        ids = t.encode(docs[i], add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r for r in Q.op8_byte_bpe(spark, SF).collect()}
    for i, text in docs.items():
        ids = e.encode_ordinary(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_decontamination_query(spark):
    docs = documents(spark)
    items = {r["item_id"]: r["text"] for r in Q.table(spark, SF, "benchmark").collect()}
    plain = lambda s: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.lower())) + " "
    held = {(d, i) for d, t in docs.items() for i, x in items.items() if plain(x) in plain(t)}
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in Q.op10_string_tiling(spark, SF).collect()}
    assert held <= set(got) and all(got[x] == 1 for x in held)
    assert len(set(got) - held) <= 2 + len(held) // 10


def test_guard_leaves_the_rest(tmp_path):
    """Without this package and the pipeline the entry still imports and keeps the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, left_out in (("quillgraph", "llm"), ("tests", "llm")):
        shutil.copytree(os.path.join(root, folder), tmp_path / folder, ignore=shutil.ignore_patterns(left_out, "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(os.path.join(root, name), tmp_path)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=tmp_path, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_functions.py", "-q", "-x"], cwd=tmp_path, check=True, env=env)
