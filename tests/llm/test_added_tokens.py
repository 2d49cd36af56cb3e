"""Texts that hold the vocabulary's added tokens, against the library's default on whole texts."""

import random
import zlib

import numpy as np
import pytest

from quillgraph.llm import queries as Q

P = pytest.importorskip("public_tokenizers")


def test_op1_finds_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "see", "café", "漢", "'s", "!", "12", " ", " ", "\n", "<", "|>"]
    texts = ["see <|endoftext|> here", "a", "x<|endoftext|>", "<|startoftext|>!?", None] + ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {x["doc_id"]: tuple(x) for x in Q.op1_repair_tokens(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert got[i] == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
