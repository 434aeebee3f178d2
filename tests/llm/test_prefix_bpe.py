import os
import random

import pytest
from pyspark.sql import functions as F

from aerolith.llm import prefix_bpe as B

pytestmark = pytest.mark.skipif(not os.path.isdir(B.TOKENIZERS), reason="no public tokenizers")
ALPHABETS = ["abcdefghij", "aab", "etaoin shrdlu", "   \n\t.,;0123456789", "日本語éàüñ가나다мирα🙂‍", "the of and ing", "'s't've"]


def texts(n, seed):
    rnd = random.Random(seed)
    out = ["", " ", "<|endoftext|>", "\x00﻿​", "a" * 5000, "日" * 300, " " * 700, "ab" * 2000 + "\r\n"]
    return out + ["".join(rnd.choice(rnd.choice(ALPHABETS)) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{B.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    mine, ts = B.vocabulary("byte_bpe_50k"), texts(3000, 1)
    for s, e in zip(ts, t.encode_batch(ts, add_special_tokens=False)):
        assert mine.encode(s) == e.ids, repr(s)


def test_rank_file_equals_the_library():
    import base64

    import tiktoken

    with open(f"{B.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = B.vocabulary("byte_bpe_multi_50k")
    for s in texts(2000, 2):
        assert mine.encode(s) == t.encode_ordinary(s), repr(s)


def test_round_trip():
    mine = B.vocabulary("byte_bpe_50k")
    back = {i: t.encode("latin-1") for t, i in mine.tokens.items()}
    for s in texts(500, 3):
        assert b"".join(back[i] for i in mine.encode(s)).decode() == s


def test_every_token_is_its_own_encoding():
    mine = B.vocabulary("byte_bpe_50k")
    for t, i in list(mine.tokens.items())[::7]:
        known = mine.tokens.pop(t)  # without the shortcut for whole tokens
        try:
            assert mine.encode_piece(t) == [i]
        finally:
            mine.tokens[t] = known


def test_column(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x")], "doc_id long, text string, ids string")
    rows = {r["doc_id"]: r["got"] for r in df.select("doc_id", B.token_ids(F.col("text")).alias("got")).collect()}
    assert rows == {1: [15496, 995], 2: [], 3: []}
    assert df.limit(0).select(B.token_ids(F.col("text"))).count() == 0
