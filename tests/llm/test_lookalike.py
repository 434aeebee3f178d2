import itertools

import pytest
from pyspark.sql import functions as F

from aerolith.llm import lookalike as L

SCHEMA = "doc_id long, text string, raw string, look string, class_id long"


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y", 5) for i, t in texts], SCHEMA)
    return sorted(map(tuple, L.pairs(*L.lookalikes(df, "doc_id", "text")).collect()))


SAME = [
    ("Hello, world!", "Ｈｅｌｌｏ， ｗｏｒｌｄ！"), ("café ệ", "café ệ"), ("ệ", "ệ"), ("ab", "a​b"), ("ab", "﻿a­⁠b‍"), ("a b", "a b"), ("a b", "a　b"), ("a b", "a b"),
    ("cope", "соре"), ("Tim", "Ⅰ".replace("Ⅰ", "T") + "ⅰⅿ"), ("bóo", "bόo"), ("ガ", "ｶﾞ"), ("각", "각"), ("e͏́x", "éx"), ("è", "ѐ"), ("μ", "µ"),
]
APART = [("a", "A"), ("resume", "résumé"), ("x2", "x²"), ("1", "①"), ("a b", "a  b"), ("a b", "a\nb"), ("a\tb", "a b"), ("ab", "a b"), ("a.", "a,"), ("l", "1"), ("O", "0"), ("か", "カ"), ("が", "か"), ("-", "–"), ("ß", "ss"), ("ﬁ", "fi"), ("o", "º")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(spark, a, b):
    assert found(spark, [(1, a), (2, b)]) == [(1, 2)]


def test_apart(spark):
    texts = [(2 * n + s, f"{n} {t}") for n, pair in enumerate(APART) for s, t in enumerate(pair)]
    assert found(spark, texts) == []


def test_copies_nulls_blanks_and_long_texts(spark):
    long = "word " * 40_000
    texts = [(1, "abc"), (2, "abc"), (3, "аbc"), (4, "ａｂｃ"), (5, None), (6, ""), (7, " "), (8, " "), (9, "​"), (10, "　​"), (11, long), (12, long.replace("o", "о")), (None, "аbс")]
    assert found(spark, texts) == sorted([(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (11, 12)])


def test_canonical_member(spark):
    df = spark.createDataFrame([(3, "аbc"), (4, "abc"), (6, "abc"), (1, "ａbc"), (7, "other"), (8, None)], "doc_id long, text string")
    got = sorted(map(tuple, L.canonical(*L.lookalikes(df, "doc_id", "text")).collect()))
    assert got == [(1, 4), (3, 4), (4, 4), (6, 4), (7, 7)]


def test_empty(spark):
    assert found(spark, []) == []


def test_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_SHARE", 3)
    df = spark.range(110_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").when(F.col("id") == 1, "sаme text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    assert L.pairs(*L.lookalikes(df, "doc_id", "text")).count() == 55_000


def test_map_is_a_function_onto_plain_signs():
    m = L.shape_map()
    assert all(len(k) == 1 and len(v) <= 1 for k, v in m.items())
    assert not any(v in m and m[v] != v for v in m.values() if v)
    assert all(not k.isascii() for k in m)
    assert sum(map(len, L.SAME_SHAPE.values())) <= 200
    letters = list(itertools.chain(*L.SAME_SHAPE.values()))
    assert len(letters) == len(set(letters))


@pytest.mark.parametrize("sign", ["\u0001", "\u007f", "\ufff9", "\U000e0041", "\U000e0100"])
def test_ignorable_signs_left_to_the_collation(spark, sign):
    assert sign not in L.shape_map()
    assert found(spark, [(1, "ab"), (2, f"a{sign}b"), (3, "aB"), (4, sign), (5, f" {sign}{sign}")]) == [(1, 2)]


#: One pair of each block that holds letters of other letters' shapes.
BLOCKS = [
    ("a", "\u0430"), ("w", "\u0461"), ("O", "\u2c9e"), ("o", "\u2c9f"), ("A", "\u13aa"), ("s", "\uabaa"), ("B", "\ua4d0"), ("O", "\u0555"), ("o", "\u0585"), ("C", "\u2ca4"), ("p", "\u2ca3"),
    ("\u039f", "\u041e"), ("\u03bf", "\u043e"), ("\u2c9f", "\u0585"), ("\u529b", "\u30ab"), ("T", "\u13a2"), ("K", "\u2c94"), ("v", "\u03bd"),
]
#: Letters of the table that a reader tells apart, and letters of other case.
TOLD_APART = [("a", "\u03b1"), ("o", "\u03c3"), ("y", "\u03b3"), ("p", "\u03c1"), ("b", "\U0001d41b"), ("O", "0"), ("l", "I"), ("l", "1"), ("m", "rn"), ("c", "\u2ca4"), ("k", "\u212a")]


def test_letters_of_every_block(spark):
    texts = [(2 * n + s, f"{n} x{t}y") for n, pair in enumerate(BLOCKS) for s, t in enumerate(pair)]
    assert found(spark, texts) == [(2 * n, 2 * n + 1) for n in range(len(BLOCKS))]


def test_told_apart(spark):
    texts = [(2 * n + s, f"{n} x{t}y") for n, pair in enumerate(TOLD_APART) for s, t in enumerate(pair)]
    assert found(spark, texts) == []


def test_look_map_ends_after_one_step(spark):
    m = L.look_map()
    assert len(m) > 800 and not any(v in m and m[v] != v for v in m.values() if v)
    assert all(m[k] == m.get(v, v) for k, v in L.shape_map().items())
