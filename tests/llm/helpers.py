"""Small fixtures and brute force for the training-data operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "épsilon", "zeta!", "1234", "%%"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(20_000))
    same = "the same text of these copies is here for every one of them to find"
    rows = [
        (1, same), (2, same), (2, same), (3, None), (None, "a text whose document has no id at all"), (None, None), (4, ""), (5, "   \n\t "),
        (6, long), (7, long + " end"), (8, "x" * 70_000), (9, "一二三四五六七八九十" * 300), (10, "one"), (11, "one"), (-5, same + " and more"),
    ]
    return spark.createDataFrame([(*r, 7, "z", 0.5, "g", 9) for r in rows], "doc_id bigint, text string, shard int, score string, count double, `group` string, key1 int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def invented(rng, n_words):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n_words))
