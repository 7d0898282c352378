"""Small documents with every odd case: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    long = prose(1, 30_000)
    text = prose(2, 120)
    rows = [
        (1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (2, text, "en", "b", None), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", "de", None, 4), (6, long, "en", "a", len(long)),
        (7, long + " tail", "en", "a", 9), (None, text, "en", "a", 1), (None, prose(3, 70), None, "b", 2), (8, "one", "en", "a", 3), (9, "ü ß 😀 \x00 　 end", "fr", "é", 5), (10, prose(4, 60) + " " + text, "en", "a", 1),
    ]
    return rows + [(100 + i, prose(100 + i, 80), "en", "c", 500) for i in range(30)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with further columns, named as the operators name their own."""
    from pyspark.sql import functions as F

    names = "row id hash keep th fp root size taken epoch n no takes _mix_epoch _mix_words _score _kept _text_score _meta_score lost_id lost_th kept_text starts hashes sha key fold quality toxic score kept licence path component_id node".split()
    return odd.withColumns({n: F.lit("x") for n in names})
