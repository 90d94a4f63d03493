"""Fixtures of these tests."""

import random

import pytest

from sensorcast.llm.shipping import ship


@pytest.fixture(scope="session")
def workers(spark):
    ship(spark)
    return spark


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def documents(workers):
    """Odd documents, with columns whose names operators use themselves."""
    base = prose(1, 80)
    passage = prose(2, 60)
    rows = [
        (1, base),
        (2, base),  # exact copy
        (3, base.replace(" ", "\t", 3) + "\n"),  # the same words
        (4, base + " one more"),  # near copy
        (5, prose(3, 30) + " " + passage + " " + prose(4, 30)),
        (6, passage + " " + prose(5, 10)),  # shares a passage of over 50 words
        (7, None),
        (8, ""),
        (9, " \n\t "),
        (10, "Two words"),
        (11, "two WORDS"),
        (12, "é中 x\xa0y 🙂  <|endoftext|> </s> ▁a"),
        (13, prose(6, 30_000, 20_000)),  # very long
        (14, "la " * 90),  # repeats itself
        (15, 'x = "k"; PASSWORD: "abcd1234efgh"; token=short; AKIA' + "A1" * 8 + " " + "0af" * 20 + " 🙂 api_key=" + "Z" * 9),
        (15, prose(7, 50)),  # a doc_id twice
        (16, prose(8, 50)),
        (16, prose(8, 50)),  # a row twice
        (None, prose(9, 50)),
        (None, base),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, mix int, secrets int, bin int, n_words int"
    full = [(i, t, None if n % 3 else "en", None if n % 4 else "src0", None if t is None else len(t), 0, 0, 0, 0, 0) for n, (i, t) in enumerate(rows)]
    return workers.createDataFrame(full, schema)


def bag(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
