import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def prose(seed: int, n: int, words=("the", "of", "Haus", "été", "niño", "und", "stone", "river.")) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ly", "ung"]) for _ in range(n))


# Null ids and texts, empty and very long texts, ties and repeated rows.
ODD = [
    (None, None), (None, "a b"), (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, LONG),
    (5, prose(1, 90)), (6, prose(1, 90)), (6, prose(1, 90)), (7, prose(2, 60)), (7, prose(3, 60)),
    (8, "x"), (9, "  two  spaces \n"), (10, "<|endoftext|> 中文 𝒳\x1c1\x852"), (11, prose(1, 89)),
]


@pytest.fixture
def odd(spark):
    """Documents of all odd kinds, with columns whose names operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", "s", 0, 1, 2, "x") for i, t in ODD],
        "doc_id long, text string, lang string, source string, n_chars long, h int, d int, spans string")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
