import random

import pytest

from vitalgrid.llm.work import ship

WORDS = [a + b + c for a in ("ba", "do", "ki", "lu", "me", "ra", "so", "ti") for b in ("n", "r", "s", "t", "l") for c in ("a", "e", "io", "um", "ix")]


@pytest.fixture(scope="session")
def sent(spark):
    ship(spark)
    return spark


@pytest.fixture
def prose():
    """prose(seed, n): n words."""
    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n))
    return make


@pytest.fixture
def near():
    """near(text, seed, edits): the text with some words replaced."""
    def make(text: str, seed: int, edits: int) -> str:
        rng, words = random.Random(seed), text.split(" ")
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        return " ".join(words)
    return make
