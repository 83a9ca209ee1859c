"""Invented texts for the tests."""

import random

SYLLABLES = "ka lo mi ter su ren dal vo pri nek tu sha bor lin gem".split()


def word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def sentence(r: random.Random, n: int) -> str:
    return " ".join(word(r) for _ in range(n)).capitalize() + "."


def prose(r: random.Random, n: int) -> str:
    """About n words in sentences, some of them on new lines."""
    out = []
    while n > 0:
        k = r.randint(4, 14)
        out.append(sentence(r, k) + r.choice([" ", " ", "\n"]))
        n -= k
    return "".join(out).strip()
