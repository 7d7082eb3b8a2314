"""Invented texts."""

import random

LETTERS = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


def prose(seed, n, sep=" "):
    pick = random.Random(seed)
    return sep.join("".join(pick.choice(LETTERS) for _ in range(pick.randint(1, 3))) for _ in range(n))


def mutate(text, seed, changes):
    pick, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[pick.randrange(len(words))] = pick.choice(LETTERS) + "zz"
    return " ".join(words)
