"""Texts that the corpus operators' tests share."""

import random

WORDS = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st", "uv", "wx", "yz", "zu", "é", "ñu", "Oh", "The", "x|y", "9"]


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


#: Texts that every operator must stand: nulls, empty, blank, ties, repeated and very long ones.
ODD = [None, "", " \n\t ", "one", "one", "Two words", "a b c", "a b c", "no-letters 123 !!", "x" * 5000, "é" * 300, "\x00\x1f odd \x85", "w " * 3000, prose(1, 4000)]
