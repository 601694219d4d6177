"""Synthetic prose, and the plain definitions of words."""

import re

SYLLABLES = "ka lo mi ter na vu sol pen dri go sha bel tor im re qua zon el ust fir".split()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def sentence_text(rng, n, per_line=12):
    w = words(rng, n)
    return "\n".join(" ".join(w[i : i + per_line]).capitalize() + "." for i in range(0, n, per_line))


def mutate(rng, text, changes):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), min(changes, len(w))):
        w[i] = "x" + w[i]
    return " ".join(w)
