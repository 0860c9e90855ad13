"""Texts for the tests of this folder."""
import random


def prose(seed: int, n: int) -> str:
    """``n`` words of plain text, a sentence in ten, a line in forty."""
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was"]
    words = [rng.choice(common) if rng.random() < .4 else "".join(
        rng.choice(["ba", "lo", "mi", "ter", "san", "que", "rin", "dol"]) for _ in range(rng.randint(1, 4)))
        for _ in range(n)]
    for i in range(0, n, 10):
        words[i] = words[i].capitalize()
        words[i - 1] += "." if i else ""
    return "".join(w + ("\n" if i % 40 == 39 else " ") for i, w in enumerate(words)).strip()
