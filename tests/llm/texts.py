"""Made-up prose for small cases."""

import random

WORDS = [a + b + c for a in ("th", "er", "on", "an", "re") for b in ("ea", "ou", "in", "ed") for c in ("", "ly", "st", "nd")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))
