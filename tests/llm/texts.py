from __future__ import annotations

import random


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    """Prose of made-up words, the same for the same arguments."""
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))
