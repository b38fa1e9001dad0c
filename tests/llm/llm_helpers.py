"""Texts and the plain definition of shingles."""

import random
import re

VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vat", "pim") for c in ("", "da", "es", "on", "ig")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def shingle_list(text):
    """Five-word shingles of a text, by the plain definition."""
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else []
