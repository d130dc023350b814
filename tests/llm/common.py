"""Small tables with what real ones may hold, and plain forms of the rules."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, n_words STRING, part STRING, found STRING, score STRING, kept STRING, window STRING"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed: int, n: int, syllables=("an", "re", "ti", "on", "the", "ea")) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text) pairs, or longer tuples in the order of SCHEMA; other columns are null or hold a clashing name's value."""
    full = [tuple(r) + ("en", "src0", 0)[len(r) - 2 :] + ("x",) * 6 for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    return [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "One"), (8, base + " more"), (None, base), (None, None),
        (9, prose(2, 400)), (10, prose(3, 30_000)), (11, "É ß  x y 🙂 " * 30), (12, "a" * 200_000), (13, "ab " * 5000), (13, "other text of a repeated id"),
    ]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
