"""Small corpora with every odd case, and plain forms of the operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose with copies, near copies, nulls in every column, empty, short and very long texts, and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([5, 30, 120, 300])) for _ in range(n)]
    rows = [(k, t, rng.choice(["en", "de", "fr", "es"]), f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    for k in range(0, n, 5):
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        rows.append((n + k, " ".join(w), "en", "s0", 1))
        rows.append((n + k + 1, texts[k], None, None, None))
    rows += [
        (1000, None, None, None, None),
        (1001, "", "en", "s1", 0),
        (1002, " \t\n ", "en", "s1", 4),
        (1003, "one", "en", "s1", 3),
        (1004, "one two", "en", "s1", 7),
        (1005, prose(rng, 20_000), "en", "s2", 1),
        (None, prose(rng, 60), "en", "s2", 1),
        (None, None, None, "s2", None),
        rows[3],
        rows[3],
    ]
    return rows


def frame(spark, rows: list[tuple], schema: str = SCHEMA):
    return spark.createDataFrame(rows, schema)
