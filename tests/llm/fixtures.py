"""Small tables for the operator tests."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ne", "po", "ra", "si", "tu", "ve") for b in ("n", "r", "s", "t", "l", "m")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def corpus(n: int = 60, seed: int = 7) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars) with copies, edits, empty and null texts."""
    rng = random.Random(seed)
    texts: list[str | None] = []
    for i in range(n):
        kind = i % 6
        if kind < 3 or not i:
            texts.append("\n".join(sentence(rng, rng.randint(12, 30)) for _ in range(rng.randint(3, 6))))
        elif kind == 3:
            texts.append(texts[rng.randrange(len(texts))])
        else:
            words = (texts[rng.randrange(len(texts))] or "").split(" ")
            for _ in range(rng.choice((1, 2, 6))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    texts += [None, "", " \n ", "one", "one two three four", "one two three four", "password = abcdef123456"]
    return [(i, t, "en", f"src{i % 3}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def clashing(df):
    """The same rows with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ("ids", "spans", "score", "a", "b", "line", "host", "content", "bands", "member", "node", "component",
             "words", "counts", "hits", "kept", "key", "asked", "first", "variant", "toxic", "evidence", "decoded")
    return df.select("*", *(F.lit(1).alias(n) for n in names))
