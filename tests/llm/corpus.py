"""A small corpus with the cases that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score string, shard string, node string"


def prose(seed: int, n: int) -> list[str]:
    """n words that hardly repeat."""
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghilmnoprstuvé", k=rng.randint(2, 8))) for _ in range(n)]


def rows(texts: dict[int | None, str | None] | list[tuple[int | None, str | None]]) -> list[tuple]:
    pairs = texts.items() if isinstance(texts, dict) else texts
    return [(i, t, None, "s", len(t or ""), "old", "old", "old", "old") for i, t in pairs]


def table(spark, texts):
    """A documents table with extra columns whose names clash with those of operators."""
    return spark.createDataFrame(rows(texts), SCHEMA)


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, blanks, a long text, equal rows, a repeated id, unusual characters."""
    long = " ".join(prose(99, 30_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, long), (6, "It's 12 o'clock, ÉCOLE ΣΑΣ \x1c <|endoftext|> 漢字 ½"),
        (7, "same same"), (7, "same same"), (8, "same same"), (None, "no id here"), (9, "a" * 5000), (10, "x\x0by\x85z w"),
    ]


def shingles(text: str | None) -> set:
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
