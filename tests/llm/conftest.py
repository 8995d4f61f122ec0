"""Texts for the corpus operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, fingerprint int, host string, spans string, word string, key int"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def words(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Null, empty and very long texts, ties, repeated rows, a null id, near copies."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(3, 60)) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100 + k, base[k]) for k in range(8)]  # copies
    rows += [(200 + k, base[k] + " zz") for k in range(8)]  # near copies
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "one two"), (305, "É ü ß 日本語"), (306, words(rng, 30_000)), (None, base[0]), (None, "nobody's text"), (5, base[5]), (5, base[5])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with columns whose names an operator may use itself."""
    rows = [(i, t, ["en", "fr", None, "xx"][k % 4], ["a", "a", "b", None][k % 4], len(t) if t else None, "x", k, "h", "s", "w", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
