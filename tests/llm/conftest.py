from __future__ import annotations

import pytest

from corpuscope.session import materialize

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " row long, id string, size string, n string, score string, lang_pred string, node string, words string"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def prose(n: int, seed: int = 0) -> str:
    return " ".join(WORDS[(i * i + seed * 7 + i * seed) % len(WORDS)] + str((i + seed) % 5) for i in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and
    extra columns named like the operators' own."""
    texts = [
        (1, prose(60, 1), "en", "a"), (2, prose(60, 1), "en", "a"), (2, prose(60, 1), "en", "a"), (3, None, None, None),
        (4, "", "en", None), (5, " \n\t ", "fr", "b"), (6, prose(59, 1) + " omega", "en", "b"), (7, "x", None, "b"),
        (None, prose(40, 3), "fr", "c"), (None, None, None, None), (8, prose(40, 3) + " é😀 ç", "fr", "c"),
        (9, "long" * 30_000, "en", "a"), (10, prose(4_000, 5), "en", "a"), (11, "12 34 --", "en", "a"), (12, "é" * 70, "fr", "d"),
    ]
    return [(d, t, lang, s, None if t is None else len(t), 7, "i", "s", "n", "z", "l", "k", "w") for d, t, lang, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return materialize(spark.createDataFrame(odd_rows(), SCHEMA), "odd-rows")


@pytest.fixture(scope="session")
def empty(odd):
    return materialize(odd.where("false"), "no-rows")
