"""Rows that the tests of the operators share."""

import random


def prose(seed: int, words: int, alphabet: str = "abcdefghij") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 5))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, tiny and very long texts, exact and near copies, repeated rows."""
    base, long = prose(1, 200), prose(2, 30_000)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "en", "a"), (4, prose(3, 80), "de", None),
        (5, "", "en", "a"), (6, None, "en", "b"), (7, " \t\n ", None, "c"), (8, "one two", "en", "a"), (9, "one two", "en", "b"),
        (10, long, "en", "c"), (11, prose(4, 60) + "\n" + base, "de", "c"), (12, "x " * 300, "en", "a"),
        (13, "x " * 200, "en", "b"), (14, base, "en", "a"), (14, base, "en", "a"), (None, base, "en", "a"),
        (None, None, None, None), (15, "123 456 !!", "de", "a"), (16, prose(5, 49), "de", "b"), (17, prose(5, 50), "de", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]
