import random

import pytest


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "of", "tion", "ing", "ré", "ou", "th", "ea", "er", "st", "中", "an"]
    ws = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + ("." if rng.random() < 0.1 else "") for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", "\n", "  "]) for w in ws)


def rows() -> list[tuple]:
    """Copies, near copies, shared passages, repeated rows, ids that are null or there twice, texts that are null, blank, short or long."""
    base = prose(1, 300)
    passage = prose(2, 60)
    edited = base.split(" ")
    edited[10] = "changed"
    out = [
        (5, base), (3, base), (9, base), (9, base), (7, " ".join(edited)), (8, base.upper()), (20, prose(3, 120) + passage + prose(4, 90)), (21, passage + prose(5, 70)),
        (22, prose(6, 80) + passage), (30, None), (31, ""), (32, " \n\t "), (33, "word"), (34, "word"), (35, "two words"), (None, prose(7, 70)), (None, base), (None, None),
        (40, "same line here\n" * 40), (41, "a b c " * 100), (42, prose(8, 60) + " ### $$$ " * 20), (50, prose(9, 9000)), (51, "x" * 5000), (51, prose(10, 55)),
        (-4, passage), (60, "é" * 150), (61, "è" * 150 + "é" * 101),
    ]
    out += [(100 + k, " ".join(prose(11, 200).split(" ")[: 190 + k])) for k in range(8)]
    return out + [(200 + k, prose(50 + k, 40 + 9 * k)) for k in range(12)]


@pytest.fixture(scope="session")
def given() -> list[tuple]:
    return rows()


@pytest.fixture(scope="session")
def docs(spark, given):
    """The rows with more columns, whose names clash with those that operators use."""
    names = "id long, route int, kept string, n_words double, receiver string, row int, carried string, shard string, starts string, lang string, n_chars long"
    full = [(i, t, None if k % 3 else k, k, "k", 1.0, None, k, "c", "s", "x", ("en", None)[k % 2], None if t is None else len(t)) for k, (i, t) in enumerate(given)]
    return spark.createDataFrame(full, f"doc_id long, text string, {names}").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
