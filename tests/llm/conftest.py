import random

import pytest

WORDS = [f"w{k}" for k in range(60)] + ["été", "über", "año", "The", "END."]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def fixture_rows() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, ties, repeated rows, empty and long texts."""
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(15, 220)) for _ in range(40)]
    passage = prose(rng, 90)
    texts = base + base[:6] + [base[7].replace(" ", "  ", 3), base[8] + " tail", base[9] + "\n" + passage, passage + " x " + base[10], passage * 2]
    words = base[20].split()
    texts += [" ".join([*words[:40], "changed", *words[41:]]), "a" * 900, "", None, " \n\t ", "one", "one two", "One TWO", prose(rng, 6000), base[3], "x\x00y " * 30]
    rows = [(k, t, "en", "hot" if k % 3 else "s", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, base[2], None, None, None), (None, None, "en", "s", 0)]


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    """The rows with further columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, _id int, key int, size string, length int, rank int"
    return spark.createDataFrame([(*r, "mine", 1, 2, "big", 3, 4) for r in fixture_rows], schema).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
