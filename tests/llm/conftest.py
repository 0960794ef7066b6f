import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest string, row string, fp string, own_text string, kept_text string, text_sha256 string, keep_id string"


def made_rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, repeated ids and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(60)]
    rows: list[tuple] = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(1, 120))]
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[: rng.randint(30, 60)]
        text = " ".join(words).capitalize()
        if i % 5 == 0:
            text += "\nA line that many share, in full.\n" + "  a LINE that many share, in full.\t\n\n" + word()
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, rows[4][1]), (104, rows[4][1].upper()), (105, rows[8][1] + " zz"), (None, rows[8][1]), (None, None), (7, rows[7][1]), (7, "another text under the same id"), (7, rows[7][1])]
    rows += [(106, "é" * 9 + "\n" + "é" * 10), (107, "é" * 9 + "\n" + "é" * 10), (108, " ".join(word() for _ in range(30_000))), (109, "x" * 200_000), (110, "periodic " * 200)]
    rng.shuffle(rows)
    return [(d, t, "en" if (d or 0) % 2 else None, "hot" if (d or 0) % 3 else None, None, "clash", "clash", "clash", "clash", "clash", "clash", "clash") for d, t in rows]


@pytest.fixture(scope="session")
def rows():
    return made_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
