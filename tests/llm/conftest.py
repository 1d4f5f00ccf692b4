import random

import pytest

WORDS = "the of and to a in is that for on with was house river stone garden light winter paper market letter window music silver morning".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", ".\n"]) for _ in range(n)).strip()


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empties, copies, near copies, shared passages, a long one and odd white space."""
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randrange(5, 200)) for _ in range(60)]
    passage = prose(rnd, 60)
    for i in range(8):
        near = texts[0].split(" ")
        near[rnd.randrange(len(near))] = f"changed{i}"
        texts.append(" ".join(near))
    texts += [texts[1]] * 5 + [texts[i] + " " + passage + " " + prose(rnd, 20) for i in range(5, 11)]
    texts += [None, "", " \n\t ", "one", "one", "two words", "12345 !!", "a  b   c \n\n d", "é" * 300 + " 漢字 ñandú", "ab " * 400, prose(rnd, 20_000), "x" * 5000]
    return [(i, t, rnd.choice(["en", "de", None]), f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows over several partitions, with extra columns whose names clash with those of the operators."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "'x' AS n", "1 AS token", "'y' AS sig", "0 AS start", "'z' AS component", "'k' AS kept", "1.5 AS score").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
