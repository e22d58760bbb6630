import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa Lambda mu nu xi omicron pi rho sigma tau upsilon café naïve".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): prose with copies, near copies, shared passages, empty, null and odd texts."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(25)]
    passage = prose(rng, 60)
    out = list(base)
    out += [base[0], base[0].upper(), base[1]]
    for i in range(6):  # near copies of one text, some far enough to be none
        w = base[2].split()
        for _ in range(i * 2):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
        out.append(" ".join(w))
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 25) for _ in range(4)]
    out += [passage + "\n" + passage, "", None, "word", "two words", " \t\n", "same " * 50, "日本語 テキスト", "a\x1cb \x85 c", "x" * 3000]
    return [(i * 7 % 101, t) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns beside them whose names clash with those inside the operators."""
    full = [(i, t, "x", 1, "y", 2.0) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, keep_id string, tag int, d string, score double")


@pytest.fixture(scope="session")
def odd(spark):
    """A null id, a repeated row, one id with two texts."""
    data = [(None, "one two three four five six seven"), (5, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "a b c"), (6, "d e f"), (None, None)]
    return spark.createDataFrame(data, "doc_id long, text string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
