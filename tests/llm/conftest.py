import random

import pytest

SCHEMA = "text string, doc_id long, bucket string, n_chars long, guest string"


def fixture_rows():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "naïve", "x.", "don't", "we're", "***", "漢字"]
    base = [" ".join(rnd.choice(vocab) for _ in range(120)) for _ in range(6)]
    rows = [None, "", " ", "\n\n", "one", "one", "a b", "the the the " * 30, "x" * 5000, "\n".join(["same line here"] * 5 + ["other"]), "<|endoftext|> a <|startoftext|>", "ends \n\n  "]
    rows += base + base[:2]
    passage = base[0].split()[10:60]
    for i in range(6):
        rows.append(" ".join([*(rnd.choice(vocab) for _ in range(20 + i)), *passage, *(rnd.choice(vocab) for _ in range(5))]))
    near = base[3].split()
    near[50] = "changed"
    rows.append(" ".join(near))
    rows.append(base[4] + "\n" + base[5] + "\n" + base[4])
    rows.append(("Line number one of a text.\n" * 3) + "tail")
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward rows, with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(t, i * 3 + 1, "b", -1, "g") for i, t in enumerate(fixture_rows())], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def texts():
    return {i * 3 + 1: t or "" for i, t in enumerate(fixture_rows())}


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
