import random

import pytest
from llm_helpers import prose

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, _id long, _s string, _h int, count int, row string, _marks string, root long"


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text) with copies, near copies, shared passages, empty, null and one long text."""
    rng = random.Random(4)
    texts = [prose(rng, rng.choice((8, 60, 150, 400))) for _ in range(40)]
    shared = prose(rng, 70)
    for i in (3, 9, 22):
        texts[i] = f"{prose(rng, 80)} {shared} {prose(rng, 50)}"
    texts[12] = texts[30] = texts[31] = texts[5] = prose(rng, 200)
    for i, k in ((13, 1), (14, 2), (15, 6), (16, 30)):
        w = texts[5].split(" ")
        for _ in range(k):
            w[rng.randrange(len(w))] = "xx" + str(rng.randrange(1000))
        texts[i] = " ".join(w)
    texts[20], texts[21], texts[23], texts[24] = "", None, "one two three", "one two three"
    texts[25] = prose(rng, 20_000)
    texts[26] = "é" * 300 + " naïve ça 漢字 " * 20
    texts[27] = "ab" * 400
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(d, t, "en", "web" if d % 3 else "books", len(t or ""), d, "x", 1, 2, "r", "m", 7) for d, t in corpus]
    rows += [(None, "a row without an id and five more words", None, None, None, None, None, None, None, None, None, None), rows[5]]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)
