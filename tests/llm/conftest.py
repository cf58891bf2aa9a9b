import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, span string, score string, row string, x string"


def words(rng, n, size=900):
    return " ".join(f"w{rng.randrange(size)}{'abcdefgh'[rng.randrange(8)]}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Plain texts, exact and near copies, a shared passage, nulls, empties, odd spaces, a long text."""
    rng = random.Random(4)
    base = [words(rng, rng.randrange(30, 120)) for _ in range(40)]
    passage = words(rng, 45)
    out = list(base)
    out += [base[0], base[0], base[1], base[1].upper()]
    for k in range(6):  # near copies: one word changed
        w = base[2].split()
        w[5 + k] = f"changed{k}"
        out.append(" ".join(w))
    out += [f"{b} {passage} {words(rng, 20)}" for b in base[10:16]]
    out += [None, None, "", "   \n\t ", "a", "a", "a b c d", "A B C D", "a b c d e", "x\x0by\x0cz\r\nw", "  　 é É", "日本語 のテキスト 。", "!!! ??? 123"]
    out += [words(rng, 30_000), " ".join(["la"] * 400), " ".join(["la", "di"] * 150)]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    out = [(i + 10, t, ["en", "de", None][i % 3], "s", len(t or ""), "clash", "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, texts[4], "en", "s", 1, None, None, None, None, None), (None, texts[5], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    from tapegrain.llm.common import prepare
    return prepare(spark).createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark, docs):
    return docs.limit(0)
