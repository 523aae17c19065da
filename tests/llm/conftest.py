import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp bigint, score int, part string, component_id string, value int, held string, block string, positive string"


def sentences(rng, n, words="abcdefghij klmno pqr the of and to in"):
    pool = words.split() + [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnrst") + str(k) for k in range(200)]
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", " ", "é è ü", "x " * 30_000, sentences(rng, 40_000), "#$%\n" * 50, "\x00\x01 \x1c y", "日本語 テキスト", "🙂 🙂"]
    texts += [sentences(rng, rng.randint(1, 120)) for _ in range(30)]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s", None]), None, "x", 1, 2, "p", "c", None, "h", "b", "q") for k, t in enumerate(texts)]
    rows += rows[:15]  # repeated rows
    rows += [(100 + k, texts[20], "en", "s", 3, None, None, None, None, None, None, None, None, None) for k in range(5)]  # copies
    rows += [(None, texts[20], None, None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose(spark):
    """Two 'languages' with labels, enough to learn from."""
    rng = random.Random(9)
    parts = {"aa": ["zu", "ko", "mi", "ra"], "bb": ["the", "ing", "er", "st"]}
    rows = []
    for k in range(240):
        lang = "aa" if k % 2 else "bb"
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 80)))
        rows.append((k, text, lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
