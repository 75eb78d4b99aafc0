import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, row string, score double, size long, keep_id long, "
    "node string, id long, text_key long, archive string, target double, copies string, _row string, label int"
)


def wordy(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(1 + rng.randrange(6))) + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables need few tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, one-word, repeated, very long and ordinary texts, some in other scripts."""
    rng = random.Random(4)
    some = [wordy(rng, rng.randrange(1, 120)) for _ in range(40)]
    return [
        None, "", " \n\t ", "one", "one", "two words", "a b c d", "a b c d e", "日本語のテキスト", "naïve café — ½ ▁x▁ 🙂\n\n\ttabs", "x" * 5000, "word " * 3000,
        wordy(rng, 20_000), *some, *some[:12], "line one is here\nline two\nline one is here\n\nline one is here", "same " * 10, "12345 !!! ***",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """Those texts with repeated rows, null and repeated ids, null sources and columns named like the operators' own."""
    rows = []
    for k, text in enumerate([*texts, *texts[3:9]]):
        doc_id = None if k in (2, 7) else (5 if k in (5, 6) else k)
        rows.append((doc_id, text, ["en", "fr", None][k % 3], [f"s{k % 4}", None][k % 7 == 0], 1, *[None] * 14))
    rows += rows[8:14]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
