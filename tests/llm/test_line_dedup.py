"""Line dedup against plain Python."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voltide.llm.line_dedup import LOWER, UPPER, dedup_lines, drop_repeated_lines

TABLE = str.maketrans(UPPER, LOWER)


def brute(rows, min_chars, min_docs, text_hash):
    def document(doc_id, text):
        return (0, text_hash[text]) if doc_id is None else (1, doc_id)

    def keys(text):
        return [line.strip(" \t\n\x0b\x0c\r").translate(TABLE) for line in (text or "").split("\n")]

    held = defaultdict(set)
    for doc_id, text in rows:
        for key in keys(text):
            if len(key) >= min_chars:
                held[key].add(document(doc_id, text))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, keys(text)) if len(held[k]) < min_docs or max(held[k]) == document(doc_id, text)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


def hashes(docs):
    return {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}


@pytest.mark.parametrize(("min_chars", "min_docs"), [(20, 3), (1, 2), (0, 2), (1, 1)])
def test_odd_documents(odd_docs, min_chars, min_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = dedup_lines(odd_docs, min_chars=min_chars, min_docs=min_docs)
    assert found(got) == brute(rows, min_chars, min_docs, hashes(odd_docs))


def test_shared_lines(spark):
    shared = "This line is on MANY pages of it"
    texts = [
        f"one\n{shared}\nend", f"{shared.upper()}\n\n  {shared}\t\r", f"first\r\n{shared}\x0b\nlast\n", f"{shared}\n{shared}\nkept twice", "É" * 20 + f"\n{shared}x",
        "é" * 20, "É" * 20 + " ", " " + shared, "a" * 19 + "\n" + "b" * 20, "a" * 19 + "\n" + "b" * 20, "a" * 19 + "\n" + "B" * 20, shared, None, "", "É" * 20,
    ]
    rows = [*enumerate(texts), (3, f"{shared}\nof an id held twice"), (None, shared), (None, f"null\n{shared}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(dedup_lines(docs))
    assert got == brute(rows, 20, 3, hashes(docs))
    assert got[(0, 3, 1, "one\nend")] == 1 and got[(11, 1, 0, shared)] == 1 and got[(None, 1, 1, "")] == 1


def test_nobody_has_an_id(spark):
    rows = [(None, f"{k} tail\nthe very same line of all of them") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(n * c for (_, _, n, _), c in found(dedup_lines(docs)).items()) == 3


def test_long_texts_and_strings_as_ids(spark):
    long = "\n".join(f"line number {k % 5000} of a very long text" for k in range(40_000))
    rows = [("b", long), ("c", long), ("a", long), ("d", "short")]
    got = found(dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")))
    assert got == Counter({("c", 40_000, 0, long): 1, ("b", 40_000, 40_000, ""): 1, ("a", 40_000, 40_000, ""): 1, ("d", 1, 0, "short"): 1})


def test_columns_stay(odd_docs, no_docs):
    out = drop_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert drop_repeated_lines(no_docs).count() == 0 and dedup_lines(no_docs).count() == 0


def test_main_path_has_no_python(odd_docs):
    plan = dedup_lines(odd_docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
