"""Source divergence against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voltide.llm.source_divergence import divergence, term_counts

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=3, top=200):
    rows = [tuple(x or "" for x in row) for row in rows]
    groups, by_lang, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(t.translate(LOWER) for t in LETTERS.findall(text))
        groups[lang, source].update(found)
        by_lang[lang].update(found)
        held[lang].update(found.keys())
    out = []
    for lang in by_lang:
        kept = [t for t in held[lang] if held[lang][t] >= min_docs]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(c) for (at, s), c in groups.items() if at == lang}
        whole = shares(by_lang[lang])
        for source in p:
            pairs = [(sum((p[source][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in p if o != source]
            special = [((p[source][t] - whole[t]) ** 2 // whole[t], t) for t in kept if groups[lang, source][t] and p[source][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", special, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return Counter(out)


def found(df):
    return Counter((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(9)
    words = ["Äpfel", "naïve", "日本", "Ω", "don't", "x1y", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]]
    rows = []
    for k in range(400):
        text = None if k % 41 == 0 else " ".join(rng.choice(words[: 20 + k % 100]) for _ in range(rng.randrange(40))) + ("." if k % 3 else "\x7f[]@`{")
        rows.append((text, ["en", "fr", None, "", "one"][k % 5 if k % 7 else 0], f"s{k * k % 23}" if k % 5 < 4 else "alone"))
    return rows + [(None, "none", "a"), ("", "none", "b"), ("rare", "none", None), ("the\x00end" * 4000, "en", "s1")] + rows[:9]


@pytest.mark.parametrize("block", [256, 3])
def test_divergence(spark, many, block):
    docs = spark.createDataFrame(many, "text string, lang string, source string").repartition(3)
    assert found(divergence(docs, block=block)) == brute(many)
    assert found(divergence(docs, block=block, min_docs=1, top_terms=5)) == brute(many, 1, 5)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert found(divergence(odd_docs)) == brute(rows)
    assert divergence(no_docs).count() == 0


@pytest.mark.parametrize(("most_terms", "most_bytes"), [(1, 1 << 20), (50, 1 << 20), (10**6, 30)])
def test_counts_for_any_parts(spark, many, most_terms, most_bytes):
    docs = spark.createDataFrame(many, "text string, lang string, source string")
    n, of = defaultdict(int), defaultdict(int)
    for text, lang, source in many:
        for term, k in [*Counter(t.translate(LOWER) for t in LETTERS.findall(text or "")).items(), ("", 1)]:
            n[lang or "", source or "", term] += k
            of[lang or "", source or "", term] += 1
    got = term_counts(docs, most_terms=most_terms, most_bytes=most_bytes).collect()
    assert {(r.lang, r.source, r.term): (r.n, r.docs) for r in got} == {k: (n[k], of[k]) for k in n} and len(got) == len(n)


def test_counts_beyond_a_long_product(spark):
    """10^9 times the count needs more than 63 bits."""
    from voltide.llm.source_divergence import share

    row = spark.createDataFrame([(3 * 10**13, 7 * 10**13, 10**6)], "n long, total long, v long").select(share(F.col("n"), F.col("total"), F.col("v"))).first()
    assert row[0] == 1 + 10**9 * (3 * 10**13 + 1) // (7 * 10**13 + 10**6)
