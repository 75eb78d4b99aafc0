"""Measurements, rule ledger and positive-unlabelled classifier."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voltide.llm import measures, quality_pu, rule_ledger
from voltide.llm.arrays import Texts

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    """The measurements of a text, word by word."""
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)),
        "n_digits": len(re.findall("[0-9]", text)), "n_bytes": len(text.encode()), "n_distinct_words": len(set(words)),
        "n_twin_words": sum(a == b for a, b in zip(words, words[1:])), "longest_word": max((len(w.encode()) for w in words), default=0),
    }


def test_measures(texts):
    got = measures.measured(Texts.of(pa.array(texts)))
    for k, text in enumerate(texts):
        for name, value in plain(text).items():
            assert got[name][k] == value, (name, text[:50])


def test_slices_of_arrow_arrays(texts):
    sliced = Texts.of(pa.array(["x", *texts]).slice(1))
    assert (measures.measured(sliced)["n_words"] == measures.measured(Texts.of(pa.array(texts, pa.large_string())))["n_words"]).all()
    assert len(measures.measured(Texts.of(pa.array([], pa.string())))["n_words"]) == 0


def failed(m):
    return {
        "few_words": m["n_words"] < 50, "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"], "symbols": 10 * m["n_symbols"] > m["n_words"],
        "duplicate_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"], "short_words": m["word_chars"] < 2 * m["n_words"],
        "long_words": m["word_chars"] > 40 * m["n_words"], "upper_case": m["n_upper"] > m["n_lower"], "twin_words": 10 * m["n_twin_words"] > 3 * m["n_words"],
    }


def test_ledger_verdicts_and_ablations(odd_docs, no_docs):
    texts = [r.text for r in odd_docs.collect()]
    book = rule_ledger.ledger(odd_docs)
    want = Counter(sum(1 << k for k, rule in enumerate(rule_ledger.RULES) if failed(plain(t))[rule.name]) for t in texts)
    assert Counter(r.failed_bits for r in book.collect()) == want
    assert rule_ledger.ledger(no_docs).count() == 0 and rule_ledger.ablations(rule_ledger.ledger(no_docs)).count() == 0
    for policy in rule_ledger.POLICIES:
        kept = sum(r.kept for r in rule_ledger.verdicts(book, policy).collect())
        bad = [failed(plain(t)) for t in texts]
        assert kept == sum(not any(f[r] for r in (*rule_ledger.BASE, *policy.rules)) for f in bad)
        for row in rule_ledger.ablations(book, (policy,)).collect():
            only = sum(f[row.rule] and not any(f[r] for r in policy.rules if r != row.rule) for f in bad)
            assert (row.n_docs, row.n_rejected, row.n_failed, row.n_only) == (
                len(texts), sum(any(f[r] for r in policy.rules) for f in bad), sum(f[row.rule] for f in bad), only)


def test_policy_may_allow_failures(odd_docs):
    book = rule_ledger.ledger(odd_docs)
    strict, mild = rule_ledger.POLICIES[-1], rule_ledger.Policy("mild", rule_ledger.POLICIES[-1].rules, allowed=1)
    assert rule_ledger.verdicts(book, mild).where("kept").count() >= rule_ledger.verdicts(book, strict).where("kept").count()


def test_risk_separates_without_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    unlabelled = np.concatenate([good[2000:3200], bad[:800]])
    model = quality_pu.train(good[:2000], unlabelled, 0.6)

    def scores(x):
        return quality_pu._sigmoid(quality_pu._forward((x - model.mean) / model.scale, *model.layers)[1])

    assert (scores(good[3200:]) >= 0.5).mean() > 0.97 and (scores(bad[800:]) < 0.5).mean() > 0.97


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    apart = F.col("doc_id") % 3 == 1
    model = quality_pu.fit(docs.where(~apart), labels.where(~apart))
    held = quality_pu.score(docs, model).join(labels.where(apart), "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.97
    assert abs(model.prior - 0.86) < 0.05
    again = quality_pu.fit(docs.where(~apart).repartition(5), labels.where(~apart))
    assert all(np.allclose(a, b) for a, b in zip(model.layers, again.layers))


def test_score_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_pu.fit(odd_docs, labels)
    scored = quality_pu.score(odd_docs, model)
    assert scored.count() == odd_docs.count() and scored.where("score BETWEEN 0 AND 1 AND predicted = int(score >= 0.5)").count() == odd_docs.count()
    kept = quality_pu.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == scored.where("predicted = 1").count()
    assert quality_pu.score(no_docs, model).count() == 0 and quality_pu.accepted(no_docs, model).count() == 0
    nothing = quality_pu.fit(no_docs, labels.limit(0))
    assert {r.score for r in quality_pu.score(odd_docs, nothing).collect()} == {0.5}
