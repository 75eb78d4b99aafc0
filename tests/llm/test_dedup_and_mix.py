"""Content sort and weighted fair queueing against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voltide.llm import content_sort, fair_mix
from voltide.llm.content_sort import content_classes, drop_copies


def groups(rows):
    out = defaultdict(list)
    for doc_id, text in rows:
        out[text or ""].append(doc_id)
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("least", [100, 1])
def test_content_classes(spark, odd_docs, keep, least, monkeypatch):
    """Also with every content cut in slices."""
    monkeypatch.setattr(content_sort, "LEAST_HOT", least)
    want = groups((r.doc_id, r.text) for r in odd_docs.collect())
    got = content_classes(odd_docs, keep=keep).collect()
    assert len(got) == odd_docs.count()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert not r.kept or r.doc_id == best
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(want)


def test_hot_content_is_sliced_and_joined(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot text").otherwise(F.concat(F.lit("hot text "), "id")).alias("text"))
    got = content_classes(docs).where("group_size > 1").agg(F.count("*"), F.sum(F.col("kept").cast("int")), F.min("keep_id"), F.max("keep_id"), F.min("group_size")).first()
    assert tuple(got) == (2000, 1, 2999, 2999, 2000)


def test_drop_copies_keeps_columns(odd_docs, no_docs):
    out = drop_copies(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == len(groups((r.doc_id, r.text) for r in odd_docs.collect()))
    assert drop_copies(no_docs).count() == 0 and content_classes(no_docs).count() == 0


def water(sizes, weights, budget):
    level, active, target = 0.0, dict(zip(sizes, weights)), {}
    left = budget
    while active:
        share = {s: left * w / sum(active.values()) for s, w in active.items()}
        over = [s for s in active if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del active[s]
    return target


@pytest.mark.parametrize("run_rows", [4096, 3])
def test_fair_mix(odd_docs, run_rows, monkeypatch):
    monkeypatch.setattr(fair_mix, "RUN_ROWS", run_rows)
    got = fair_mix.fair_mix(odd_docs, carry=True).select("doc_id", "size", "source_size", "target", "taken", "copies", "row.source", "row.text").collect()
    assert len(got) == odd_docs.count()
    sizes = defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").split(" ")) if r.text == "two words" else True
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = water({s: sizes[s] for s in order}, [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(c.words for c in r.copies)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in order)


def test_fair_mix_does_not_depend_on_partitions(odd_docs):
    def rows(df):
        return sorted((str(r.doc_id), r.size, r.taken) for r in fair_mix.fair_mix(df).collect())

    assert rows(odd_docs) == rows(odd_docs.repartition(7))


def test_mixed_documents(odd_docs, no_docs):
    plan = fair_mix.fair_mix(odd_docs)
    mix = fair_mix.mixed_documents(odd_docs)
    words = mix.select(F.sum(fair_mix.word_count(F.col("text")))).first()[0]
    assert mix.columns == odd_docs.columns and words == plan.agg(F.sum("taken")).first()[0]
    assert fair_mix.mixed_documents(no_docs).count() == 0 and fair_mix.fair_mix(no_docs).count() == 0


def test_mix_order_is_by_finish(odd_docs):
    firsts = [r.copies[0].finish for r in fair_mix.in_mix_order(fair_mix.fair_mix(odd_docs)).collect() if r.copies]
    assert firsts == sorted(firsts)
