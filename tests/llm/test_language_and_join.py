"""Language models against a word-for-word version, and the similarity join against all pairs."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.llm import jaccard_join, language_id
from voltide.llm.arrays import mixed
from voltide.llm.components import connected


def chances(texts):
    """Interpolated Kneser-Ney by dictionaries: log probability of the last character of a window."""
    grams, _ = language_id.windows(texts)
    counts = {4: Counter(map(tuple, grams.tolist()))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    total, kinds, discount = {}, {}, {}
    for n, table in counts.items():
        total[n], kinds[n] = Counter(), Counter()
        for g, c in table.items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1
        ones, twos = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        discount[n] = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones and twos else 0.5

    def p(g, n, letters):
        if n == 0:
            return 1 / (letters + 1)
        g = g[-n:]
        context = g[:-1]
        lower = p(g, n - 1, letters)
        if not total[n][context]:
            return lower
        return max(counts[n][g] - discount[n], 0) / total[n][context] + discount[n] * kinds[n][context] / total[n][context] * lower

    return p, {g[0] for g in counts[1]}


def test_kneser_ney():
    rng = random.Random(1)
    texts = [["".join(rng.choice(letters) for _ in range(60)) for _ in range(20)] for letters in ("aab ", "abcc d")]
    grams, language, counts = [], [], []
    for k, some in enumerate(texts):
        table = Counter(map(tuple, language_id.windows(some)[0].tolist()))
        grams += table
        language += [k] * len(table)
        counts += table.values()
    model = language_id.train(np.array(grams, np.uint32), np.array(language), np.array(counts), ["x", "y"])
    asked = language_id.windows(["abca bd zz", "cab", ""])[0]
    got = model.log_probabilities(asked)
    both = [chances(some) for some in texts]
    letters = len(both[0][1] | both[1][1])
    for row, gram in zip(got, map(tuple, asked.tolist())):
        for value, (p, _) in zip(row, both):
            assert value == pytest.approx(math.log(p(gram, 4, letters)), abs=1e-4)


def test_held_out_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    got = language_id.identify(docs.where("doc_id % 2 = 1"), model).join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() > 0.99 * got.count()
    odd = language_id.identify(odd_docs, model)
    assert odd.count() == odd_docs.count() and odd.where("score BETWEEN 0 AND 1").count() == odd.count()
    without = odd_docs.where("NOT coalesce(text RLIKE '\\\\p{L}', false)").count()
    assert odd.where("lang_pred = 'und'").count() == without == odd.where("lang_pred = 'und' AND rejected AND score = 0").count()
    assert language_id.identify(no_docs, model).count() == 0
    strange = spark.createDataFrame([(1, "zzqx xqzz qqqz " * 40)], "doc_id long, text string")
    assert language_id.identify(strange, model).first().rejected


def test_nothing_to_learn(odd_docs, no_docs):
    model = language_id.fit(no_docs)
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd_docs, model).collect()} == {("und", 0.0)}


def shingle_sets(rows, n=5):
    out = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out.append(frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset())
    return out


def all_pairs(rows):
    """Class (smallest id) and links of every row."""
    sets = shingle_sets(rows)
    near = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(near[i])))
    return sorted(out, key=str)


def got(docs, **options):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_classes(docs, **options).collect()), key=str)


def near_copies(n, words, changes, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(changes + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_join_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(odd_docs) == all_pairs(rows)
    assert jaccard_join.near_classes(no_docs).count() == 0
    kept = jaccard_join.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns


def test_one_row_of_each_class_stays(spark):
    """Also if ids are null, stand on several texts or repeat with their row."""
    groups = [near_copies(4, 200, 1, s) for s in range(6)]
    rows = [(10, groups[0][0]), (11, groups[0][1]), (11, groups[1][0]), (12, groups[1][1])]  # 11 is the second of one class and first of another
    rows += [(None, t) for t in groups[2]] + [(None, groups[3][0]), (40, groups[3][1])]
    rows += [(50, groups[4][0])] * 3 + [(51, groups[4][1])] + [(60, groups[5][0]), (60, groups[5][1]), (60, groups[5][0])]
    rows += [(70, None), (70, None), (None, ""), (71, " \t")]
    docs = spark.createDataFrame([(*r, k, k) for k, r in enumerate(rows)], "doc_id long, text string, _row int, class int")
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    have = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(have) == len(groups) + 4 and all(sum(t in g for _, t in have) == 1 for g in groups)
    assert {i for i, t in have if t in groups[0] + groups[1] + groups[3] + groups[4]} == {10, 11, 40, 50}
    assert (11, groups[1][0]) in have and sorted(have, key=str) == sorted(((r.doc_id, r.text) for r in jaccard_join.drop_near_copies(docs.repartition(5)).collect()), key=str)


@pytest.mark.parametrize(("leaf", "block"), [(512, 128), (8, 4)])
def test_join_of_groups(spark, leaf, block, monkeypatch):
    """Also with small buckets and blocks, so that buckets are split to the deepest level and groups into cells."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = [t for s in range(12) for t in near_copies(4, 60, 4, s)] + near_copies(90, 120, 3, 99) + ["same text of a few words here"] * 30
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, have = all_pairs(rows), got(docs)
    assert [r[:2] for r in have] == [r[:2] for r in want]
    lost = sum(b[2] for b in want) - sum(a[2] for a in have)
    assert all(a[2] <= b[2] for a, b in zip(have, want)) and lost <= 0.001 * sum(b[2] for b in want)


@pytest.mark.parametrize(("groups", "others"), [((60,), 3), ((60,), 0), ((40, 40), 2), ((25, 25), 12)])
def test_large_buckets_by_representatives(spark, groups, others, monkeypatch):
    """One bucket of linked groups, of which nothing may be lost that a comparison of all pairs links; a finished bucket is not split."""
    monkeypatch.setattr(jaccard_join, "LEAF", 10)
    monkeypatch.setattr(jaccard_join, "DEPTH", 0)
    rng = np.random.default_rng(1)
    rows = []
    for size in (*groups, *[2] * others):
        base = rng.integers(0, 1 << 16, 64, np.uint16)
        for _ in range(size):
            marks = base.copy()
            marks[rng.integers(0, 64, 8)] = rng.integers(0, 1 << 16, 8)
            rows.append((bytearray(rng.bytes(16)), 100, bytearray(marks.tobytes()), [7]))
    sets = spark.createDataFrame(rows, "node binary, size long, marks binary, roots array<long>")
    marks = np.array([np.frombuffer(r[2], np.uint16) for r in rows])
    near = (marks[:, None] == marks[None]).mean(2) >= jaccard_join._floor(0.8, 0.999)
    want = jaccard_join.components(len(rows), *np.nonzero(near))
    place = {bytes(r[0]): k for k, r in enumerate(rows)}
    links = [(place[bytes(r.a)], place[bytes(r.b)]) for r in jaccard_join.candidates(sets, 0.8, 0.999).collect()]
    a, b = np.array(links).T
    assert near[a, b].all()
    assert (jaccard_join.components(len(rows), a, b) == want).all()
    assert len(links) <= (2 if len(groups) == 1 else len(rows)) * len(rows)  # a group of its own costs a link or two per set


def test_main_component():
    assert jaccard_join._main({0: 5, 1: 7, 2: 4, 4: 4, 6: 1}) == (6, 12) and jaccard_join._main({0: 3}) == (0, 3) and jaccard_join._main({1: 2, 2: 2, 3: 1}) == (3, 0)


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.8, 0.999) > jaccard_join.runs_for(0.8, 0.9) >= 1


@pytest.mark.parametrize("depth", [1, 2])
def test_roots_reach_the_recall(depth, monkeypatch):
    """Pairs at the threshold, by whether each minimum hash agrees; below the roots a bucket draws anew."""
    monkeypatch.setattr(jaccard_join, "DEPTH", depth)
    rng = np.random.default_rng(3)
    n, k = 200_000, jaccard_join.COORDINATES
    roots = mixed(np.arange(1, jaccard_join.runs_for(0.8, 0.999) + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    agree = rng.random((n, k)) < 0.8
    common = agree.astype(int) @ jaccard_join._drawn(roots, 0.8).sum(0)
    for _ in range(depth):
        common = rng.binomial(common * agree.sum(1), 1 / (0.8 * k))
    lost = ((common == 0) | (agree.mean(1) < 0.6)).mean()
    assert lost <= 0.001 * 1.15  # two standard deviations of this sample
    assert abs(lost - jaccard_join.miss_probability(0.8, 0.999, len(roots))) < 0.0002


def test_high_recall_lowers_the_floor():
    runs = jaccard_join.runs_for(0.8, 0.99999)
    assert jaccard_join.miss_probability(0.8, 0.99999, runs) <= 0.00001 < jaccard_join.miss_probability(0.8, 0.99999, runs - 1)


def test_pairs_at_the_threshold_in_split_buckets(spark, monkeypatch):
    """Pairs with 8 of 10 shingles in common, in buckets that are split to the deepest level."""
    monkeypatch.setattr(jaccard_join, "LEAF", 1)
    n, rows = 6000, []
    for k in range(n):
        words = [f"w{k}x{j}" for j in range(14)]
        rows += [(2 * k, " ".join(words[:-1])), (2 * k + 1, " ".join(words[1:]))]
    found = jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count()
    assert 2 * n - found <= 2 * 0.0015 * n


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 516)] + [(700, 700)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = connected(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {k: root(k) for k in parent}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
