"""Filter audit against plain Python."""

import re
from collections import Counter
from itertools import permutations

import pytest

from voltide.llm import filter_audit
from voltide.llm.filter_audit import filter_audit as audit

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good, toxic = ({i for i, *flags in labels if i is not None and flags[k] == 1} for k in (0, 1))
    docs = []
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows) else set()
        docs.append((part or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = Counter()
        of = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                left = [d for d in of if not d[1] & set(order[:step])]
                gone = [d for d in left if name in d[1]]
                shapley[name] += len(gone)
                failing = sum(name in d[1] for d in of)
                out[part, "".join(order), step + 1] = [
                    len(left) - len(gone), len(gone), failing - len(gone), sum(d[1] == {name} for d in of), sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("files", "per_batch", "compact"), [(1, None, 8), (9, 1, 2), (9, 2, 3), (5, None, 8)])
def test_any_dealing_of_the_files(spark, odd_docs, tmp_path, files, per_batch, compact):
    """Files written in falling order of ids, so that smaller ones keep arriving."""
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    varied = [f"w{k} Word " * 30 + " ".join(f"v{k}x{j}" for j in range(200)) for k in range(4)]
    rows += [(k * 7 % 60, varied[k % 4] + "$" * (k % 8 > 5), ["de", None, ""][k % 3]) for k in range(40)]
    rows.sort(key=lambda r: -(r[0] if r[0] is not None else 30))
    labels = [(k % 60, k % 2, int(k % 5 == 0)) for k in range(0, 90, 2)] + [(None, 1, 1), (4, None, 1), (6, 1, None)]
    path = str(tmp_path / "documents.parquet")
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, odd_docs.select("doc_id", "text", "lang").schema).coalesce(1).write.mode("append").parquet(path)
    got = audit(spark, path, spark.createDataFrame(labels, LABELS), files_per_batch=per_batch, compact=compact)
    assert found(got) == brute(rows, labels)


def test_an_interrupted_run_goes_on(spark, tmp_path, monkeypatch):
    rows = [(k, f"text {k % 5}", "en") for k in range(30, 0, -1)]
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "audit")
    for k in range(6):
        spark.createDataFrame(rows[5 * k : 5 * k + 5], "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(path)
    labels = spark.createDataFrame([(3, 1, 0)], LABELS)
    write, calls = filter_audit.RetractingCounters._write, []

    def breaks(self, frame, kind, batch):
        calls.append(kind)
        if kind == "counts" and batch == 2 and calls.count("counts") == 3:
            raise RuntimeError("lost")
        write(self, frame, kind, batch)

    monkeypatch.setattr(filter_audit.RetractingCounters, "_write", breaks)
    with pytest.raises(Exception, match="lost"):
        audit(spark, path, labels, files_per_batch=1, folder=folder)
    assert found(audit(spark, path, labels, files_per_batch=1, folder=folder)) == brute(rows, [(3, 1, 0)])


def test_no_documents(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert audit(spark, str(tmp_path / "documents.parquet"), spark.createDataFrame([], LABELS)).count() == 0
