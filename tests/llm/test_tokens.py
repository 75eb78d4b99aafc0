"""Token counts of all prefixes, and encoding and decoding, against the library of the model."""

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from voltide.llm import queries, sentence_pieces, token_counts
from voltide.llm.arrays import Texts
from voltide.llm.pieces import load, read_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = read_model(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
BITS = [" ", "  ", "\n", "\t", "▁", "a", "e", "th", "é", "ß", "日本", "語", "🙂", "Ελ", "<s>", "</s>", "<unk>", "<0x41>", "1", ".", "\x00", "ing", "    "]


def rows(flat, lengths):
    return np.split(flat, np.cumsum(lengths)[:-1])


def test_every_prefix_and_id():
    rng = random.Random(2)
    texts = ["", *("".join(rng.choice(BITS) for _ in range(rng.randrange(25))) for _ in range(800))]
    counts = rows(*token_counts.counted(MODEL, Texts.of(pa.array(texts))))
    ids = rows(*sentence_pieces.encoded(MODEL, Texts.of(pa.array(texts))))
    for text, c, i in zip(texts, counts, ids):
        assert i.tolist() == LIBRARY.encode(text)
        assert list(c[1:]) == [len(LIBRARY.encode(text[:k])) for k in range(1, len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    ids, _ = sentence_pieces.encoded(MODEL, Texts.of(pa.array([text])))
    assert ids.tolist() == LIBRARY.encode(text)


def test_small_cache_changes_nothing(texts, monkeypatch):
    column = Texts.of(pa.array(texts))
    want = token_counts.counted(MODEL, column)[0]
    monkeypatch.setattr(token_counts._tables[MODEL], "most", 3)
    for _ in range(3):
        assert (token_counts.counted(MODEL, column)[0] == want).all()


def test_pieces_follow_as_in_the_library():
    pieces, rng = load(MODEL), random.Random(3)
    names = [t for t in pieces.ids if "▁" not in t]
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names)
        # Behind a line feed, which joins nothing, the text stands without a blank in front.
        assert pieces.follows(a, b) == (LIBRARY.encode("\n" + a + b, out_type=str)[-2:] == [a, b] and len(LIBRARY.encode("\n" + a + b)) == len(LIBRARY.encode("\n")) + 2)


def test_operators(odd_docs, no_docs):
    want = sorted(len(LIBRARY.encode(r.text or "")) for r in odd_docs.collect())
    counted = token_counts.token_counts(odd_docs, PATH, budgets=(10, 100), table=True).collect()
    assert sorted(r.n_tokens for r in counted) == want
    for r in counted:
        fits = [k for k, c in enumerate(r.prefixes) if c <= 10]
        assert r.n_tokens == r.prefixes[-1] and r.cuts[0] == fits[-1]
    encoded = sentence_pieces.encode(odd_docs, PATH)
    assert sorted(r.n_tokens for r in encoded.collect()) == want
    decoded = sentence_pieces.decode(encoded, PATH).collect()
    assert sorted(r.text for r in decoded) == sorted((r.text or "").replace("▁", " ") for r in odd_docs.collect())
    for made in (token_counts.token_counts(no_docs, PATH), sentence_pieces.encode(no_docs, PATH)):
        assert made.count() == 0


def test_truncation(spark):
    docs = spark.createDataFrame([(1, "some longer text to cut"), (2, "short"), (3, None)], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in token_counts.truncated(docs, PATH, 3).collect()}
    assert cut[2] == "short" and cut[3] is None
    assert len(LIBRARY.encode(cut[1])) <= 3 < len(LIBRARY.encode("some longer text to cut"[: len(cut[1]) + 1]))


def test_decoding_odd_lists(spark):
    ids = spark.createDataFrame([(1, None), (2, []), (3, [3 + 0xC3]), (4, LIBRARY.encode("é x"))], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in sentence_pieces.decode(ids, PATH).collect()}
    assert got == {1: None, 2: "", 3: "�", 4: "é x"}


@pytest.mark.parametrize("length", [0, 1, 70_000])
def test_long_stretch_without_blanks(length):
    text = "ab日" * length
    ids, _ = sentence_pieces.encoded(MODEL, Texts.of(pa.array([text])))
    assert ids.tolist() == LIBRARY.encode(text)


def test_query_decodes_every_text(spark, tmp_path):
    texts = ["two words", " \n▁ x", "", None, "é日\x00", "two words"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_sentence_pieces(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        assert got[k].ids == LIBRARY.encode(text or "") and got[k].n_tokens == len(got[k].ids) and got[k].round_trip
        assert got[k].decoded_sha256 == sha256((text or "").replace("▁", " ").encode()).hexdigest()
