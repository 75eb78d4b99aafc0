"""SentencePiece encoding by suffix-array matching, and decoding.

The new stretches of a batch are laid end to end and their suffixes sorted. A binary search finds for every piece of the model the range
of suffixes that begin with it, that is, all its occurrences. Each is an edge from where the piece begins to where it ends. Sorted by
position, the edges are relaxed: an edge ends the encoding up to its end if its piece may follow the piece that ends at its start.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltide.llm.arrays import PART_BYTES, Texts, parts
from voltide.llm.pieces import SPACE_MARK, Pieces, Ragged, distinct, gathered, load, marked, read_model, units

CODES_PER_KEY = 4
CODE_BITS = 16


class Matcher:
    """Finds the occurrences of all pieces in a text of character codes and keeps which pieces may follow which."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        alphabet = sorted({c for piece in pieces.ids for c in piece})
        #: Code 0 ends a stretch, 1 is any character without a piece; the others keep the order of the alphabet.
        self.code = np.ones(0x110000, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        self.code[10] = 1
        self.texts = sorted(pieces.ids)
        self.ids = np.array([pieces.ids[t] for t in self.texts], np.int64)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.words = -(-pieces.longest // CODES_PER_KEY)
        padded = np.zeros((len(self.texts), self.words * CODES_PER_KEY), np.uint16)
        for k, t in enumerate(self.texts):
            padded[k, : len(t)] = self.code[[ord(c) for c in t]]
        self.low = self._keys(padded)
        for k, t in enumerate(self.texts):
            padded[k, len(t) :] = 0xFFFF
        self.high = self._keys(padded)
        self.outside = pieces.size  # a character without a piece; which one doesn't matter, for no piece holds it
        self.known = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)

    def _keys(self, codes: np.ndarray) -> list[np.ndarray]:
        wide = codes.astype(np.uint64)
        return [
            sum((wide[:, CODES_PER_KEY * w + j] << np.uint64(CODE_BITS * (CODES_PER_KEY - 1 - j)) for j in range(CODES_PER_KEY)), np.uint64(0))
            for w in range(self.words)
        ]

    def suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix array by the first ``longest`` characters, and the sorted suffixes' keys of ``CODES_PER_KEY`` characters each."""
        n = len(codes)
        wide = np.concatenate([codes, np.zeros(self.words * CODES_PER_KEY, np.uint16)]).astype(np.uint64)
        first = sum((wide[j : n + (self.words - 1) * CODES_PER_KEY + j] << np.uint64(CODE_BITS * (CODES_PER_KEY - 1 - j)) for j in range(CODES_PER_KEY)), np.uint64(0))
        keys = [first[CODES_PER_KEY * w : CODES_PER_KEY * w + n] for w in range(self.words)]
        order = np.argsort(keys[0], kind="stable")
        for w in range(1, self.words):  # sort further only where all before is equal
            tied = np.ones(n, bool)
            for key in keys[:w]:
                ranked = key[order]
                tied[1:] &= ranked[1:] == ranked[:-1]
            tied[:1] = False
            group = np.cumsum(~tied)
            inner = tied.copy()
            inner[:-1] |= tied[1:]
            if not inner.any():
                break
            some = np.flatnonzero(inner)
            order[some] = order[some][np.lexsort((keys[w][order[some]], group[some]))]
        return order, [key[order] for key in keys]

    @staticmethod
    def _search(ranked: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """For each wanted key the first place whose key is not smaller (``right``: larger)."""
        low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(ranked[0]))
        for _ in range(len(ranked[0]).bit_length()):
            open_ = low < high
            middle = np.minimum((low + high) >> 1, len(ranked[0]) - 1)
            less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
            for have, want in zip(ranked, wanted):
                got = have[middle]
                less |= same & (got < want)
                same &= got == want
            less |= same & right
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece number (in ``texts``) of every occurrence of a piece."""
        order, ranked = self.suffixes(codes)
        begin, end = self._search(ranked, self.low, False), self._search(ranked, self.high, True)
        counts = end - begin
        return gathered(order, begin, counts), np.repeat(np.arange(len(counts)), counts)

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Per pair of ids (``outside`` included) whether the second may follow the first."""
        pairs = left * (self.pieces.size + 1) + right
        asked = np.unique(pairs)
        at = np.searchsorted(self.known, asked)
        new = asked[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != asked)] if len(self.known) else asked
        if len(new):
            names = [*self.pieces.text_of, "\n"]
            answers = np.array([self.pieces.follows(names[p // (self.pieces.size + 1)], names[p % (self.pieces.size + 1)]) for p in new.tolist()], bool)
            place = np.searchsorted(self.known, new)
            self.known, self.fits = np.insert(self.known, place, new), np.insert(self.fits, place, answers)
        return self.fits[np.searchsorted(self.known, pairs)]

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches (with space marks) one after the other, and how many each has."""
        if len(self.known) > 1 << 21:
            self.known, self.fits = self.known[:0], self.fits[:0]
        points = np.frombuffer("\0".join([*stretches, ""]).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        starts = np.cumsum(sizes + 1) - sizes - 1
        place = np.arange(len(points)) - np.repeat(starts, sizes + 1)  # within its stretch
        codes = self.code[points]
        codes[starts + sizes] = 0

        begin, piece = self.edges(codes)
        length, name = self.lengths[piece], self.ids[piece]
        alone = np.flatnonzero(codes == 1)  # characters without a piece are edges of their own
        begin, length = np.concatenate([begin, alone]), np.concatenate([length, np.ones(len(alone), np.int64)])
        name = np.concatenate([name, np.full(len(alone), self.outside)])
        end = place[begin] + length
        order = np.argsort(end, kind="stable")
        begin, length, name, end = begin[order], length[order], name[order], end[order]
        last, back = np.full(len(points), -1, np.int64), np.zeros(len(points), np.int64)  # piece that ends before a place, its length
        cuts = np.searchsorted(end, np.arange(1, (int(end[-1]) if len(end) else 0) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at, what, size = begin[a:b], name[a:b], length[a:b]
            good = place[at] == 0
            later = np.flatnonzero(~good)
            if len(later):
                good[later] = self.may_follow(last[at[later]], what[later])
            at, what, size = at[good], what[good], size[good]
            last[at + size], back[at + size] = what, size

        # From the end of each stretch back to its start.
        who, at = np.arange(len(stretches)), starts + sizes
        seen_who, seen_at, seen_what = [], [], []
        while len(who):
            seen_who.append(who)
            seen_what.append(last[at])
            at = at - back[at]
            seen_at.append(at)
            more = at > starts[who]
            who, at = who[more], at[more]
        who, at, what = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (seen_who, seen_at, seen_what))
        order = np.argsort(at, kind="stable")
        who, at, what = who[order], at[order], what[order]
        lost = np.flatnonzero(what == self.outside)
        if len(lost):  # those become the bytes of the character
            spelt = [chr(c).encode() for c in points[at[lost]].tolist()]
            repeats = np.ones(len(what), np.int64)
            repeats[lost] = [len(s) for s in spelt]
            first = np.cumsum(repeats) - repeats
            who, what = np.repeat(who, repeats), np.repeat(what, repeats)
            for k, s in zip(first[lost].tolist(), spelt):
                what[k : k + len(s)] = self.pieces.byte_ids[list(s)]
        return what.astype(np.int32), np.bincount(who, minlength=len(stretches)).astype(np.int64)


_matchers: dict[bytes, tuple[Matcher, Ragged]] = {}


def encoded(model: bytes, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts one after the other, and how many each text has."""
    if model not in _matchers:
        _matchers.clear()
        _matchers[model] = Matcher(load(model)), Ragged()
    matcher, table = _matchers[model]
    texts = marked(texts)
    starts, ends, owners = units(texts)
    keys, which = distinct(texts, starts, ends)
    at, lengths = table.rows(keys, lambda new: matcher.encode([key.decode().replace(" ", SPACE_MARK) for key in new]))
    at, lengths = at[which], lengths[which]
    return gathered(table.flat, at, lengths), np.bincount(owners, lengths, texts.n).astype(np.int64)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens`` (long) and ``ids`` (array of int).

    The ids are those of the model's library, without begin or end tokens. A null or empty text has none. Equal rows and null ids
    each get their row. A worker keeps a bounded number of stretches it has encoded; memory follows the longest text.
    """
    model = read_model(model_path)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids array<int>"
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, "_text", 2 * PART_BYTES):
                flat, counts = encoded(model, texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.ListArray.from_arrays(offsets, flat)], fields.names)

    return rows.mapInArrow(run, fields).withColumnRenamed("_id", id_col)


class Speller:
    """Turns ids back into texts."""

    def __init__(self, pieces: Pieces):
        spelt = pieces.bytes_of
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.lengths = np.array([len(s) for s in spelt], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids that lie one after the other, ``counts`` for each."""
        lengths = self.lengths[ids]
        data = gathered(self.flat, self.starts[ids], lengths).tobytes()
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(total[ends - counts].tolist(), total[ends].tolist())]
        return [t[1:] if t[:1] == " " else t for t in texts]


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of :func:`encode` with ``decoded_sha256`` (lowercase hex) of what the ids decode to, and ``round_trip`` (boolean).

    ``round_trip`` is true if the decoded text is the text, a null one being empty and space marks being blanks. A text is decoded where it
    was encoded, so neither texts nor ids move.
    """
    model = read_model(model_path)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fields = StructType.fromDDL(f"_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")
    mark = SPACE_MARK.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(load(model))
        for batch in batches:
            for part, texts in parts(batch, "_text", 2 * PART_BYTES):
                flat, counts = encoded(model, texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                again = [t.encode() for t in speller.texts(flat, counts)]
                data, ends = texts.data.tobytes(), texts.offsets.tolist()
                same = [t == data[a:b].replace(mark, b" ") for t, a, b in zip(again, ends[:-1], ends[1:])]
                digests = [sha256(t).hexdigest() for t in again]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), pa.ListArray.from_arrays(offsets, flat), pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                    fields.names,
                )

    return rows.mapInArrow(run, fields).withColumnRenamed("_id", id_col)


def decode(encoded_docs: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and ``text``.

    Null ids give a null text, an empty list an empty text. Bytes that are not UTF-8 become the replacement character; ids outside
    the model are an error. Encoding and decoding gives back the text, with blanks for space marks.
    """
    model = read_model(model_path)
    rows = encoded_docs.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    fields = StructType.fromDDL(f"_id {dict(encoded_docs.dtypes)[id_col]}, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(load(model))
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                lists = part.column(1)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = speller.texts(lists.flatten().to_numpy(zero_copy_only=False), counts)
                none = lists.is_null().to_pylist()
                texts = [None if gone else t for t, gone in zip(texts, none)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], fields.names)

    return rows.mapInArrow(run, fields).withColumnRenamed("_id", id_col)
