"""The pieces of a SentencePiece BPE model, and which piece may follow which.

BPE with scores merges, again and again, the neighbouring pair whose joined piece scores best, the leftmost of equals. Whether a
sequence of pieces is the result for its text depends on neighbours only: it is if every two neighbours are the result for their
joined text. For were some first merge to cross a border of the sequence, the same merge would cross it with the two neighbours alone.
So the piece that ends the encoding of a prefix is the only one that may follow the encoding of the rest.
"""

from __future__ import annotations


import numpy as np
import sentencepiece

from voltide.llm.arrays import Texts

SPACE_MARK = "▁"
NEVER = float("-inf")
#: Entries a worker keeps of what it worked out before; then it starts afresh.
MOST_KEPT = 1 << 20


class Pieces:
    """Scores and ids of the pieces of a model given as bytes. Characters outside the model have one id each, from ``size`` on."""

    def __init__(self, model: bytes):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = processor.get_piece_size()
        plain = [k for k in range(self.size) if not (processor.is_control(k) or processor.is_unknown(k) or processor.is_byte(k) or processor.is_unused(k))]
        self.text_of = [processor.id_to_piece(k) for k in range(self.size)]
        self.score = {self.text_of[k]: processor.get_score(k) for k in plain}
        self.bytes_of = [
            bytes([int(t[1:-1], 16)]) if processor.is_byte(k) else b"" if processor.is_control(k) else t.replace(SPACE_MARK, " ").encode()
            for k, t in enumerate(self.text_of)
        ]
        self.byte_ids = np.zeros(256, np.int32)
        for k in range(self.size):
            if processor.is_byte(k):
                self.byte_ids[self.bytes_of[k][0]] = k
        if any(SPACE_MARK in t.lstrip(SPACE_MARK) for t in self.score) or any("\n" in t for t in self.score):
            raise ValueError("a piece spans a word border; this model's texts can't be worked on word by word")
        self.longest = max(map(len, self.score))
        self._traces: dict[str, tuple] = {}
        self._follows: dict[tuple[str, str], bool] = {}
        #: Ids of the pieces that are the encoding of their own text; only these occur.
        self.ids = {self.text_of[k]: k for k in plain if len(self._trace(self.text_of[k])) > 0}

    def _trace(self, piece: str) -> tuple:
        """Steps of the encoding of ``piece`` alone: (score of the next merge, piece at the left edge, at the right edge).

        Empty if it doesn't end as one piece.
        """
        got = self._traces.get(piece)
        if got is None:
            parts, steps, score = list(piece), [], self.score
            while True:
                best, at = NEVER, -1
                for k in range(len(parts) - 1):
                    s = score.get(parts[k] + parts[k + 1], NEVER)
                    if s > best:
                        best, at = s, k
                steps.append((best, parts[0], parts[-1]))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = self._traces[piece] = tuple(steps) if len(parts) == 1 else ()
        return got

    def follows(self, left: str, right: str) -> bool:
        """Whether ``left, right`` is the encoding of their joined text: no merge ever crosses the border."""
        known = self._follows.get((left, right))
        if known is None:
            if len(self._follows) > 2 * MOST_KEPT:
                self._follows.clear()
            a, b, score, i, j, known = self._trace(left), self._trace(right), self.score, 0, 0, True
            while True:
                own_left, own_right = a[i][0], b[j][0]
                cross = score.get(a[i][2] + b[j][1], NEVER)
                if cross > own_left and cross >= own_right and cross > NEVER:
                    known = False
                    break
                if own_left == own_right == NEVER:
                    break
                if own_left >= own_right:
                    i += 1
                else:
                    j += 1
            self._follows[left, right] = known
        return known


_loaded: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    """One ``Pieces`` per worker and model."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Pieces(model)
    return _loaded[model]


def read_model(path: str) -> bytes:
    """A tokenizer file, read on the driver; a few hundred kilobytes that travel with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def marked(texts: Texts) -> Texts:
    """Texts as the model sees them, but with blanks for space marks: a blank in front, none for an empty text."""
    data, offsets = texts.data, texts.offsets
    raw = data.tobytes()
    if SPACE_MARK.encode() in raw:
        cut = [raw[a:b].replace(SPACE_MARK.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        data = np.frombuffer(b"".join(cut), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])
    full = np.diff(offsets) > 0
    moved = offsets + np.concatenate([[0], np.cumsum(full)])
    out = np.full(int(moved[-1]), 32, np.uint8)
    inner = np.ones(len(out), bool)
    inner[moved[:-1][full]] = False
    out[inner] = data
    return Texts(out, moved)


def units(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the stretches that no merge crosses: blanks and what follows them, and single line feeds.

    No piece has a blank behind another character, or a line feed, so a stretch ends before a blank that follows something else and
    around every line feed.
    """
    data = texts.data
    n = len(data)
    if not n:
        return (np.empty(0, np.int64),) * 3
    blank, feed = data == 32, data == 10
    opens = np.ones(n, bool)
    opens[1:] = (blank[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
    opens[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    starts = np.flatnonzero(opens)
    return starts, np.append(starts[1:], n), texts.owner(starts)


def distinct(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct stretches, and which of them each stretch is."""
    _, first, which = np.unique(texts.hashes(starts, ends), return_index=True, return_inverse=True)
    data = texts.data.tobytes()
    return [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], which


class Ragged:
    """Rows of numbers kept end to end and found by key; starts afresh when it holds more than ``most`` keys."""

    def __init__(self, most: int = MOST_KEPT):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.flat = np.empty(0, np.int32)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def rows(self, keys: list[bytes], make) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in ``flat`` for each key; ``make`` gives the rows of new keys as (flat, lengths)."""
        if len(self.row) > self.most:
            self.clear()
        new = [k for k in keys if k not in self.row]
        if new:
            flat, lengths = make(new)
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            self.row.update(zip(new, range(len(self.starts), len(self.starts) + len(new))))
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        at = np.fromiter((self.row[k] for k in keys), np.int64, len(keys))
        return self.starts[at], self.lengths[at]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The rows ``flat[start : start + length]`` one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)] if total else flat[:0]
