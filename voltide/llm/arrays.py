"""Texts of Arrow batches as NumPy arrays: bytes, words, lines and their hashes, without a Python object per text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of text worked on at once. A longer text is worked on alone.
PART_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_places = np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that looks random."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def place_factors(n: int) -> np.ndarray:
    global _places
    if len(_places) < n:
        _places = mixed((np.arange(max(n, 2 * len(_places), 256), dtype=np.uint64) + np.uint64(1)) * _ODD) | np.uint64(1)
    return _places[:n]


class Texts:
    """Texts laid end to end: ``data`` their UTF-8 bytes, text i at ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """Nulls become empty texts."""
        column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        _, ends, data = column.buffers()
        kind = np.int64 if wide else np.int32
        offsets = np.frombuffer(ends, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        got = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.empty(0, np.uint8)
        return cls(got, offsets - first)

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per text, the sum of ``mask`` over its bytes."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the words ``[^\\x20\\x09-\\x0D]+``."""
        inner = ~SPACE[self.data]
        if not inner.any():
            return (np.empty(0, np.int64),) * 3
        opens, closes = inner.copy(), inner.copy()
        opens[1:] &= ~inner[:-1]
        closes[:-1] &= ~inner[1:]
        full = np.flatnonzero(np.diff(self.offsets) > 0)
        first, last = self.offsets[full], self.offsets[full + 1] - 1
        opens[first], closes[last] = inner[first], inner[last]
        starts = np.flatnonzero(opens)
        return starts, np.flatnonzero(closes) + 1, self.owner(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines between line feeds."""
        feeds = np.flatnonzero(self.data == 10)
        return np.sort(np.concatenate([self.offsets[:-1], feeds + 1])), np.sort(np.concatenate([feeds, self.offsets[1:]]))

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The number of the text in which each place lies."""
        return np.searchsorted(self.offsets, at, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of nonempty spans."""
        if not len(starts):
            return np.empty(0, np.uint64)
        lengths = ends - starts
        before = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
        at = inside if len(inside) == len(self.data) and (ends[:-1] == starts[1:]).all() else np.repeat(starts, lengths) + inside
        data = self.data if at is inside else self.data[at]
        products = (data.astype(np.uint64) + np.uint64(1)) * place_factors(int(lengths.max()))[inside]
        return mixed(np.add.reduceat(products, before) + lengths.astype(np.uint64) * _ODD)


def chained(hashes: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``n`` neighbours of the same owner, and where each window starts."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(owners[: len(owners) - n + 1] == owners[n - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(place_factors(n)):
        total += hashes[at + k] * factor
    return mixed(total), at


def parts(batch: pa.RecordBatch, text: str, most: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch with about ``most`` bytes of text each."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths), 0
    while start < len(batch):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        part = batch.slice(start, stop - start)
        yield part, Texts.of(part.column(batch.schema.get_field_index(text)))
        start = stop


def map_texts(rows: DataFrame, text: str, schema: str | StructType, work: Callable[[pa.RecordBatch, Texts], list]) -> DataFrame:
    """``rows`` mapped part by part; ``work`` gives the columns of ``schema`` for a part, in order."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, text):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in work(part, texts)], names)

    return rows.mapInArrow(run, fields)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int = 4096, text: str | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``: of about ``most_rows`` rows, and ``PART_BYTES`` of ``text``, or one larger group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < most_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(table, keys)
        yield from _slices(table, starts, most_rows, text)
        held, rows = table.slice(int(starts[-1])).combine_chunks().to_batches(), 0  # the last group may go on in the next batch
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if len(table):
            yield from _slices(table, np.append(group_starts(table, keys), len(table)), most_rows, text)


def _slices(table: pa.Table, starts: np.ndarray, most_rows: int, text: str | None) -> Iterator[pa.Table]:
    """The rows before the last of ``starts``, cut at these places."""
    share = np.arange(len(table) + 1) / most_rows
    if text:
        share[1:] += np.cumsum(pc.fill_null(pc.binary_length(table.column(text)), 0).to_numpy()) / PART_BYTES
    begin = 0
    for stop, after in zip(starts[1:].tolist(), [*starts[2:].tolist(), None]):
        if after is None or share[after] - share[begin] > 1:
            yield table.slice(begin, stop - begin)
            begin = stop


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a new combination of ``keys`` begins, in a sorted table."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        if len(table) > 1:
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(table) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes with edges (a, b), the smallest node connected with each."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        new = new[label]
        if (new == label).all():
            return label
        label = new
