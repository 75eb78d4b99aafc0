"""Token counts at every prefix of a text, by dynamic programming over prefixes.

The last piece of a prefix's encoding is the one piece that ends there and may follow the last piece of what is before it, so one pass
from left to right gives the exact count of every prefix. Budgets and truncations are then looked up, not encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltide.llm.arrays import PART_BYTES, Texts, parts
from voltide.llm.pieces import SPACE_MARK, Pieces, Ragged, distinct, gathered, load, marked, read_model, units


def prefix_counts(pieces: Pieces, texts: list[str]) -> list[list[int]]:
    """For each text, the tokens of ``text[:0], text[:1], ...``; blanks are space marks.

    Texts are taken in sorted order, and each goes on from where its beginning parts from the one before.
    """
    ids, follows, longest = pieces.ids, pieces.follows, pieces.longest
    out: list[list[int]] = [[]] * len(texts)
    before, last, counts = "", [""], [0]
    for at in sorted(range(len(texts)), key=texts.__getitem__):
        text = texts[at]
        n, same = len(text), 0
        for x, y in zip(text, before):
            if x != y:
                break
            same += 1
        del last[same + 1 :], counts[same + 1 :]
        for end in range(same + 1, n + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = text[start:end]
                if piece in ids:
                    if not start or follows(last[start], piece):
                        last.append(piece)
                        counts.append(counts[start] + 1)
                        break
                elif start == end - 1:  # a character the model lacks becomes its bytes
                    last.append(piece)
                    counts.append(counts[start] + len(piece.encode()))
        out[at] = counts[:]
        before = text
    return out


_tables: dict[bytes, Ragged] = {}


def counted(model: bytes, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For texts: the counts of all prefixes with a character more than the one before, text after text, and the texts' lengths."""
    pieces, texts = load(model), marked(texts)
    table = _tables.setdefault(model, Ragged())
    starts, ends, owners = units(texts)
    keys, which = distinct(texts, starts, ends)

    def make(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = [row[1:] for row in prefix_counts(pieces, [key.decode().replace(" ", SPACE_MARK) for key in new])]
        return np.fromiter(chain.from_iterable(rows), np.int32), np.fromiter(map(len, rows), np.int64)

    at, lengths = table.rows(keys, make)
    at, lengths = at[which], lengths[which]
    whole = table.flat[at + lengths - 1].astype(np.int64) if len(at) else np.empty(0, np.int64)
    before = np.cumsum(whole) - whole  # tokens of earlier stretches, of this text and the texts before
    first = np.searchsorted(owners, np.arange(texts.n))
    base = np.append(before, whole.sum())[first]
    inner = gathered(table.flat, at, lengths) + np.repeat(before - base[owners], lengths)
    return inner, np.bincount(owners, lengths, texts.n).astype(np.int64)


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = (), table: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens`` (long), ``cuts`` and, if asked for, ``prefixes``.

    ``cuts`` has for each budget the code points of the longest prefix with at most so many tokens. ``prefixes`` (array of int) has the
    token count of every prefix, from the empty one on; it is as long as the text, so it is made on request. Texts are encoded as the
    model's library does it, without begin or end tokens. A null text counts as empty: 0 bytes, 0 tokens, cuts 0. Stretches between
    blanks are independent, so a worker works each distinct one out once; it keeps a bounded number. Memory follows the longest text.
    """
    model = read_model(model_path)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, cuts array<long>" + ", prefixes array<int>" * table
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, "_text", 2 * PART_BYTES):
                counts, lengths = counted(model, texts)  # the first of each text is that of the blank in front of it
                ends = np.cumsum(lengths)
                full = lengths > 0
                n_tokens = np.zeros(len(part), np.int64)
                n_tokens[full] = counts[ends[full] - 1]
                owners = np.repeat(np.arange(len(part)), lengths)
                cuts = np.zeros((len(part), len(budgets)), np.int64)
                for k, budget in enumerate(budgets):
                    cuts[:, k] = _cut(counts, owners, lengths, budget)
                out = [part.column(0), pa.array(np.diff(texts.offsets)), pa.array(n_tokens), pa.array(list(cuts), pa.list_(pa.int64()))]
                if table:
                    starts = ends - lengths
                    out.append(pa.array([_prefixes(counts[a:b]) for a, b in zip(starts, ends)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, fields.names)

    return rows.mapInArrow(run, fields).withColumnRenamed("_id", id_col)


def _prefixes(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], counts[1:]]) if len(counts) else np.zeros(1, np.int64)


def _cut(counts: np.ndarray, owners: np.ndarray, lengths: np.ndarray, budget: int) -> np.ndarray:
    """Code points of the longest prefix within the budget; counts are not monotonic, so the last fitting one is taken."""
    fits = np.flatnonzero(counts <= budget)
    place = np.arange(len(counts)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros(len(lengths), np.int64)
    np.maximum.at(out, owners[fits], place[fits])
    return out


def truncated(docs: DataFrame, model_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the text cut to the longest prefix of at most ``budget`` tokens. Ids must be unique and not null."""
    cuts = token_counts(docs, model_path, id_col, text_col, (budget,)).select(F.col(id_col).alias("_of"), F.get("cuts", F.lit(0)).alias("_cut"))
    out = docs.join(cuts, docs[id_col] == cuts["_of"])
    return out.select(*[F.substring(docs[c], F.lit(1), cuts["_cut"].cast("int")).alias(c) if c == text_col else docs[c] for c in docs.columns])
