"""How the vocabulary of each source diverges from that of its language and of the other sources.

A document is tokenised by one ``bytes.translate``, which lowers letters and blanks all separators, and one ``bytes.split``; a ``Counter``
of its terms is added to those of its language and source. The counts stay sparse throughout: what a source has no count for enters the
sums of a pair as a number of terms times a constant.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.arrays import group_starts
from voltide.session import materialise

#: Separators are blanked, A-Z lower-cased, and all bytes of characters beyond ASCII kept.
TABLE = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms, and bytes of the texts they are from, that a task gathers before it hands them on.
GATHERED_TERMS, GATHERED_BYTES = 250_000, 64 << 20
#: Sources of a language that are compared at once; sources in all up to which their table is broadcast (about 100 bytes each).
BLOCK, BROADCAST_SOURCES = 256, 200_000
SCALE = 1_000_000_000
_COUNTED = T.StructType([T.StructField(n, k) for n, k in (
    ("lang", T.StringType()), ("source", T.StringType()), ("term", T.StringType()), ("n", T.LongType()), ("docs", T.LongType()))])


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _gathered(batches: Iterator[pa.RecordBatch], most_terms: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}  # of each group: documents by term, and occurrences beyond the first in each
    size, read = 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, more) in held.items():
            found = pa.array(list(docs), pa.binary()).view(pa.string())
            n = pa.array([k + more.get(term, 0) for term, k in docs.items()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(docs)), pa.repeat(source, len(docs)), found, n, pa.array(list(docs.values()), pa.int64())], _COUNTED.names)
        held.clear()

    for batch in batches:
        groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for group, text in zip(groups, batch.column(2)):
            if group not in held:
                held[group] = Counter(), Counter()
            docs, more = held[group]
            content = text.as_buffer().to_pybytes() if text.is_valid else b""
            found = Counter(terms(content))
            found[b""] = 1  # stands for the document itself, so that a group without terms is known too
            before = len(docs)
            docs.update(iter(found))
            size += len(docs) - before
            for term, n in found.items():
                if n > 1:
                    more[term] += n - 1
            read += len(content)
            if size >= most_terms or read >= most_bytes:
                yield from flush()
                size, read = 0, 0
    yield from flush()


def term_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most_terms: int = GATHERED_TERMS, most_bytes: int = GATHERED_BYTES,
) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term, and documents with it; the empty term counts the documents.

    Null texts, languages and sources count as empty. A task adds up what it reads and hands it on in parts of bounded size, so a hot
    source or term costs a few rows per task.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _gathered(batches, most_terms, most_bytes), _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + size)), exact for any counts."""
    wide = F.lit(SCALE).cast("decimal(12,0)") * (n + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + size).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); the square stays below 2 ** 63."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _common(cells: DataFrame, block: int) -> DataFrame:
    """``lang, a, b, value``: over the terms that sources a and b both have, what their own shares add to the constants of ``pair_sums``.

    ``cells`` has ``lang, low, high, term, of, p, p0``: the two blocks of a cell, source number, its share of the term and of a missing
    one. Rows of a term lie together; a task holds a matrix of at most 2 * block sources by the terms of a batch, and sums per cell.
    """
    schema = T.StructType([cells.schema["lang"], *(T.StructField(c, T.LongType()) for c in ("a", "b", "value"))])

    def emit(key: tuple, sums: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        lang, low, high = key
        a, b = np.nonzero(seen)
        number = np.concatenate([low * block + np.arange(block), high * block + np.arange(block)])
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(a), pa.string()), pa.array(number[a]), pa.array(number[b]), pa.array(sums[a, b])], schema.names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, seen, held = None, None, None, None
        for batch in _whole_terms(batches):
            names = [batch.column(c).to_pylist() for c in ("lang", "low", "high")]
            keys = list(zip(*names))
            new = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for start, stop in zip(new, new[1:]):
                if keys[start] != key:
                    if key is not None:
                        yield emit(key, sums, seen)
                    key, sums, seen, held = keys[start], np.zeros((2 * block, 2 * block), np.int64), np.zeros((2 * block, 2 * block), bool), np.zeros(2 * block, np.int64)
                part = batch.slice(start, stop - start)
                of = part.column("of").to_numpy()
                place = np.where(of // block == key[1], of % block, block + of % block)
                term = np.cumsum(part.column("new").to_numpy(zero_copy_only=False)) - 1
                term -= term[0]
                held[place] = part.column("p0").to_numpy()
                used = np.unique(place)
                matrix = np.zeros((int(term[-1]) + 1, len(used)), np.int64)
                matrix[term, np.searchsorted(used, place)] = part.column("p").to_numpy()
                for i, at in enumerate(used):
                    # Pairs within a block belong to that block's own cell.
                    others = np.flatnonzero((used != at) & ((key[1] == key[2]) | ((used < block) != (at < block))))
                    rows = matrix[matrix[:, i] > 0]
                    if not len(others) or not len(rows):
                        continue
                    p, q = rows[:, i : i + 1], rows[:, others]
                    both = q > 0
                    p0, q0 = held[at], held[used[others]][None, :]
                    value = np.where(both, _gap(p, np.maximum(q, 1)) - _gap(p, q0) - _gap(p0, np.maximum(q, 1)) + _gap(p0, q0), 0)
                    sums[at, used[others]] += value.sum(0)
                    seen[at, used[others]] |= both.any(0)
        if key is not None:
            yield emit(key, sums, seen)

    where = ["lang", "low", "high", "term"]
    return cells.repartition(*where).sortWithinPartitions(*where).mapInArrow(run, schema)


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut between terms, with ``new`` where a term begins; a term has a row per source of a cell at most."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        new = np.zeros(len(table), bool)
        new[starts := group_starts(table, ["lang", "low", "high", "term"])] = True
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield table.slice(0, cut).append_column("new", pa.array(new[:cut])).combine_chunks().to_batches()[0]
        rest = table.slice(cut).combine_chunks().to_batches()
        held = rest[0] if rest else None
    if held is not None and len(held):
        first = np.zeros(len(held), bool)
        first[0] = True
        yield held.append_column("new", pa.array(first))


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top_terms: int = 200, block: int = BLOCK,
) -> DataFrame:
    """``lang, source, part, item, value`` (long) and ``rank`` (int, from 1 in each group and part, by falling value, then item).

    Terms are runs of letters a-z and characters beyond ASCII, only A-Z lower-cased. A language keeps the V terms that ``min_docs`` of
    its documents hold or more. The share of a kept term in a group (language and source), or in a language, is
    p = 1 + floor(10^9 * (count + 1) / (N + V)) with N the counts of all kept terms; the gap of p to q is floor((p - q)^2 / q).

    Part ``pair`` has for each group every other source of its language and the sum of gaps to that over all kept terms (0 if V = 0).
    Part ``term`` has the ``top_terms`` kept terms with the largest gaps to the language that occur in the group more often than there.

    Null texts, languages and sources count as empty; groups without terms take part; repeated rows count each; an empty table gives an
    empty result; other columns don't matter. All arithmetic is exact. Memory follows the longest
    text and the 2 * ``block`` sources that are compared at once; the sources of a language are numbered in one task.
    """
    counts = materialise(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    some = F.col("term") != ""
    kept = counts.where(some).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs)
    kept = materialise(kept.select("lang", "term", F.col("n").alias("lang_n")), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    of_groups = materialise(counts.where(some).join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "group-terms")
    totals = of_groups.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))

    # A row per group, numbered within its language.
    all_groups = counts.where(~some).select("lang", "source")
    zero = F.lit(0).cast("long")
    groups = all_groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "held", "v", "lang_total")]
    )
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"))).otherwise(F.lit(1).cast("long")))
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("of", F.row_number().over(by_lang.orderBy("source")).cast("long") - 1).withColumn("sources", F.count(F.lit(1)).over(by_lang))
    groups = materialise(groups, "groups")
    small = groups.count() <= BROADCAST_SOURCES

    def beside(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if small else frame

    p = share(F.col("n"), F.col("total"), F.col("v"))
    shares = of_groups.join(beside(groups), ["lang", "source"]).withColumn("p", p)
    shares = materialise(shares.withColumn("lang_p", share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).select(
        "lang", "source", "of", "sources", "term", "p", "p0", "lang_p"), "shares")
    pairs = pair_sums(groups, shares, beside, block)
    order = [F.col("value").desc(), F.col("item").asc()]
    ranked = Window.partitionBy("lang", "source").orderBy(*order)
    pair_rows = pairs.withColumn("rank", F.row_number().over(ranked)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    wide = shares.where(F.col("p") > F.col("lang_p")).select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("lang_p")).alias("value"))
    # Spark keeps the first ranks of every task before it shuffles, so a source with very many terms makes no large task.
    term_rows = wide.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    return pair_rows.unionByName(term_rows.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def pair_sums(groups: DataFrame, shares: DataFrame, beside: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, in both directions.

    With p0 and q0 the shares of terms that a source has not, and V terms in all, the sum over all kept terms is that over P's terms of
    gap(p, q0), over Q's terms of gap(p0, q), (V - |P| - |Q|) gap(p0, q0), and over common terms of
    gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0). The first two need only how often each share occurs in a source.
    """
    big = "decimal(38,0)"
    mine = groups.select("lang", "source", "of", "held", "v", "p0")
    others = groups.select("lang", F.col("source").alias("item"), F.col("of").alias("item_of"), F.col("held").alias("item_held"), F.col("p0").alias("q0"))
    two = F.col("source") != F.col("item")
    base = mine.join(beside(others), "lang").where(two).select(
        "lang", "of", "item_of", ((F.col("v") - F.col("held") - F.col("item_held")).cast(big) * gap(F.col("p0"), F.col("q0")).cast("decimal(19,0)")).cast(big).alias("value")
    )
    each = shares.groupBy("lang", "source", "of", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    alone = each.join(beside(others), "lang").where(two).select("lang", F.inline(F.array(
        F.struct(F.col("of"), F.col("item_of"), (F.col("m").cast("decimal(19,0)") * gap(F.col("p"), F.col("q0")).cast("decimal(19,0)")).cast(big).alias("value")),
        F.struct(F.col("item_of").alias("of"), F.col("of").alias("item_of"), (F.col("m").cast("decimal(19,0)") * gap(F.col("q0"), F.col("p")).cast("decimal(19,0)")).cast(big).alias("value")),
    )))
    last = F.floor((F.col("sources") - 1) / block)
    own = F.floor(F.col("of") / block)
    cells = shares.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "lang", F.least(own, "_other").alias("low"), F.greatest(own, "_other").alias("high"), "term", "of", "p", "p0"
    )
    common = _common(cells, block).select("lang", F.col("a").alias("of"), F.col("b").alias("item_of"), F.col("value").cast(big).alias("value"))
    total = base.unionByName(alone).unionByName(common).groupBy("lang", "of", "item_of").agg(F.sum("value").cast("long").alias("value"))
    named = total.join(beside(mine.select("lang", "of", "source")), ["lang", "of"])
    return named.join(beside(others.select("lang", "item_of", "item")), ["lang", "item_of"]).select("lang", "source", "item", "value")
