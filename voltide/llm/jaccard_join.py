"""Similarity join of documents on the Jaccard index of their word n-grams, by chosen paths.

A run splits the sets on sampled shared tokens: a node of its tree draws a few of the tokens, and sets that share a drawn token go to
the same child. A set stands in the tree by its minimum hashes, of which two sets share as large a part as their Jaccard index. Small
buckets are compared by brute force on these hashes. In a large one all sets are first compared with a few of them: those that are linked
with the same one belong together already, so what is left to search are pairs with one of the others. Few others are compared with the
whole bucket, in blocks; with many the bucket is split again, and what is still large at the deepest level is compared block by block.
Runs are repeated until a pair at the threshold is found with the target recall.

What the buckets find are candidate groups. Inside a group all pairs are then compared exactly, on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.arrays import Texts, chained, components, group_starts, map_texts, mixed, whole_groups
from voltide.llm.components import connected
from voltide.llm.measures import repeated
from voltide.session import materialise

#: Minimum hashes of a set.
COORDINATES = 64
#: Levels below the root at which large buckets are split; sets of a bucket or block that are compared with each other.
DEPTH, LEAF, BLOCK = 2, 512, 128
#: Sets of a large bucket that all others of it are compared with before it is split.
REPRESENTATIVES = 4

_FACTORS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_XOR, _ODD = _FACTORS[:COORDINATES], _FACTORS[COORDINATES:] | np.uint64(1)


def shingles(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct word n-grams, text after text, and their texts. A text of fewer words is one shingle."""
    starts, ends, owners = texts.words()
    hashes = texts.hashes(starts, ends)
    tokens, at = chained(hashes, owners, n)
    own = owners[at]
    sizes = np.bincount(owners, minlength=texts.n)
    for k in range(1, n):
        short = sizes[owners] == k
        if short.any():
            few, at = chained(hashes[short], owners[short], k)
            tokens, own = np.concatenate([tokens, few]), np.concatenate([own, owners[short][at]])
    order = np.argsort(own, kind="stable")
    tokens, own = tokens[order], own[order]
    order, again = repeated(tokens, own)
    keep = np.ones(len(tokens), bool)
    keep[order[again]] = False
    return tokens[keep], own[keep]


def runs_for(similarity: float, recall: float) -> int:
    """The first number of runs after which a pair at the threshold, split down to the deepest level, is found with probability ``recall``."""
    if not 0 < recall < 1:
        raise ValueError("recall must be between 0 and 1")
    runs = 1
    while miss_probability(similarity, recall, runs) > 1 - recall:
        runs += 1
    return runs


def miss_probability(similarity: float, recall: float, runs: int) -> float:
    """That of a pair at the threshold whose buckets are all split down to the deepest level, with the coordinates that these roots draw.

    Each minimum hash of such a pair agrees with probability ``similarity``. Below the roots every coordinate is drawn anew in every
    bucket. A pair that agrees on less than the floor of the estimate is lost in any case.
    """
    agree = np.arange(COORDINATES + 1)
    share = min(1.0, 1 / (similarity * COORDINATES))  # of a coordinate to be drawn by a node
    lost = np.zeros(COORDINATES + 1)  # in a common bucket, by how many coordinates agree
    for _ in range(DEPTH):
        lost = (1 - share + share * lost) ** agree
    chance = np.zeros((COORDINATES + 1, COORDINATES + 1))  # with ``lost`` of a row, of so many coordinates that agree and no common bucket that finds the pair
    chance[:, 0] = 1
    for drawn in _drawn(_roots(runs), similarity).sum(0).tolist():
        more = chance * (1 - similarity)
        more[:, 1:] += chance[:, :-1] * similarity * (lost**drawn)[:, None]
        chance = more
    below = agree < _floor(similarity, recall) * COORDINATES
    return float(np.where(below, _agreeing(similarity), np.diag(chance)).sum())


def _agreeing(similarity: float) -> np.ndarray:
    """Probability of each number of minimum hashes that agree."""
    return np.array([math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(COORDINATES + 1)])


def _floor(similarity: float, recall: float) -> float:
    """Estimate from which a pair is linked: four standard deviations below the threshold, or less where that loses over half of 1 - recall."""
    lost = np.concatenate([[0.0], np.cumsum(_agreeing(similarity))])  # with so many or more wanted
    least = np.flatnonzero(lost[:-1] <= (1 - recall) / 2)[-1] / COORDINATES
    return min(similarity - 4 * math.sqrt(similarity * (1 - similarity) / COORDINATES), float(least))


def _roots(runs: int) -> np.ndarray:
    return mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _drawn(paths: np.ndarray, similarity: float) -> np.ndarray:
    """Which coordinates the nodes at the ends of ``paths`` draw, a row of truth values each."""
    seeds = mixed(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(1))
    return mixed(paths[:, None] ^ seeds[None, :]) < np.uint64(2**64 / (similarity * COORDINATES))


def _child(paths: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mixed(mixed(paths + coordinate.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) ^ value)


def described(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, runs: int) -> DataFrame:
    """Per row: ``id``, ``text_key``, ``node`` (128-bit digest of the set, null if empty), ``size``, ``marks``, ``roots`` (buckets of all runs)."""
    roots = _roots(runs)
    run, coordinate = np.nonzero(_drawn(roots, similarity))

    def work(part: pa.RecordBatch, texts: Texts) -> list:
        tokens, own = shingles(texts, words)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
        full = own[first]
        sizes = np.bincount(own, minlength=texts.n)
        least = np.empty((len(full), COORDINATES), np.uint64)
        for k in range(COORDINATES if len(full) else 0):
            least[:, k] = np.minimum.reduceat((tokens ^ _XOR[k]) * _ODD[k], first)
        least = mixed(least)
        node, marks, buckets = [None] * texts.n, [None] * texts.n, [None] * texts.n
        if len(full):
            digest = np.stack([np.add.reduceat(mixed(tokens ^ _XOR[0]), first), np.add.reduceat(mixed(tokens ^ _ODD[0]), first)], 1)
            small = (least & np.uint64(0xFFFF)).astype(np.uint16)
            paths = _child(np.broadcast_to(roots[run], (len(full), len(run))), np.broadcast_to(coordinate, (len(full), len(run))), least[:, coordinate])
            for i, k in enumerate(full.tolist()):
                node[k], marks[k], buckets[k] = digest[i].tobytes(), small[i].tobytes(), paths[i].view(np.int64)
        return [part.column(0), part.column(1), pa.array(node, pa.binary()), pa.array(sizes.astype(np.int64)), pa.array(marks, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("_text"))
    return map_texts(rows, "_text", f"id {dict(docs.dtypes)[id_col]}, text_key long, node binary, size long, marks binary, roots array<long>", work)


def _children(rows: DataFrame, similarity: float) -> DataFrame:
    """``bucket, node`` one level deeper, from ``bucket, node, size, marks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_numpy().view(np.uint64)
            marks = _marks(batch.column(3))
            row, coordinate = np.nonzero(_drawn(paths, similarity))
            child = _child(paths[row], coordinate, marks[row, coordinate].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(pa.array(row))], ["bucket", "node"])

    return rows.select("bucket", "node", "size", "marks").mapInArrow(run, T.StructType([T.StructField("bucket", T.LongType()), T.StructField("node", T.BinaryType())]))


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), COORDINATES)


def _pairs(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within groups of a sorted table, the smaller row first."""
    sizes = np.diff(np.append(starts, n))
    later = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # rows of the group behind each row
    a = np.repeat(np.arange(n), later)
    before = np.cumsum(later) - later
    return a, np.arange(len(a)) - before[a] + a + 1


def _bucket_links(rows: DataFrame, keys: list[str], similarity: float, floor: float) -> DataFrame:
    """``a, b``: each set of a bucket with the first of those that it is linked with there, by estimate; at most a row per row.

    Only pairs with a set that is ``open`` are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            marks, sizes = _marks(table.column("marks").combine_chunks()), table.column("size").to_numpy()
            wanted = table.column("open").to_numpy(zero_copy_only=False).astype(bool)
            starts = group_starts(table, keys)
            ends = np.append(starts[1:], len(table))
            large = ends - starts > 64
            found = []
            small = np.concatenate([np.arange(s, e) for s, e in zip(starts[~large], ends[~large])]) if (~large).any() else np.empty(0, np.int64)
            lengths = (ends - starts)[~large]
            a, b = _pairs(np.cumsum(lengths) - lengths, len(small))
            some = wanted[small[a]] | wanted[small[b]]
            a, b = a[some], b[some]
            for k in range(0, len(a), 1 << 17):
                found.append(_close(marks, sizes, small[a[k : k + (1 << 17)]], small[b[k : k + (1 << 17)]], similarity, floor))
            for s, e in zip(starts[large].tolist(), ends[large].tolist()):
                places = np.arange(s, e)
                for k in range(s, e):
                    rest = places[k + 1 - s :] if wanted[k] else places[k + 1 - s :][wanted[k + 1 : e]]
                    found.append(_close(marks, sizes, np.full(len(rest), k), rest, similarity, floor))
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            label = components(len(table), a, b)
            moved = np.flatnonzero(label != np.arange(len(table)))
            nodes = table.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(label[moved]))], ["a", "b"])

    cells = rows.repartition(*keys).sortWithinPartitions(*keys)
    return cells.mapInArrow(run, T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())]))


def _close(marks: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    may = small >= similarity * large  # else the index is below the threshold for certain
    a, b = a[may], b[may]
    near = (marks[a] == marks[b]).mean(1) >= floor if len(a) else np.empty(0, bool)
    return a[near], b[near]


def _in_cells(rows: DataFrame, count: str, block: int) -> DataFrame:
    """Rows of a group of ``count`` once for each pair of blocks that they take part in: ``low, high`` and their own ``block``."""
    blocks = F.ceil(F.col(count) / F.lit(block)).cast("int")
    return (
        rows.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_blocks", "_other")
    )


def _represented(large: DataFrame, similarity: float, floor: float, name: str) -> tuple[DataFrame, DataFrame]:
    """Large buckets compared with representatives: links ``a, b``, and the rows with ``open`` (must still be compared) and ``n_open``.

    A bucket's largest component of sets that are linked by representatives needs no search among its own; all others are open.
    """
    pick = F.pmod(F.xxhash64("node"), F.lit(REPRESENTATIVES)).alias("pick")
    first = large.groupBy("bucket", pick).agg(F.min(F.struct("node", "size", "marks")).alias("_one"))
    chosen = materialise(first.groupBy("bucket").agg(F.sort_array(F.collect_list("_one")).alias("ones")), f"{name}-representatives")
    kinds = {"bucket": T.LongType(), "node": T.BinaryType(), "size": T.LongType(), "marks": T.BinaryType(), "n": T.LongType(), "near": T.IntegerType(), "to": T.ArrayType(T.BinaryType())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            ones = batch.column(batch.schema.get_field_index("ones"))
            starts, flat = ones.offsets.to_numpy(), ones.values
            marks, sizes = _marks(batch.column(3)), batch.column(2).to_numpy()
            nodes, one_nodes = batch.column(1).to_pylist(), flat.field("node").to_pylist()
            one_marks, one_sizes = _marks(flat.field("marks")), flat.field("size").to_numpy()
            buckets = batch.column(0).to_numpy()
            near, to = np.zeros(rows, np.int32), [[] for _ in range(rows)]
            for k in range(REPRESENTATIVES):
                row = np.flatnonzero(starts[:-1] + k < starts[1:])
                at = starts[row] + k
                a, _ = _close(np.concatenate([marks, one_marks]), np.concatenate([sizes, one_sizes]), row, rows + at, similarity, floor)
                near[a] |= 1 << k
            told = set()  # of a bucket, which representatives a set has joined already
            for row in np.flatnonzero(near).tolist():
                bits, key = int(near[row]), (int(buckets[row]), int(near[row]))
                joins = [k for k in range(REPRESENTATIVES) if bits >> k & 1]
                to[row] = [one_nodes[starts[row] + k] for k in (joins[:1] if key in told else joins) if one_nodes[starts[row] + k] != nodes[row]]
                told.add(key)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(near), pa.array(to, pa.list_(pa.binary()))], list(kinds))

    fields = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])
    seen = large.join(chosen, "bucket").select("bucket", "node", "size", "marks", "n", "ones").mapInArrow(run, fields)
    seen = materialise(seen, f"{name}-represented")
    links = seen.select(F.col("node").alias("a"), F.explode("to").alias("b"))
    masks = seen.groupBy("bucket", "near").agg(F.count(F.lit(1)).alias("m")).groupBy("bucket").agg(F.collect_list(F.struct("near", "m")).alias("masks"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mains, opens = zip(*(_main({x["near"]: x["m"] for x in masks}) for masks in batch.column(1).to_pylist())) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mains, pa.int32()), pa.array(opens, pa.int64())], ["bucket", "main", "n_open"])

    settled = materialise(masks.mapInArrow(settle, "bucket long, main int, n_open long"), f"{name}-settled")
    rows = seen.drop("to").join(settled, "bucket").withColumn("open", F.col("near").bitwiseAND(F.col("main")) == 0)
    return links, rows.drop("near", "main")


def _main(masks: dict[int, int]) -> tuple[int, int]:
    """Of rows counted by the representatives they are linked with: those of the largest component, and the rows outside it."""
    parts: list[int] = []
    for mask in masks:
        if mask:
            joined = [x for x in parts if x & mask]
            parts = [x for x in parts if not x & mask] + [sum(joined) | mask]
    inside = {part: sum(n for mask, n in masks.items() if mask & part) for part in parts}
    main = max(inside, key=lambda x: (inside[x], x), default=0)
    return main, sum(masks.values()) - inside.get(main, 0)


def _open_cells(rows: DataFrame) -> DataFrame:
    """Open rows once for each block of their bucket, all others in their own block."""
    blocks = F.ceil(F.col("n") / F.lit(LEAF)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    at = F.when(F.col("open"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    return rows.withColumn("low", F.explode(at)).withColumn("high", F.col("low"))


def candidates(sets: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Links ``a, b`` between sets that a bucket holds together and whose estimate may reach the threshold.

    They connect what any such pairs would connect: in a bucket whose sets are linked with representatives, pairs among these are left out.
    """
    floor = _floor(similarity, recall)
    keys = ["bucket", "low", "high"]
    facts = sets.select("node", "size", "marks")
    rows, links = sets.select(F.explode("roots").alias("bucket"), "node"), []
    for depth in range(DEPTH + 1):
        # Written first: with plain shuffles on both sides of the join, Spark can split the rows of a hot bucket.
        counts = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"bucket-counts-{depth}")
        live = materialise(rows.join(counts, "bucket").join(facts, "node"), f"bucket-rows-{depth}")
        small = live.where(F.col("n") <= LEAF).withColumn("open", F.lit(True))
        links.append(_bucket_links(_in_cells(small, "n", LEAF), keys, similarity, floor))
        large = live.where(F.col("n") > LEAF)
        if large.isEmpty():
            break
        joined, large = _represented(large, similarity, floor, f"bucket-{depth}")
        few = large.where((F.col("n_open") > 0) & (F.col("n_open") <= LEAF))
        many = large.where(F.col("n_open") > LEAF)
        links += [joined, _bucket_links(_open_cells(few), keys, similarity, floor)]
        if depth == DEPTH:
            links.append(_bucket_links(_in_cells(many, "n", LEAF), keys, similarity, floor))
        else:
            rows = _children(many, similarity)
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def _verified(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Exact comparison inside the cells of candidate groups: per row ``node``, ``links`` (copies of linked sets) and ``root``."""
    keys = ["component", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 256, "text"):
            starts = group_starts(table, keys)
            ends = np.append(starts[1:], len(table))
            tokens, own = shingles(Texts.of(table.column("text").combine_chunks()), words)
            first = np.searchsorted(own, np.arange(len(table) + 1))
            block, copies = table.column("block").to_numpy(), table.column("copies").to_numpy()
            one = (table.column("low").to_numpy() == table.column("high").to_numpy())
            links, label = np.zeros(len(table), np.int64), np.arange(len(table))
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s < 2:
                    continue
                near = _near(tokens[first[s] : first[e]], own[first[s] : first[e]] - s, e - s, similarity)
                if not one[s]:  # pairs within a block belong to that block's own cell
                    near &= block[s:e, None] != block[None, s:e]
                links[s:e] = near @ copies[s:e]
                a, b = np.nonzero(near)
                label[s:e] = components(e - s, a, b) + s
            nodes = table.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([nodes, pa.array(links), nodes.take(pa.array(label))], ["node", "links", "root"])

    cells = rows.repartition(*keys).sortWithinPartitions(*keys)
    fields = [T.StructField("node", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType())]
    return cells.mapInArrow(run, T.StructType(fields))


def _near(tokens: np.ndarray, own: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """Which pairs of n sets reach the threshold; none with itself."""
    _, which, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    sizes = np.bincount(own, minlength=n)
    number = np.cumsum(counts > 1) - 1
    shared = counts[which] > 1
    column, row = number[which[shared]], own[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n), np.float64)
    width = 8192
    for k in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(column, (k, k + width))
        held = np.zeros((n, width), np.float32)
        held[row[a:b], column[a:b] - k] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    near = (common > 0) & (common >= similarity * union - 1e-9)
    np.fill_diagonal(near, False)
    return near


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows described, and per node its ``class``, the class's smallest id ``class_id``, ``copies`` and ``n_links``. Both are written."""
    runs = runs_for(similarity, recall)
    records = materialise(described(docs, id_col, text_col, words, similarity, runs), "join-records")
    sets = materialise(
        records.where(F.col("node").isNotNull()).groupBy("node").agg(
            F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "text_key")).alias("of"), F.first("size").alias("size"),
            F.first("marks").alias("marks"), F.first("roots").alias("roots"),
        ), "join-sets")
    groups = connected(candidates(sets, similarity, recall), "join-candidates")
    counted = groups.join(groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component").join(sets.select("node", "copies", "of"), "node")
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key")).alias("_of"), F.col(text_col).alias("text"))
    members = counted.join(texts, F.col("of").eqNullSafe(F.col("_of"))).dropDuplicates(["node"]).select("component", "n", "node", "copies", "text")
    verified = materialise(_verified(_in_cells(members, "n", BLOCK), words, similarity), "join-links")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), "join-classes")
    named = classes.join(sets.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("class_id"))
    # Written, like the bucket counts, so that the rows of a hot node can be split below.
    of_node = materialise(
        sets.select("node", "least", "copies").join(classes, "node", "left").join(named, "component", "left").join(links, "node", "left").select(
            "node", F.coalesce("component", "node").alias("class"), F.coalesce("class_id", "least").alias("class_id"), "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ), "join-nodes")
    return records, of_node


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.999,
) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id``, ``n_links`` and ``n_copies`` (long).

    Two documents are linked if the Jaccard index of their sets of word n-grams is ``similarity`` or more. ``n_links`` counts the
    other documents linked with this one, copies included; a class is what links connect, named by its smallest id. Documents with
    the same set are one node of all the work and are never paired with each other: ``n_copies`` counts them. Fewer words than an
    n-gram has make one shingle; a null text, or one without words, has an empty set, no links and its own id as class. Null ids
    are allowed and never name a class unless all its ids are null. Equal rows each get their row. An empty table gives an empty
    result.

    Found links are exact, and those inside candidate groups are complete. No set of a bucket is dropped: beyond the deepest level
    buckets are compared in blocks, and so are the groups.
    """
    records, of_node = _joined(docs, id_col, text_col, words, similarity, recall)
    return records.select("id", "node").join(of_node.drop("class"), "node", "left").select(
        F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.999,
) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: one of each class of ``near_classes``.

    It is the one with the smallest id, null last, and of several texts with that id the one with the smallest hash; of rows with the
    same id and text, the one whose whole row has the smallest hash. So every class keeps one row, also if ids are null or repeated.
    Rows whose text is null or has no word are in no class and stay.
    """
    records, of_node = _joined(docs, id_col, text_col, words, similarity, recall)
    # Of each (class, id, text) a row with its count, so that copies are combined before anything is joined by class.
    keys = materialise(
        records.where(F.col("node").isNotNull()).groupBy("node", "id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
        .join(of_node.select("node", "class"), "node").select("class", "id", "text_key", "rows"), "join-keys")
    order = F.struct(F.col("id").isNull().alias("absent"), "id", "text_key")
    stays = materialise(keys.groupBy("class").agg(F.min(order).alias("stays"), F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("of")).where("of > 1"), "join-stays")
    gone = keys.join(stays.where("keys > 1"), "class").where(order != F.col("stays")).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    kept = _without(docs, id_col, text_col, gone)
    again = keys.where("rows > 1").join(stays, "class").where(order == F.col("stays")).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    if again.isEmpty():
        return kept
    again = materialise(again, "join-again")
    row = F.struct(*(kept[c] for c in kept.columns))
    held = kept.join(again, kept[id_col].eqNullSafe(again["_id"]) & (F.xxhash64(kept[text_col]) == again["_key"]), "left_semi")
    once = held.groupBy(id_col, text_col).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row")).select("_row.*")
    return _without(kept, id_col, text_col, again).unionByName(once)


def _without(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> DataFrame:
    return docs.join(keys, docs[id_col].eqNullSafe(keys["_id"]) & (F.xxhash64(docs[text_col]) == keys["_key"]), "left_anti")
