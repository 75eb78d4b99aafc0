"""Fixity audit of WARC archives by Merkle trees.

Every record is hashed. The records of an archive are nodes of a tree by ranges of their offsets: a node's hash covers those of the
ranges below it in order. Two replicas with equal roots are equal. Where roots differ, only differing branches are followed down, until
the damaged records are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.session import materialise

#: Bytes of an archive that one lowest node covers, children of each node above, records of an archive.
LEAF_BYTES, FANOUT, ARCHIVE_RECORDS = 1 << 16, 16, 1000


def warc_record(id: Column, url: Column, payload: Column) -> Column:
    """The bytes of a response record, as text. Null id, url and payload are written as empty ones."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archived(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", records: int = ARCHIVE_RECORDS, stored: Column | None = None,
) -> DataFrame:
    """The index of the archives that hold ``pages``: ``archive, offset, length, id, digest``, one row per row of ``pages``.

    Ids in runs of ``records`` share an archive and lie there in their order, equal ids in that of their digests. Rows without id
    are spread over archives by their digest. A record is hashed where it is read; only its hash and length are shuffled.
    With ``stored``, the payload that another replica holds in place of a row's, ``read`` is the digest of that replica's record.
    """
    record = warc_record(F.col(id_col), F.col(url_col), F.col(payload_col))
    again = [] if stored is None else [F.sha2(warc_record(F.col(id_col), F.col(url_col), stored), 256).alias("read")]
    kept = ["read"] if again else []
    hashed = pages.select(F.col(id_col).alias("id"), record.alias("_record"), *again).select(
        "id", F.octet_length("_record").cast("long").alias("length"), F.sha2("_record", 256).alias("digest"), *kept
    )
    place = F.coalesce(F.floor(F.col("id") / records).cast("string"), F.concat(F.lit("none-"), F.substring("digest", 1, 4)))
    before = Window.partitionBy("archive").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.withColumn("archive", place).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        "archive", "offset", "length", "id", "digest", *kept
    )


def merkle_nodes(records: DataFrame, levels: int) -> DataFrame:
    """``archive, level, node, digest`` from ``archive, offset, digest``; level 0 covers ``LEAF_BYTES``, the last the whole archive.

    A node's digest is that of its children's numbers and digests in order, so a child that is missing shows. A node has as many
    children as records begin in its range, or ``FANOUT``. Repeated records count each; a null digest counts as empty.
    """
    level = (
        records.groupBy("archive", F.floor(F.col("offset") / LEAF_BYTES).alias("node"))
        .agg(F.sort_array(F.collect_list(F.struct("offset", F.coalesce("digest", F.lit("")).alias("digest")))).alias("_below"))
        .select("archive", F.lit(0).alias("level"), "node", _digest("offset").alias("digest"))
    )
    out = level
    for k in range(1, levels):
        level = (
            level.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node"))
            .agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("_below"))
            .select("archive", F.lit(k).alias("level"), "node", _digest("node").alias("digest"))
        )
        out = out.union(level)
    return out


def _digest(name: str) -> Column:
    parts = F.transform("_below", lambda x: F.concat_ws(":", x[name].cast("string"), x["digest"]))
    return F.sha2(F.array_join(parts, "\n"), 256)


def levels_for(length: int) -> int:
    """Levels of a tree whose root covers ``length`` bytes."""
    levels, covered = 1, LEAF_BYTES
    while covered < length:
        levels, covered = levels + 1, covered * FANOUT
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """``archive, offset, id, digest, found, status``: the records that differ between two replicas' indexes (``archived``).

    ``status`` is ``altered``, ``missing`` (only in the first) or ``extra`` (only in the second). Of records that share archive,
    offset and digest any number counts as one here. Rows without archive or offset take part in nothing. Replicas that are equal,
    or empty, give an empty result. Beyond the roots only children of differing nodes are joined; the number of levels, taken from
    the longest archive, is all that reaches the driver.
    """
    first, second = materialise(first, "replica-a"), materialise(second, "replica-b")
    longest = first.select("offset").union(second.select("offset")).agg(F.max("offset")).first()[0]
    levels = levels_for((longest or 0) + 1)
    trees = [materialise(merkle_nodes(x, levels), "merkle") for x in (first, second)]
    wrong = None
    for level in range(levels - 1, -1, -1):
        a, b = (t.where(F.col("level") == level).select("archive", "node", F.col("digest").alias(n)) for t, n in zip(trees, ("_a", "_b")))
        if wrong is not None:
            a, b = (_below(x.withColumn("_parent", F.floor(F.col("node") / FANOUT)), wrong) for x in (a, b))
        wrong = a.join(b, ["archive", "node"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("archive", F.col("node").alias("_parent"))
        # Written, for both sides of the next level read it: as a plan, each level would hold that of the level above twice.
        wrong = materialise(wrong, f"differing-{level}")
        if wrong.isEmpty():
            break
    a, b = (_below(x.withColumn("_parent", F.floor(F.col("offset") / LEAF_BYTES)), wrong).withColumn("_in", F.lit(True)) for x in (first, second))
    a, b = a.dropDuplicates(["archive", "offset", "digest"]), b.dropDuplicates(["archive", "offset", "digest"])
    both = a.alias("a").join(b.alias("b"), (F.col("a.archive") == F.col("b.archive")) & (F.col("a.offset") == F.col("b.offset")), "full")
    status = F.when(F.col("b._in").isNull(), "missing").when(F.col("a._in").isNull(), "extra").otherwise("altered")
    return both.where(~F.col("a.digest").eqNullSafe(F.col("b.digest")) | F.col("a._in").isNull() | F.col("b._in").isNull()).select(
        F.coalesce("a.archive", "b.archive").alias("archive"), F.coalesce("a.offset", "b.offset").alias("offset"), F.coalesce("a.id", "b.id").alias("id"),
        F.col("a.digest").alias("digest"), F.col("b.digest").alias("found"), status.alias("status"),
    )


def _below(rows: DataFrame, wrong: DataFrame) -> DataFrame:
    return rows.join(wrong, ["archive", "_parent"], "left_semi").drop("_parent")
