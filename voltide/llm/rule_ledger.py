"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document. The ledger stores the measurements and one bit for each rule that failed; policies are
masks over these bits, so a new policy, or what a policy would do without one of its rules, never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm import measures
from voltide.llm.arrays import map_texts


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL condition over the measurements of ``measures.NAMES``."""

    name: str
    failed: str


#: Position in this list is the bit. Append only: ledgers on disk keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("upper_case", "n_upper > n_lower"),
    Rule("twin_words", "10 * n_twin_words > 3 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails more than ``allowed`` of ``rules``."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


def mask_of(names: tuple[str, ...]) -> int:
    bits = {rule.name: 1 << k for k, rule in enumerate(RULES)}
    return sum(bits[name] for name in names)


POLICIES = (
    Policy("1", ("symbols", "duplicate_lines", "short_words", "long_words")),
    Policy("2", ("symbols", "duplicate_lines", "short_words", "long_words", "upper_case", "twin_words")),
)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, every measurement (long) and ``failed_bits`` (long).

    A null or empty text has no words and measures 0 everywhere. Equal rows and null ids each get their row; other columns of
    ``docs`` don't matter. Words and lines are compared by 64-bit hashes within one text. Memory follows the longest text.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, " + ", ".join(f"{name} long" for name in measures.NAMES)
    taken = map_texts(rows, "_text", schema, lambda part, texts: [part.column(0), *measures.measured(texts).values()])
    bits = sum((F.when(F.expr(rule.failed), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES)), F.lit(0).cast("long"))
    return taken.withColumn("failed_bits", bits).withColumnRenamed("_id", id_col)


def verdicts(book: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` (false if ``base_failed`` or the policy rejects)."""
    base = F.col("failed_bits").bitwiseAND(F.lit(mask_of(BASE))) != 0
    hits = F.bit_count(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)))
    return book.withColumn("base_failed", base).withColumn("kept", ~base & (hits <= policy.allowed))


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: documents it fails, and those that only this rule rejects, which dropping it would bring back.

    ``version, rule, n_docs, n_rejected, n_failed, n_only`` (long). The documents are first counted by their bits, which gives at
    most 2 to the number of rules rows; all else is bit arithmetic on those counts. An empty ledger gives an empty result.
    """
    counted = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    asked = [(p.version, p.mask, p.allowed, rule, mask_of((rule,))) for p in policies for rule in p.rules]
    rules = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("version", "mask", "allowed", "rule", "bit"), row)]) for row in asked]))
    hit = F.bit_count(F.col("failed_bits").bitwiseAND(F.col("r.mask")))
    has = F.col("failed_bits").bitwiseAND(F.col("r.bit")) != 0
    return counted.select("failed_bits", "n", rules.alias("r")).groupBy(F.col("r.version").alias("version"), F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n_docs"), F.sum(F.when(hit > F.col("r.allowed"), F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(has & (hit == F.col("r.allowed") + 1), F.col("n")).otherwise(0)).alias("n_only"),
    )
