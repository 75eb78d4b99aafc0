"""Language identification by interpolated Kneser-Ney models of characters.

Each language has a model of four-character sequences. An unseen sequence falls back on shorter ones, whose counts are the number of
different characters seen in front of them. The models of all languages share sorted arrays of hashes, with a row of log
probabilities, a column per language, for each sequence. The language with the lowest cross-entropy per character is chosen.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltide.llm.arrays import mixed, parts, place_factors

ORDER = 4
#: Characters of each language that a fit reads, about, and documents that calibrate it; both chosen by a hash of id and text.
FIT_CHARS, CALIBRATION_DOCS = 1_000_000, 2_000
#: Share of a language's own documents that may be rejected.
REJECTED = 0.001
#: Marks the start of a text; gives the first characters a full context.
START = "\x01" * (ORDER - 1)

_word_code: np.ndarray | None = None


def _codes() -> np.ndarray:
    """For every code point itself if a letter or a mark on one, the start mark too, otherwise a blank."""
    global _word_code
    if _word_code is None:
        kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
        _word_code = np.where((kinds == "L") | (kinds == "M"), np.arange(0x110000), 32).astype(np.uint32)
        _word_code[1] = 1
    return _word_code


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ``ORDER`` character windows of all texts (a row each) and their texts.

    Letters are in lower case, and whatever stands between words is one blank.
    """
    pieces = [START + " " + t.lower().replace("\x01", " ") + " " for t in texts]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    codes = _codes()[np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owners = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes, owners = codes[keep], owners[keep]
    at = np.flatnonzero(codes != 1)
    at = at[at >= ORDER - 1]
    return np.stack([codes[at - k] for k in range(ORDER - 1, -1, -1)], 1), owners[at]


def hashed(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows."""
    n = grams.shape[1]
    total = np.full(len(grams), n, np.uint64)
    for k, factor in enumerate(place_factors(ORDER)[:n]):
        total += (grams[:, k].astype(np.uint64) + np.uint64(1)) * factor
    return mixed(total)


@dataclass
class Table:
    """A sorted hash array with a row of numbers per hash."""

    keys: np.ndarray
    rows: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and which of them are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


@dataclass
class Model:
    languages: list[str]
    #: Log probabilities of sequences of n characters, and log weights of the shorter ones after a context of n - 1, at n - 1.
    grams: list[Table]
    backoff: list[Table]
    unseen: float  # log probability of a character no language has
    heat: float = 1.0
    doubt: float = 0.0
    #: Per language mean and limit of (cross-entropy - mean) * sqrt(characters).
    usual: np.ndarray | None = None
    limit: np.ndarray | None = None

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """A row of log probabilities, a column per language, of each window's last character."""
        n = grams.shape[1]
        if n == 0:
            return np.full((len(grams), len(self.languages)), self.unseen, np.float32)
        at, there = self.grams[n - 1].find(hashed(grams))
        out = self.grams[n - 1].rows[at] if len(self.grams[n - 1].keys) else np.zeros((len(grams), len(self.languages)), np.float32)
        miss = np.flatnonzero(~there)
        if len(miss):
            lower = self.log_probabilities(grams[miss, 1:])
            at, there = self.backoff[n - 1].find(hashed(grams[miss, :-1]))
            lower[there] += self.backoff[n - 1].rows[at[there]]
            out[miss] = lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, in nats, and the characters of each text."""
        grams, owners = windows(texts)
        size = np.bincount(owners, minlength=len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        if len(owners) and self.languages:
            starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
            total[owners[starts]] = -np.add.reduceat(self.log_probabilities(grams), starts, axis=0, dtype=np.float64)
        return total / np.maximum(1, size)[:, None], size


def train(grams: np.ndarray, language: np.ndarray, counts: np.ndarray, languages: list[str]) -> Model:
    """Interpolated Kneser-Ney models from the counted windows of each language."""
    width = len(languages)
    per = [_levels(grams[language == k], counts[language == k]) for k in range(width)]
    letters = np.unique(np.concatenate([level[0][0] for level in per]), axis=0)
    model = Model(languages, [], [], float(-np.log(len(letters) + 1)))
    lower: Table | None = None
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([level[n - 1][0] for level in per]), axis=0)
        contexts = np.unique(union[:, :-1], axis=0)
        gram_keys, context_keys = hashed(union), hashed(contexts)
        order, context_order = np.argsort(gram_keys), np.argsort(context_keys)
        union, gram_keys, context_keys = union[order], gram_keys[order], context_keys[context_order]
        share, weight = np.zeros((len(union), width)), np.ones((len(contexts), width))
        for k in range(width):
            own, count = per[k][n - 1]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones and twos else 0.5
            at = np.searchsorted(context_keys, hashed(own[:, :-1]))
            total, kinds = np.bincount(at, count, len(contexts)), np.bincount(at, minlength=len(contexts))
            share[np.searchsorted(gram_keys, hashed(own)), k] = (count - discount) / total[at]
            weight[:, k] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        below = np.exp(model.unseen) if lower is None else lower.rows[np.searchsorted(lower.keys, hashed(union[:, 1:]))]
        lower = Table(gram_keys, share + weight[np.searchsorted(context_keys, hashed(union[:, :-1]))] * below)
        model.grams.append(Table(gram_keys, np.log(lower.rows).astype(np.float32)))
        model.backoff.append(Table(context_keys, np.log(weight).astype(np.float32)))
    return model


def _levels(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences of 1 to ``ORDER`` characters; the longest with counts, the others with the number of characters seen in front."""
    levels = [(grams, counts.astype(float))]
    while levels[0][0].shape[1] > 1:
        shorter, kinds = np.unique(levels[0][0][:, 1:], axis=0, return_counts=True)
        levels.insert(0, (shorter, kinds.astype(float)))
    return levels


def calibrate(model: Model, entropies: np.ndarray, size: np.ndarray, truth: np.ndarray) -> None:
    """Sets how sure a difference of cross-entropies makes, and the limits of rejection, from documents not used in the fit."""
    if not len(truth):
        return
    best = None
    for heat in np.geomspace(0.05, 50, 31):
        chance = _chances(entropies, size, heat)
        loss = -np.log(np.maximum(chance[np.arange(len(truth)), truth], 1e-12)).mean()
        if best is None or loss < best[0] - 1e-9:
            best = (loss, heat)
    model.heat = float(best[1])
    model.doubt = (int((entropies.argmin(1) != truth).sum()) + 1) / (len(truth) + 2)
    own = entropies[np.arange(len(truth)), truth]
    width = len(model.languages)
    model.usual, model.limit = np.zeros(width), np.full(width, np.inf)
    for k in range(width):
        if (truth == k).any():
            model.usual[k] = np.average(own[truth == k], weights=size[truth == k])
            off = (own[truth == k] - model.usual[k]) * np.sqrt(size[truth == k])
            model.limit[k] = max(np.quantile(off, 1 - REJECTED), 4 * off.std()) if len(off) > 1 else np.inf


def _chances(entropies: np.ndarray, size: np.ndarray, heat: float) -> np.ndarray:
    scaled = -entropies * np.sqrt(size)[:, None] * heat
    scaled -= scaled.max(1, keepdims=True)
    chance = np.exp(scaled)
    return chance / chance.sum(1, keepdims=True)


def _usable(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_chars: int = FIT_CHARS, calibration_docs: int = CALIBRATION_DOCS) -> Model:
    """Models of every language that ``lang_col`` names.

    About ``fit_chars`` characters of each language are read, whole documents chosen by a hash, and other documents, about
    ``calibration_docs`` of each language, for calibration. Windows are counted on the executors; what reaches the driver, and later
    every task, is bounded by ``fit_chars`` for each language. Rows without text, letters or language teach nothing. Without any
    other row the model has no language.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & _usable(F.col(text_col))).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col), F.col(text_col)), F.lit(1_000_003)).alias("draw")
    )
    sizes = {r.lang: r for r in labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("docs")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [], [], 0.0)
    number = F.create_map(*[x for k, lang in enumerate(languages) for x in (F.lit(lang), F.lit(k))])

    def limit(of: dict[str, float]) -> Column:
        return F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(of[lang] * 1_000_003))])[F.col("lang")]

    # At least four fifths of a small language are fitted on, the rest calibrates.
    fitted = {lang: min(0.8, fit_chars / sizes[lang].chars) for lang in languages}
    upper = {lang: min(1.0, fitted[lang] + calibration_docs / sizes[lang].docs) for lang in languages}
    chosen = labelled.where(F.col("draw") < limit(upper)).select(number[F.col("lang")].alias("language"), "text", (F.col("draw") < limit(fitted)).alias("fits"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in parts(batch, "text"):
                grams, owners = windows(part.column(1).to_pylist())
                language = part.column(0).to_numpy()[owners]
                key = grams[:, 0].astype(np.uint64) << np.uint64(42) | grams[:, 1].astype(np.uint64) << np.uint64(21) | grams[:, 2].astype(np.uint64)
                seen, n = np.unique(np.stack([language.astype(np.uint64), key, grams[:, 3].astype(np.uint64)], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0].astype(np.int32)), pa.array(seen[:, 1].view(np.int64)), pa.array(seen[:, 2].astype(np.int32)), pa.array(n)], names)

    names = ["language", "context", "letter", "n"]
    counted = chosen.where("fits").select("language", "text").mapInArrow(count, StructType.fromDDL("language int, context long, letter int, n long"))
    table = counted.groupBy("language", "context", "letter").agg(F.sum("n").alias("n")).toPandas().sort_values(names[:3])
    context = table["context"].to_numpy().view(np.uint64)
    bits = np.uint64((1 << 21) - 1)
    grams = np.stack([context >> np.uint64(42), context >> np.uint64(21) & bits, context & bits, table["letter"].to_numpy().astype(np.uint64)], 1).astype(np.uint32)
    model = train(grams, table["language"].to_numpy(), table["n"].to_numpy(), languages)

    rest = chosen.where("NOT fits").select("language", "text")
    got = _scored(rest, model, "language int, size long, entropies array<double>", lambda part, entropies, size: [part.column(0), size, list(entropies)]).toPandas()
    got = got[got["size"] > 0]
    if len(got):
        entropies = np.array(got["entropies"].tolist())
        calibrate(model, entropies, got["size"].to_numpy(), got["language"].to_numpy())
    return model


def _scored(rows: DataFrame, model: Model, schema: str, columns) -> DataFrame:
    fields = StructType.fromDDL(schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in parts(batch, "text"):
                entropies, size = shared.value.entropies([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns(part, entropies, size)], fields.names)

    return rows.mapInArrow(run, fields)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` (nats per character) and ``rejected``.

    ``score`` is the calibrated chance that the prediction is right. ``rejected`` marks a text that is less like the language found
    than all but one in a thousand of that language's documents; the prediction stands beside it. A text that is null or has no
    letter is ``und`` with score 0, rejected; so is every text if the model has no language. The whole text is read. Memory follows
    the longest text.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), _usable(F.col(text_col)).alias("usable"))
    names = [*model.languages, "und"]
    width = len(model.languages)

    def columns(part: pa.RecordBatch, entropies: np.ndarray, size: np.ndarray) -> list:
        good = part.column(2).to_numpy(zero_copy_only=False) & (width > 0)
        if not width:
            return [part.column(0), ["und"] * len(part), np.zeros(len(part)), pa.nulls(len(part), pa.float64()), ~good]
        best = np.where(good, entropies.argmin(1), width)
        rows_, known = np.arange(len(part)), np.minimum(best, width - 1)
        chance = _chances(entropies, size, model.heat)[rows_, known]
        score = np.where(good, (1 - model.doubt) * chance + model.doubt / width, 0.0)
        own = entropies[rows_, known]
        far = np.zeros(len(part), bool) if model.limit is None else (own - model.usual[known]) * np.sqrt(size) > model.limit[known]
        return [part.column(0), [names[k] for k in best], score, pa.array(own, mask=~good), far | ~good]

    schema = f"_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, cross_entropy double, rejected boolean"
    return _scored(rows, model, schema, columns).withColumnRenamed("_id", id_col)
