"""Gaussian maximum likelihood of GARCH(1,1) for many series, and many expanding windows of each, at once.

Series are packed into blocks of consecutive rows. A pass scores a few parameters, shared by all windows of a series, with likelihood,
gradient and curvature at every window's end (``garch_score``); each window keeps the best, and windows that their gradient says are not
done propose the next ones. So no row is copied for a window, and windows that end close to each other are fitted together.

Series of up to ``LOCAL_ROWS`` rows are fitted in one task each. Longer ones keep their blocks apart: all blocks answer the parameters in
parallel, a short table of blocks gives the state that enters each, and all are then summed up to the windows' ends. The state of the
search is a table with a row per series. Both ways run the same search.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.operators.cleaning import finite_or_zero
from voltide.operators.garch import in_force, train_test_split
from voltide.operators.garch_score import (
    STARTS, TERMS, Search, block_end, block_steps, block_sums, entering, first_candidates, passed,
)
from voltide.plans.series import Series, over_series
from voltide.session import materialise

LOCAL_ROWS = 65_536
MIN_ROWS = 30
BROADCAST_BYTES = 64 << 20
ROUNDS = 40
# parameters where a fit is impossible (fixed values): share of the variance, alpha, beta
FALLBACK = (0.05, 0.10, 0.85)
FITTED = ("omega", "alpha", "beta", "loglik")
VECTOR = T.ArrayType(T.DoubleType())


def pack(df: DataFrame, s: Series, order: str | None = None, returns: str = "log_return") -> DataFrame:
    """Blocks ``(keys, block, n, squares, previous, rn)`` of a series; ``order`` is kept for cutting."""
    rows = df.select(*s.keys, s.time, *([order] if order else []), F.pow(finite_or_zero(F.col(returns)), 2).alias("_r2"))

    def build(d, f):
        return d.withColumn("_p2", F.coalesce(F.lag("_r2", 1).over(f.ordered), F.lit(float("nan"))))

    rows = over_series(rows, s, build, before=1).withColumn("block", s.chunk())
    index = F.col(order) if order else F.lit(0).cast("long")
    packed = rows.groupBy(*s.keys, "block").agg(
        F.array_sort(F.collect_list(F.struct(F.col(s.time).alias("t"), "_r2", "_p2", index.alias("rn")))).alias("_rows")
    )
    return packed.select(
        *s.keys, "block", F.size("_rows").cast("long").alias("n"), F.transform("_rows", lambda x: x["_r2"]).alias("squares"),
        F.transform("_rows", lambda x: x["_p2"]).alias("previous"), F.transform("_rows", lambda x: x["rn"]).alias("rn"),
    )


def _fields(df: DataFrame, names: Sequence[str], **more: T.DataType) -> T.StructType:
    return T.StructType([df.schema[c] for c in names] + [T.StructField(c, kind) for c, kind in more.items()])


def _arrays(pdf: pd.DataFrame, column: str) -> list[np.ndarray]:
    return [np.asarray(x, float) for x in pdf[column]]


def _apart(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, for a cogroup with frames derived from the same table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _parts(rn: Sequence[int], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where in a block the rows of another window begin, the first window that has each part, and the rows that any window has."""
    window = np.searchsorted(cuts, np.asarray(rn), side="right")
    window = window[window < len(cuts)]  # in time order; what is behind the last cut is in no window
    starts = np.flatnonzero(np.diff(window, prepend=-1)) if len(window) else np.empty(0, int)
    return starts, window[starts], len(window)


def _up_to(parts: Sequence[tuple[int, np.ndarray]], windows: int, shape: tuple[int, ...]) -> np.ndarray:
    """Running sums over the windows of what each adds."""
    out = np.zeros((windows, *shape))
    for window, value in parts:
        out[window] += value
    return out.cumsum(0)


def _results(key: tuple, refits: Sequence[int], counts: np.ndarray, best: np.ndarray) -> list[list]:
    out = []
    for refit, n, found in zip(refits, counts, best):
        fitted = [None] * 4 if n < MIN_ROWS or not np.isfinite(found).all() else [*found[:3], -0.5 * (n * np.log(2 * np.pi) + found[3])]
        out.append([*key, int(refit), int(n), *fitted])
    return out


def fit_series(blocks: pd.DataFrame, cuts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each window that ends before a cut, and the best parameters with their sums; no fit for a window of under ``MIN_ROWS`` rows."""
    blocks = blocks.sort_values("block")
    data = list(zip(_arrays(blocks, "squares"), _arrays(blocks, "previous"), [_parts(rn, cuts) for rn in blocks["rn"]]))
    ends = [(w, (b - a, squares[a:b].sum())) for squares, _, (starts, windows, n) in data for a, b, w in zip(starts, [*starts[1:], n], windows)]
    totals = _up_to([(w, np.array(x, float)) for w, x in ends], len(cuts), (2,))
    counts = totals[:, 0].astype(int)
    fitted = counts >= MIN_ROWS
    search = Search.of(len(cuts))
    if not fitted.any():
        return counts, search.best
    theta = first_candidates(totals[fitted, 1] / counts[fitted])
    for _ in range(rounds):
        state, parts = entering(theta), []
        for squares, previous, (starts, windows, n) in data:
            if n:
                parts += zip(windows, block_sums(squares[:n], previous[:n], theta, state, starts))
            state = block_end(previous, theta) + passed(state, theta, block_steps(previous))
        sums = _up_to(parts, len(cuts), (TERMS, len(theta)))
        sums[~fitted] = np.nan
        search.take(theta, sums)
        theta = search.theta
        if not len(theta):
            break
    return counts, search.best


def _fit_local(blocks: DataFrame, cuts: DataFrame, groups: list[str], rounds: int) -> DataFrame:
    """A fit is long and its input short, so the partitions are fixed and not merged by size."""

    def fit(key: tuple, rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        names = [*groups, "refit", "n", *FITTED]
        if not len(rows) or not len(ends):
            return pd.DataFrame([], columns=names)
        ends = ends.sort_values("cut")
        counts, best = fit_series(rows, ends["cut"].to_numpy(), rounds)
        return pd.DataFrame(_results(key, ends["refit"], counts, best), columns=names)

    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = _fields(blocks, groups, refit=T.LongType(), n=T.LongType(), **dict.fromkeys(FITTED, T.DoubleType()))
    left, right = blocks.repartition(partitions, *groups), _apart(cuts).repartition(partitions, *groups)
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(fit, schema)


def _fit_distributed(blocks: DataFrame, cuts: DataFrame, groups: list[str], rounds: int) -> DataFrame:
    """Passes as jobs over all blocks; the search of each series is a row of a table that every pass writes anew."""
    blocks = blocks.select(*groups, "block", "squares", "previous", "rn")
    ends = cuts.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("cut", "refit"))).alias("_ends"))
    ends = ends.select(*groups, F.transform("_ends", lambda x: x["cut"]).alias("cuts"), F.transform("_ends", lambda x: x["refit"]).alias("refits"))
    longs = T.ArrayType(T.LongType())
    state_schema = _fields(blocks, groups, cuts=longs, refits=longs, counts=longs, theta=VECTOR, best=VECTOR, stalled=longs)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                at = np.asarray(row["cuts"])
                totals = _up_to([(x["window"], np.array([x["n"], x["total"]], float)) for x in row["parts"]], len(at), (2,))
                some = totals[:, 0] >= MIN_ROWS
                search = Search.of(len(at))
                theta = first_candidates(totals[some, 1] / totals[some, 0]) if some.any() else search.theta
                out.append([*[row[g] for g in groups], at, row["refits"], totals[:, 0].astype(int), theta.ravel(), search.best.ravel(), search.stalled])
            yield pd.DataFrame(out, columns=state_schema.names)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                squares = np.asarray(row["squares"], float)
                starts, windows, n = _parts(row["rn"], np.asarray(row["cuts"]))
                out += [[*[row[g] for g in groups], int(w), int(b - a), squares[a:b].sum()] for a, b, w in zip(starts, [*starts[1:], n], windows)]
            yield pd.DataFrame(out, columns=[*groups, "window", "n", "total"])

    part_schema = _fields(blocks, groups, window=T.LongType(), n=T.LongType(), total=T.DoubleType())
    parts = blocks.join(ends, groups).mapInPandas(sizes, part_schema).groupBy(*groups, "window").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    parts = parts.groupBy(*groups).agg(F.collect_list(F.struct("window", "n", "total")).alias("parts"))
    state = materialise(ends.join(parts, groups).mapInPandas(begin, state_schema), "search-0")
    end_schema = _fields(blocks, [*groups, "block"], steps=T.LongType(), end=VECTOR, theta=VECTOR)
    carry_schema = _fields(blocks, [*groups, "block"], carry=VECTOR)
    sum_schema = _fields(blocks, groups, window=T.LongType(), sums=VECTOR)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                previous, theta = np.asarray(row["previous"], float), np.asarray(row["theta"]).reshape(-1, 3)
                out.append([*[row[g] for g in groups], row["block"], block_steps(previous), block_end(previous, theta).ravel(), row["theta"]])
            yield pd.DataFrame(out, columns=end_schema.names)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        theta = np.asarray(pdf["theta"].iloc[0]).reshape(-1, 3)
        now, carried = entering(theta), []
        for end, steps in zip(pdf["end"], pdf["steps"]):
            carried.append(now.ravel())
            now = np.asarray(end).reshape(4, -1) + passed(now, theta, int(steps))
        return pdf.assign(carry=carried)[carry_schema.names]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                theta = np.asarray(row["theta"]).reshape(-1, 3)
                starts, windows, n = _parts(row["rn"], np.asarray(row["cuts"]))
                if n:
                    squares, previous = (np.asarray(row[c], float)[:n] for c in ("squares", "previous"))
                    sums = block_sums(squares, previous, theta, np.asarray(row["carry"]).reshape(4, -1), starts)
                    out += [[*[row[g] for g in groups], int(w), x.ravel()] for w, x in zip(windows, sums)]
            yield pd.DataFrame(out, columns=sum_schema.names)

    def turn(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        row = before.iloc[0]
        theta, counts = np.asarray(row["theta"]).reshape(-1, 3), np.asarray(row["counts"])
        search = Search(np.asarray(row["best"], float).reshape(-1, 3 + TERMS).copy(), np.asarray(row["stalled"]).copy())
        shape = (TERMS, len(theta))
        sums = _up_to([(w, np.asarray(x).reshape(shape)) for w, x in zip(rows["window"], rows["sums"])], len(counts), shape)
        sums[counts < MIN_ROWS] = np.nan
        if len(theta):
            search.take(theta, sums)
        values = [*key, row["cuts"], row["refits"], row["counts"], search.theta.ravel(), search.best.ravel(), search.stalled]
        return pd.DataFrame({c: [v] for c, v in zip(state_schema.names, values)})

    # Of known size: what a block needs of its series' search; a plain join beyond the limit.
    windows, series = state.agg(F.sum(F.size("cuts")), F.count(F.lit(1))).first()
    small = 8 * ((windows or 0) + 200 * series) <= BROADCAST_BYTES
    for k in range(1, rounds + 1):
        open_ = state.where(F.size("theta") > 0)
        if open_.isEmpty():
            break
        asked = open_.select(*groups, "cuts", "theta")
        work = blocks.join(F.broadcast(asked) if small else asked, groups)
        carried = work.mapInPandas(answer, end_schema).groupBy(*groups).applyInPandas(carry, carry_schema)
        scored = work.join(carried, [*groups, "block"]).mapInPandas(score, sum_schema)
        after = scored.groupBy(*groups).cogroup(_apart(open_).groupBy(*groups)).applyInPandas(turn, state_schema)
        state = materialise(after.unionByName(state.where(F.size("theta") == 0)), f"search-{k}")
    schema = _fields(blocks, groups, refit=T.LongType(), n=T.LongType(), **dict.fromkeys(FITTED, T.DoubleType()))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                best = np.asarray(row["best"], float).reshape(-1, 3 + TERMS)
                out += _results(tuple(row[g] for g in groups), row["refits"], row["counts"], best)
            yield pd.DataFrame(out, columns=schema.names)

    return state.mapInPandas(finish, schema)


def fit_packed(blocks: DataFrame, cuts: DataFrame, groups: Sequence[str], local_rows: int = LOCAL_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``(groups, refit, n, omega, alpha, beta, loglik)`` per row of ``cuts(groups, refit, cut)``; NULL parameters under 30 rows."""
    groups = list(groups)
    sizes = materialise(blocks.groupBy(*groups).agg(F.sum("n").alias("_rows")), "series-sizes")
    longest = sizes.agg(F.max("_rows")).first()[0] or 0
    if longest <= local_rows:
        return _fit_local(blocks, cuts, groups, rounds)
    short, long = sizes.where(F.col("_rows") <= local_rows).select(*groups), sizes.where(F.col("_rows") > local_rows).select(*groups)
    local = _fit_local(blocks.join(short, groups, "left_semi"), cuts.join(short, groups, "left_semi"), groups, rounds)
    return local.unionByName(_fit_distributed(blocks.join(long, groups, "left_semi"), cuts.join(long, groups, "left_semi"), groups, rounds))


def scores_at_cuts(df: DataFrame, s: Series, candidates: DataFrame, cuts: DataFrame, returns: str = "log_return") -> DataFrame:
    """Log-likelihood and its gradient for given parameters on given expanding windows, in one pass over the rows of each series.

    ``candidates(keys, candidate, omega, alpha, beta)`` within the bounds of a fit, ``cuts(keys, refit, cut)``: a window is the rows with
    index below its cut. Gives ``keys, refit, candidate, n, loglik, d_omega, d_alpha, d_beta`` for windows with rows.
    """
    keys = list(s.keys)
    rows = train_test_split(df.select(*keys, s.time, returns), s)
    blocks = pack(rows, s, order="rn", returns=returns)
    theta = F.array_sort(F.collect_list(F.struct("candidate", "omega", "alpha", "beta"))).alias("theta")
    asked = candidates.groupBy(*keys).agg(theta).join(cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cut", "refit"))).alias("ends")), keys)
    names = ("loglik", "d_omega", "d_alpha", "d_beta")
    schema = T.StructType([
        *[df.schema[k] for k in keys], T.StructField("refit", T.LongType()), T.StructField("candidate", candidates.schema["candidate"].dataType),
        T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names],
    ])

    def run(key: tuple, pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(given):
            theta = np.array([[x["omega"], x["alpha"], x["beta"]] for x in given["theta"].iloc[0]])
            ends = given["ends"].iloc[0]
            at = np.array([x["cut"] for x in ends])
            state, parts, sizes = entering(theta), [], []
            for squares, previous, rn in pdf.sort_values("block")[["squares", "previous", "rn"]].itertuples(index=False):
                squares, previous = np.asarray(squares, float), np.asarray(previous, float)
                starts, windows, n = _parts(rn, at)
                if n:
                    parts += zip(windows, block_sums(squares[:n], previous[:n], theta, state, starts))
                    sizes += zip(windows, np.diff([*starts, n]))
                state = block_end(previous, theta) + passed(state, theta, block_steps(previous))
            sums, counts = _up_to(parts, len(at), (TERMS, len(theta))), _up_to(sizes, len(at), ())
            for window, end in enumerate(ends):
                for c, x in enumerate(given["theta"].iloc[0]):
                    value = -0.5 * sums[window, :4, c]
                    out.append([*key, end["refit"], x["candidate"], int(counts[window]), value[0] - 0.5 * counts[window] * np.log(2 * np.pi), *value[1:]])
        return pd.DataFrame([x for x in out if x[len(key) + 2]], columns=schema.names)

    return blocks.groupBy(*keys).cogroup(_apart(asked).groupBy(*keys)).applyInPandas(run, schema)


def _with_fallback(params: DataFrame, sigma2: Column) -> DataFrame:
    share, alpha, beta = FALLBACK
    return params.withColumns(
        {"omega": F.coalesce("omega", sigma2 * share), "alpha": F.coalesce("alpha", F.lit(alpha)),
         "beta": F.coalesce("beta", F.lit(beta))}
    )


def garch_fit(df: DataFrame, s: Series, returns: str = "log_return", local_rows: int = LOCAL_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One fit per series; under 30 rows the moment-based parameters."""
    packed = materialise(pack(df, s, returns=returns), "packed")
    whole = packed.select(*s.keys, F.lit(0).cast("long").alias("refit"), F.lit(1).cast("long").alias("cut")).distinct()
    fitted = fit_packed(packed, whole, s.keys, local_rows, rounds).drop("refit")
    clean = df.withColumn("_r", finite_or_zero(F.col(returns)))
    spread = clean.groupBy(*s.keys).agg(F.when(F.count("_r") > 1, F.var_pop("_r")).otherwise(1e-6).alias("_s2"))
    return _with_fallback(fitted.join(spread, list(s.keys)), F.col("_s2")).drop("_s2")


def refit_cuts(df: DataFrame, s: Series, refit_every: int, train_frac: float = 0.8) -> DataFrame:
    """``(keys, refit, cut)``: the training fit (refit 0) and every refit that can still be used."""
    ends = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_end", F.floor(F.col("_n") * F.lit(train_frac)))
    last = F.floor((F.col("_n") - 1 - F.col("_end")) / F.lit(refit_every))
    refits = ends.withColumn("refit", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long")))))
    return refits.select(*s.keys, "refit", (F.col("_end") + F.col("refit") * refit_every).alias("cut"))


def baseline_fits(df: DataFrame, s: Series, refit_every: int = 168, train_frac: float = 0.8) -> DataFrame:
    """Parameters of every refit of the plain model on its expanding window, all fitted in one job."""
    rows = train_test_split(df.select(*s.keys, s.time, "log_return"), s, train_frac)
    packed = materialise(pack(rows, s, order="rn"), "packed")
    fitted = fit_packed(packed, refit_cuts(df, s, refit_every, train_frac), s.keys)
    clean = rows.where(F.col("part") == "train").groupBy(*s.keys).agg(
        F.var_pop(finite_or_zero(F.col("log_return"))).alias("_s2")
    )
    return _with_fallback(fitted.join(clean, list(s.keys)), F.col("_s2")).drop("_s2")


def regime_fits(df: DataFrame, s: Series, refit_every: int = 168, train_frac: float = 0.8, n_regimes: int = 3) -> DataFrame:
    """Parameters of every refit of every regime on the regime's own compacted returns.

    With under 30 training rows a regime takes the moment-based parameters of the whole training set; a
    refit with under 30 rows keeps what is in force.
    """
    rows = train_test_split(df.select(*s.keys, s.time, "log_return", "regime"), s, train_frac)
    cuts = refit_cuts(df, s, refit_every, train_frac)
    within = s.by("regime")
    packed = materialise(pack(rows, within, order="rn"), "packed")
    of_regimes = cuts.join(packed.select(*within.keys).distinct(), list(s.keys)).select(*within.keys, "refit", "cut")
    fitted = fit_packed(packed, of_regimes, within.keys)
    spread = rows.where(F.col("part") == "train").groupBy(*s.keys).agg(
        F.var_pop(finite_or_zero(F.col("log_return"))).alias("_s2")
    )
    regimes = F.explode(F.sequence(F.lit(0), F.lit(n_regimes - 1)).cast("array<int>")).alias("regime")
    plan = cuts.select(*s.keys, "refit", regimes).join(spread, list(s.keys))
    full = plan.join(fitted.withColumn("regime", F.col("regime").cast("int")), [*within.keys, "refit"], "left")
    share, alpha, beta = FALLBACK
    first = F.col("refit") == 0
    full = full.withColumns(
        {"omega": F.when(first, F.coalesce("omega", F.col("_s2") * share)).otherwise(F.col("omega")),
         "alpha": F.when(first, F.coalesce("alpha", F.lit(alpha))).otherwise(F.col("alpha")),
         "beta": F.when(first, F.coalesce("beta", F.lit(beta))).otherwise(F.col("beta"))}
    )
    return in_force(full, within.keys)
