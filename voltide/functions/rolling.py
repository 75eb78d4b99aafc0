"""Rolling moments at a bounded number of steps per row, without differences of sums.

A window function over the last n rows is evaluated from scratch for every row, so 240-row features would cost 240 steps each, and running
sums would let one huge value spoil every later window. Here only windows of up to ``DIRECT`` rows are evaluated that way, all of them by
one window operator. A longer window is merged from shorter ones that lie end to end, such as 168 rows from seven times 24 and 720 from
four times 168 and twice 24: count, mean and central moments of the parts give those of the whole. The parts are lags of what the rows
before have, so a level of such windows is one more window operator, and nothing outside a window ever enters it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.plans.series import Frames

#: Rows of a window that is evaluated from scratch; parts that a longer one is merged from at most, beyond those of its own multiples.
DIRECT, PARTS = 32, 12


def parts_of(rows: int, sizes: list[int]) -> list[int]:
    """Sizes that ``rows`` is the sum of, the largest first: of ``sizes`` if they give few parts, else powers of ``DIRECT``, and a rest."""
    for known in (sizes, [DIRECT**k for k in range(1, 8)]):
        left, out = rows, []
        for size in sorted((x for x in known if x < rows), reverse=True):
            out += [size] * (left // size)
            left %= size
        out += [left] if left else []
        if left <= DIRECT and (len(out) <= PARTS or known is not sizes):
            return out
    raise ValueError(f"no parts for {rows} rows")


class Rolling:
    """Tracked values of one chunk layout: ``track``, then the window columns, then ``prepare``, then use the columns.

    The formulas are SQL text: a matrix has hundreds of terms, and as text each column is one call to the JVM.
    """

    def __init__(self, frames: Frames):
        self.f = frames
        self.values: dict[str, Column] = {}
        self.fields: dict[str, str] = {}
        self.asked: dict[tuple[str, int], None] = {}
        self.made: set[str] = set()

    def track(self, name: str, value: Column, powers: int = 1) -> Rolling:
        """Track ``value`` for means (powers 1), deviations (2) or skewness (3)."""
        self.values[name] = value
        self.fields[name] = {1: "ns", 2: "nmq", 3: "nmqt"}[powers]
        return self

    def _add(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        self.made |= set(columns)
        return df.withColumns({name: F.expr(sql) for name, sql in columns.items()}) if columns else df

    def _plan(self) -> tuple[set[tuple[str, int]], list[dict[tuple[str, int], list[int]]]]:
        """Windows evaluated from scratch, and those merged from others, level by level."""
        direct, parts, todo = set(), {}, sorted(self.asked, key=lambda x: x[1])
        known: dict[str, list[int]] = {}
        while todo:
            name, rows = todo.pop(0)
            if (name, rows) in direct or (name, rows) in parts:
                continue
            if rows <= DIRECT:
                direct.add((name, rows))
            else:
                parts[name, rows] = parts_of(rows, known.get(name, []))
                todo = [(name, size) for size in sorted(set(parts[name, rows]))] + todo
            known.setdefault(name, []).append(rows)
        levels: list[dict[tuple[str, int], list[int]]] = []
        done = set(direct)
        while left := {key: sizes for key, sizes in parts.items() if key not in done}:
            levels.append({key: sizes for key, sizes in left.items() if all((key[0], size) in done for size in sizes)})
            done |= set(levels[-1])
        return direct, levels

    def prepare(self, df: DataFrame) -> DataFrame:
        self.made |= {f"_x_{n}" for n in self.values}
        df = df.withColumns({f"_x_{n}": v.cast("double") for n, v in self.values.items()})
        direct, levels = self._plan()
        raw, states = {}, {}
        for name, rows in sorted(direct):
            over = f"OVER ({self.f.sql} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
            window, x = self._window(name, rows), f"_x_{name}"
            n, q = f"_n{rows}_{name}", f"_q{rows}_{name}"
            raw[n], states[window["n"]] = f"count({x}) {over}", f"CAST({n} AS DOUBLE)"
            for field, call in (("s", "sum"), ("m", "avg")):
                if field in window:
                    raw[f"_{field}{rows}_{name}"] = f"{call}({x}) {over}"
                    states[window[field]] = f"coalesce(_{field}{rows}_{name}, 0.0D)"
            if "q" in window:
                raw[q], states[window["q"]] = f"var_pop({x}) {over}", f"coalesce({q} * {n}, 0.0D)"
            if "t" in window:
                raw[f"_t{rows}_{name}"] = f"skewness({x}) {over}"
                states[window["t"]] = f"coalesce(nanvl(_t{rows}_{name}, 0.0D) * power({q}, 1.5D) * {n}, 0.0D)"
        df = self._add(self._add(df, raw), states)
        for level in levels:
            df = self._merged(df, level)
        return df

    def _merged(self, df: DataFrame, level: dict[tuple[str, int], list[int]]) -> DataFrame:
        """Adds windows whose parts are there already."""
        lags, first, second = {}, {}, {}
        for (name, rows), sizes in level.items():
            whole, parts, at = self._window(name, rows), [], 0
            for size in sizes:
                part = self._window(name, size)
                if at:
                    names = {f: f"_lag_{f}{size}_{at}_{name}" for f in part}
                    lags |= {names[f]: f"coalesce(lag({c}, {at}) OVER ({self.f.sql}), 0.0D)" for f, c in part.items()}
                    part = names
                parts.append(part)
                at += size
            first[whole["n"]] = " + ".join(x["n"] for x in parts)
            if "s" in whole:
                first[whole["s"]] = " + ".join(x["s"] for x in parts)
            if "m" in whole:
                one, more = parts[0]["m"], " + ".join(f"{x['n']} * ({x['m']} - {parts[0]['m']})" for x in parts[1:])
                first[whole["m"]] = f"{one} + coalesce(try_divide({more}, {first[whole['n']]}), 0.0D)"
            if "q" in whole:
                second[whole["q"]] = " + ".join(f"{x['q']} + {x['n']} * power({x['m']} - {whole['m']}, 2)" for x in parts)
            if "t" in whole:
                second[whole["t"]] = " + ".join(
                    f"{x['t']} + ({x['m']} - {whole['m']}) * (3 * {x['q']} + {x['n']} * power({x['m']} - {whole['m']}, 2))" for x in parts
                )
        return self._add(self._add(self._add(df, lags), first), second)

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.made)

    def _window(self, name: str, rows: int) -> dict[str, str]:
        self.asked[name, rows] = None
        return {f: f"_window_{f}{rows}_{name}" for f in self.fields[name]}

    def mean(self, name: str, rows: int) -> Column:
        w = self._window(name, rows)
        return F.expr(f"CASE WHEN {w['n']} > 0 THEN {w['m'] if 'm' in w else w['s'] + ' / ' + w['n']} END")

    def sum(self, name: str, rows: int) -> Column:
        w = self._window(name, rows)
        return F.expr(f"CASE WHEN {w['n']} > 0 THEN {w['s'] if 's' in w else w['m'] + ' * ' + w['n']} END")

    def deviation(self, name: str, rows: int) -> Column:
        """Sample standard deviation, NULL for a single value."""
        w = self._window(name, rows)
        return F.expr(f"CASE WHEN {w['n']} > 1 THEN sqrt({w['q']} / ({w['n']} - 1)) END")

    def skewness(self, name: str, rows: int) -> Column:
        """Population skewness, NULL without variation."""
        w = self._window(name, rows)
        return F.expr(f"CASE WHEN {w['n']} > 1 AND {w['q']} > 0 THEN try_divide({w['t']} / {w['n']}, power({w['q']} / {w['n']}, 1.5D)) END")
