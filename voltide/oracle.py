"""The registered queries as DuckDB SQL.

Short names inside: t timestamp, o/h/l/c prices, v volume, q quote volume, n trades, r log return.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def dbl(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 2.3e-{digits + 2}, {digits}) + 0.0 AS {name or expr}"


def ts(name: str = "timestamp", expr: str = "t") -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def dbls(*names: str) -> str:
    return ", ".join(dbl(n) for n in names)


SERIES = "PARTITION BY symbol ORDER BY t"


def roll(n: int) -> str:
    return f"OVER ({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(expr: str, n: int = 1) -> str:
    return f"lag({expr}, {n}) OVER ({SERIES})"


def skew(x: str, over: str = "", k: str = "count") -> str:
    """Population skewness from moments."""
    m1, m2, m3 = f"avg({x}) {over}", f"avg({x}*{x}) {over}", f"avg({x}*{x}*{x}) {over}"
    var = f"({m2} - ({m1})*({m1}))"
    third = f"({m3} - 3*({m1})*({m2}) + 2*({m1})*({m1})*({m1}))"
    return f"CASE WHEN {k}({x}) {over} > 1 AND {var} > 1e-13 THEN {third} / pow({var}, 1.5) END"


TICKS = """ticks AS (SELECT event_type AS symbol, ts AS tt, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, event_id AS id FROM events WHERE value > 0)"""

LI_TICKS = """ticks AS (SELECT l_returnflag AS symbol, l_shipdate AS tt, l_extendedprice / l_quantity AS price,
  l_quantity AS size, l_orderkey * 8 + l_linenumber AS id FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)"""


def raw_bars(bucket: str, name: str = "bars0") -> str:
    return f"""{name} AS (SELECT symbol, {bucket} AS t, first(price ORDER BY tt, id, price) AS o, max(price) AS h,
  min(price) AS l, last(price ORDER BY tt, id, price) AS c, sum(size) AS v, sum(price * size) AS q, count(*) AS n
  FROM ticks GROUP BY ALL)"""


RETURNS = f"bars AS (SELECT *, ln(c / {lag('c')}) AS r FROM bars0)"
HOUR_START, QUARTER_START, DAY_START = "date_trunc('hour', tt)", "time_bucket(INTERVAL '15 minutes', tt)", "date_trunc('day', tt)"
HOUR = f"{TICKS}, {raw_bars(HOUR_START)}, {RETURNS}"
QUARTER = f"{TICKS}, {raw_bars(QUARTER_START)}, {RETURNS}"
DAY = f"{LI_TICKS}, {raw_bars(DAY_START)}, {RETURNS}"

BASE = f"""base AS (SELECT *, c - {lag('c')} AS dc,
  greatest(h - l, coalesce(abs(h - {lag('c')}), h - l), coalesce(abs(l - {lag('c')}), h - l)) AS tr FROM bars)"""


def rsi(n: int = 14) -> str:
    gain = f"avg(CASE WHEN dc > 0 THEN dc ELSE 0 END) {roll(n)}"
    loss = f"avg(CASE WHEN dc < 0 THEN -dc ELSE 0 END) {roll(n)}"
    return f"100 - 100 / (1 + CASE WHEN {loss} > 0 THEN {gain} / {loss} ELSE 100 END)"


def guarded(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 1.0 END"


HOURLY = f"""wide AS (SELECT *, stddev_samp(r) {roll(24)} AS vol_24h, stddev_samp(r) {roll(168)} AS vol_168h,
  stddev_samp(r) {roll(720)} AS vol_720h, sum(r) {roll(24)} AS cum_return_24h, sum(r) {roll(168)} AS cum_return_168h,
  sum(r) {roll(720)} AS cum_return_720h, {skew('r', roll(24))} AS return_skew_24h,
  {skew('r', roll(168))} AS return_skew_168h, avg(v) {roll(24)} AS vol_avg_24h, avg(v) {roll(168)} AS vol_avg_168h,
  {rsi()} AS rsi, avg(tr) {roll(14)} AS atr, avg((h - l) / c) {roll(24)} AS hl_range_24h,
  avg(c) {roll(20)} AS bb_m, stddev_samp(c) {roll(20)} AS bb_s FROM base),
full_feats AS (SELECT * EXCLUDE (bb_m, bb_s, dc, tr), {guarded('vol_24h', 'vol_168h')} AS vol_ratio_24_168,
  {guarded('vol_168h', 'vol_720h')} AS vol_ratio_168_720, {guarded('v', 'vol_avg_24h')} AS volume_spike,
  atr / c * 100 AS atr_pct, 2 * bb_s / NULLIF(bb_m, 0) AS bb_width, vol_24h AS vol_60m, vol_168h AS vol_240m,
  {guarded('vol_24h', 'vol_168h')} AS vol_ratio_60_240, cum_return_24h AS cum_return_60m,
  return_skew_24h AS return_skew_60m FROM wide),
feats AS (SELECT * FROM full_feats WHERE r IS NOT NULL AND vol_24h IS NOT NULL AND vol_168h IS NOT NULL
  AND vol_720h IS NOT NULL AND return_skew_24h IS NOT NULL AND return_skew_168h IS NOT NULL AND bb_width IS NOT NULL)"""
FEATURES = f"{HOUR}, {BASE}, {HOURLY}"

NAMED = "CASE regime WHEN 0 THEN 'low_vol' WHEN 1 THEN 'medium_vol' WHEN 2 THEN 'high_vol' END AS regime_name"
THRESHOLD = """cuts AS (SELECT symbol, quantile_disc(vol_60m, 0.33) AS q33, quantile_disc(vol_60m, 0.67) AS q67
  FROM feats GROUP BY symbol),
threshold AS (SELECT f.*, CASE WHEN vol_60m <= q33 THEN 0 WHEN vol_60m <= q67 THEN 1 ELSE 2 END AS regime
  FROM feats f JOIN cuts USING (symbol))"""
LABELS = f"{FEATURES}, {THRESHOLD}"
LAB = f"WITH {LABELS}, labels_ AS (SELECT * FROM threshold)"

MULTI = """xcuts AS (SELECT symbol, quantile_cont(vol_60m, 0.33) AS a33, quantile_cont(vol_60m, 0.67) AS a67,
  quantile_cont(volume_spike, 0.33) AS b33, quantile_cont(volume_spike, 0.67) AS b67 FROM feats GROUP BY symbol),
scored AS (SELECT f.*, CASE WHEN vol_60m <= a33 THEN 0.0 WHEN vol_60m <= a67 THEN 1.0 ELSE 2.0 END
  + CASE WHEN volume_spike <= b33 THEN 0.0 WHEN volume_spike <= b67 THEN 0.5 ELSE 1.0 END
  + CASE WHEN abs(cum_return_60m) > 0.02 THEN 0.5 ELSE 0.0 END AS score FROM feats f JOIN xcuts USING (symbol)),
multi AS (SELECT *, CASE WHEN score < 1.0 THEN 0 WHEN score < 2.5 THEN 1 ELSE 2 END AS regime FROM scored)"""
BAND = f"""banded AS (SELECT *, avg(vol_60m) {roll(240)} AS vol_ma, stddev_samp(vol_60m) {roll(240)} AS vol_std FROM feats),
breakout AS (SELECT *, CASE WHEN vol_60m < vol_ma - vol_std THEN 0 WHEN vol_60m > vol_ma + vol_std THEN 2 ELSE 1 END
  AS regime FROM banded)"""
STACKED = f"""{LABELS}, {MULTI}, {BAND}, stacked AS (
  SELECT symbol, 'threshold' AS method, t, r, vol_60m, vol_240m, cum_return_60m, volume_spike, regime FROM threshold
  UNION ALL SELECT symbol, 'multi_indicator', t, r, vol_60m, vol_240m, cum_return_60m, volume_spike, regime FROM multi
  UNION ALL SELECT symbol, 'breakout', t, r, vol_60m, vol_240m, cum_return_60m, volume_spike, regime FROM breakout)"""



def bar_out(digits: int = 6) -> str:
    prices = {"o": "price_open", "h": "price_high", "l": "price_low", "c": "price_close", "v": "volume_base", "q": "volume_quote"}
    return f"symbol, {ts()}, {', '.join(dbl(x, name, digits) for x, name in prices.items())}, {big('n', 'num_trades')}"


BAR_OUT = bar_out()
CAL = (f"{big('year(t)', 'year')}, {big('month(t)', 'month')}, {big('day(t)', 'day')}, {big('hour(t)', 'hour')}")
KLINE = (
    f"symbol, {big('epoch_ms(t)', 'open_time')}, {dbl('o', 'open')}, {dbl('h', 'high')}, {dbl('l', 'low')}, "
    f"{dbl('c', 'close')}, {dbl('v', 'volume')}, {big('epoch_ms(t) + 3599999', 'close_time')}, "
    f"{dbl('q', 'quote_volume')}, {big('n', 'trades')}"
)

# sources, cleaning -----------------------------------------------------------------------------
ORACLE["scan_kline_csv"] = (
    f"WITH {HOUR} SELECT {KLINE}, 0.0::DOUBLE AS taker_buy_base, 0.0::DOUBLE AS taker_buy_quote, '0' AS ignore FROM bars"
)
ORACLE["decode_kline_json"] = f"WITH {HOUR} SELECT {KLINE} FROM bars"
ORACLE["scan_parquet_bars"] = (
    f"WITH {HOUR} SELECT symbol, {ts('first_bar', 'min(t)')}, {ts('last_bar', 'max(t)')}, count(*) AS n FROM bars "
    "WHERE t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-20' GROUP BY symbol"
)
ORACLE["write_partitioned"] = f"WITH {HOUR} SELECT {BAR_OUT}, {dbl('r', 'log_return')}, {CAL} FROM bars"
ORACLE["append_bars"] = (
    f"WITH {HOUR} SELECT symbol, {big('year(t)', 'year')}, {big('month(t)', 'month')}, count(*) AS n FROM bars GROUP BY ALL"
)
ORACLE["consolidate"] = (
    f"WITH {HOUR} SELECT symbol, {ts()}, {dbl('c', 'price_close')}, {dbl('r', 'log_return')}, "
    f"{big('year(t)', 'year')}, {big('month(t)', 'month')} FROM bars"
)
ORACLE["write_report_csv"] = ORACLE["regime_distribution"] = (
    f"WITH {LABELS}, g AS (SELECT symbol, regime, count(*) AS n FROM threshold GROUP BY ALL) SELECT symbol, "
    f"{big('regime', 'regime')}, n, {dbl('100.0 * n / sum(n) OVER (PARTITION BY symbol)', 'pct')} FROM g"
)
ORACLE["epoch_to_timestamp"] = (
    "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 "
    "WHEN 1 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) END AS BIGINT) AS micros FROM events"
)
CANDLES = """candles AS (SELECT l_returnflag AS symbol, epoch_ms(l_shipdate) AS open_time, p AS open,
  p * (1 + l_discount) AS high, p * (1 - l_tax) AS low, p * (1 + l_discount - 2 * l_tax) AS close,
  l_quantity AS volume, l_orderkey, l_linenumber
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem))"""
ORACLE["valid_candles"] = f"""WITH {CANDLES}, loose AS (SELECT * FROM candles WHERE open > 0 AND close > 0 AND high >= low)
SELECT 'strict' AS mode, symbol, count(*) AS n, {dbl('sum(volume)', 'volume')} FROM loose
  WHERE high >= close AND low <= close GROUP BY symbol
UNION ALL SELECT 'loose', symbol, count(*), round(sum(volume), 6) + 0.0 FROM loose GROUP BY symbol"""
ORACLE["dedup_bars"] = f"""WITH {CANDLES}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, open_time
  ORDER BY l_orderkey DESC, l_linenumber DESC, open DESC, close DESC, volume DESC) AS rn FROM candles)
SELECT symbol, open_time, {dbls('open', 'close', 'volume')}, l_orderkey, {big('l_linenumber', 'l_linenumber')}
FROM k WHERE rn = 1"""
ORACLE["calendar_columns"] = f"WITH {HOUR} SELECT symbol, {ts()}, {CAL} FROM bars"
ORACLE["canonical_bars"] = f"WITH {HOUR} SELECT {BAR_OUT}, CAST(NULL AS DOUBLE) AS log_return, {CAL} FROM bars"
SELECTED = ("vol_60m", "vol_240m", "vol_ratio_60_240", "cum_return_60m", "return_skew_60m", "volume_spike", "rsi",
            "bb_width", "atr_pct")
ORACLE["regime_feature_select"] = (
    f"WITH {FEATURES} SELECT symbol, {ts()}, {dbl('c', 'price_close')}, {dbl('r', 'log_return')}, {dbls(*SELECTED)} "
    "FROM full_feats WHERE r IS NOT NULL AND vol_60m IS NOT NULL AND vol_240m IS NOT NULL "
    "AND return_skew_60m IS NOT NULL AND bb_width IS NOT NULL"
)
ORACLE["drop_incomplete"] = f"WITH {HOUR} SELECT symbol, {ts()}, {dbl('r', 'log_return')} FROM bars WHERE r IS NOT NULL"
ORACLE["hourly_aliases"] = (
    f"WITH {FEATURES} SELECT symbol, {ts()}, {dbls('vol_60m', 'vol_240m', 'vol_ratio_60_240', 'cum_return_60m', 'return_skew_60m')} FROM feats"
)


def zscore(x: str, part: str = "symbol") -> str:
    return (f"({x} - avg({x}) OVER (PARTITION BY {part})) / "
            f"coalesce(NULLIF(stddev_pop({x}) OVER (PARTITION BY {part}), 0), 1)")


ORACLE["null_to_zero_matrix"] = (
    f"WITH {HOUR}, z AS (SELECT symbol, t, coalesce(r, 0) AS r, v, c FROM bars) SELECT symbol, {ts()}, "
    f"{dbl(zscore('r'), 'z_log_return')}, {dbl(zscore('v'), 'z_volume_base')}, {dbl(zscore('c'), 'z_price_close')} FROM z"
)
ORACLE["fill_defaults"] = (
    f"WITH {HOUR} SELECT symbol, {ts()}, {dbl('coalesce(r, 0)', 'log_return')}, "
    f"{big('CASE WHEN r > 0 THEN 2 ELSE 0 END', 'regime')} FROM bars"
)
ORACLE["resolve_columns"] = (
    f"WITH {FEATURES} SELECT symbol, {', '.join(dbl(f'avg({c})', c) for c in ('vol_60m', 'vol_240m', 'cum_return_60m'))} "
    "FROM feats GROUP BY symbol"
)
ORACLE["attach_labels"] = (
    f"WITH {LABELS} SELECT symbol, {ts()}, {dbl('c', 'price_close')}, {big('regime', 'regime')}, {NAMED} FROM threshold"
)
ORACLE["label_rank_map"] = f"""WITH {FEATURES}, m AS (SELECT symbol, hour(t) % 3 AS cluster, avg(vol_60m) AS mv FROM feats GROUP BY ALL),
every AS (SELECT DISTINCT symbol, k.cluster FROM m, (SELECT unnest(range(4)) AS cluster) k),
filled AS (SELECT e.symbol, e.cluster, coalesce(mv, 0) AS mv FROM every e LEFT JOIN m USING (symbol, cluster))
SELECT symbol, {big('cluster', 'cluster')}, row_number() OVER (PARTITION BY symbol ORDER BY mv, cluster) - 1 AS regime,
{dbl('mv', 'mean_vol')} FROM filled"""

# aggregations ----------------------------------------------------------------------------------
ORACLE["ohlcv_bars"] = f"""WITH {QUARTER}, up AS (SELECT symbol, date_trunc('hour', t) AS hr, first(o ORDER BY t) AS o, max(h) AS h,
  min(l) AS l, last(c ORDER BY t) AS c, sum(v) AS v, sum(q) AS q, sum(n) AS n, count(*) AS k FROM bars GROUP BY ALL)
SELECT {BAR_OUT}, k AS n_bars FROM (SELECT *, hr AS t FROM up)"""
ORACLE["ohlcv_bars_lineitem"] = f"WITH {DAY} SELECT {BAR_OUT} FROM bars"
ORACLE["partition_counts"] = (
    f"WITH {DAY} SELECT symbol, {big('year(t)', 'year')}, {big('month(t)', 'month')}, count(*) AS n FROM bars GROUP BY ALL"
)
ORACLE["describe_columns"] = f"WITH {HOUR} " + " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", count({x}) AS count, {dbl(f'avg({x})', 'mean')}, {dbl(f'stddev_samp({x})', 'stddev')}, "
    f"{dbl(f'min({x})', 'min')}, {dbl(f'max({x})', 'max')} FROM bars"
    for name, x in (("price_close", "c"), ("volume_base", "v"), ("log_return", "r"))
)
ORACLE["date_range"] = (
    f"WITH {HOUR} SELECT symbol, {ts('first_bar', 'min(t)')}, {ts('last_bar', 'max(t)')}, count(*) AS n FROM bars GROUP BY symbol"
)
ORACLE["null_report"] = f"WITH {FEATURES}, counts AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", count(*) - count({x}) AS n_null, count(*) AS total FROM full_feats"
    for name, x in (("log_return", "r"), ("vol_24h", "vol_24h"), ("vol_720h", "vol_720h"),
                    ("return_skew_24h", "return_skew_24h"), ("rsi", "rsi"), ("bb_width", "bb_width"))
) + f") SELECT \"column\", n_null, {dbl('100.0 * n_null / total', 'pct_null')} FROM counts WHERE n_null > 0"
ORACLE["quality_report"] = f"""WITH {HOUR}, d AS (SELECT *, (epoch(t) - epoch({lag('t')})) / 3600 AS steps,
  abs(c / {lag('c')} - 1) * 100 AS chg FROM bars),
g AS (SELECT symbol, count(*) AS n_rows, sum(CASE WHEN steps <> 1 THEN 1 ELSE 0 END) AS n_gaps,
  sum(CASE WHEN steps > 1 THEN floor(steps) - 1 ELSE 0 END) AS missing_rows, sum(CASE WHEN c <= 1.0 THEN 1 ELSE 0 END) AS n_low_price,
  sum(CASE WHEN chg > 50 THEN 1 ELSE 0 END) AS n_big_change, sum(CASE WHEN v < 10.0 THEN 1 ELSE 0 END) AS n_low_volume
  FROM d GROUP BY symbol)
SELECT symbol, n_rows, {big('n_gaps', 'n_gaps')}, {big('missing_rows', 'missing_rows')}, {big('n_low_price', 'n_low_price')},
{big('n_big_change', 'n_big_change')}, {big('n_low_volume', 'n_low_volume')},
{dbl('100.0 * missing_rows / (missing_rows + n_rows)', 'pct_missing')}, {big('CASE WHEN n_gaps <= 10 THEN 1 ELSE 0 END', 'gaps_ok')} FROM g"""
ORACLE["vol_quantiles"] = f"WITH {LABELS} SELECT symbol, {dbls('q33', 'q67')} FROM cuts"
ORACLE["vol_quantiles_exact"] = f"WITH {FEATURES} SELECT symbol, " + ", ".join(
    dbl(f"quantile_cont({c}, {p})", f"{c}_q{int(p * 100)}") for c in ("vol_60m", "volume_spike", "rsi") for p in (0.33, 0.67)
) + " FROM feats GROUP BY symbol"
ORACLE["vol_quantiles_exact_lineitem"] = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS feature, {p}::DOUBLE AS prob, {dbl(f'quantile_cont({c}, {p})', 'quantile')} FROM lineitem GROUP BY l_returnflag"
    for c in ("l_quantity", "l_extendedprice") for p in (0.0, 0.05, 0.33, 0.5, 0.67, 0.95, 1.0)
)
ORACLE["regime_feature_summary"] = f"WITH {LABELS} SELECT symbol, {big('regime', 'regime')}, " + ", ".join(
    f"{dbl(f'avg({x})', f'{c}_mean')}, {dbl(f'stddev_samp({x})', f'{c}_std')}, {dbl(f'min({x})', f'{c}_min')}, {dbl(f'max({x})', f'{c}_max')}"
    for c, x in (("log_return", "r"), ("vol_60m", "vol_60m"), ("cum_return_60m", "cum_return_60m"),
                 ("volume_spike", "volume_spike"), ("atr_pct", "atr_pct"))
) + " FROM threshold GROUP BY symbol, regime"

AUTO = """lagged AS (SELECT *, lag(r, 1) OVER w AS r1, lag(r, 2) OVER w AS r2, lag(r, 24) OVER w AS r24 FROM threshold
  WINDOW w AS (PARTITION BY symbol, regime ORDER BY t)),
auto AS (SELECT symbol, regime, CASE WHEN count(*) > 2 THEN corr(r, r1) END AS autocorr_lag1,
  CASE WHEN count(*) > 3 THEN corr(r, r2) END AS autocorr_lag2, CASE WHEN count(*) > 25 THEN corr(r, r24) END AS autocorr_lag24
  FROM lagged GROUP BY ALL)"""
ORACLE["return_autocorrelation"] = (
    f"WITH {LABELS}, {AUTO} SELECT symbol, {big('regime', 'regime')}, {dbls('autocorr_lag1', 'autocorr_lag2', 'autocorr_lag24')} FROM auto"
)
STATS = f"""{AUTO}, st AS (SELECT symbol, regime, count(*) AS n_bars, avg(r) AS return_mean, stddev_samp(r) AS return_std,
  {skew('r')} AS return_skew, kurtosis_pop(r) AS return_kurtosis, 100.0 * avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS pct_positive,
  avg(vol_60m) AS vol_mean, stddev_samp(vol_60m) AS vol_std, quantile_cont(vol_60m, 0.25) AS vol_p25,
  quantile_cont(vol_60m, 0.5) AS vol_median, quantile_cont(vol_60m, 0.75) AS vol_p75, quantile_cont(vol_60m, 0.95) AS vol_p95,
  avg(rsi) AS rsi_mean, stddev_samp(rsi) AS rsi_std, avg(atr_pct) AS atr_mean, avg(bb_width) AS bb_width_mean,
  avg(volume_spike) AS vol_spike_mean FROM threshold GROUP BY ALL),
stats AS (SELECT st.*, 100.0 * n_bars / sum(n_bars) OVER (PARTITION BY symbol) AS pct_of_total, return_mean / return_std AS sharpe_hourly,
  vol_std / vol_mean AS vol_of_vol, autocorr_lag1, autocorr_lag2, autocorr_lag24 FROM st JOIN auto USING (symbol, regime))"""
STAT_NAMES = ("return_mean", "return_std", "return_skew", "return_kurtosis", "pct_positive", "vol_mean", "vol_std", "vol_p25",
              "vol_median", "vol_p75", "vol_p95", "rsi_mean", "rsi_std", "atr_mean", "bb_width_mean", "vol_spike_mean",
              "pct_of_total", "sharpe_hourly", "vol_of_vol", "autocorr_lag1", "autocorr_lag2", "autocorr_lag24")
SHOWN = "CASE regime WHEN 0 THEN 'Low Vol' WHEN 1 THEN 'Medium Vol' ELSE 'High Vol' END AS regime_name"
ORACLE["regime_stats"] = (
    f"WITH {LABELS}, {STATS} SELECT symbol, {big('regime', 'regime')}, {SHOWN}, n_bars, {dbls(*STAT_NAMES)} FROM stats"
)
MATRIX = """pairs AS (SELECT symbol, regime AS a, lead(regime) OVER (PARTITION BY symbol ORDER BY t) AS b FROM threshold),
pc AS (SELECT symbol, a, b, count(*) AS n FROM pairs WHERE b IS NOT NULL GROUP BY ALL),
cells AS (SELECT s.symbol, x.a, y.b, coalesce(n, 0) AS n FROM (SELECT DISTINCT symbol FROM threshold) s,
  (SELECT unnest(range(3)) AS a) x, (SELECT unnest(range(3)) AS b) y LEFT JOIN pc ON pc.symbol = s.symbol AND pc.a = x.a AND pc.b = y.b),
matrix AS (SELECT *, coalesce(n / NULLIF(sum(n) OVER (PARTITION BY symbol, a), 0), 0) AS probability FROM cells)"""
ORACLE["key_findings"] = f"""WITH {LABELS}, {STATS}, {MATRIX},
vf AS (SELECT symbol, first(regime ORDER BY vol_mean DESC, regime) AS most_volatile,
  first(regime ORDER BY pct_of_total DESC, regime) AS most_common FROM stats GROUP BY symbol),
lf AS (SELECT symbol, first(a ORDER BY probability DESC, a) AS most_persistent, max(probability) AS p_stay FROM matrix WHERE a = b GROUP BY symbol)
SELECT symbol, {big('most_volatile', 'most_volatile')}, {big('most_common', 'most_common')},
{big('most_persistent', 'most_persistent')}, {dbl('p_stay')} FROM vf JOIN lf USING (symbol)"""

# window features -------------------------------------------------------------------------------
FEATURE_COLUMNS: dict[str, dict[str, str]] = {
    "realized_volatility": {f"vol_{n}m": f"stddev_samp(r) {roll(n)}" for n in (30, 60, 240)},
    "high_low_range": {f"hl_range_{n}m": f"avg((h - l) / c) {roll(n)}" for n in (60, 240)},
    "cumulative_return": {f"cum_return_{n}m": f"sum(r) {roll(n)}" for n in (30, 60, 240)},
    "bullish_ratio": {f"bullish_ratio_{n}m": f"avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) {roll(n)}" for n in (30, 60, 240)},
    "return_skewness": {f"return_skew_{n}m": skew("r", roll(n)) for n in (30, 60, 240)},
    "price_momentum": {f"momentum_{n}m": f"coalesce(c / {lag('c', n)} - 1, 0)" for n in (10, 30, 60)},
    "volume_average": {f"vol_avg_{n}m": f"avg(v) {roll(n)}" for n in (30, 60, 240)},
    "volume_spike": {"vol_avg_60m": f"avg(v) {roll(60)}", "volume_spike": guarded("v", f"avg(v) {roll(60)}")},
    "vwap": {f"vwap_{n}m": f"sum(c * v) {roll(n)} / NULLIF(sum(v) {roll(n)}, 0)" for n in (60, 240)}
    | {f"price_vs_vwap_{n}m": f"c / NULLIF(sum(c * v) {roll(n)} / NULLIF(sum(v) {roll(n)}, 0), 0)" for n in (60, 240)},
    "volume_momentum": {
        f"volume_momentum_{n}m": f"CASE WHEN {lag('v', n)} > 0 THEN (v - {lag('v', n)}) / {lag('v', n)} ELSE 0 END" for n in (60, 240)
    },
    "volume_volatility": {f"volume_vol_{n}m": f"stddev_samp(v) {roll(n)}" for n in (60, 240)},
    "rsi": {"rsi": rsi()},
    "moving_average": {f"ma_{n}": f"avg(c) {roll(n)}" for n in (20, 50)}
    | {f"price_vs_ma_{n}": f"c / NULLIF(avg(c) {roll(n)}, 0)" for n in (20, 50)},
    "bollinger": {
        "bb_width": f"4 * stddev_samp(c) {roll(20)} / NULLIF(avg(c) {roll(20)}, 0)",
        "bb_position": f"(c - (avg(c) {roll(20)} - 2 * stddev_samp(c) {roll(20)})) / NULLIF(4 * stddev_samp(c) {roll(20)}, 0)",
    },
    "atr": {"atr": f"avg(tr) {roll(14)}", "atr_pct": f"100 * avg(tr) {roll(14)} / c"},
}
for _name, _cols in FEATURE_COLUMNS.items():
    ORACLE[_name] = f"WITH {QUARTER}, {BASE} SELECT symbol, {ts()}, {', '.join(dbl(x, c) for c, x in _cols.items())} FROM base"
VOLS = f"vols AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in FEATURE_COLUMNS['realized_volatility'].items())} FROM base)"
CHANGE = {"vol_change_30m": f"vol_30m - {lag('vol_30m', 30)}"}
RATIO = {"vol_ratio_30_240": guarded("vol_30m", "vol_240m"), "vol_ratio_60_240": guarded("vol_60m", "vol_240m")}
ORACLE["volatility_change"] = (
    f"WITH {QUARTER}, {BASE}, {VOLS} SELECT symbol, {ts()}, {dbl('vol_30m')}, {dbl(CHANGE['vol_change_30m'], 'vol_change_30m')} FROM vols"
)
ORACLE["volatility_ratio"] = (
    f"WITH {QUARTER}, {BASE}, {VOLS} SELECT symbol, {ts()}, {dbls('vol_30m', 'vol_60m', 'vol_240m')}, "
    f"{', '.join(dbl(x, c) for c, x in RATIO.items())} FROM vols"
)
_all = {c: x for cols in FEATURE_COLUMNS.values() for c, x in cols.items()} | CHANGE | RATIO
for _c in ("vol_30m", "vol_60m", "vol_240m"):
    _all[_c] = _c
ORACLE["feature_matrix"] = (
    f"WITH {QUARTER}, {BASE}, {VOLS} SELECT {bar_out()}, {dbl('r', 'log_return')}, {', '.join(dbl(x, c) for c, x in _all.items())} FROM vols"
)
ORACLE["log_return"] = f"WITH {HOUR} SELECT symbol, {ts()}, {dbl('c', 'price_close')}, {dbl('r', 'log_return')} FROM bars"
ORACLE["hourly_feature_matrix"] = f"WITH {FEATURES} SELECT {BAR_OUT}, {dbl('r', 'log_return')}, {CAL}, " + dbls(
    "vol_24h", "vol_168h", "vol_720h", "cum_return_24h", "cum_return_168h", "cum_return_720h", "return_skew_24h", "return_skew_168h",
    "vol_avg_24h", "vol_avg_168h", "rsi", "atr", "hl_range_24h", "vol_ratio_24_168", "vol_ratio_168_720", "volume_spike", "atr_pct",
    "bb_width", "vol_60m", "vol_240m", "vol_ratio_60_240", "cum_return_60m", "return_skew_60m",
) + " FROM feats"
ORACLE["rolling_band"] = (
    f"WITH {FEATURES}, {BAND} SELECT symbol, {ts()}, {dbls('vol_ma', 'vol_std')}, {dbl('vol_ma - vol_std', 'vol_lower')}, "
    f"{dbl('vol_ma + vol_std', 'vol_upper')} FROM banded"
)

# spells and transitions ------------------------------------------------------------------------
FLAGS = f"flags AS (SELECT *, CASE WHEN regime <> {lag('regime')} THEN 1 ELSE 0 END AS changed FROM threshold)"
SPELLS = f"""{FLAGS}, ids AS (SELECT *, sum(changed) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS spell_id FROM flags),
spells AS (SELECT symbol, spell_id, regime, min(t) AS a, max(t) AS b, count(*) AS duration FROM ids GROUP BY ALL)"""
ORACLE["regime_change_flag"] = f"WITH {LABELS}, {FLAGS} SELECT symbol, {ts()}, {big('regime', 'regime')}, {big('changed', 'changed')} FROM flags"
SPELL_OUT = f"symbol, {big('spell_id', 'spell_id')}, {big('regime', 'regime')}, {ts('spell_start', 'a')}, {ts('spell_end', 'b')}, duration"
ORACLE["regime_spells"] = f"WITH {LABELS}, {SPELLS} SELECT {SPELL_OUT} FROM spells"
ORACLE["spell_stats"] = (
    f"WITH {LABELS}, {SPELLS} SELECT symbol, {big('regime', 'regime')}, {dbl('avg(duration)', 'mean_duration')}, max(duration) AS max_duration, "
    f"count(*) AS n_spells, {dbl('quantile_cont(duration, 0.5)', 'median_duration')} FROM spells GROUP BY symbol, regime"
)
ORACLE["transition_matrix"] = (
    f"WITH {LABELS}, {MATRIX} SELECT symbol, {big('a', 'from_regime')}, {big('b', 'to_regime')}, {big('n', 'n')}, {dbl('probability')} FROM matrix"
)
ORACLE["transition_matrix_wide"] = f"WITH {LABELS}, {MATRIX} SELECT symbol, {big('a', 'from_regime')}, " + ", ".join(
    dbl(f"max(probability) FILTER (b = {j})", f"to_{j}") for j in range(3)
) + " FROM matrix GROUP BY symbol, a"
_trig = {"log_return": "r"} | {c: c for c in ("vol_60m", "vol_ratio_60_240", "rsi", "volume_spike", "atr_pct", "bb_width")}
ORACLE["transition_triggers"] = f"""WITH {LABELS},
ahead AS (SELECT *, lead(regime) OVER ({SERIES}) AS b, lead(t, 2) OVER ({SERIES}) AS later FROM threshold),
at_ AS (SELECT symbol, regime, b, count(*) AS n, {', '.join(f'avg({x}) AS {c}_a' for c, x in _trig.items())} FROM ahead
  WHERE b <> regime AND later IS NOT NULL GROUP BY symbol, regime, b),
base_ AS (SELECT symbol, regime, {', '.join(f'avg({x}) AS {c}_b' for c, x in _trig.items())} FROM threshold GROUP BY symbol, regime)
SELECT symbol, {big('regime', 'from_regime')}, {big('b', 'to_regime')}, n AS n_transitions, """ + ", ".join(
    f"{dbl(f'{c}_a', f'{c}_at_transition')}, {dbl(f'coalesce(({c}_a - {c}_b) / NULLIF(abs({c}_b), 0), 0)', f'{c}_vs_baseline')}" for c in _trig
) + " FROM at_ JOIN base_ USING (symbol, regime)"

# limits, ranks ---------------------------------------------------------------------------------
_few = f"symbol, {ts()}, {dbl('c', 'price_close')}, {dbl('v', 'volume_base')}"
ORACLE["recent_rows"] = f"WITH {HOUR} SELECT {_few} FROM (SELECT * FROM bars ORDER BY t DESC, symbol LIMIT 20)"
ORACLE["sample_rows"] = f"WITH {HOUR} SELECT {_few} FROM (SELECT * FROM bars ORDER BY t, symbol LIMIT 10)"


ORACLE["capped_sample"] = f"""WITH {FEATURES}, counted AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_rows,
  ('0x' || substr(md5(symbol || '|' || t), 1, 8))::BIGINT / 4294967296.0 AS draw FROM feats)
SELECT symbol, {ts()}, {dbl('r', 'log_return')}, {dbl('vol_60m')} FROM counted WHERE n_rows <= 200 OR draw < 200.0 / n_rows"""


def strided(source: str, n: int) -> str:
    return f"""idx AS (SELECT *, row_number() OVER ({SERIES}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM {source}),
strided AS (SELECT * EXCLUDE (rn, total) FROM idx WHERE rn % CASE WHEN total > {n} THEN total // {n} ELSE 1 END = 0)"""


ORACLE["stride_downsample"] = f"WITH {HOUR}, {strided('bars', 100)} SELECT symbol, {ts()}, {dbl('c', 'price_close')} FROM strided"
ORACLE["stack_methods"] = f"WITH {STACKED} SELECT symbol, method, {ts()}, {big('regime', 'regime')}, {NAMED} FROM stacked"

EVAL_X = ("r", "vol_60m", "vol_240m", "cum_return_60m", "volume_spike")


def evaluation(source: str, key: str, squared: bool = False) -> str:
    """CTEs of all metrics of ``source`` grouped by the columns ``key``; the silhouette on distances or their squares."""
    k = [c.strip() for c in key.split(",")]
    same = " AND ".join(f"x.{c} = y.{c}" for c in k)
    z = [f"z{i}" for i in range(len(EVAL_X))]
    dist = ("(" if squared else "sqrt(") + " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in z) + ")"
    center = "sqrt(" + " + ".join(f"(z.{c} - m.m{c}) * (z.{c} - m.m{c})" for c in z) + ")"
    gap = "sqrt(" + " + ".join(f"(x.m{c} - y.m{c}) * (x.m{c} - y.m{c})" for c in z) + ")"
    on_m = " AND ".join(f"z.{c} = m.{c}" for c in (*k, "regime"))
    kx = ", ".join(f"x.{c}" for c in k)
    # the Euclidean form is defined on about 10,000 rows of a larger group, drawn by a digest of their key
    drawn = "'0x' || substr(md5(symbol || '|' || strftime(t, '%Y-%m-%d %H:%M:%S')), 1, 8)"
    few = "true" if squared else f"size <= 10000 OR CAST({drawn} AS BIGINT) / 4294967296.0 < 10000.0 / size"
    return f"""z AS (SELECT {key}, t, r AS ret, vol_60m AS vol, regime, {', '.join(f'{zscore(x, key)} AS {c}' for x, c in zip(EVAL_X, z))} FROM {source}),
zs AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS size FROM z) WHERE {few}),
pd AS (SELECT {kx}, x.t, x.regime, y.regime AS other, sum({dist}) AS d, count(*) AS n FROM zs x JOIN zs y ON {same} GROUP BY ALL),
ab AS (SELECT {key}, t, regime, max(CASE WHEN other = regime THEN CASE WHEN n > 1 THEN d / (n - 1) END END) AS a,
  min(CASE WHEN other <> regime THEN d / n END) AS b FROM pd GROUP BY {key}, t, regime),
sil AS (SELECT {key}, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette_score FROM ab GROUP BY {key}),
m AS (SELECT {key}, regime, count(*) AS n, {', '.join(f'avg({c}) AS m{c}, var_pop({c}) AS v{c}' for c in z)} FROM z GROUP BY {key}, regime),
ch AS (SELECT {key}, sum(n * ({' + '.join(f'm{c} * m{c}' for c in z)})) * (sum(n) - count(*))
  / (sum(n * ({' + '.join(f'v{c}' for c in z)})) * (count(*) - 1)) AS calinski_harabasz_score FROM m GROUP BY {key}),
sc AS (SELECT {', '.join(f'm.{c}' for c in k)}, m.regime, avg({center}) AS s, {', '.join(f'any_value(m.m{c}) AS m{c}' for c in z)}
  FROM z JOIN m ON {on_m} GROUP BY {', '.join(f'm.{c}' for c in k)}, m.regime),
wr AS (SELECT {kx}, x.regime, max((x.s + y.s) / {gap}) AS w FROM sc x JOIN sc y ON {same} AND x.regime <> y.regime GROUP BY {kx}, x.regime),
db AS (SELECT {key}, avg(w) AS davies_bouldin_score FROM wr GROUP BY {key}),
ef AS (SELECT *, CASE WHEN regime <> lag(regime) OVER (PARTITION BY {key} ORDER BY t) THEN 1 ELSE 0 END AS changed FROM z),
du AS (SELECT {key}, count(*) / (sum(changed) + 1) AS avg_regime_duration, sum(changed) / count(*) AS transition_frequency FROM ef GROUP BY {key}),
sz AS (SELECT {key}, regime, count(*) AS n, avg(vol) AS vm, var_samp(vol) AS vv, stddev_samp(ret) AS rs FROM z GROUP BY {key}, regime),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY {key}) AS p FROM sz),
ba AS (SELECT {key}, CASE WHEN count(*) > 1 THEN sum(-p * ln(p + 1e-10)) / ln(count(*)) ELSE 0 END AS regime_balance FROM sh GROUP BY {key}),
vs AS (SELECT {key}, (sum(n * vm * vm) - sum(n * vm) * sum(n * vm) / sum(n)) * (sum(n) - count(*))
  / (sum((n - 1) * vv) * (count(*) - 1)) AS volatility_separation FROM sz GROUP BY {key}),
wv AS (SELECT {key}, sum(n * rs) / sum(n) AS within_regime_volatility FROM sz GROUP BY {key})"""


METRICS = ("silhouette_score", "calinski_harabasz_score", "davies_bouldin_score", "avg_regime_duration", "transition_frequency",
           "regime_balance", "volatility_separation", "within_regime_volatility")
_single = f"WITH {LABELS}, {evaluation('threshold', 'symbol')}"
for _name, _cte, _col in (
    ("silhouette_euclidean", "sil", "silhouette_score"), ("calinski_harabasz", "ch", "calinski_harabasz_score"),
    ("davies_bouldin", "db", "davies_bouldin_score"), ("avg_regime_duration", "du", "avg_regime_duration"),
    ("regime_balance", "ba", "regime_balance"), ("volatility_separation", "vs", "volatility_separation"),
    ("transition_frequency", "du", "transition_frequency"), ("within_regime_volatility", "wv", "within_regime_volatility"),
):
    ORACLE[_name] = f"{_single} SELECT symbol, {dbl(_col)} FROM {_cte}"
ORACLE["silhouette_squared"] = (
    f"WITH {LABELS}, {evaluation('threshold', 'symbol', True)} SELECT symbol, {dbl('silhouette_score', 'silhouette_squared')} FROM sil"
)
_joined = " JOIN ".join(["sil", *[f"{c} USING (symbol, method)" for c in ("ch", "db", "du", "ba", "vs", "wv")]])
_compared = f"WITH {STACKED}, {evaluation('stacked', 'symbol, method', True)}, cmp AS (SELECT symbol, method, {', '.join(METRICS)} FROM {_joined})"
ORACLE["evaluate_regimes"] = f"{_compared} SELECT symbol, method, {dbls(*METRICS)} FROM cmp"
ORACLE["best_method"] = (
    f"{_compared} SELECT symbol, first(method ORDER BY silhouette_score DESC, method) AS best_method, "
    f"{dbl('max(silhouette_score)', 'silhouette_score')} FROM cmp GROUP BY symbol"
)


def avg_rank(metric: str, order: str) -> str:
    return (f"rank() OVER (PARTITION BY symbol ORDER BY {metric} {order}) + "
            f"(count(*) OVER (PARTITION BY symbol, {metric}) - 1) / 2")


_ranks = {"silhouette_rank": avg_rank("silhouette_score", "DESC"), "separation_rank": avg_rank("volatility_separation", "DESC"),
          "davies_bouldin_rank": avg_rank("davies_bouldin_score", "ASC")}
ORACLE["rank_by_metric"] = (
    f"{_compared}, rk AS (SELECT symbol, method, {', '.join(f'{x} AS {c}' for c, x in _ranks.items())} FROM cmp) "
    f"SELECT symbol, method, {dbls(*_ranks)}, {dbl('(' + ' + '.join(_ranks) + ') / 3', 'avg_rank')} FROM rk"
)
LOWER = ("davies_bouldin_score", "transition_frequency", "within_regime_volatility")


def scaled(m: str, eps: str, flat: str) -> str:
    lo, hi = f"min({m}) OVER (PARTITION BY symbol)", f"max({m}) OVER (PARTITION BY symbol)"
    value = f"({m} - {lo}) / ({hi} - {lo}{eps})"
    value = f"1 - {value}" if m in LOWER else value
    return f"CASE WHEN {hi} > {lo} THEN {value} ELSE {flat} END" if flat else value


ORACLE["composite_rank"] = (
    f"{_compared}, sc2 AS (SELECT symbol, method, ({' + '.join('(' + scaled(m, '', '0.5') + ')' for m in METRICS)}) / 8 AS composite_score FROM cmp) "
    f"SELECT symbol, method, {dbl('composite_score')}, row_number() OVER (PARTITION BY symbol ORDER BY composite_score DESC, method) AS rank FROM sc2"
)
ORACLE["metric_radar"] = f"{_compared} SELECT symbol, method, {', '.join(dbl(scaled(m, ' + 1e-10', ''), f'{m}_axis') for m in METRICS)} FROM cmp"

# calendars -------------------------------------------------------------------------------------
ORACLE["backfill_plan"] = f"""WITH {QUARTER}, nx AS (SELECT symbol, t, lead(t) OVER ({SERIES}) AS t2 FROM bars),
holes AS (SELECT symbol, t + INTERVAL '15 minutes' AS a, t2 - INTERVAL '15 minutes' AS b FROM nx WHERE t2 - t > INTERVAL '15 minutes'),
pages AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL '1 hour')) AS p, b FROM holes),
ends AS (SELECT symbol, p, least(p + INTERVAL '45 minutes', b) AS e FROM pages)
SELECT symbol, {ts('page_start', 'p')}, {ts('page_end', 'e')}, {big('(epoch(e) - epoch(p)) / 900 + 1', 'n_candles')} FROM ends"""
ORACLE["backfill_merge"] = ORACLE["log_return"]

# rule detectors --------------------------------------------------------------------------------
_lab = f"symbol, {ts()}, {big('regime', 'regime')}, {NAMED}"
ORACLE["regime_threshold"] = f"WITH {LABELS} SELECT {_lab} FROM threshold"
ORACLE["regime_multi_indicator"] = f"WITH {FEATURES}, {MULTI} SELECT {_lab}, {dbl('score')} FROM multi"
ORACLE["regime_breakout"] = f"WITH {FEATURES}, {BAND} SELECT {_lab} FROM breakout"
ORACLE["sequence_settings"] = f"""WITH {FEATURES}, g AS (SELECT symbol, count(*) AS n_bars,
  CASE WHEN count(*) < 6000 THEN 168 WHEN count(*) < 13000 THEN 336 ELSE 504 END AS s FROM feats GROUP BY symbol)
SELECT symbol, n_bars, {big('s', 'seq_len')}, 24::BIGINT AS patch_len, {big('s // 24', 'n_patches')} FROM g"""

# chart tables ----------------------------------------------------------------------------------
ORACLE["regime_timeline"] = f"WITH {LABELS}, {SPELLS} SELECT {SPELL_OUT} FROM spells"
_box = {"log_return": "r", "vol_60m": "vol_60m", "cum_return_60m": "cum_return_60m", "volume_spike": "volume_spike", "rsi": "rsi"}
ORACLE["feature_box_stats"] = f"""WITH {LABELS}, long AS ({' UNION ALL '.join(
    f"SELECT symbol, regime, '{c}' AS feature, {x} AS x FROM threshold" for c, x in _box.items())}),
q AS (SELECT symbol, regime, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM long GROUP BY ALL)
SELECT symbol, {big('regime', 'regime')}, feature, {dbls('q1', 'median', 'q3')},
{dbl('min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END)', 'whisker_low')}, {dbl('max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END)', 'whisker_high')}
FROM long JOIN q USING (symbol, regime, feature) GROUP BY symbol, regime, feature, q1, median, q3"""
_heat = ("return_mean", "return_std", "return_skew", "return_kurtosis", "vol_mean", "vol_of_vol", "rsi_mean", "atr_mean", "bb_width_mean",
         "vol_spike_mean", "autocorr_lag1", "autocorr_lag24", "sharpe_hourly")
ORACLE["regime_heatmap"] = f"WITH {LABELS}, {STATS}, hl AS (" + " UNION ALL ".join(
    f"SELECT symbol, regime, '{c}' AS stat, {c} AS x FROM stats" for c in _heat
) + f""") SELECT symbol, {big('regime', 'regime')}, stat, {dbl('(x - avg(x) OVER (PARTITION BY symbol, stat)) / (stddev_samp(x) OVER (PARTITION BY symbol, stat) + 1e-10)', 'z')} FROM hl"""


def binned(source: str, x: str, bins: str) -> str:
    return f"""lim AS (SELECT symbol, regime, min({x}) AS lo0, max({x}) AS hi0, count({x}) AS nv, avg({x}) AS mean FROM {source} GROUP BY symbol, regime),
lim2 AS (SELECT symbol, regime, mean, {bins} AS bins, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
  CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM lim),
bin_ AS (SELECT symbol, regime, bins, mean, lo, (hi - lo) / bins AS w, least(floor(({x} - lo) / ((hi - lo) / bins)), bins - 1) AS bin
  FROM {source} JOIN lim2 USING (symbol, regime))
SELECT symbol, {big('regime', 'regime')}, {big('bin', 'bin')}, {big('bins', 'bins')}, count(*) AS n, {dbl('mean')},
{dbl('lo + bin * w', 'bin_start')}, {dbl('w', 'bin_width')} FROM bin_ GROUP BY symbol, regime, bin, bins, mean, lo, w"""


ORACLE["duration_histogram"] = f"WITH {LABELS}, {SPELLS}, {binned('spells', 'duration', 'least(50, nv // 2 + 1)')}"
ORACLE["return_density"] = f"""WITH {LABELS}, shape AS (SELECT symbol, regime, count(r) AS n, stddev_samp(r) AS s, min(r) AS lo, max(r) AS hi
  FROM threshold GROUP BY symbol, regime),
grid AS (SELECT *, s * pow(n, -0.2) AS bw, lo - (hi - lo) / 2 + point * (2 * (hi - lo) / 999) AS x FROM shape, (SELECT unnest(range(1000)) AS point))
SELECT symbol, {big('regime', 'regime')}, {big('point', 'point')}, {dbl('x')}, {dbl('sum(exp(-0.5 * pow((x - r) / bw, 2))) / (grid.n * bw * sqrt(2 * pi()))', 'density')}
FROM grid JOIN threshold USING (symbol, regime) GROUP BY symbol, regime, point, x, grid.n, bw"""


# volatility models -----------------------------------------------------------------------------
FILLED = f"""f AS (SELECT symbol, t, coalesce(r, 0) AS r, row_number() OVER ({SERIES}) - 1 AS rn FROM bars),
fp AS (SELECT *, {lag('r')} AS p FROM f),
given AS (SELECT symbol, 0.05 * var_pop(r) AS w, 0.10::DOUBLE AS a, 0.85::DOUBLE AS b FROM f GROUP BY symbol),
gv AS (SELECT symbol, 0::BIGINT AS rn, w / greatest(1 - a - b, 1e-6) AS h FROM given
  UNION ALL SELECT fp.symbol, fp.rn, greatest(w + a * p * p + b * gv.h, 1e-10) FROM gv
  JOIN fp ON fp.symbol = gv.symbol AND fp.rn = gv.rn + 1 JOIN given ON given.symbol = fp.symbol)"""
ORACLE["kmeans_step_given"] = f"""WITH {LABELS}, kz AS (SELECT row_number() OVER () AS i, """ + ", ".join(
    f"(coalesce({x}, 0) - avg(coalesce({x}, 0)) OVER s) / CASE WHEN stddev_pop(coalesce({x}, 0)) OVER s > 0 THEN stddev_pop(coalesce({x}, 0)) OVER s ELSE 1 END AS {n}"
    for x, n in (("r", "a"), ("vol_60m", "b"), ("rsi", "c"))
) + f""" FROM threshold WINDOW s AS (PARTITION BY symbol)),
kd AS (SELECT i, a, b, c, k, pow(a - k + 1, 2) + pow(b - k + 1, 2) + pow(c - k + 1, 2) AS apart FROM kz, (SELECT unnest([0, 1, 2]) AS k)),
kn AS (SELECT * FROM kd QUALIFY row_number() OVER (PARTITION BY i ORDER BY apart, k) = 1)
SELECT CAST(k AS BIGINT) AS cluster, count(*) AS n, {dbl('sum(apart)', 'inertia')}, {dbl('avg(a)', 'log_return')}, {dbl('avg(b)', 'vol_60m')}, {dbl('avg(c)', 'rsi')}
FROM kn GROUP BY k"""

def stump_sum(low: tuple[float, ...], high: tuple[float, ...], b: str, c: str) -> str:
    """Summed shares of one class over the three known trees."""
    cuts = ((b, -0.5), (b, 0.5), (c, 0))
    return " + ".join(f"CASE WHEN {x} <= {t} THEN {lo} ELSE {hi} END" for (x, t), lo, hi in zip(cuts, low, high))


_shares = [stump_sum(low, high, "b", "c") for low, high in (((0.7, 0.3, 0.2), (0.1, 0.05, 0.5)), ((0.2, 0.6, 0.5), (0.3, 0.15, 0.05)), ((0.1, 0.1, 0.3), (0.6, 0.8, 0.45)))]
ORACLE["permutation_hits_given"] = f"""WITH {LABELS}, ps AS (SELECT symbol, regime, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS rn, count(*) OVER s AS n, """ + ", ".join(
    f"(coalesce({x}, 0) - avg(coalesce({x}, 0)) OVER s) / CASE WHEN stddev_pop(coalesce({x}, 0)) OVER s > 0 THEN stddev_pop(coalesce({x}, 0)) OVER s ELSE 1 END AS {n}"
    for x, n in (("vol_60m", "b"), ("rsi", "c"))
) + f""" FROM threshold WINDOW s AS (PARTITION BY symbol)),
pa AS (SELECT *, (rn * (1000003 % n)) % n AS place FROM ps),
pb AS (SELECT *, CAST(floor(place * ceil(n / 4096) / n) AS BIGINT) AS block FROM pa),
pc AS (SELECT *, row_number() OVER (PARTITION BY symbol, block ORDER BY place) - 1 AS p, count(*) OVER (PARTITION BY symbol, block) AS m FROM pb),
pd AS (SELECT pc.*, repeat, (p * a + repeat + 1) % m AS q FROM pc, (VALUES (0, 4099), (1, 4111), (2, 4127), (3, 4129)) AS v(repeat, a)),
pe AS (SELECT pd.regime, pd.repeat, pd.b, pd.c, o.b AS ob, o.c AS oc FROM pd JOIN pc o ON o.symbol = pd.symbol AND o.block = pd.block AND o.p = pd.q),
pf AS (SELECT j, repeat, regime, CASE WHEN j = 1 THEN ob ELSE b END AS b, CASE WHEN j = 2 THEN oc ELSE c END AS c FROM pe, (SELECT unnest([0, 1, 2]) AS j)
  UNION ALL SELECT -1, 0, regime, b, c FROM pe WHERE repeat = 0),
pg AS (SELECT j, repeat, regime, {_shares[0]} AS s0, {_shares[1]} AS s1, {_shares[2]} AS s2 FROM pf)
SELECT CAST(j AS BIGINT) AS j, CAST(repeat AS BIGINT) AS repeat, CAST(sum(CASE WHEN regime = CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END THEN 1 ELSE 0 END) AS BIGINT) AS hits,
  count(*) AS n FROM pg GROUP BY j, repeat"""
ORACLE["garch_variance"] = (
    f"WITH RECURSIVE {HOUR}, {FILLED} SELECT symbol, {ts()}, {dbl('r', 'log_return')}, {dbl('h', 'variance')} FROM gv JOIN f USING (symbol, rn)"
)
ORACLE["params_table_given"] = (
    f"WITH RECURSIVE {HOUR}, {FILLED} SELECT symbol, {dbl('w', 'omega', 12)}, {dbl('a', 'alpha', 12)}, {dbl('b', 'beta', 12)}, 'baseline' AS model FROM given"
)
ORACLE["garch_loglik"] = (
    f"WITH RECURSIVE {HOUR}, {FILLED} SELECT symbol, {dbl('-0.5 * sum(ln(2 * pi()) + ln(greatest(h, 1e-10)) + r * r / greatest(h, 1e-10))', 'loglik')}, "
    "count(*) AS n FROM gv JOIN f USING (symbol, rn) GROUP BY symbol"
)


ORACLE["garch_scores_given"] = f"""WITH RECURSIVE {HOUR}, {FILLED},
gc AS (SELECT symbol, k AS candidate, s * var_pop(r) AS w, a, b FROM f, (VALUES (0, 0.05::DOUBLE, 0.10::DOUBLE, 0.85::DOUBLE), (1, 0.10, 0.15, 0.80),
  (2, 0.02, 0.05, 0.93)) AS v(k, s, a, b) GROUP BY symbol, k, s, a, b),
gd AS (SELECT symbol, candidate, w, a, b, 0::BIGINT AS rn, w / (1 - a - b) AS h, 1 / (1 - a - b) AS hw, w / pow(1 - a - b, 2) AS ha, w / pow(1 - a - b, 2) AS hb
  FROM gc
  UNION ALL SELECT gd.symbol, candidate, w, a, b, fp.rn, w + a * p * p + b * h, 1 + b * hw, p * p + b * ha, h + b * hb
  FROM gd JOIN fp ON fp.symbol = gd.symbol AND fp.rn = gd.rn + 1),
ge AS (SELECT symbol, count(*) AS n, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS te FROM f GROUP BY symbol),
gk AS (SELECT symbol, unnest(range(0, CAST(greatest(floor((n - 1 - te) / 48.0), 0) AS BIGINT) + 1)) AS refit, te FROM ge)
SELECT symbol, refit, candidate::BIGINT AS candidate, count(*) AS n, {dbl('-0.5 * sum(ln(2 * pi()) + ln(h) + r * r / h)', 'loglik', 4)},
  {dbl('-0.5 * sum((1 - r * r / h) * hw * w / h)', 'd_log_omega', 4)}, {dbl('-0.5 * sum((1 - r * r / h) * ha / h)', 'd_alpha', 4)},
  {dbl('-0.5 * sum((1 - r * r / h) * hb / h)', 'd_beta', 4)}
FROM gk JOIN gd USING (symbol) JOIN f USING (symbol, rn) WHERE rn < te + refit * 48 GROUP BY symbol, refit, candidate"""


def split(source: str) -> str:
    return f"""sp AS (SELECT *, row_number() OVER ({SERIES}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n_rows,
  coalesce({lag('coalesce(r, 0)')}, NULL) AS p FROM {source}),
tr AS (SELECT *, CAST(floor(n_rows * 0.8::DOUBLE) AS BIGINT) AS te FROM sp)"""


ORACLE["train_test_split"] = (
    f"WITH {HOUR}, {split('bars')} SELECT symbol, {ts()}, rn, n_rows, te AS train_end, "
    "CASE WHEN rn < te THEN 'train' ELSE 'test' END AS part FROM tr"
)
RK = "CAST(greatest(floor((rn - te - 1) / 48.0), 0) AS BIGINT)"
BASELINE = """gb AS (SELECT symbol, 0.05 * var_pop(r) AS w, 0.10::DOUBLE AS a, 0.85::DOUBLE AS b FROM threshold GROUP BY symbol),
h0b AS (SELECT symbol, var_pop(r) AS h0 FROM tr WHERE rn < te GROUP BY symbol),
tb AS (SELECT symbol, t, r, p, rn, rn - te AS i, w, a + 0.01 * (""" + RK + """ % 3) AS a, b FROM tr JOIN gb USING (symbol) WHERE rn >= te),
fb AS (SELECT tb.symbol, t, r, i, greatest(w + a * p * p + b * h0, 1e-10) AS h FROM tb JOIN h0b USING (symbol) WHERE i = 0
  UNION ALL SELECT tb.symbol, tb.t, tb.r, tb.i, greatest(w + a * p * p + b * fb.h, 1e-10) FROM fb JOIN tb ON tb.symbol = fb.symbol AND tb.i = fb.i + 1)"""


def regime_forecast(label: str = "regime") -> str:
    return f"""gr AS (SELECT symbol, regime, 0.05 * var_pop(r) AS w, 0.10::DOUBLE AS a, 0.85::DOUBLE AS b FROM threshold GROUP BY symbol, regime),
tl AS (SELECT * EXCLUDE (regime), {label} AS regime FROM tr),
tg AS (SELECT symbol, regime, t, r, p, {RK} AS k, row_number() OVER (PARTITION BY symbol, regime ORDER BY t) AS i FROM tl WHERE rn >= te),
tk AS (SELECT tg.*, w, gr.a + 0.01 * (k % 3) AS a, b, w / greatest(1 - gr.a - b, 1e-6) AS h0 FROM tg JOIN gr USING (symbol, regime)),
fr AS (SELECT symbol, regime, t, r, i, greatest(w + a * p * p + b * h0, 1e-10) AS h FROM tk WHERE i = 1
  UNION ALL SELECT tk.symbol, tk.regime, tk.t, tk.r, tk.i, greatest(w + a * p * p + b * fr.h, 1e-10) FROM fr
  JOIN tk ON tk.symbol = fr.symbol AND tk.regime = fr.regime AND tk.i = fr.i + 1)"""


_g = f"WITH RECURSIVE {LABELS}, {split('threshold')}"
ORACLE["rolling_forecast_given"] = (
    f"{_g}, {BASELINE} SELECT symbol, {ts()}, {dbl('h', 'forecast')}, {dbl('sqrt(h)', 'forecast_vol')}, {dbl('r * r', 'realised_var')} FROM fb"
)
_fr = f"symbol, {ts()}, {dbl('h', 'rs_forecast')}, {dbl('sqrt(h)', 'rs_vol')}, {dbl('r * r', 'realised_var')}, {big('regime', 'regime')}"
ORACLE["rolling_forecast_regime_given"] = f"{_g}, {regime_forecast()} SELECT {_fr} FROM fr"
_lagged = regime_forecast(f"coalesce({lag('regime')}, regime)")
ORACLE["rolling_forecast_regime_lagged"] = f"{_g}, {_lagged} SELECT {_fr} FROM fr"
ORACLE["insample_regime_variance"] = f"""{_g}, gr AS (SELECT symbol, regime, 0.05 * var_pop(r) AS w, 0.10::DOUBLE AS a, 0.85::DOUBLE AS b
  FROM threshold GROUP BY symbol, regime),
ti AS (SELECT tr.symbol, tr.regime, t, p, rn, row_number() OVER (PARTITION BY tr.symbol, tr.regime ORDER BY t) AS i, w, a, b,
  w / greatest(1 - a - b, 1e-6) AS h0 FROM tr JOIN gr ON gr.symbol = tr.symbol AND gr.regime = tr.regime WHERE rn < te),
vi AS (SELECT symbol, regime, t, i, CASE WHEN rn = 0 THEN h0 ELSE greatest(w + a * p * p + b * h0, 1e-10) END AS h FROM ti WHERE i = 1
  UNION ALL SELECT ti.symbol, ti.regime, ti.t, ti.i, greatest(w + a * p * p + b * vi.h, 1e-10) FROM vi
  JOIN ti ON ti.symbol = vi.symbol AND ti.regime = vi.regime AND ti.i = vi.i + 1)
SELECT symbol, {ts()}, {big('regime', 'regime')}, {dbl('h', 'variance')} FROM vi"""
AHEAD = """la AS (SELECT symbol, last(regime ORDER BY t) AS regime, last(r ORDER BY t) AS lr, last(h ORDER BY t) AS lh FROM fr GROUP BY symbol),
mk AS (SELECT symbol, CAST(floor((any_value(n_rows) - 1 - any_value(te)) / 48.0) AS BIGINT) AS k FROM tr GROUP BY symbol),
st0 AS (SELECT la.symbol, la.regime, lr, lh, w, a + 0.01 * (k % 3) AS a, b FROM la JOIN gr ON gr.symbol = la.symbol AND gr.regime = la.regime JOIN mk ON mk.symbol = la.symbol),
ah AS (SELECT symbol, regime, 1 AS step, greatest(w + a * lr * lr + b * lh, 1e-10) AS h, w, a, b FROM st0
  UNION ALL SELECT symbol, regime, step + 1, greatest(w + (a + b) * h, 1e-10), w, a, b FROM ah WHERE step < 168)"""
_ah = f"{_g}, {regime_forecast()}, {AHEAD}"
_fv = f"{dbl('h', 'forecast_variance')}, {dbl('sqrt(h)', 'forecast_vol')}, {dbl('sqrt(h * 8760)', 'forecast_vol_ann')}"
ORACLE["forecast_ahead"] = f"{_ah} SELECT symbol, {big('regime', 'active_regime')}, {big('step', 'step')}, {_fv} FROM ah"
ORACLE["forecast_band"] = (
    f"{_ah} SELECT symbol, {big('step', 'step')}, {dbl('0.9 * sqrt(h)', 'band_low')}, {dbl('1.1 * sqrt(h)', 'band_high')} FROM ah WHERE step <= 24"
)
ORACLE["forecast_variance"] = f"""WITH RECURSIVE {LABELS}, gr AS (SELECT symbol, regime, 0.05 * var_pop(r) AS w, 0.10::DOUBLE AS a, 0.85::DOUBLE AS b,
  last(r ORDER BY t) AS lr, last(vol_60m * vol_60m ORDER BY t) AS lh FROM threshold GROUP BY symbol, regime),
ah AS (SELECT symbol, regime, 1 AS step, greatest(w + a * lr * lr + b * lh, 1e-10) AS h, w, a, b FROM gr
  UNION ALL SELECT symbol, regime, step + 1, greatest(w + (a + b) * h, 1e-10), w, a, b FROM ah WHERE step < 24)
SELECT symbol, {big('regime', 'regime')}, {big('step', 'step')}, {_fv} FROM ah"""
_two = f"{_g}, {BASELINE}, {regime_forecast()}"
ORACLE["forecast_table"] = (
    f"{_two} SELECT fb.symbol, {ts('timestamp', 'fb.t')}, {dbl('fb.h', 'forecast')}, {dbl('sqrt(fb.h)', 'forecast_vol')}, "
    f"{dbl('fb.r * fb.r', 'realised_var')}, {dbl('fr.h', 'rs_forecast')}, {dbl('sqrt(fr.h)', 'rs_vol')}, {big('regime', 'regime')} "
    "FROM fb JOIN fr ON fb.symbol = fr.symbol AND fb.t = fr.t"
)
ORACLE["combine_forecasts"] = (
    f"{_two} SELECT fb.symbol, count(*) AS n, {dbl('avg(fr.h - fb.h)', 'mean_gap')} FROM fb JOIN fr ON fb.symbol = fr.symbol AND fb.t = fr.t GROUP BY fb.symbol"
)


def metrics(source: str, name: str) -> str:
    return f"""{name} AS (SELECT symbol, count(*) AS n_oos, sqrt(avg((h - r * r) * (h - r * r))) AS rmse, avg(abs(h - r * r)) AS mae,
  100 * avg(abs((h - r * r) / greatest(r * r, 1e-10))) AS mape_pct, avg(ln(h) + r * r / h) AS qlike, corr(h, r * r) AS corr FROM {source} GROUP BY symbol)"""


M = ("rmse", "mae", "mape_pct", "qlike", "corr")
_m = f"{_two}, {metrics('fb', 'mb')}, {metrics('fr', 'mr')}"
_mcols = ", ".join(dbl(c, digits=4) for c in M)
ORACLE["forecast_metrics"] = (
    f"{_m} SELECT symbol, n_oos, {_mcols}, 'baseline' AS model FROM mb UNION ALL SELECT symbol, n_oos, {_mcols}, 'regime_switching' FROM mr"
)
ORACLE["model_improvement"] = f"{_m}, both_ AS (" + " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS metric, mb.{c} AS x, mr.{c} AS y, {1 if c == 'corr' else -1} AS dir FROM mb JOIN mr USING (symbol)" for c in M
) + f""") SELECT symbol, metric, {dbl('x', 'baseline', 4)}, {dbl('y', 'regime_switching', 4)}, {dbl('(y - x) / NULLIF(abs(x), 0) * 100 * dir', 'improvement_pct', 4)},
CASE WHEN (dir = 1 AND x > y) OR (dir = -1 AND x < y) THEN 'baseline' ELSE 'regime_switching' END AS winner FROM both_"""
ORACLE["forecast_vol_histogram"] = f"{_g}, {regime_forecast()}, fv AS (SELECT symbol, regime, sqrt(h) AS rs_vol FROM fr), {binned('fv', 'rs_vol', '50')}"

# sequences -------------------------------------------------------------------------------------
ORACLE["garch_features"] = f"""WITH RECURSIVE {FEATURES}, f AS (SELECT symbol, t, r, row_number() OVER ({SERIES}) - 1 AS rn FROM feats),
{FILLED[FILLED.index('fp AS'):]}, g AS (SELECT symbol, t, r, sqrt(h) AS gvol FROM gv JOIN f USING (symbol, rn)),
g2 AS (SELECT *, avg(gvol) {roll(24)} / avg(gvol) {roll(168)} AS ratio FROM g)
SELECT symbol, {ts()}, {dbl('gvol', 'global_garch_vol')}, {dbl('r / gvol', 'standardised_return')}, {dbl('ratio', 'garch_vol_ratio')},
{dbl('(r / gvol) * (r / gvol)', 'arch_indicator')} FROM g2"""
_patch = {
    f"{name}_p{j}": f"avg({x}) OVER ({SERIES} ROWS BETWEEN {(j + 1) * 24} PRECEDING AND {j * 24 + 1} PRECEDING)"
    for name, x in (("log_return", "r"), ("rsi", "rsi")) for j in range(7)
}
ORACLE["sequence_windows"] = (
    f"WITH {FEATURES}, sq AS (SELECT symbol, t, {', '.join(f'{x} AS {c}' for c, x in _patch.items())}, row_number() OVER ({SERIES}) AS i FROM feats) "
    f"SELECT symbol, {ts()}, {dbls(*_patch)} FROM sq WHERE i > 168"
)
ORACLE["head_fill"] = f"""WITH {LABELS}, sn AS (SELECT symbol, t, CASE WHEN day(t) > 8 THEN regime END AS seen FROM threshold),
fs AS (SELECT symbol, first(seen ORDER BY t) AS head FROM sn WHERE seen IS NOT NULL GROUP BY symbol)
SELECT symbol, {ts()}, {big('coalesce(seen, head)', 'seen')} FROM sn JOIN fs USING (symbol)"""

# streams end in the rows of their batch forms --------------------------------------------------
ORACLE["stream_ingest"] = f"WITH {HOUR} SELECT {BAR_OUT}, {CAL} FROM bars"
ORACLE["stream_dedup"] = ORACLE["scan_kline_csv"]
ORACLE["stream_bars"] = f"WITH {HOUR} SELECT {BAR_OUT} FROM bars"
ORACLE["stream_log_return"] = ORACLE["late_repair"] = ORACLE["hybrid_ingest"] = ORACLE["log_return"]
ORACLE["stream_threshold_regime"] = ORACLE["regime_threshold"]
