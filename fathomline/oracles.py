"""DuckDB SQL that gives the rows of the catalog's queries."""

from __future__ import annotations

NAV = """nav AS (SELECT l_returnflag || l_linestatus AS code, CAST(l_shipdate AS DATE) AS date,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS nav FROM lineitem GROUP BY 1, 2),
base AS (SELECT *, row_number() OVER w AS pos, nav / lag(nav) OVER w - 1 AS ret FROM nav WINDOW w AS (PARTITION BY code ORDER BY date))"""
W = "PARTITION BY code ORDER BY date"


def num(x: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"CASE WHEN round({x}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({x}, {digits}) END"


def frame(n: int, last: int = 0) -> str:
    return f"({W} ROWS BETWEEN {n - 1 + last} PRECEDING AND {f'{last} PRECEDING' if last else 'CURRENT ROW'})"


def full(fn: str, x: str, n: int, last: int = 0, args: str | None = None) -> str:
    f = frame(n, last)
    return f"(CASE WHEN count({x}) OVER {f} = {n} THEN {fn}({args or x}) OVER {f} END)"


def pct(x: str, n: int) -> str:
    return f"({x} / nullif(lag({x}, {n}) OVER ({W}), 0) - 1)"


def regr(fn: str, n: int) -> str:
    return full(fn, "nav", n, args="nav, CAST(pos AS DOUBLE)")


def factor(name: str, n: int, k: int = 5) -> str:
    """A factor over ``base`` (ma_slope over a column sma)."""
    sd, sdp = full("stddev_samp", "ret", n), full("stddev_pop", "ret", n)
    top, low = full("max", "nav", n), full("min", "nav", n)
    sxx, syy, sxy = (regr(f"regr_{s}", n) for s in ("sxx", "syy", "sxy"))
    left = f"greatest({syy} - {sxy} * {sxy} / {sxx}, 0.0)"
    fitted = f"({regr('regr_intercept', n)} + {regr('regr_slope', n)} * pos)"
    return {
        "momentum": pct("nav", n),
        "ma_trend_state": f"(nav / {full('avg', 'nav', n)} - 1)",
        "ma_slope": pct("sma", k),
        "trend_r2": f"(CASE WHEN count(nav) OVER {frame(n)} = {n} THEN CASE WHEN {syy} <= 0 THEN 0.0 ELSE greatest(0.0, {regr('regr_r2', n)}) END END)",
        "trend_tvalue": f"(CASE WHEN count(nav) OVER {frame(n)} = {n} THEN CASE WHEN {left} <= 1e-20 * greatest({syy}, 1e-300) THEN 0.0 ELSE coalesce({sxy} / {sxx} / nullif(sqrt({left} / {float(n - 2)} / {sxx}), 0), 0) END END)",
        "price_position": f"((nav - {low}) / nullif({top} - {low}, 0))",
        "breakout_strength": f"(nav / {full('max', 'nav', n, 1)} - 1)",
        "donchian_breakout": f"coalesce(CAST(nav > {full('max', 'nav', n, 1)} AS DOUBLE), 0.0)",
        "trend_residual": f"(CASE WHEN abs({fitted}) > 1e-12 THEN nav / {fitted} - 1 END)",
        "volatility": sd,
        "drawdown": f"(nav / {top} - 1)",
        "risk_adjusted_momentum": f"({pct('nav', n)} / nullif({sd}, 0))",
        "sharpe_like_trend": f"({full('avg', 'ret', n)} / nullif({sdp}, 0))",
    }[name]


DEFAULTS = {"momentum": 40, "ma_trend_state": 60, "ma_slope": 20, "trend_r2": 20, "trend_tvalue": 20, "price_position": 60, "breakout_strength": 60, "donchian_breakout": 20, "trend_residual": 20, "volatility": 20, "drawdown": 60, "risk_adjusted_momentum": 20, "sharpe_like_trend": 20}
WEIGHTS = {"momentum": 0.12, "ma_trend_state": 0.10, "ma_slope": 0.08, "trend_r2": 0.08, "trend_tvalue": 0.08, "price_position": 0.08, "breakout_strength": 0.08, "donchian_breakout": 0.07, "trend_residual": 0.07, "volatility": 0.08, "drawdown": 0.08, "risk_adjusted_momentum": 0.10, "sharpe_like_trend": 0.06}
INVERTED = ("trend_residual", "volatility", "drawdown")


def z(x: str, n: int = 60) -> str:
    return f"coalesce(({x} - {full('avg', x, n)}) / nullif({full('stddev_pop', x, n)}, 0), 0)"


RAW = f"""{NAV},
smas AS (SELECT *, {full('avg', 'nav', 20)} AS sma FROM base),
raws AS (SELECT code, date, nav, pos, ret, {', '.join(f'{factor(f, n)} AS {f}' for f, n in DEFAULTS.items())} FROM smas)"""
ZED = f"""{RAW},
zed AS (SELECT *, {', '.join(f"{'-' if f in INVERTED else ''}({z(f)}) AS {f}_z" for f in DEFAULTS)} FROM raws),
scored AS (SELECT code, date, nav, pos, ret, {' + '.join(f'{w} * {f}_z' for f, w in WEIGHTS.items())} AS score FROM zed)"""
DAY = "CAST(date AS VARCHAR) AS date"


def one_factor(name: str) -> str:
    n = DEFAULTS[name]
    src = f"(SELECT *, {full('avg', 'nav', 20)} AS sma FROM base)" if name == "ma_slope" else "base"
    return f"WITH {NAV}, f AS (SELECT code, date, {factor(name, n)} AS x FROM {src}) SELECT code, {DAY}, {num('x')} AS {name} FROM f"


def edges(enter: str, leave: str, src: str) -> str:
    """code, date, entries, exits of rising conditions."""
    return f"""r AS (SELECT code, date, nav, coalesce({enter}, false) AS i, coalesce({leave}, false) AS o FROM {src}),
    sig AS (SELECT code, date, nav, i AND NOT coalesce(lag(i) OVER ({W}), false) AS entries, o AND NOT coalesce(lag(o) OVER ({W}), false) AS exits FROM r)"""


MA = f"m AS (SELECT code, date, nav, {full('avg', 'nav', 5)} AS a, {full('avg', 'nav', 20)} AS b FROM base), " + edges("a > b", "a < b", "m")
MOM = f"m AS (SELECT code, date, nav, {pct('nav', 20)} AS x FROM base), " + edges("x > 0", "x <= 0", "m")
MULTI = edges("score > 0.2", "score <= 0.0", "scored")
HOLD = "sig AS (SELECT code, date, nav, pos = 1 AS entries, false AS exits FROM base)"


def bt(src: str = "sig", out: str = "bt", keys: str = "code") -> str:
    w = f"PARTITION BY {keys} ORDER BY date"
    return f"""{out}_s AS (SELECT *, CASE WHEN entries AND NOT exits THEN 1 WHEN exits AND NOT entries THEN 0 END AS s FROM {src}),
    {out}_p AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM {out}_s),
    {out}_h AS (SELECT *, coalesce(lag(position) OVER ({w}), 0) AS held, lag(nav) OVER ({w}) AS before FROM {out}_p),
    {out} AS (SELECT *, position - held AS traded, 10000 * product((CASE WHEN held = 1 THEN nav / before ELSE 1.0 END) * (CASE position - held WHEN 1 THEN 1 / 1.001 WHEN -1 THEN 0.999 ELSE 1.0 END)) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM {out}_h)"""


def stats(src: str, keys: str, rf: str = "0.0", out: str = "st") -> str:
    w = f"PARTITION BY {keys} ORDER BY date"
    return f"""{out}_r AS (SELECT *, equity / nullif(lag(equity) OVER ({w}), 0) - 1 AS er, equity / max(equity) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM {src}),
    {out}_a AS (SELECT {keys}, arg_max(equity, date) / arg_min(equity, date) - 1 AS cum, count(er) AS n, stddev_pop(er) AS sd, avg(er - {rf}) AS m, stddev_pop(er - {rf}) AS esd, min(dd) AS mdd FROM {out}_r GROUP BY {keys}),
    {out} AS (SELECT {keys}, cum AS cumulative_return, CASE WHEN n > 0 THEN pow(1 + cum, 252.0 / greatest(n, 1)) - 1 ELSE 0 END AS annual_return, CASE WHEN n > 0 THEN sd * sqrt(252.0) ELSE 0 END AS annual_volatility, CASE WHEN n > 0 THEN coalesce(m / (CASE WHEN esd > 0 THEN esd END) * sqrt(252.0), 0) ELSE 0 END AS sharpe, CASE WHEN n > 0 THEN mdd ELSE 0 END AS max_drawdown FROM {out}_a)"""


STATS = ", ".join(f"{num(c)} AS {c}" for c in ("cumulative_return", "annual_return", "annual_volatility", "sharpe", "max_drawdown"))
FWD = f"fw AS (SELECT code, date, nav, pos, lead(nav, 5) OVER ({W}) / nav - 1 AS fwd FROM base)"

# Development folds of a series, as the split rules give them; window 700, steps 75 to 105.
FOLDS = """sizes AS (SELECT code, count(*) AS n FROM nav GROUP BY code),
devs AS (SELECT code, n, CAST(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT) AS dev FROM sizes),
steps AS (SELECT code, n, dev, arg_min(s, (dev - 700) % s * 1000 - s) AS step FROM devs, range(75, 106) t(s) GROUP BY ALL),
folds AS (SELECT code, n, CAST(k + 1 AS INTEGER) AS fold_id, segment, CAST(k * step + a AS BIGINT) AS start_pos, CAST(k * step + b AS BIGINT) AS end_pos
  FROM steps, range(0, 40) t(k), (VALUES ('train', 0, 525), ('valid', 525, 700)) v(segment, a, b) WHERE k * step + 700 <= dev)"""
FACTORS6 = ["momentum", "ma_trend_state", "price_position", "volatility", "drawdown", "sharpe_like_trend"]
LONG = f"""{FWD},
longs AS (UNPIVOT (SELECT code, date, pos, {', '.join(f'{f}_z AS {f}' for f in FACTORS6)} FROM zed) ON {', '.join(FACTORS6)} INTO NAME candidate_label VALUE value),
cut AS (SELECT l.code, l.date, l.candidate_label, l.value, f.fwd, d.fold_id, d.segment FROM longs l JOIN fw f USING (code, date) JOIN folds d ON d.code = l.code AND l.pos - 1 >= d.start_pos AND l.pos - 1 < d.end_pos)"""


def ic_sql(src: str, keys: str, value: str = "value", out: str = "ics") -> str:
    part = f"PARTITION BY {keys}"
    return f"""{out}_b AS (SELECT * FROM {src} WHERE {value} IS NOT NULL AND fwd IS NOT NULL),
    {out}_k AS (SELECT *, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({part}, {value}) - 1) / 2.0 AS ra, rank() OVER ({part} ORDER BY fwd) + (count(*) OVER ({part}, fwd) - 1) / 2.0 AS rb FROM {out}_b),
    {out} AS (SELECT {keys}, count(*) AS n, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS spearman_ic, covar_pop({value}, fwd) / nullif(stddev_pop({value}) * stddev_pop(fwd), 0) AS pearson_ic FROM {out}_k GROUP BY {keys})"""


KEYS = "code, candidate_label"
ICS = f"{ZED}, {FOLDS}, {LONG}, {ic_sql('cut', 'code, candidate_label, fold_id, segment')}"
SUMM = """summ AS (SELECT code, candidate_label, segment, count(spearman_ic) AS folds, avg(spearman_ic) AS ic_mean, stddev_pop(spearman_ic) AS ic_std,
  coalesce(CASE WHEN stddev_pop(spearman_ic) > 1e-12 THEN avg(spearman_ic) / stddev_pop(spearman_ic) ELSE 0 END, 0) AS icir,
  coalesce(avg(CASE WHEN spearman_ic IS NOT NULL THEN CAST(spearman_ic > 0 AS DOUBLE) END), 0) AS positive_ratio FROM ics GROUP BY ALL),
cand AS (SELECT t.code, t.candidate_label, t.ic_mean AS train_ic_mean, t.icir AS train_icir, t.positive_ratio AS train_positive_ratio, v.ic_mean AS valid_ic_mean, v.icir AS valid_icir, v.positive_ratio AS valid_positive_ratio
  FROM summ t JOIN summ v USING (code, candidate_label) WHERE t.segment = 'train' AND v.segment = 'valid')"""
CAND = ", ".join(f"{num(c)} AS {c}" for c in ("train_ic_mean", "train_icir", "train_positive_ratio", "valid_ic_mean", "valid_icir", "valid_positive_ratio"))
PAIRS = [(a, b) for i, a in enumerate(sorted(FACTORS6)) for b in sorted(FACTORS6)[i + 1 :]]
CORR = f"""wide AS (SELECT z.code, f.fold_id, {', '.join(f'z.{f}_z AS {f}' for f in FACTORS6)} FROM zed z JOIN folds f ON f.code = z.code AND f.segment = 'train' AND z.pos - 1 >= f.start_pos AND z.pos - 1 < f.end_pos),
pairs AS ({' UNION ALL '.join(f"SELECT code, fold_id, '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS corr FROM wide GROUP BY code, fold_id" for a, b in PAIRS)}),
mc AS (SELECT code, a, b, avg(corr) AS mean_corr FROM pairs GROUP BY ALL)"""
LOSERS = """duel AS (SELECT mc.*, x.train_icir AS t1, y.train_icir AS t2, x.valid_icir AS av, y.valid_icir AS bv, x.valid_ic_mean AS ai, y.valid_ic_mean AS bi FROM mc JOIN cand x ON x.code = mc.code AND x.candidate_label = a JOIN cand y ON y.code = mc.code AND y.candidate_label = b WHERE abs(mean_corr) >= 0.7),
losers AS (SELECT code, CASE WHEN t1 < t2 THEN a WHEN t2 < t1 THEN b WHEN av < bv THEN a WHEN bv < av THEN b WHEN ai < bi THEN a WHEN bi < ai THEN b ELSE greatest(a, b) END AS candidate_label, count(*) AS losses, max(abs(mean_corr)) AS max_abs_corr FROM duel GROUP BY ALL)"""
TRIALS = """trials AS (SELECT code, CAST(n AS INTEGER) AS trial_number, CASE WHEN n % 17 = 3 THEN NULL ELSE (n * 7919 % 101) / 101.0::DOUBLE + n % 7 * 0.01 - abs(least(0.0, (n * 31 % 23 - 11) / 23.0)) * 0.2 END AS value FROM (SELECT DISTINCT code FROM nav), range(0, 60) t(n))"""
SCORES = f"""{ZED}, raw AS (SELECT code, date, nav, 1 / (1 + exp(-2.0 * (score - 0.1))) AS raw FROM scored)"""
# Recursions as folds over each series' ordered list.
GATE = """lists AS (SELECT code, list(raw ORDER BY date) AS xs, list(date ORDER BY date) AS ds, list(nav ORDER BY date) AS ns FROM raw GROUP BY code),
ema AS (SELECT code, ds, ns, list_reduce(list_prepend([xs[1]], list_transform(xs[2:], lambda x: [x])), lambda acc, x: list_append(acc, 1.0/3 * x[1] + 2.0/3 * acc[-1])) AS es FROM lists),
gate AS (SELECT code, ds, ns, list_transform(es, lambda e: greatest(0.0, least(1.0, e))) AS es FROM ema),
gates AS (SELECT code, ds, ns, es, list_reduce(list_transform(es, lambda e: [e]), lambda acc, x: list_append(acc, CASE WHEN abs(x[1] - acc[-1]) >= 0.05 THEN x[1] ELSE acc[-1] END)) AS ts FROM gate),
target AS (SELECT code, unnest(ds) AS date, unnest(ns) AS nav, unnest(es) AS smoothed, unnest(ts) AS target FROM gates)"""
CONT = f"""tp AS (SELECT *, coalesce(lag(target) OVER ({W}), 0) AS held, coalesce(nav / lag(nav) OVER ({W}) - 1, 0) AS r FROM target),
tr AS (SELECT *, abs(target - held) AS turnover, held * r - 0.001 * abs(target - held) AS strategy_return FROM tp),
cb AS (SELECT *, 10000 * product(1 + strategy_return) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM tr)"""
BARS = """bars AS (SELECT l_returnflag || l_linestatus AS code, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS open,
  max(l_extendedprice) AS high, min(l_extendedprice) AS low, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100 AS volume FROM lineitem GROUP BY 1, 2)"""
CHOSEN = {"momentum": 20, "volatility": 20, "donchian_breakout": 20, "price_position": 60}
# A series is a code and a source; its name takes the place of the code in the windows.
SOURCES = f"""WITH {BARS}, s AS (SELECT code AS k, date, unnest(['open', 'high', 'low', 'volume']) AS source, unnest([open, high, low, volume]) AS nav FROM bars),
base AS (SELECT *, row_number() OVER w AS pos, nav / lag(nav) OVER w - 1 AS ret FROM (SELECT k || source AS code, * FROM s) WINDOW w AS ({W})),
raws AS (SELECT code, k, source, date, nav, {', '.join(f'{factor(f, n)} AS {f}' for f, n in CHOSEN.items())} FROM base),
zed AS (SELECT *, {z('nav')} AS own, {', '.join(f"{'-' if f in INVERTED else ''}({z(f)}) AS {f}_z" for f in CHOSEN)} FROM raws),
cells AS ({' UNION ALL '.join(f"SELECT k, source, date, source || '__{f}(window={n})__zscore' AS label, {f} AS raw, {f}_z AS value, false AS sure FROM zed" for f, n in CHOSEN.items())} UNION ALL SELECT k, source, date, source || '__zscore', nav, own, true FROM zed),
good AS (SELECT k, label FROM cells GROUP BY 1, 2 HAVING bool_or(sure) OR (avg(CAST(raw IS NULL AS INT)) <= 0.2 AND avg(CAST(value = 0 AS INT)) <= 0.3))
SELECT k AS code, {DAY}, label AS candidate_label, {num('raw')} AS raw, {num('value')} AS value FROM cells JOIN good USING (k, label)"""
SPLIT = """bounds AS (SELECT code, s AS segment, CASE s WHEN 'train' THEN 0 WHEN 'valid' THEN a ELSE b END AS start_pos, CASE s WHEN 'train' THEN a WHEN 'valid' THEN b ELSE n END AS end_pos FROM
  (SELECT code, count(*) AS n, CAST(floor(count(*) * 0.6::DOUBLE) AS BIGINT) AS a, CAST(floor(count(*) * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT) AS b FROM nav GROUP BY code), (VALUES ('train'), ('valid'), ('test')) t(s))"""
SEGMENTED = f"""mc2 AS (SELECT b.*, n.pos FROM bt b JOIN base n USING (code, date)), seg AS (SELECT m.code, m.date, m.equity, d.segment FROM mc2 m JOIN bounds d ON d.code = m.code AND m.pos - 1 >= d.start_pos - 1 AND m.pos - 1 < d.end_pos), {stats('seg', 'code, segment')}"""
FEATURES = {"return": pct("nav", 1)} | {f"ret_{n}": pct("nav", n) for n in (1, 5, 10, 20, 60)} | {f"momentum_{n}": pct("nav", n) for n in (5, 20, 60, 120)} | {f"vol_{n}": full("stddev_samp", "ret", n) for n in (5, 10, 20, 60)} | {f"ma_ratio_{n}": f"(nav / {full('avg', 'nav', n)} - 1)" for n in (5, 10, 20, 60, 120)} | {f"ma_cross_{a}_{b}": f"({full('avg', 'nav', a)} / {full('avg', 'nav', b)} - 1)" for a, b in ((5, 20), (10, 60), (20, 120))} | {f"drawdown_{n}": f"(nav / {full('max', 'nav', n)} - 1)" for n in (20, 60, 120)} | {f"position_{n}": f"((nav - {full('min', 'nav', n)}) / nullif({full('max', 'nav', n)} - {full('min', 'nav', n)}, 0))" for n in (20, 60)}
NAV3 = """nav3 AS (SELECT l_returnflag AS code, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS nav FROM lineitem GROUP BY 1, 2)"""
FRANK = f"""fr AS (SELECT code, date, nav, pos, lead(nav, 7) OVER ({W}) / nav - 1 AS fwd FROM base),
ranked AS (SELECT code, date, nav, pos, fwd, CASE WHEN fwd IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY fwd DESC NULLS LAST) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 END AS future_rank FROM fr)"""


def grid() -> str:
    spec = {"momentum": (10, 120, 5), "ma_trend_state": (20, 120, 5), "trend_r2": (10, 60, 5), "trend_tvalue": (10, 60, 5), "price_position": (20, 120, 5), "breakout_strength": (20, 120, 5), "donchian_breakout": (10, 60, 5), "trend_residual": (10, 60, 5), "volatility": (10, 40, 5), "drawdown": (20, 120, 5), "risk_adjusted_momentum": (10, 60, 5), "sharpe_like_trend": (10, 60, 5)}
    parts = [f"SELECT '{f}' AS factor_name, '{f}(window=' || w || ')' AS candidate_label FROM range({a}, {b + 1}, {s}) t(w)" for f, (a, b, s) in spec.items()]
    parts.append("SELECT 'ma_slope', 'ma_slope(lookback=' || k || ', window=' || w || ')' FROM range(10, 61, 5) t(w), range(2, 21) u(k)")
    return " UNION ALL ".join(parts)


ORACLE: dict[str, str] = {
    "s15_normalize_dedup": "WITH e AS (SELECT event_id, event_type AS code, CAST(ts AS DATE) AS date, value AS nav FROM events WHERE value IS NOT NULL AND ts IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY date, code ORDER BY event_id DESC) AS k FROM e) SELECT CASE WHEN length(code) < 6 THEN lpad(code, 6, '0') ELSE code END AS code, CAST(date AS VARCHAR) AS date, nav FROM r WHERE k = 1",
    "s08_incremental_upsert": f"WITH {NAV}, old AS (SELECT code, date, nav, 0 AS age FROM nav WHERE date < DATE '2000-01-01'), fresh AS (SELECT code, date, nav * 2 AS nav, 1 AS age FROM nav WHERE date >= DATE '1999-12-17'), u AS (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY age DESC) AS k FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh)) SELECT code, {DAY}, {num('nav')} AS nav FROM u WHERE k = 1",
    "s10_fetch_window": f"WITH {NAV}, l AS (SELECT code, max(date) AS last_date FROM nav GROUP BY code) SELECT code, CAST(last_date AS VARCHAR) AS last_date, CAST(last_date - 15 AS VARCHAR) AS start_date, CASE WHEN d <= 31 THEN '1月' WHEN d <= 92 THEN '3月' WHEN d <= 183 THEN '6月' WHEN d <= 366 THEN '1年' WHEN d <= 1098 THEN '3年' WHEN d <= 1830 THEN '5年' ELSE '成立来' END AS period FROM (SELECT *, DATE '2003-01-01' - last_date AS d FROM l)",
    "s05_yearly_windows": f"WITH {NAV}, s AS (SELECT code, min(date) AS a, max(date) AS b FROM nav GROUP BY code), w AS (SELECT code, b, CAST(unnest(generate_series(a, b, INTERVAL 365 DAY)) AS DATE) AS s FROM s) SELECT code, CAST(s AS VARCHAR) AS \"start\", CAST(least(s + 364, b) AS VARCHAR) AS \"end\" FROM w",
    "p05_common_range_align": f"WITH {NAV}, s AS (SELECT code, min(date) AS a, max(date) AS b FROM nav GROUP BY code), g AS (SELECT max(a) AS a, min(b) AS b, count(*) AS c FROM s), d AS (SELECT date FROM nav, g GROUP BY date, g.a, g.b, g.c HAVING count(DISTINCT code) = g.c AND date BETWEEN g.a AND g.b) SELECT code, {DAY}, {num('nav')} AS nav FROM nav WHERE date IN (SELECT date FROM d)",
    "p04_pivot_panel": f"WITH {NAV} SELECT {DAY}, {', '.join(f'''{num(f"max(CASE WHEN code = '{c}' THEN nav END)")} AS {c}''' for c in ('AF', 'AO', 'NF', 'NO', 'RF', 'RO'))} FROM nav GROUP BY date",
    "p09_spine_left_join": f"WITH {NAV}, s AS (SELECT date FROM nav WHERE code = 'AF'), c AS (SELECT DISTINCT code FROM nav) SELECT c.code, CAST(s.date AS VARCHAR) AS date, {num('n.nav')} AS value FROM s CROSS JOIN c LEFT JOIN nav n ON n.date = s.date AND n.code = c.code",
    "w31_neighbor_fill": f"""WITH {NAV3}, s AS (SELECT DISTINCT date FROM nav3), c AS (SELECT DISTINCT code FROM nav3), g AS (SELECT c.code, s.date, n.nav AS value FROM s CROSS JOIN c LEFT JOIN nav3 n ON n.date = s.date AND n.code = c.code),
      h AS (SELECT *, value IS NULL AS gap, coalesce(lag(value IS NULL) OVER (PARTITION BY code ORDER BY date), false) AS pg, (lag(value) OVER (PARTITION BY code ORDER BY date) + lead(value) OVER (PARTITION BY code ORDER BY date)) / 2 AS m FROM g),
      k AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY code) <= 4 AND NOT bool_or(gap AND pg) OVER (PARTITION BY code) AS ok FROM h)
      SELECT code, {DAY}, {num('CASE WHEN gap AND ok THEN m ELSE value END')} AS value, gap AND ok AND m IS NOT NULL AS filled FROM k""",
    "p12_unpivot_features": f"WITH {RAW} SELECT code, {DAY}, candidate_label, {num('value')} AS value FROM (UNPIVOT (SELECT code, date, momentum, drawdown FROM raws) ON momentum, drawdown INTO NAME candidate_label VALUE value)",
    "p15_candidate_grid": f"WITH {NAV}, n AS (SELECT code, count(*) AS n FROM nav GROUP BY code), g AS ({grid()}) SELECT code, factor_name, candidate_label FROM n JOIN g ON n > CAST(regexp_extract(candidate_label, 'window=(\\d+)', 1) AS INT) + coalesce(TRY_CAST(regexp_extract(candidate_label, 'lookback=(\\d+)', 1) AS INT), 0)",
    **{f"w{i:02d}_{f}": one_factor(f) for i, f in enumerate(("momentum", "ma_trend_state", "ma_slope", "trend_r2", "trend_tvalue", "price_position", "breakout_strength", "donchian_breakout", "trend_residual", "volatility", "drawdown", "risk_adjusted_momentum", "sharpe_like_trend"), 1)},
    "w15_rolling_zscore": f"WITH {NAV}, m AS (SELECT code, date, {pct('nav', 20)} AS x FROM base), q AS (SELECT code, date, {z('x')} AS v FROM m) SELECT code, {DAY}, {num('v')} AS z FROM q",
    "w17_factor_table": f"WITH {ZED} SELECT code, {DAY}, {', '.join(f'{num(f)} AS {f}, {num(f + chr(95) + chr(122))} AS {f}_z' for f in DEFAULTS)} FROM zed",
    "w18_multi_factor_score": f"WITH {ZED} SELECT code, {DAY}, {num('score')} AS score FROM scored",
    "w22_panel_features": f"WITH {NAV}, f AS (SELECT code, date, nav, {', '.join(f'{x} AS x_{c}' for c, x in FEATURES.items())} FROM base) SELECT code, {DAY}, {num('nav')} AS nav, {', '.join(f'''{num('x_' + c)} AS "{c}"''' for c in FEATURES)} FROM f",
    "w23_forward_return": f"WITH {NAV}, {FWD} SELECT code, {DAY}, {num('fwd')} AS fwd FROM fw",
    "w24_future_rank": f"WITH {NAV}, {FRANK} SELECT code, {DAY}, {num('future_rank')} AS future_rank FROM ranked",
    "w28_drawdown": f"WITH {NAV}, d AS (SELECT code, date, nav / max(nav) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS x FROM nav) SELECT code, {DAY}, {num('x')} AS drawdown FROM d",
    "a18_daily_return": f"WITH {NAV} SELECT code, {DAY}, {num('ret')} AS ret FROM base",
    "j06_asof_risk_free": f"WITH {NAV}, rf AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders), c AS (SELECT d, 0.01::DOUBLE + 0.0001::DOUBLE * month(d) AS r FROM rf), j AS (SELECT b.code, b.date, coalesce(c.r, (SELECT arg_min(r, d) FROM c)) AS r FROM nav b ASOF LEFT JOIN c ON b.date >= c.d) SELECT code, {DAY}, round(pow(1 + r, 1 / 252.0::DOUBLE) - 1, 10) AS rf FROM j",
    "x01_buy_and_hold": f"WITH {NAV}, {HOLD} SELECT code, {DAY}, entries, exits FROM sig",
    "x01_ma_cross_signals": f"WITH {NAV}, {MA} SELECT code, {DAY}, entries, exits FROM sig",
    "x01_momentum_signals": f"WITH {NAV}, {MOM} SELECT code, {DAY}, entries, exits FROM sig",
    "x01_multi_factor_signals": f"WITH {ZED}, {MULTI} SELECT code, {DAY}, entries, exits FROM sig",
    "w27_t_plus_one": f"WITH {NAV}, {MA} SELECT code, {DAY}, coalesce(lag(entries) OVER ({W}), false) AS entries, coalesce(lag(exits) OVER ({W}), false) AS exits FROM sig",
    "x07_signal_backtest": f"WITH {NAV}, {MA}, {bt()} SELECT code, {DAY}, CAST(position AS BIGINT) AS position, CAST(traded AS BIGINT) AS traded, {num('equity', 4)} AS equity FROM bt",
    "a17_segment_trade_count": f"WITH {NAV}, {SPLIT}, {MA}, {bt()}, p AS (SELECT code, entries, row_number() OVER ({W}) AS pos FROM bt) SELECT code, segment, CAST(count_if(entries) AS BIGINT) AS trade_count FROM p JOIN bounds USING (code) WHERE pos > start_pos AND pos <= end_pos GROUP BY 1, 2",
    "j01_cumulative_join": f"WITH {NAV}, c AS (SELECT l_returnflag || l_linestatus AS code, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS cumulative_nav FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2) SELECT code, CAST(nav.date AS VARCHAR) AS date, {num('nav')} AS nav, {num('cumulative_nav')} AS cumulative_nav FROM nav LEFT JOIN c USING (code, date)",
    "p19_effective_codes": f"""WITH {NAV}, k AS (SELECT DISTINCT code FROM nav), p AS (SELECT a.code AS p, b.code AS c FROM k a JOIN k b ON a.code[1] = b.code[1]), l AS (SELECT a.code AS p, b.code AS c FROM k a JOIN k b ON a.code[2] = b.code[2]),
        u AS (SELECT DISTINCT p, c FROM (SELECT * FROM p UNION ALL SELECT * FROM l)) SELECT lpad(u.p, 6, '0') AS "primary", lpad(u.c, 6, '0') AS code, CASE WHEN p.c IS NULL THEN lpad(u.c, 6, '0') ELSE 'pool ' || u.c END AS name, CASE WHEN u.c[2] = 'F' THEN 'fund' ELSE 'index' END AS kind FROM u LEFT JOIN p ON p.p = u.p AND p.c = u.c""",
    "w21_source_factors": SOURCES,
    "p10_linked_sources": f"WITH {BARS}, s AS (SELECT code, date, unnest(['open', 'volume']) AS source, unnest([open, volume]) AS value FROM bars), d AS (SELECT date FROM bars WHERE code = 'AF'), n AS (SELECT DISTINCT code, source FROM s WHERE code[2] = 'F') SELECT 'AF' AS code, CAST(d.date AS VARCHAR) AS date, n.code || '__' || n.source AS source, {num('s.value')} AS value FROM d CROSS JOIN n LEFT JOIN s ON s.code = n.code AND s.source = n.source AND s.date = d.date",
    "a16_trade_count": f"WITH {NAV}, {MA}, {bt()} SELECT code, CAST(count_if(traded = 1) AS BIGINT) AS trade_count, CAST(count_if(entries) AS BIGINT) AS entry_signals FROM bt GROUP BY code",
    "a12_return_metrics": f"WITH {NAV}, {MA}, {bt()}, {stats('bt', 'code')} SELECT code, {STATS} FROM st",
    "a12_metrics_with_rf": f"WITH {NAV}, rf AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders), c AS (SELECT d, 0.01::DOUBLE + 0.0001::DOUBLE * month(d) AS r FROM rf), {MA}, {bt()}, j AS (SELECT b.*, pow(1 + coalesce(c.r, (SELECT arg_min(r, d) FROM c)), 1 / 252.0::DOUBLE) - 1 AS rf FROM bt b ASOF LEFT JOIN c ON b.date >= c.d), {stats('j', 'code', 'rf')} SELECT code, {STATS} FROM st",
    "a15_mean_daily_return": f"WITH {NAV}, {MA}, {bt()}, dr AS (SELECT code, equity / lag(equity) OVER ({W}) - 1 AS x FROM bt) SELECT code, round(coalesce(avg(x), 0), 9) AS mean_daily_return FROM dr GROUP BY code",
    "j07_benchmark_curve": f"WITH {NAV}, {MA}, {bt()} SELECT code, {DAY}, {num(f'equity / first_value(equity) OVER ({W})')} AS strategy, {num(f'nav / first_value(nav) OVER ({W})')} AS fund FROM bt",
    "w33_segment_metrics": f"WITH {NAV}, {SPLIT}, {MA}, {bt()}, {SEGMENTED} SELECT code, segment, {STATS} FROM st",
    "t09_strategy_summary": f"WITH {ZED}, a AS (SELECT * FROM (WITH {HOLD} SELECT 'buy_and_hold' AS strategy, * FROM sig) UNION ALL SELECT * FROM (WITH {MA} SELECT 'ma_cross', * FROM sig) UNION ALL SELECT * FROM (WITH {MOM} SELECT 'momentum', * FROM sig) UNION ALL SELECT * FROM (WITH {MULTI} SELECT 'multi_factor_score', * FROM sig)), {bt('a', 'bt', 'code, strategy')}, {stats('bt', 'code, strategy')} SELECT code, strategy, {STATS}, row_number() OVER (PARTITION BY code ORDER BY round(sharpe, 6) DESC, round(annual_return, 6) DESC, strategy) AS place FROM st",
    "f01_ratio_split": f"WITH {NAV}, {SPLIT} SELECT code, segment, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos FROM bounds",
    "f02_walk_forward_folds": f"WITH {NAV}, sizes AS (SELECT code, count(*) AS n FROM nav GROUP BY code) SELECT code, CAST(k + 1 AS INTEGER) AS fold_id, segment, CAST(k * 60 + a AS BIGINT) AS start_pos, CAST(k * 60 + b AS BIGINT) AS end_pos FROM sizes, range(0, 60) t(k), (VALUES ('train', 0, 420), ('valid', 420, 560), ('test', 560, 700)) v(segment, a, b) WHERE k * 60 + 700 <= n",
    "f03_dynamic_step": f"WITH {NAV}, {FOLDS} SELECT code, CAST(step AS BIGINT) AS step, CAST((dev - 700) % step AS BIGINT) AS tail FROM steps",
    "f04_dev_folds": f"WITH {NAV}, {FOLDS} SELECT code, fold_id, segment, start_pos, end_pos FROM folds",
    "f05_context_split": f"WITH {NAV}, n AS (SELECT *, CAST(floor(count(*) OVER (PARTITION BY code) * 0.8::DOUBLE) AS BIGINT) AS cut FROM base) SELECT code, {DAY}, 'train' AS segment, false AS context FROM n WHERE pos <= cut UNION ALL SELECT code, {DAY}, 'valid', pos <= cut FROM n WHERE pos > cut - 30",
    "a01_ic_by_fold": f"WITH {ICS} SELECT code, candidate_label, fold_id, segment, n, {num('spearman_ic')} AS spearman_ic, {num('pearson_ic')} AS pearson_ic FROM ics",
    "a02_icir_classic": f"WITH {ICS}, {SUMM} SELECT code, candidate_label, segment, folds, {num('ic_mean')} AS ic_mean, {num('ic_std')} AS ic_std, {num('icir')} AS icir FROM summ",
    "a03_icir_exp_weighted": f"WITH {ICS}, k AS (SELECT *, pow(0.5::DOUBLE, (row_number() OVER (PARTITION BY code, candidate_label, segment ORDER BY fold_id DESC) - 1) / 3.0) AS w FROM ics WHERE spearman_ic IS NOT NULL), m AS (SELECT *, sum(w * spearman_ic) OVER p / sum(w) OVER p AS m FROM k WINDOW p AS (PARTITION BY code, candidate_label, segment)), s AS (SELECT code, candidate_label, segment, count(*) AS folds, any_value(m) AS ic_mean, sqrt(sum(w * pow(spearman_ic - m, 2)) / sum(w)) AS ic_std FROM m GROUP BY ALL) SELECT code, candidate_label, segment, folds, {num('ic_mean')} AS ic_mean, {num('ic_std')} AS ic_std, {num('CASE WHEN ic_std > 1e-12 THEN ic_mean / ic_std ELSE 0 END')} AS icir FROM s",
    "a05_positive_ratio": f"WITH {ICS}, {SUMM} SELECT code, candidate_label, segment, {num('positive_ratio')} AS positive_ratio FROM summ",
    "a06_trimmed_mean": f"WITH {ICS}, k AS (SELECT *, count(*) OVER (PARTITION BY code, candidate_label, segment) AS c, row_number() OVER (PARTITION BY code, candidate_label, segment ORDER BY spearman_ic) AS r FROM ics WHERE spearman_ic IS NOT NULL), g AS (SELECT *, CAST(floor(c * 0.1::DOUBLE) AS BIGINT) AS q FROM k) SELECT code, candidate_label, segment, {num('avg(spearman_ic)')} AS trimmed_mean FROM g WHERE c <= 2 * q OR (r > q AND r <= c - q) GROUP BY code, candidate_label, segment",
    "a07_flip_count": f"WITH {ICS}, k AS (SELECT *, sign(spearman_ic) AS s FROM ics WHERE abs(spearman_ic) > 1e-12), f AS (SELECT *, CAST(s <> lag(s) OVER (PARTITION BY code, candidate_label, segment ORDER BY fold_id) AS BIGINT) AS f FROM k) SELECT code, candidate_label, segment, CAST(coalesce(sum(f), 0) AS BIGINT) AS flips FROM f GROUP BY code, candidate_label, segment",
    "a08_tail_reject": f"WITH {RAW}, t AS (SELECT code, date, round(momentum, 9) AS momentum, round(volatility, 9) AS volatility FROM raws), k AS (SELECT *, CAST(floor(count(momentum) OVER p * 0.05::DOUBLE) AS BIGINT) AS k1, CAST(floor(count(volatility) OVER p * 0.05::DOUBLE) AS BIGINT) AS k2, row_number() OVER (PARTITION BY code ORDER BY momentum DESC NULLS LAST) AS r1, row_number() OVER (PARTITION BY code ORDER BY volatility DESC NULLS LAST) AS r2 FROM t WINDOW p AS (PARTITION BY code)), h AS (SELECT *, max(CASE WHEN r1 = k1 THEN momentum END) OVER (PARTITION BY code) AS t1, max(CASE WHEN r2 = k2 THEN volatility END) OVER (PARTITION BY code) AS t2 FROM k) SELECT code, {DAY}, coalesce(momentum >= t1, false) OR coalesce(volatility >= t2, false) AS tail_rejected FROM h",
    "t01_factor_selection": f"WITH {ICS}, {SUMM}, p AS (SELECT *, coalesce(train_ic_mean >= 0 AND train_icir >= 0 AND train_positive_ratio > 0.5, false) AS train_passed, coalesce(valid_ic_mean > 0 AND valid_icir > 0 AND valid_positive_ratio > 0.5, false) AS valid_passed FROM cand), q AS (SELECT *, train_passed AND valid_passed AS selected FROM p) SELECT code, candidate_label, {CAND}, train_passed, valid_passed, selected, CAST(CASE WHEN selected THEN row_number() OVER (PARTITION BY code, selected ORDER BY train_passed DESC, valid_passed DESC, valid_icir DESC NULLS LAST, valid_ic_mean DESC NULLS LAST, train_icir DESC NULLS LAST, candidate_label) END AS BIGINT) AS final_rank FROM q",
    "t02_stability_rank": f"""WITH {ICS}, {SUMM},
      tk AS (SELECT *, count(*) OVER (PARTITION BY code, candidate_label, segment) AS c, row_number() OVER (PARTITION BY code, candidate_label, segment ORDER BY spearman_ic) AS r FROM ics WHERE spearman_ic IS NOT NULL),
      tm AS (SELECT code, candidate_label, segment, avg(spearman_ic) AS t FROM (SELECT *, CAST(floor(c * 0.1::DOUBLE) AS BIGINT) AS q FROM tk) x WHERE c <= 2 * q OR (r > q AND r <= c - q) GROUP BY ALL),
      fl AS (SELECT code, candidate_label, CAST(coalesce(sum(f), 0) AS BIGINT) AS f FROM (SELECT code, candidate_label, CAST(sign(spearman_ic) <> lag(sign(spearman_ic)) OVER (PARTITION BY code, candidate_label ORDER BY fold_id) AS BIGINT) AS f FROM ics WHERE segment = 'valid' AND abs(spearman_ic) > 1e-12) y GROUP BY ALL),
      g AS (SELECT cand.*, a.t AS train_trimmed, b.t AS valid_trimmed, coalesce(fl.f, 0) AS valid_ic_flip_count, abs(train_ic_mean - valid_ic_mean) AS train_valid_ic_mean_gap, abs(valid_ic_mean - b.t) AS valid_trimmed_ic_gap
        FROM cand JOIN tm a ON a.code = cand.code AND a.candidate_label = cand.candidate_label AND a.segment = 'train' JOIN tm b ON b.code = cand.code AND b.candidate_label = cand.candidate_label AND b.segment = 'valid' LEFT JOIN fl ON fl.code = cand.code AND fl.candidate_label = cand.candidate_label)
      SELECT code, candidate_label, {CAND}, {num('train_trimmed')} AS train_trimmed, {num('valid_trimmed')} AS valid_trimmed, valid_ic_flip_count, {num('train_valid_ic_mean_gap')} AS train_valid_ic_mean_gap, {num('valid_trimmed_ic_gap')} AS valid_trimmed_ic_gap, false AS tail_rejected,
        CAST(row_number() OVER (PARTITION BY code ORDER BY valid_ic_mean DESC, valid_icir DESC, train_valid_ic_mean_gap, valid_ic_flip_count, valid_trimmed_ic_gap, candidate_label) AS BIGINT) AS stability_rank FROM g""",
    "a22_quality_filter": f"WITH {ZED}, l AS (SELECT code, '{FACTORS6[0]}' AS candidate_label, {FACTORS6[0]} AS raw, {FACTORS6[0]}_z AS value FROM zed {' '.join(f'''UNION ALL SELECT code, '{f}', {f}, {f}_z FROM zed''' for f in [*FACTORS6[1:], 'donchian_breakout'])}) SELECT code, candidate_label, {num('avg(CAST(raw IS NULL AS DOUBLE))')} AS raw_null_ratio, {num('avg(CAST(value = 0 AS DOUBLE))')} AS zero_ratio, avg(CAST(raw IS NULL AS DOUBLE)) > 0.2 OR avg(CAST(value = 0 AS DOUBLE)) > 0.8 AS dropped FROM l GROUP BY code, candidate_label",
    "a23_flip_detection": f"WITH {ICS} SELECT code, candidate_label, {num('avg(spearman_ic)')} AS ic_mean, CAST(count_if(spearman_ic < 0) AS BIGINT) AS negative, CAST(count_if(spearman_ic > 0) AS BIGINT) AS positive, avg(spearman_ic) < 0 AND count_if(spearman_ic < 0) > count_if(spearman_ic > 0) AS flipped FROM ics WHERE segment = 'train' GROUP BY code, candidate_label",
    "a09_mean_fold_corr": f"WITH {ZED}, {FOLDS}, {CORR} SELECT code, a, b, {num('mean_corr')} AS mean_corr FROM mc",
    "a10_corr_losers": f"WITH {ICS}, {SUMM}, {CORR}, {LOSERS} SELECT code, candidate_label, losses, {num('max_abs_corr')} AS max_abs_corr FROM losers",
    "t03_corr_drop": f"WITH {ICS}, {SUMM}, {CORR}, {LOSERS}, r AS (SELECT l.code, l.candidate_label, l.losses, row_number() OVER (PARTITION BY l.code ORDER BY losses DESC, train_icir, valid_icir, l.candidate_label) AS place FROM losers l JOIN cand USING (code, candidate_label)) SELECT code, candidate_label, losses, place FROM r WHERE place <= 2",
    "x13_equal_weights": f"WITH {ICS}, {SUMM} SELECT code, candidate_label, {num('1.0 / count(*) OVER (PARTITION BY code)')} AS weight FROM cand",
    "x13_icir_weights": f"WITH {ICS}, {SUMM}, g AS (SELECT code, candidate_label, greatest(coalesce(train_icir, 0), 0) AS p FROM cand) SELECT code, candidate_label, {num('CASE WHEN sum(p) OVER (PARTITION BY code) <= 1e-12 THEN 1.0 / count(*) OVER (PARTITION BY code) ELSE p / sum(p) OVER (PARTITION BY code) END')} AS weight FROM g",
    "x14_weighted_score_ic": f"WITH {ICS}, wsum AS (SELECT code, fold_id, segment, date, sum(coalesce(value, 0) * CASE candidate_label WHEN 'momentum' THEN 0.5 WHEN 'drawdown' THEN 0.3 ELSE 0.2 END) AS score, any_value(fwd) AS fwd FROM cut WHERE candidate_label IN ('momentum', 'drawdown', 'volatility') GROUP BY ALL), wr AS (SELECT code, fold_id, segment, round(score, 9) AS score, fwd FROM wsum), {ic_sql('wr', 'code, fold_id, segment', 'score', 'wi')} SELECT code, fold_id, segment, n, {num('spearman_ic')} AS spearman_ic, {num('pearson_ic')} AS pearson_ic FROM wi",
    "a21_score_quantiles": f"WITH {ZED} SELECT code, {num('quantile_cont(score, 0.1)')} AS q10, {num('quantile_cont(score, 0.5)')} AS q50, {num('quantile_cont(score, 0.9)')} AS q90, {num('min(score)')} AS low, {num('max(score)')} AS high FROM scored GROUP BY code",
    "x09_sigmoid": f"WITH {ZED} SELECT code, {DAY}, {num('1 / (1 + exp(-2.0 * (score - 0.1)))')} AS position FROM scored",
    "x09_tanh": f"WITH {ZED} SELECT code, {DAY}, {num('0.5 * ((exp(2 * 2.0 * (score - 0.1)) - 1) / (exp(2 * 2.0 * (score - 0.1)) + 1) + 1)')} AS position FROM scored",
    "x09_piecewise": f"WITH {ZED} SELECT code, {DAY}, {num('greatest(0.0, least(1.0, (score + 0.2) / 0.7))')} AS position FROM scored",
    "w29_ema": f"WITH {SCORES}, {GATE} SELECT code, {DAY}, {num('smoothed')} AS smoothed FROM target",
    "w30_gate": f"WITH {SCORES}, {GATE} SELECT code, {DAY}, {num('target')} AS target FROM target",
    "x08_continuous_backtest": f"WITH {SCORES}, {GATE}, {CONT} SELECT code, {DAY}, {num('held')} AS held, {num('turnover')} AS turnover, {num('strategy_return')} AS strategy_return, {num('ln(equity)')} AS log_equity FROM cb",
    "a13_fold_aggregate": f"WITH {SCORES}, {FOLDS}, {GATE}, {CONT}, cp AS (SELECT c.code, c.date, c.equity, c.turnover, b.pos FROM cb c JOIN base b USING (code, date)), cf AS (SELECT c.*, f.fold_id, f.segment FROM cp c JOIN folds f ON f.code = c.code AND c.pos - 1 >= f.start_pos AND c.pos - 1 < f.end_pos), {stats('cf', 'code, fold_id, segment')}, tc AS (SELECT code, fold_id, segment, count_if(turnover > 1e-12) AS trade_count FROM cf GROUP BY ALL) SELECT code, segment, {', '.join(f'{num(f"avg({c})")} AS {c}' for c in ('cumulative_return', 'annual_return', 'annual_volatility', 'sharpe', 'max_drawdown'))}, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM st JOIN tc USING (code, fold_id, segment) GROUP BY code, segment",
    "t10_topk_trials": f"WITH {NAV}, {TRIALS}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY value DESC NULLS LAST, trial_number) AS place FROM trials) SELECT code, trial_number, {num('value')} AS value, place FROM r WHERE place <= 12",
    "t11_running_best": f"WITH {NAV}, {TRIALS}, r AS (SELECT *, max(value) OVER (PARTITION BY code ORDER BY trial_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM trials) SELECT code, trial_number, {num('value')} AS value FROM r WHERE value IS NOT NULL AND (b IS NULL OR value > b)",
    "x21_objective": f"WITH {NAV}, {MA}, {bt()}, {stats('bt', 'code')} SELECT code, {num('sharpe - 0.2 * abs(least(0.0, max_drawdown))')} AS objective FROM st",
    "p08_lookback_samples": f"WITH {NAV}, l AS (SELECT code, date, ret AS y, {', '.join(f'lag(ret, {k}) OVER ({W}) AS x{k}' for k in (1, 2, 3, 4, 5))} FROM base) SELECT code, {DAY}, {num('y')} AS y, {num('x1')} AS newest, {num('x5')} AS oldest, {num('x1 + x2 + x3 + x4 + x5')} AS total FROM l WHERE y IS NOT NULL AND x5 IS NOT NULL",
    "t12_cross_section_topk": f"WITH {NAV}, m AS (SELECT code, date, {pct('nav', 20)} AS score FROM base), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS place FROM m WHERE score IS NOT NULL) SELECT code, {DAY}, {num('score')} AS score, place FROM r WHERE place <= 2 AND score > 0",
    "a19_rank_ic": f"WITH {NAV}, {FRANK}, p AS (SELECT r.date, r.code, r.future_rank, m.x FROM ranked r JOIN (SELECT code, date, {pct('nav', 20)} AS x FROM base) m USING (code, date) WHERE m.x IS NOT NULL AND r.future_rank IS NOT NULL), k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x DESC) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY future_rank) + (count(*) OVER (PARTITION BY date, future_rank) - 1) / 2.0 AS b FROM p), d AS (SELECT date, count(*) AS n, covar_pop(a, b) / nullif(CASE WHEN least(stddev_pop(a), stddev_pop(b)) >= 1e-12 THEN stddev_pop(a) * stddev_pop(b) END, 0) AS ic FROM k GROUP BY date) SELECT {num('avg(ic)')} AS mean_rank_ic, count(*) AS days FROM d WHERE n >= 2 AND ic IS NOT NULL",
    "a20_group_sizes": f"WITH {NAV} SELECT {DAY}, count(*) AS size FROM nav GROUP BY date",
}
