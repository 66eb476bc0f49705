"""DuckDB SQL of regression tests: nested least squares by elimination, and tail probabilities by series."""

from __future__ import annotations

#: Terms of the power series; they rise and fall well within these.
TERMS = 3000


def chi2_sf_sql(x: str, df: int) -> str:
    """Chance of a chi-square number above x: one minus the series of the lower incomplete gamma function."""
    a, z = f"{df / 2.0!r}::DOUBLE", f"(greatest({x}, 1e-300) / 2.0::DOUBLE)"
    return f"(1 - list_sum(list_transform(range(0, {TERMS}), lambda k: exp(({a} + k) * ln({z}) - {z} - lgamma({a} + k + 1)))))"


def f_sf_sql(x: str, df1: int, df2: str) -> str:
    """Chance of an F number above x: one minus the series of the incomplete beta function."""
    a, b = f"{df1 / 2.0!r}::DOUBLE", f"({df2} / 2.0::DOUBLE)"
    y = f"({df1} * greatest({x}, 1e-300) / ({df1} * greatest({x}, 1e-300) + {df2}))"
    term = f"exp(({a} + k) * ln({y}) + {b} * ln(1 - {y}) + lgamma({a} + {b} + k) - lgamma({a} + k + 1) - lgamma({b}))"
    return f"(1 - list_sum(list_transform(range(0, {TERMS}), lambda k: {term})))"


def nested_rss_sql(rows: str, keys: str, size: int, short_at: int) -> str:
    """keys, m, short, long: residual sums of squares of z{size-1} on a constant and z1.. of the table `rows`.

    Of the columns z1 to z{size-2}, short has those before z{short_at} and long has all.
    """
    z, last = ["1.0::DOUBLE", *[f"z{i}" for i in range(1, size)]], size - 1
    step = f"SELECT {keys}, count(*) AS m, " + ", ".join(f"sum({z[i]} * {z[j]}) AS g{i}_{j}" for i in range(size) for j in range(i, size)) + f" FROM {rows} GROUP BY {keys}"
    for p in range(last):
        short = f"g{last}_{last} AS short, " if p == short_at else "short, " if p > short_at else ""
        rest = [f"g{i}_{j} - g{p}_{i} * g{p}_{j} / nullif(g{p}_{p}, 0) AS g{i}_{j}" for i in range(p + 1, size) for j in range(i, size)]
        step = f"SELECT {keys}, m, {short}" + ", ".join(rest) + f" FROM ({step})"
    return f"SELECT {keys}, m, short, g{last}_{last} AS long FROM ({step})"


def granger_sql(source: str, max_lag: int, name: str = "granger") -> list[str]:
    """CTEs up to `name`: granger_tests of the table source (cause, effect, week_end, x, y)."""
    w = "(PARTITION BY cause, effect ORDER BY week_end)"
    ctes = [f"""{name}_c AS (SELECT cause, effect, week_end, x - avg(x) OVER k AS x, y - avg(y) OVER k AS y, count(*) OVER k AS n, row_number() OVER (k ORDER BY week_end) AS place
      FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL WINDOW k AS (PARTITION BY cause, effect))"""]
    parts = []
    for lag in range(1, max_lag + 1):
        past = [f"lag({v}, {k}) OVER w AS z{k + (lag if v == 'x' else 0)}" for v in ("y", "x") for k in range(1, lag + 1)]
        size = 2 * lag + 2
        ctes.append(f"{name}_z{lag} AS (SELECT * FROM (SELECT cause, effect, n, place, y AS z{size - 1}, {', '.join(past)} FROM {name}_c WINDOW w AS {w}) WHERE place > {lag})")
        ctes.append(f"""{name}_{lag} AS (SELECT cause, effect, n, m - {2 * lag + 1} AS df, (short - long) / {lag} / (long / (m - {2 * lag + 1})) AS f, m * (short - long) / long AS chi
          FROM ({nested_rss_sql(f'{name}_z{lag}', 'cause, effect, n', size, lag + 1)}))""")
        parts.append(f"SELECT cause, effect, {lag}::INTEGER AS lag, f AS f_stat, {f_sf_sql('f', lag, 'df')} AS f_p, chi AS chi2_stat, {chi2_sf_sql('chi', lag)} AS chi2_p, n FROM {name}_{lag}")
    return [*ctes, f"{name} AS ({' UNION ALL '.join(parts)})"]


GRANGER_COLUMNS = "cause, effect, lag, round(f_stat, 5) AS f_stat, round(f_p, 5) AS f_p, round(chi2_stat, 5) AS chi2_stat, round(chi2_p, 5) AS chi2_p, n"


def screening_sql(source: str = "granger", name: str = "screen") -> str:
    """CTE of screening() over granger tests."""
    return f"""{name} AS (SELECT cause, effect, p, best_lag, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS sig,
      CASE WHEN p < 0.05 THEN 'include' ELSE 'exclude' END AS verdict
      FROM (SELECT cause, effect, min(chi2_p) AS p, arg_min(lag, (chi2_p, lag)) AS best_lag FROM {source} GROUP BY 1, 2))"""


def diagnostics_sql(source: str, lags: int = 10, arch_lags: int = 5) -> list[str]:
    """CTEs up to diag: diagnostics() of the table source (week_end, series, value)."""
    past = ", ".join(f"lag(e*e, {k}) OVER w AS z{k}" for k in range(1, arch_lags + 1))
    sums = ", ".join(f"sum(e * lag{k}) AS a{k}" for k in range(1, lags + 1))
    lagged = ", ".join(f"lag(e, {k}) OVER w AS lag{k}" for k in range(1, lags + 1))
    shares = " + ".join(["0.0::DOUBLE"])
    tails = []
    for k in range(1, lags + 1):
        shares += f" + power(a{k} / v, 2) / (n - {k})"
        tails.append(chi2_sf_sql(f"(n * (n + 2) * ({shares}))", k))
    w = "WINDOW w AS (PARTITION BY series ORDER BY week_end)"
    return [
        f"dv AS (SELECT series, week_end, value FROM {source} WHERE value IS NOT NULL)",
        "dc AS (SELECT series, week_end, value, value - avg(value) OVER (PARTITION BY series) AS e FROM dv)",
        f"""dl AS (SELECT series, least({', '.join(tails)}) AS lb_min_p FROM (SELECT series, sum(e*e) AS v, count(*)::DOUBLE AS n, {sums} FROM (SELECT series, e, {lagged} FROM dc {w}) GROUP BY 1))""",
        f"""dz AS (SELECT * FROM (SELECT series, row_number() OVER w AS place, e*e AS z{arch_lags + 1}, {past} FROM (SELECT series, week_end, value / max(abs(value)) OVER (PARTITION BY series) AS e FROM dv) {w}) WHERE place > {arch_lags})""",
        f"da AS (SELECT series, m * (1 - long / short) AS lm FROM ({nested_rss_sql('dz', 'series', arch_lags + 2, 1)}))",
        """dm AS (SELECT series, count(*)::DOUBLE AS n, avg(e*e*e) / power(avg(e*e), 1.5) AS skew, avg(e*e*e*e) / power(avg(e*e), 2) - 3 AS kurtosis FROM dc GROUP BY 1)""",
        f"""diag AS (SELECT series, lb_min_p, lm AS arch_stat, {chi2_sf_sql('lm', arch_lags)} AS arch_p, n / 6 * (power(skew, 2) + power(kurtosis, 2) / 4) AS jb_stat,
          exp(-n / 12 * (power(skew, 2) + power(kurtosis, 2) / 4)) AS jb_p, skew, kurtosis FROM dl JOIN da USING (series) JOIN dm USING (series))""",
    ]


def projection_sql(source: str, horizons) -> list[str]:
    """CTEs up to proj: projection_tests with two lags of the table source (cause, effect, week_end, x, y).

    The lags of x and the lead of y, made orthogonal to a constant and the lags of y, give the same
    Wald number as the whole regression: with g their cross products and M the weighted products of the
    scores, it is g' M^-1 g.
    """
    keys = "cause, effect, horizon"
    grid = ", ".join(f"({h})" for h in horizons)
    leads = "CASE " + " ".join(f"WHEN horizon = {h} THEN lead(y, {h}) OVER w" for h in horizons) + " END"
    along = "sum({v} * {u}) OVER k / sum({u} * {u}) OVER k"
    window = f"WINDOW k AS (PARTITION BY {keys})"

    def without(u: str, columns: list[str]) -> str:
        return ", ".join(f"{v} - {along.format(v=v, u=u)} * {u} AS {v}" for v in columns)

    return [
        f"""p0 AS (SELECT * FROM (SELECT {keys}, row_number() OVER w AS place, y AS u, lag(y) OVER w AS v, x AS a, lag(x) OVER w AS b, {leads} AS t
          FROM {source}, (VALUES {grid}) h(horizon) WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY {keys} ORDER BY week_end)) WHERE place > 1 AND t IS NOT NULL)""",
        f"p1 AS (SELECT {keys}, place, {', '.join(f'{v} - avg({v}) OVER k AS {v}' for v in 'uvabt')} FROM p0 {window})",
        f"p2 AS (SELECT {keys}, place, {without('u', ['v', 'a', 'b', 't'])} FROM p1 {window})",
        f"p3 AS (SELECT {keys}, place, {without('v', ['a', 'b', 't'])} FROM p2 {window})",
        f"p4 AS (SELECT *, {without('a', ['b']).replace(' AS b', ' AS c')}, t - {along.format(v='t', u='a')} * a AS r FROM p3 {window})",
        f"p5 AS (SELECT {keys}, place, a, b, t, r - {along.format(v='r', u='c')} * c AS e FROM p4 {window})",
        f"g AS (SELECT {keys}, count(*) AS n, sum(a * t) AS ga, sum(b * t) AS gb FROM p5 GROUP BY ALL)",
        f"""m AS (SELECT cause, effect, horizon, sum(w * sa * ta) AS maa, sum(w * sa * tb) AS mab, sum(w * sb * tb) AS mbb FROM (
          SELECT p.cause, p.effect, p.horizon, 1 - abs(p.place - q.place) / (greatest(p.horizon, 2) + 1.0::DOUBLE) AS w, p.a * p.e AS sa, p.b * p.e AS sb, q.a * q.e AS ta, q.b * q.e AS tb
          FROM p5 p JOIN p5 q ON p.cause = q.cause AND p.effect = q.effect AND p.horizon = q.horizon AND q.place BETWEEN p.place - greatest(p.horizon, 2) AND p.place + greatest(p.horizon, 2)) GROUP BY ALL)""",
        f"""wd AS (SELECT {keys}, n, (ga * ga * mbb - 2 * ga * gb * mab + gb * gb * maa) / (maa * mbb - mab * mab) * (n - 5) / n / 2 AS wald_f FROM g JOIN m USING ({keys}))""",
        f"proj AS (SELECT {keys}, wald_f, power(1 + 2 * wald_f / (n - 5), -(n - 5) / 2.0::DOUBLE) AS p_value, n FROM wd)",
    ]


def lag_selection_sql(source: str, columns: list[str], max_lag: int) -> list[str]:
    """CTEs up to orders: p, aic, bic, hq of vector autoregressions of the table source (week_end, columns)."""
    k = len(columns)
    size = 1 + k * (max_lag + 1)
    z = ["1.0::DOUBLE", *[f"z{i}" for i in range(1, size)]]
    past = [f"lag({c}, {p}) OVER w AS z{1 + k * (p - 1) + i}" for p in range(1, max_lag + 1) for i, c in enumerate(columns)] + [f"{c} AS z{1 + k * max_lag + i}" for i, c in enumerate(columns)]
    ctes = [
        f"v0 AS (SELECT week_end, {', '.join(f'{c} - avg({c}) OVER () AS {c}' for c in columns)} FROM {source})",
        f"v1 AS (SELECT * FROM (SELECT row_number() OVER w AS place, {', '.join(past)} FROM v0 WINDOW w AS (ORDER BY week_end)) WHERE place > {max_lag})",
        "e0 AS MATERIALIZED (SELECT count(*)::DOUBLE AS m, " + ", ".join(f"sum({z[i]} * {z[j]}) AS g{i}_{j}" for i in range(size) for j in range(i, size)) + " FROM v1)",
    ]
    t = 1 + k * max_lag
    for p in range(t):
        rest = [f"g{i}_{j} - g{p}_{i} * g{p}_{j} / g{p}_{p} AS g{i}_{j}" for i in range(p + 1, size) for j in range(i, size)]
        ctes.append(f"e{p + 1} AS MATERIALIZED (SELECT m, {', '.join(rest)} FROM e{p})")
    a, b, c, d, e, f = (f"g{t + i}_{t + j}" for i in range(3) for j in range(i, 3))
    det = f"({a} * ({d} * {f} - {e} * {e}) - {b} * ({b} * {f} - {e} * {c}) + {c} * ({b} * {e} - {d} * {c}))"
    rows = " UNION ALL ".join(f"SELECT {p}::INTEGER AS p, m, ln({det} / power(m, 3)) AS ld, {k * (1 + k * p)}::DOUBLE AS k FROM e{1 + k * p}" for p in range(1, max_lag + 1))
    return [*ctes, f"orders AS (SELECT p, ld + 2 * k / m AS aic, ld + ln(m) * k / m AS bic, ld + 2 * ln(ln(m)) * k / m AS hq FROM ({rows}))"]


def eliminated(source: str, keys: str, columns: list[str], kept: dict[int, str], name: str) -> list[str]:
    """CTEs {name}0, {name}1, ...: the cross products of columns by keys, with one column after the other taken out of the rest.

    The last column's sum of squares before column number i goes is kept under the name kept[i]. Columns of zeros are passed over.
    """
    size, held = len(columns), ""
    last = size - 1
    out = [f"{name}0 AS MATERIALIZED (SELECT {keys}, count(*) AS m, " + ", ".join(f"sum(({columns[i]}) * ({columns[j]})) AS g{i}_{j}" for i in range(size) for j in range(i, size)) + f" FROM {source} GROUP BY {keys})"]
    for p in range(last):
        if p in kept:
            held += f", g{last}_{last} AS {kept[p]}"
        rest = [f"CASE WHEN g{p}_{p} > 1e-9 THEN g{i}_{j} - g{p}_{i} * g{p}_{j} / g{p}_{p} ELSE g{i}_{j} END AS g{i}_{j}" for i in range(p + 1, size) for j in range(i, size)]
        out.append(f"{name}{p + 1} AS MATERIALIZED (SELECT {keys}, m{held}, {', '.join(rest)} FROM {name}{p})")
        held = "".join(f", {n}" for i, n in kept.items() if i <= p)
    return out


def stationarity_sql(source: str, longest: int = 20, least: int = 30, name: str = "st") -> list[str]:
    """CTEs up to `name`: stationarity() of the table source (series, week_end, value); lags up to `longest`, which no series here exceeds."""
    n, lags = name, range(1, longest + 1)
    w = "WINDOW w AS (PARTITION BY series ORDER BY week_end)"
    along = "WINDOW w AS (PARTITION BY series ORDER BY t)"
    zero = lambda top: [f"CASE WHEN {k} <= {top} THEN l{k} ELSE 0 END" for k in lags]
    left = lambda k: f"r{k}" if k < longest else f"g{k + 2}_{k + 2}"
    aics = ", ".join(f"CASE WHEN {k} <= top THEN m * ln(greatest({left(k)}, 1e-300) / m) + {2 * (k + 2)} END" for k in (0, *lags))
    tail = lambda x: f"(CASE WHEN {x} < 0 THEN {chi2_sf_sql(f'({x} * {x})', 1)} / 2 ELSE 1 - {chi2_sf_sql(f'({x} * {x})', 1)} / 2 END)"
    small, large = "(2.1659 + 1.4412 * tau + 0.038269 * tau * tau)", "(1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau)"
    return [
        f"""{n}_v AS (SELECT * FROM (SELECT series, week_end, (value - avg(value) OVER s) / nullif(stddev_pop(value) OVER s, 0) AS e, count(*) OVER s AS n, row_number() OVER (s ORDER BY week_end) - 1 AS t
          FROM {source} WHERE value IS NOT NULL WINDOW s AS (PARTITION BY series)) WHERE n >= {least} AND e IS NOT NULL)""",
        f"{n}_d AS (SELECT * FROM (SELECT series, n, t, e AS level, lead(e) OVER w - e AS d, least(ceil(12.0 * power(n / 100.0, 0.25)), n // 2 - 2)::INTEGER AS top FROM {n}_v {w}) WHERE d IS NOT NULL)",
        f"{n}_l AS (SELECT *, {', '.join(f'lag(d, {k}) OVER w AS l{k}' for k in lags)} FROM {n}_d {along})",
        *eliminated(f"(SELECT * FROM {n}_l WHERE t >= top)", "series, top", ["1.0::DOUBLE", "level", *zero("top"), "d"], {k + 2: f"r{k}" for k in (0, *lags[:-1])}, f"{n}_a"),
        f"{n}_k AS (SELECT series, list_position(a, list_min(a)) - 1 AS lags FROM (SELECT series, [{aics}] AS a FROM {n}_a{longest + 2}))",
        *eliminated(f"(SELECT x.*, lags FROM {n}_l x JOIN {n}_k USING (series) WHERE t >= lags)", "series, lags", ["1.0::DOUBLE", *zero("lags"), "level", "d"], {}, f"{n}_b"),
        f"""{n}_t AS (SELECT series, lags, a / sqrt((c - b * b / g) / (m - lags - 2) / g) AS tau FROM (SELECT series, lags, m, g{longest + 1}_{longest + 2} / g{longest + 1}_{longest + 1} AS a, g{longest + 1}_{longest + 1} AS g,
          g{longest + 1}_{longest + 2} AS b, g{longest + 2}_{longest + 2} AS c FROM {n}_b{longest + 1}))""",
        f"{n}_p AS (SELECT series, lags, tau, CASE WHEN tau > 2.74 THEN 1.0 WHEN tau < -18.83 THEN 0.0 ELSE {tail('z')} END AS p FROM (SELECT *, CASE WHEN tau <= -1.61 THEN {small} ELSE {large} END AS z FROM {n}_t))",
        # level stationarity: bandwidth from lagged products, then the weighted variance, then the sums of sums
        f"{n}_w AS (SELECT x.series, x.t - y.t AS i, any_value(x.n) AS n, sum(x.e * y.e) / any_value(x.n) AS c FROM {n}_v x JOIN {n}_v y ON x.series = y.series AND y.t BETWEEN x.t - 200 AND x.t GROUP BY 1, 2)",
        f"""{n}_g AS (SELECT series, any_value(n) AS n, least(floor(1.1447 * power(power(2 * sum(i * c) FILTER (i BETWEEN 1 AND floor(power(n, 2.0 / 9))) / (any_value(c) FILTER (i = 0) + 2 * sum(c) FILTER (i BETWEEN 1 AND floor(power(n, 2.0 / 9)))), 2), 1.0 / 3)
          * power(any_value(n), 1.0 / 3)), any_value(n) - 1) AS width FROM {n}_w GROUP BY series)""",
        f"{n}_s AS (SELECT series, any_value(width)::INTEGER AS width, sum(CASE WHEN i = 0 THEN c ELSE 2 * (1 - i / (width + 1)) * c END) FILTER (i <= width) AS v FROM {n}_w JOIN {n}_g USING (series) GROUP BY series)",
        f"{n}_q AS (SELECT series, sum(s * s) / any_value(n * n) AS u FROM (SELECT series, n, sum(e) OVER (PARTITION BY series ORDER BY t) AS s FROM {n}_v) GROUP BY series)",
        f"""{n}_h AS (SELECT series, width, stat, CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - 0.05 * (stat - 0.347) / 0.116 WHEN stat <= 0.574 THEN 0.05 - 0.025 * (stat - 0.463) / 0.111
          WHEN stat <= 0.739 THEN 0.025 - 0.015 * (stat - 0.574) / 0.165 ELSE 0.01 END AS p FROM (SELECT series, width, u / v AS stat FROM {n}_q JOIN {n}_s USING (series)))""",
        f"""{name} AS (SELECT k.series, t.tau AS adf_stat, CASE WHEN t.p IS NOT NULL THEN greatest(t.p, 0.0) END AS adf_p, t.lags::INTEGER AS adf_lags, h.stat AS kpss_stat, h.p AS kpss_p, h.width AS kpss_lags,
          CASE WHEN t.p IS NULL THEN 'UNDEFINED' WHEN t.p < 0.05 AND h.p >= 0.05 THEN 'STATIONARY' WHEN t.p >= 0.05 AND h.p < 0.05 THEN 'NON_STATIONARY' WHEN t.p < 0.05 THEN 'TREND_STATIONARY' ELSE 'INCONCLUSIVE' END AS verdict
          FROM (SELECT DISTINCT series FROM {source}) k LEFT JOIN {n}_p t USING (series) LEFT JOIN {n}_h h USING (series))""",
    ]


def lag_robustness_sql(source: str, columns: list[str], max_lag: int) -> list[str]:
    """CTEs up to robust: lag_robustness of the table source (week_end, columns): each regressor is taken out of the rows in turn, order by order."""
    k, orders = len(columns), ", ".join(f"({p})" for p in range(1, max_lag + 1))
    zs = [f"z{i}" for i in range(k * max_lag)]
    past = ", ".join(f"CASE WHEN p >= {lag} THEN lag({c}, {lag}) OVER w ELSE 0 END AS z{k * (lag - 1) + i}" for lag in range(1, max_lag + 1) for i, c in enumerate(columns))
    out = [
        f"u0 AS (SELECT p, place, {', '.join(f'{c} AS y{i}' for i, c in enumerate(columns))}, {past} FROM (SELECT *, row_number() OVER (ORDER BY week_end) AS place FROM {source}), (VALUES {orders}) o(p) WINDOW w AS (PARTITION BY p ORDER BY place))",
        f"u1 AS MATERIALIZED (SELECT p, place, {', '.join(f'{v} - avg({v}) OVER (PARTITION BY p) AS {v}' for v in [*zs, *[f'y{i}' for i in range(k)]])} FROM u0 WHERE place > p)",
    ]
    for i, u in enumerate(zs):
        rest = [*zs[i + 1 :], *[f"y{j}" for j in range(k)]]
        spread = f"sum({u} * {u}) OVER o"
        out.append(f"u{i + 2} AS MATERIALIZED (SELECT p, place, {', '.join(f'CASE WHEN {spread} > 1e-12 THEN {v} - sum({v} * {u}) OVER o / ({spread}) * {u} ELSE {v} END AS {v}' for v in rest)} FROM u{i + 1} WINDOW o AS (PARTITION BY p))")
    left = f"u{len(zs) + 1}"
    s = lambda i, j: f"(sum(y{i} * y{j}) / count(*))"
    det = f"({s(0, 0)} * ({s(1, 1)} * {s(2, 2)} - {s(1, 2)} * {s(1, 2)}) - {s(0, 1)} * ({s(0, 1)} * {s(2, 2)} - {s(1, 2)} * {s(0, 2)}) + {s(0, 2)} * ({s(0, 1)} * {s(1, 2)} - {s(1, 1)} * {s(0, 2)}))"
    z, a = "(greatest(q, 1e-300) / 2)", "(lag / 2.0::DOUBLE)"
    tail = f"(1 - list_sum(list_transform(range(0, {TERMS}), lambda k: exp(({a} + k) * ln({z}) - {z} - lgamma({a} + k + 1)))))"
    return [
        *out,
        f"ld AS (SELECT p, count(*)::DOUBLE AS n, ln({det}) AS ld, {k} * (1 + {k} * p)::DOUBLE AS k FROM {left} GROUP BY p)",
        f"le AS (SELECT p, place, unnest([{', '.join(repr(c) for c in columns)}]) AS series, unnest([{', '.join(f'y{i}' for i in range(k))}]) AS e FROM {left})",
        f"lc AS (SELECT x.p, x.series, x.place - y.place AS lag, sum(x.e * y.e) AS c FROM le x JOIN le y ON x.p = y.p AND x.series = y.series AND y.place BETWEEN x.place - 2 * x.p AND x.place GROUP BY ALL)",
        "lq AS (SELECT p, series, lag, n * (n + 2) * sum(power(c / v, 2) / (n - lag)) OVER (PARTITION BY p, series ORDER BY lag) AS q FROM lc JOIN (SELECT p, series, c AS v FROM lc WHERE lag = 0) USING (p, series) JOIN ld USING (p) WHERE lag > 0)",
        f"lw AS (SELECT p, series, greatest(min({tail}), 0.0) AS tail FROM lq GROUP BY p, series)",
        """robust AS (SELECT p, ld + 2 * k / n AS aic, ld + ln(n) * k / n AS bic, n_failures, worst_series, min_p FROM ld JOIN (SELECT p, sum((tail < 0.05)::INTEGER)::INTEGER AS n_failures, arg_min(series, (tail, series)) AS worst_series, min(tail) AS min_p FROM lw GROUP BY p) USING (p))""",
    ]


def iterated_sql(source: str, keys: str, columns: list[str], horizons, lags: int, decay: float | None = None, name: str = "it") -> list[str]:
    """CTEs up to `name`: gram.iterated_forecasts of the table source (keys, week_end, columns): running sums, elimination, and one CTE a step ahead."""
    n, k, size = name, len(columns), 1 + len(columns) * lags
    z = ["1.0::DOUBLE", *[f"l{i}" for i in range(k * lags)], *[f"y{i}" for i in range(k)]]
    weight = "1.0::DOUBLE" if decay is None else f"power({1.0 / decay!r}::DOUBLE, place)"
    w = f"(PARTITION BY {keys} ORDER BY week_end)"
    past = ", ".join(f"lag(y{i}, {lag}) OVER {w} AS l{k * (lag - 1) + i}" for lag in range(1, lags + 1) for i in range(k))
    means = ", ".join(f"mean{i}" for i in range(k))
    last = ", ".join(f"{f'y{i}' if lag == 0 else f'l{k * (lag - 1) + i}'} AS h{k * lag + i}" for lag in range(lags) for i in range(k))
    base = f"{keys}, week_end, n_fit, wt, {means}, " + ", ".join(f"h{i}" for i in range(k * lags))
    step = f"SELECT {keys}, week_end, {means}, {last}, count(*) OVER u AS n_fit, sum({weight}) OVER u AS wt, " + ", ".join(f"sum({weight} * {z[i]} * {z[j]}) OVER u AS g{i}_{j}" for i in range(size + k) for j in range(i, size + k)) + f" FROM {n}_l WINDOW u AS (PARTITION BY {keys} ORDER BY week_end ROWS UNBOUNDED PRECEDING)"
    for p in range(size):
        kept = [f"g{i}_{j}" for i in range(p + 1) for j in range(i, size + k)]
        step = f"SELECT {base}, " + ", ".join(kept + [f"g{i}_{j} - g{p}_{i} * g{p}_{j} / nullif(g{p}_{p}, 0) AS g{i}_{j}" for i in range(p + 1, size + k) for j in range(i, size + k)]) + f" FROM ({step})"
    for y in range(k):
        for p in reversed(range(size)):
            step = f"SELECT *, (g{p}_{size + y}" + "".join(f" - g{p}_{q} * c{y}_{q}" for q in range(p + 1, size)) + f") / nullif(g{p}_{p}, 0) AS c{y}_{p} FROM ({step})"
    coefs = [f"c{y}_{p}" for y in range(k) for p in range(size)]
    sigma = lambda i, j: f"v{min(i, j)}{max(i, j)}"
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    start = [f"{1.0 if i == j else 0.0}::DOUBLE AS p{i}_{j}" for i in range(k) for j in range(k * lags)] + [f"0.0::DOUBLE AS s_{i}{j}" for i, j in pairs]
    shared = f"{keys}, week_end, n_fit, {means}, " + ", ".join([*coefs, *[sigma(i, j) for i, j in pairs]])
    out = [
        f"{n}_c AS (SELECT {keys}, week_end, row_number() OVER {w} AS place, {', '.join(f'{c} - avg({c}) OVER m AS y{i}, avg({c}) OVER m AS mean{i}' for i, c in enumerate(columns))} FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)} WINDOW m AS (PARTITION BY {keys}))",
        f"{n}_l AS (SELECT * FROM (SELECT *, {past} FROM {n}_c) WHERE place > {lags})",
        f"{n}_0 AS MATERIALIZED (SELECT {keys}, week_end, n_fit, {means}, {', '.join(coefs)}, " + ", ".join(f"g{size + i}_{size + j} / wt AS {sigma(i, j)}" for i, j in pairs) + ", " + ", ".join([*[f"h{i}" for i in range(k * lags)], *start]) + f" FROM ({step}) WHERE n_fit >= {2 + size})",
    ]
    for s in range(max(horizons)):
        ahead = [f"c{i}_0" + "".join(f" + c{i}_{1 + q} * h{q}" for q in range(k * lags)) + f" AS h{i}" for i in range(k)] + [f"h{i - k} AS h{i}" for i in range(k, k * lags)]
        added = [f"s_{i}{j} + " + " + ".join(f"p{i}_{a} * {sigma(a, b)} * p{j}_{b}" for a in range(k) for b in range(k)) + f" AS s_{i}{j}" for i, j in pairs]
        power = [" + ".join([f"p{i}_{m} * c{m}_{1 + j}" for m in range(k)] + ([f"p{i}_{j + k}"] if j + k < k * lags else [])) + f" AS p{i}_{j}" for i in range(k) for j in range(k * lags)]
        out.append(f"{n}_{s + 1} AS MATERIALIZED (SELECT {shared}, {', '.join([*ahead, *added, *power])} FROM {n}_{s})")
    told = ", ".join([f"h{i} + mean{i} AS forecast_{c}" for i, c in enumerate(columns)] + [f"s_{i}{j}" for i, j in pairs])
    return [*out, f"{name} AS (" + " UNION ALL ".join(f"SELECT {keys}, week_end, {h} AS horizon, n_fit, {told} FROM {n}_{h}" for h in horizons) + ")"]
