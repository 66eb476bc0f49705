"""Closed forms, published values and edge fixtures of the weekly engine."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from termforge.functions import columns, linear, special
from termforge.operators import calibrate, curve, deal, hypothesis, probability, regress, weekly
from termforge.sources import readers
from termforge.streaming.weekly import windowed_last

FRIDAYS = [dt.date(2000, 1, 7) + dt.timedelta(7 * i) for i in range(400)]


# distribution functions ---------------------------------------------------------------------
def test_distribution_functions_match_tables():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert special.chi2_ppf(0.95, 2) == pytest.approx(-2 * math.log(0.05), abs=1e-9)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.f_sf(3.0, 2, 2) == pytest.approx(1 / (1 + 3.0), abs=1e-12)
    assert special.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.norm_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)
    assert special.chi2_log_sf(5000, 10) == pytest.approx(math.log(special.gamma_q(5, 350)) + special.log_gamma_q(5, 2500) - special.log_gamma_q(5, 350), rel=1e-9)
    assert special.chi2_log_sf(2 * 700, 2) == pytest.approx(-700, rel=1e-12)


# calendar -----------------------------------------------------------------------------------
def test_weeks_end_on_friday(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 15)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", columns.week_end(F.col("d")).alias("w"), columns.is_weekday(F.col("d")).alias("k")).collect()
    for r in rows:
        assert r.w.weekday() == 4 and 0 <= (r.w - r.d).days < 7 and r.k == (r.d.weekday() < 5)


def test_week_last_skips_nulls_and_weekends(spark):
    rows = [(dt.date(2024, 1, 4), 1.0, 0), (dt.date(2024, 1, 5), None, 0), (dt.date(2024, 1, 6), 9.0, 0), (dt.date(2024, 1, 7), 9.0, 0), (dt.date(2024, 1, 4), 2.0, 1)]
    got = weekly.weekly_last(spark.createDataFrame(rows, "d date, v double, i int"), "d", [], ["v"], ["i"]).collect()
    assert [(r.week_end, r.v) for r in got] == [(dt.date(2024, 1, 5), 2.0)]


def test_fill_reaches_one_row_only(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, None, 2.0, None, None, 3.0])], "i int, v double")
    from pyspark.sql import Window

    got = [r.f for r in rows.select("i", weekly.fill_one("v", Window.orderBy("i")).alias("f")).orderBy("i").collect()]
    assert got == [1.0, 1.0, 2.0, 2.0, None, 3.0]


def test_flat_series_has_no_z_score(spark):
    rows = spark.createDataFrame([(w, 5.0) for w in FRIDAYS[:60]], "week_end date, v double")
    assert rows.select(weekly.rolling_z("v", weekly.by_week()).alias("z")).where("z is not null").count() == 0


def test_nearest_takes_the_later_on_ties(spark):
    left = spark.createDataFrame([(dt.date(2024, 1, 10),), (dt.date(2024, 2, 10),), (dt.date(2024, 3, 10),)], "t date")
    right = spark.createDataFrame([(dt.date(2024, 1, 8), 1), (dt.date(2024, 1, 12), 2), (dt.date(2024, 2, 14), 3), (dt.date(2024, 3, 10), 4), (dt.date(2024, 3, 11), 5)], "day date, v int")
    got = {r.t: r.v for r in weekly.nearest_within(left, "t", right, "day").collect()}
    assert got == {dt.date(2024, 1, 10): 2, dt.date(2024, 2, 10): None, dt.date(2024, 3, 10): 4}


# curves -------------------------------------------------------------------------------------
def exact_panel(spark, betas, decay, drop=()):
    rows = []
    for w, b in zip(FRIDAYS, betas):
        for m in range(1, 7):
            if (w, m) not in drop:
                _, s, c = columns.loadings(m, decay)
                rows.append((w, m, math.exp(b[0] + s * b[1] + c * b[2])))
    return spark.createDataFrame(rows, "week_end date, maturity int, price double")


def test_noiseless_curves_are_recovered(spark):
    betas = [(9.0 + 0.01 * i, 0.02 * (-1) ** i, 0.03 - 0.005 * i) for i in range(8)]
    drop = {(FRIDAYS[2], m) for m in (1, 4, 6)} | {(FRIDAYS[3], m) for m in (1, 2, 3, 4)}
    got = curve.factors(exact_panel(spark, betas, 1.95, drop), range(1, 7), 1.95).orderBy("week_end").collect()
    for i, r in enumerate(got):
        if i == 3:
            assert r.beta0 is None and r.n_maturities == 2
        else:
            assert (r.beta0, r.beta1, r.beta2) == pytest.approx(betas[i], abs=1e-8)
            assert r.rmse < 1e-8


def test_grid_finds_the_decay(spark):
    panel = exact_panel(spark, [(9.0, 0.05, -0.04), (9.1, -0.03, 0.02)], 2.4)
    best = curve.best_decay(curve.grid_rmse(panel, range(1, 7), (1.2, 1.95, 2.4, 4.0))).first()
    assert best.decay == 2.4
    rmse, agree = curve.grid_rmse(panel, range(1, 7), (1.2, 1.95, 2.4, 4.0)).collect(), curve.grid_agreement(panel, range(1, 7), (1.2, 1.95, 2.4, 4.0)).collect()
    assert curve.choose_decay(rmse, agree, flat=0.0) == (2.4, "rmse") and curve.choose_decay(rmse, agree, flat=1.0)[1] == "agreement"
    assert curve.choose_decay([Row(decay=1.0, mean_rmse=0.1), Row(decay=2.0, mean_rmse=0.2)], [Row(decay=2.0, agreement_pct=90.0), Row(decay=1.0, agreement_pct=80.0)]) == (2.0, "agreement")


def test_loadings_limit_and_wide_fit(spark):
    assert columns.loadings(0.0, 1.95) == (1.0, 1.0, 0.0)
    assert columns.loadings(1e-10, 1.95) == (1.0, 1.0, 0.0)
    assert deal.remaining_maturity(3, 13) == 0.0
    panel = exact_panel(spark, [(9.0, 0.05, -0.04), (9.1, -0.03, 0.02)], 1.95)
    wide = weekly.to_wide(panel, range(1, 7))
    fit = curve.fit_wide(wide, range(1, 7), (1.95,)).orderBy("week_end").collect()
    assert (fit[0].beta0, fit[0].beta1, fit[0].beta2) == pytest.approx((9.0, 0.05, -0.04), abs=1e-9)
    with pytest.raises(ValueError):
        curve.fit_wide(wide, range(1, 7), (1.95, 1.95))


def test_seasonal_z_of_a_single_observation_is_zero(spark):
    rows = spark.createDataFrame([(dt.date(2020, 12, 31), 0.5), (dt.date(2019, 3, 1), 1.0), (dt.date(2018, 3, 2), 3.0)], "week_end date, beta1 double")
    got = {r.week_end: r.beta1_zscore for r in curve.seasonal_z(rows, dt.date(2021, 1, 1)).collect()}
    assert got[dt.date(2020, 12, 31)] == 0.0 and got[dt.date(2019, 3, 1)] == pytest.approx(-1 / math.sqrt(2))


# regressions --------------------------------------------------------------------------------
def walk(n, seed=3):
    r = np.random.default_rng(seed)
    return np.cumsum(r.normal(0, 0.05, (n, 3)), 0) * 0.2 + r.normal(0, 0.02, (n, 3)) + (9, 0, 0), r.normal(size=n)


@pytest.mark.parametrize("model,decay", [(1, 1.0), (2, 1.0), (3, 0.97)])
def test_backtest_matches_a_plain_loop(spark, model, decay):
    beta, x = walk(120)
    table = spark.createDataFrame([(FRIDAYS[i], *map(float, beta[i]), float(x[i])) for i in range(120)], "week_end date, beta0 double, beta1 double, beta2 double, x double")
    got = {r.week_end: r for r in regress.backtest(table, [4], [model], FRIDAYS[80], ["x"], 1, decay).collect()}
    assert len(got) == 40
    for t in (80, 100, 119):
        rows = np.arange(0, t - 3)
        design = np.column_stack([np.ones(len(rows)), beta[rows], *([x[rows]] if model > 1 else [])])
        w = decay ** np.arange(len(rows) - 1, -1, -1.0) if model == 3 else np.ones(len(rows))
        root = np.sqrt(w)[:, None]
        coef = np.linalg.lstsq(design * root, beta[rows + 4] * root, rcond=None)[0]
        want = np.concatenate([[1.0], beta[t], [x[t]] if model > 1 else []]) @ coef
        r = got[FRIDAYS[t]]
        assert (r.beta0_hat, r.beta1_hat, r.beta2_hat) == pytest.approx(tuple(want), abs=1e-9)
        assert r.t_plus_h == (FRIDAYS[t + 4] if t + 4 < 120 else None)


def test_backtest_leads_by_rows_and_falls_back(spark):
    beta, _ = walk(12)
    weeks = [w for i, w in enumerate(FRIDAYS[:14]) if i not in (5, 9)]
    table = spark.createDataFrame([(w, *map(float, beta[i]), None) for i, w in enumerate(weeks)], "week_end date, beta0 double, beta1 double, beta2 double, x double")
    got = regress.backtest(table, [2], [2], weeks[0], ["x"]).orderBy("week_end").collect()
    assert [r.t_plus_h for r in got] == [*weeks[2:], None, None]
    assert all((r.beta0_hat, r.n_rows) == (pytest.approx(beta[i, 0]), 0) for i, r in enumerate(got))


def test_collinear_columns_have_a_least_norm_fit():
    beta, x = walk(60)
    a = linear.least_squares(np.column_stack([np.ones(60), x]), beta)
    b = linear.least_squares(np.column_stack([np.ones(60), x, x]), beta)
    assert b[1] + b[2] == pytest.approx(a[1]) and b[1] == pytest.approx(b[2])
    assert regress.decay_weights(5, 1.0) == pytest.approx(np.ones(5)) and regress.decay_weights(7, 0.9).sum() == pytest.approx(7)


def test_iterated_forecast_and_its_covariance():
    r = np.random.default_rng(1)
    y = np.zeros((3_000, 2))
    a = np.array([[0.5, 0.1], [0.0, 0.3]])
    for t in range(1, 3_000):
        y[t] = a @ y[t - 1] + r.normal(size=2)
    beta, e = linear.var_fit(y, 1)
    assert beta[1:].T == pytest.approx(a, abs=0.05)
    want = a @ a @ y[-1]
    assert linear.var_forecast(y, np.vstack([np.zeros(2), a.T]), 1, 2) == pytest.approx(want)
    cov = linear.forecast_covariance(np.vstack([np.zeros(2), a.T]), np.eye(2), 1, 2)
    assert cov == pytest.approx(np.eye(2) + a @ a.T)
    coef, sigma = regress.weighted_var(y, 1, 1.0)
    assert coef == pytest.approx(beta) and sigma == pytest.approx(e.T @ e / len(e))
    assert regress.autoregression(y[:, 0], 1).shape == (2,)


# tests of hypotheses ------------------------------------------------------------------------
def test_unit_root_and_stationarity_tests_tell_series_apart():
    r = np.random.default_rng(7)
    noise, path = r.normal(size=500), np.cumsum(r.normal(size=500) + 0.1)
    assert linear.adf(noise)[1] < 0.01 and linear.adf(path)[1] > 0.05
    assert linear.kpss(noise)[1] >= 0.05 and linear.kpss(path)[1] == 0.01
    # 5 per cent point of the limit distribution (constant): -2.86
    assert linear.adf_p_value(-2.86) == pytest.approx(0.05, abs=0.002)
    assert linear.adf_p_value(-3.43) == pytest.approx(0.01, abs=0.001)
    assert linear.adf_p_value(-2.57) == pytest.approx(0.10, abs=0.003)


def test_granger_and_projection_find_a_planted_cause():
    r = np.random.default_rng(5)
    x, y = r.normal(size=400), np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.3 * y[t - 1] + 0.5 * x[t - 1] + r.normal()
    f, p, chi, q = linear.granger(y, x, 2)
    assert p < 1e-6 and q < 1e-6 and linear.granger(x, y, 2)[1] > 0.01
    assert f == pytest.approx(chi / 2 * (398 - 5) / 398)
    assert linear.projection_test(y, x, 1, 2)[1] < 1e-6 and linear.projection_test(y[:9], x[:9], 1, 2)[0] != linear.projection_test(y[:9], x[:9], 1, 2)[0]


def test_residual_statistics():
    r = np.random.default_rng(2)
    e = r.normal(size=1_000)
    assert linear.jarque_bera(e)[1] > 0.01 and linear.jarque_bera(e**3)[1] < 1e-6
    assert linear.ljung_box(e, 5)[4][2] > 0.01 and linear.ljung_box(np.cumsum(e), 5)[4][2] < 1e-6
    assert linear.arch_test(e)[1] > 0.01
    x = r.normal(size=(500, 3))
    x[:, 2] = x[:, 0] + 0.1 * r.normal(size=500)
    vif = linear.variance_inflation(x)
    assert vif[1] < 1.2 and vif[0] > 50


def test_vif_table_matches_regressions(spark):
    x = np.random.default_rng(4).normal(size=(300, 3)) + 1
    x[:, 1] += x[:, 0]
    table = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    for centred in (False, True):
        got = {r.variable: r.vif for r in hypothesis.inflation(table, ["a", "b", "c"], centred).collect()}
        assert [got[k] for k in "abc"] == pytest.approx(linear.variance_inflation(x, centred), rel=1e-6)


# probabilities ------------------------------------------------------------------------------
def test_probability_is_the_share_of_the_pool(spark):
    fc = spark.createDataFrame([(FRIDAYS[10], 4, 0, 9.0, 0.0, 0.0, FRIDAYS[14])], "week_end date, horizon int, model int, beta0_hat double, beta1_hat double, beta2_hat double, t_plus_h date")
    pool = spark.createDataFrame([(4, 0, FRIDAYS[i], FRIDAYS[i + 4], 0.05 * (i - 3), 0.0, 0.0) for i in range(9)], "horizon int, model int, origin date, realized_date date, r0 double, r1 double, r2 double")
    panel = spark.createDataFrame([(FRIDAYS[10], 1, math.exp(9.0)), (FRIDAYS[14], 1, math.exp(9.0) * 1.08)], "week_end date, maturity int, price double")
    r = probability.exceedance(fc, pool, panel, [1], [0.08, 0.02], 1.95).orderBy("threshold").collect()
    assert [x.n_pool for x in r] == [7, 7]  # realised by the week itself, none later
    assert (r[0].p_up, r[0].p_down) == (3 / 7, 3 / 7) and (r[1].p_up, r[1].p_down) == (2 / 7, 2 / 7)
    assert (r[0].actual_up, r[0].actual_down) == (1, 0)
    more = pool.union(spark.createDataFrame([(4, 0, FRIDAYS[8], FRIDAYS[12], 1.0, 0.0, 0.0)], pool.schema))
    assert probability.exceedance(fc, more, panel, [1], [0.08], 1.95).first().p_up == r[1].p_up


def test_barrier_is_strict(spark):
    row = spark.range(1).select(columns.barrier_hit(F.lit(110.0), F.lit(110.0), True).alias("a"), columns.barrier_hit(F.lit(None).cast("double"), F.lit(1.0), True).alias("b")).first()
    assert (row.a, row.b) == (0, None)


def test_normal_distribution_column(spark):
    rows = spark.createDataFrame([(z / 4,) for z in range(-20, 21)], "z double").select("z", columns.norm_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - special.norm_cdf(r.z)) < 2e-7 for r in rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1)), min_size=1, max_size=40))
def test_auc_with_ties(spark, pairs):
    rows = spark.createDataFrame([("k", p / 5, y) for p, y in pairs], "k string, p double, actual int")
    r = probability.auc(rows, ["k"]).first()
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) if pos and neg else None
    assert r.auc == (pytest.approx(want) if want is not None else None)
    flipped = probability.auc(rows.withColumn("p", -F.col("p")), ["k"]).first().auc
    assert want is None or flipped == pytest.approx(1 - want)


def test_auc_verdicts(spark):
    cases = [(None, 9, 9), (0.9, 4, 90), (0.6, 9, 9), (0.58, 9, 9), (0.42, 9, 9), (0.3, 9, 9)]
    rows = spark.createDataFrame(cases, "a double, p int, n int").select(columns.auc_verdict(F.col("a"), F.col("p"), F.col("n")).alias("v")).collect()
    assert [r.v for r in rows] == ["UNDEFINED", "INSUFFICIENT", "GENUINE", "WEAK", "WEAK", "INVERTED"]


def test_scores_keep_nulls(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(columns.logit(none).alias("a"), columns.sigmoid(none).alias("b"), columns.sigmoid(F.lit(0.0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (None, None, 0.5)


# calibration --------------------------------------------------------------------------------
def test_platt_recovers_and_bounds():
    r = np.random.default_rng(8)
    p = r.uniform(0.02, 0.98, 4_000)
    y = (r.uniform(size=4_000) < 1 / (1 + np.exp(-(0.6 * np.log(p / (1 - p)) - 0.4)))).astype(float)
    assert linear.platt(p, y) == pytest.approx((0.6, -0.4), abs=0.1)
    assert linear.platt(np.array([0.1, 0.2, 0.8, 0.9] * 10), np.array([0, 0, 1, 1.0] * 10))[0] <= 50
    a, b = linear.platt(np.linspace(0.1, 0.9, 40), np.array([1, 0] * 20)[np.argsort(-np.linspace(0, 1, 40))] * 1.0)
    assert a >= 0
    a, b = linear.platt(np.linspace(0.1, 0.9, 40), (np.linspace(0, 1, 40) < 0.5).astype(float))
    assert (a, b) == pytest.approx((0.0, 0.0), abs=1e-9)


def test_rolling_fits_see_only_the_past(spark):
    r = np.random.default_rng(9)
    rows = [("k", FRIDAYS[i], FRIDAYS[i + 4], float(p), int(r.uniform() < p)) for i in range(80) for p in r.uniform(0.1, 0.9, 2)]
    schema = "k string, week_end date, realized_date date, p double, actual int"
    shock = FRIDAYS[60]
    got = {x.week_end: x for x in calibrate.rolling(spark.createDataFrame(rows, schema), ["k"], None, shock).collect()}
    early = {x.week_end: x for x in calibrate.rolling(spark.createDataFrame([x for x in rows if x[1] <= FRIDAYS[40]], schema), ["k"], None, shock).collect()}
    assert all((got[w].a, got[w].n_used) == (early[w].a, early[w].n_used) for w in early)
    assert got[FRIDAYS[12]].a is None and got[FRIDAYS[40]].n_used == 2 * 37
    assert not got[FRIDAYS[70]].in_domain and got[FRIDAYS[70]].a == got[FRIDAYS[59]].a


# files --------------------------------------------------------------------------------------
def test_messy_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    macro = readers.read_macro_csv(spark, put("m.csv", "observation_date,DGS1MO\n2021-07-02,0.05\n2021-07-05,\n2021-07-06,.\nbad,1\n")).orderBy("day").collect()
    assert [(str(r.day), r.value) for r in macro] == [("2021-07-02", 0.05), ("2021-07-05", None), ("2021-07-06", None)]
    one = put("p1.csv", "Date,LPA,LPB\n2020-01-02,\"6,100.5\",#N/A\n2020-01-03,6200,6210\n,1,2\n")
    two = put("p2.csv", "Date,X,Y\n2020-01-03,6300,\n")
    prices = {str(r.day): r for r in readers.read_price_files(spark, [one, two]).collect()}
    assert prices["2020-01-02"].m01 == 6100.5 and prices["2020-01-02"].m02 is None
    assert (prices["2020-01-03"].m01, prices["2020-01-03"].m02) == (6300.0, None)
    head = ",".join(f'"{v}"' for v in readers.POSITIONS.values())
    good = put("c.txt", f"{head}\n COPPER ,2020-01-07, 085692 ,\"1,000\",400,150,10\n GOLD ,2020-01-07,088691,5,1,1,1\n COPPER ,2020-01-07,085692,9,9,9,9\n")
    net = readers.read_positions(spark, [good, put("other.txt", "a,b\n1,2\n")], ["085692"]).collect()
    assert [(r.open_interest, r.net_speculative, r.net_spec_pct_oi) for r in net] == [(1000, 250, 25.0)]
    cash = readers.read_cash_files(spark, [put("k.csv", "date,cash,three_month\n02. January 2020,\"6,165.00\",6174\ndate,cash,three_month\n03. January 2020,6100,x\n"), put("k2.csv", "date,cash\n1,2\n")])
    assert {str(r.day): (r.cash, r.m03) for r in cash.collect()} == {"2020-01-02": (6165.0, 6174.0), "2020-01-03": (6100.0, None)}
    risk = put("g.csv", "date,extra,GPRD\n2020-01-02,a,101.5\n2020-01-03,b,\n")
    assert [(str(r.day), r.value) for r in readers.read_risk_index(spark, risk).collect()] == [("2020-01-02", 101.5)]
    with pytest.raises(ValueError):
        readers.read_risk_index(spark, one)
    audit = readers.audit_series(spark, {"m": str(tmp_path / "m.csv")}, "2021-01-01").first()
    assert (audit.n_null, audit.starts_late, audit.many_nulls) == (2, True, False)
    gone = readers.missing_names(spark.createDataFrame([("a",)], "n string"), "n", ["a", "b"])
    assert [r.name for r in gone.collect()] == ["b"]
    readers.write_report({"x": gone}, str(tmp_path / "rep"))
    readers.write_table(gone.withColumn("k", F.lit(1)), str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and spark.read.csv(str(tmp_path / "rep/x"), header=True).first().name == "b"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = windowed_last(stream, "ts", ["event_type"], "value", "1 day", "40 days")
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.window_start, r.event_type): (r.n, round(r.total, 6)) for r in spark.table("windows").collect()}
    want = {(r.window_start, r.event_type): (r.n, round(r.total, 6)) for r in windowed_last(events, "ts", ["event_type"], "value", "1 day").collect()}
    assert got == want


def test_entry_works_without_the_training_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/termforge", tmp_path / "termforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(n.startswith('op') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_later_rows_change_no_earlier_probability(spark, sf_dir):
    """Point in time: with all prices after a week doubled, what was known by the week gives the same numbers."""
    from termforge.operators import gram
    from termforge.plans import base

    cut = "2000-06-30"
    table = base.fact(spark, sf_dir).select("week_end", "beta0", "beta1", "beta2").orderBy("week_end").toPandas()
    changed = table.copy()
    late = pd.to_datetime(changed["week_end"]) > pd.Timestamp(cut)
    changed.loc[late, ["beta0", "beta1", "beta2"]] *= 2.0
    panel = base.panel(spark, sf_dir)
    out = []
    for t in (table, changed):
        fact = spark.createDataFrame(t, "week_end date, beta0 double, beta1 double, beta2 double")
        every = regress.random_walk(fact, [1, 4], "1999-01-01")
        pool = regress.residual_pool(every, fact)
        normal = probability.gaussian_exceedance(every, regress.expanding_covariance(pool).drop("n"), panel, [1], [0.05], 1.95)
        exact = probability.exceedance(every, pool, panel, [1], [0.05], 1.95).select("week_end", "horizon", "model", "maturity", "threshold", "p_up", "p_down")
        direct = gram.direct_forecasts(fact, [4], "1999-01-01", 1).select("week_end", F.col("horizon"), F.col("model"), F.lit(0).alias("maturity"), F.lit(0.0).alias("threshold"), F.col("beta0_hat").alias("p_up"), F.col("beta1_hat").alias("p_down"))
        rows = normal.select(*exact.columns).withColumn("kind", F.lit("normal")).union(exact.withColumn("kind", F.lit("pool"))).union(direct.withColumn("kind", F.lit("direct")))
        out.append({(r.kind, r.week_end, r.horizon): (r.p_up, r.p_down) for r in rows.where(F.col("week_end") <= cut).collect()})
    assert len(out[0]) > 200 and out[0].keys() == out[1].keys()
    for k, v in out[0].items():
        assert v == pytest.approx(out[1][k], abs=1e-7), k


@pytest.mark.parametrize("model,decay", [(1, None), (2, None), (3, 0.97)])
def test_running_sums_match_a_plain_loop(spark, model, decay):
    """Forecasts from running Gram sums against a least-squares fit from scratch at every week."""
    from termforge.operators import gram

    r = np.random.default_rng(model)
    n, h = 70, 4
    t = pd.DataFrame(r.normal(size=(n, 4)).cumsum(0) * 0.1 + 7.0, columns=["beta0", "beta1", "beta2", "x1"])
    t.insert(0, "week_end", pd.date_range("2000-01-07", periods=n, freq="7D").date)
    macros = ["x1"] if model > 1 else []
    want = regress.backtest_group(t.assign(week_end=pd.to_datetime(t["week_end"])), h, model, pd.Timestamp("2000-01-01"), ["x1"], 1, decay or 1.0)
    table = spark.createDataFrame(t, "week_end date, beta0 double, beta1 double, beta2 double, x1 double")
    got = gram.direct_forecasts(table, [h], "2000-01-01", model, macros, decay).orderBy("week_end").toPandas()
    assert (got["n_fit"].to_numpy() == want["n_rows"].to_numpy()).all()
    for b in ("beta0_hat", "beta1_hat", "beta2_hat"):
        assert got[b].to_numpy() == pytest.approx(want[b].to_numpy(), abs=1e-6)
    last = got.iloc[-1]["coef"]
    assert np.sqrt(sum(np.dot(c, c) for c in last)) == pytest.approx(want.iloc[-1]["coef_norm"], rel=1e-5)


def test_collinear_regressors_get_least_norm(spark):
    from termforge.operators import gram

    rows = [(i, 1.0 * i, 2.0 * i, 3.0 * i + 1) for i in range(-3, 4)]
    table = spark.createDataFrame(rows, "place int, x double, z double, y double").withColumn("k", F.lit(1))
    fit = gram.expanding_fits(table, ["k"], "place", ["x", "z"], ["y"]).orderBy(F.col("place").desc()).first()
    a, b, c = fit.coef[0]
    assert a == pytest.approx(1) and b + 2 * c == pytest.approx(3) and fit.rss[0] == pytest.approx(0, abs=1e-9)


def test_stability_rules(spark):
    from datetime import date, timedelta

    from termforge.operators import gram

    r = np.random.default_rng(0)
    coefs = np.cumsum(np.where(np.arange(120)[:, None] < 60, 1.0, 0.01) * r.normal(size=(120, 4)), 0)
    rows = [(date(2000, 1, 7) + timedelta(7 * i), 4, 1, 30, [c.tolist()]) for i, c in enumerate(coefs)]
    f = spark.createDataFrame(rows, "week_end date, horizon int, model int, n_fit int, coef array<array<double>>")
    table = gram.stability(f).orderBy("week_end").toPandas()
    change = pd.Series(np.linalg.norm(np.diff(coefs, axis=0), axis=1))
    assert table["change"].dropna().to_numpy() == pytest.approx(change.to_numpy())
    smooth = change.rolling(26).mean()
    assert table["smooth"].dropna().to_numpy() == pytest.approx(smooth.dropna().to_numpy())
    got = gram.stabilisation_date(gram.stability(f)).first()
    limit = 1.5 * change.iloc[-int(len(change) * 0.2) :].median()
    first = next(i for i in range(len(smooth)) if not np.isnan(smooth[i]) and smooth[i:].max() <= limit)
    assert got.stable_from == rows[first + 1][0] and got.n_changes == 119
    assert gram.stabilisation_date(gram.stability(f.where("week_end < '2000-12-01'"))).first().stable_from is None


def test_small_pools_get_normal_probabilities(spark):
    f = spark.createDataFrame([("2000-01-07", 1, 0, 7.0, 0.0, 0.0, None)], "week_end string, horizon int, model int, beta0_hat double, beta1_hat double, beta2_hat double, t_plus_h date").withColumn("week_end", F.to_date("week_end"))
    panel = spark.createDataFrame([("2000-01-07", 1, float(np.exp(7.0)))], "week_end string, maturity int, price double").withColumn("week_end", F.to_date("week_end"))
    pool = spark.createDataFrame([(1, 0, "2000-01-01", 9.0, 0.0, 0.0)] * 4, "horizon int, model int, realized_date string, r0 double, r1 double, r2 double").withColumn("realized_date", F.to_date("realized_date"))
    from termforge.functions.columns import loadings

    _, s, c = loadings(1, 1.95)
    for p, n in ((pool, 4), (pool.limit(0), 0)):
        r = probability.exceedance(f, p, panel, [1], [0.02], 1.95).first()
        z = np.log(1.02) / np.sqrt(1e-4 * (1 + s * s + c * c))
        assert r.n_pool == n and r.p_up == pytest.approx(1 - 0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1e-6) and r.actual_up is None
    assert probability.exceedance(f, pool.union(pool), panel, [1], [0.02], 1.95).first().p_up == 1.0


def test_newton_sums_match_the_plain_fit(spark):
    from termforge.functions.linear import platt
    from termforge.operators import calibrate

    r = np.random.default_rng(7)
    rows = [("a", float(p), int(r.random() < 0.2 + 0.5 * p)) for p in r.random(400)] + [("falling", float(p), int(r.random() < 0.8 - 0.6 * p)) for p in r.random(300)] + [("few", 0.5, 1)] * 5
    table = spark.createDataFrame(rows, "k string, p double, actual int")
    got = {x.k: x for x in calibrate.fit_pooled(table, ["k"]).collect()}
    assert set(got) == {"a", "falling"}
    for k in got:
        p, y = (np.array([v[i] for v in rows if v[0] == k], float) for i in (1, 2))
        assert (got[k].a, got[k].b) == pytest.approx(platt(p, y), abs=1e-5)


def test_gaps_by_fixture(spark):
    """Missing weeks, missing cells and thin weeks, which the test tables don't have."""
    from termforge.operators import weekly

    rows = [("2000-01-07", 1.0, 2.0, None), ("2000-01-14", None, None, None), ("2000-02-04", 4.0, None, 5.0)]
    t = spark.createDataFrame(rows, "week_end string, m01 double, m02 double, m03 double").withColumn("week_end", F.to_date("week_end"))
    spine = weekly.on_spine(t).orderBy("week_end").collect()
    assert [str(r.week_end) for r in spine] == ["2000-01-07", "2000-01-14", "2000-01-21", "2000-01-28", "2000-02-04"] and spine[2].m01 is None
    assert [(str(r.day), r.gap_days) for r in weekly.date_gaps(t, "week_end", 14).collect()] == [("2000-02-04", 21)]
    filled = spark.createDataFrame([(1, 1.0), (2, None), (3, None), (4, 2.0)], "i int, v double")
    from pyspark.sql import Window

    assert [r.f for r in filled.select(weekly.fill_one("v", Window.orderBy("i")).alias("f")).collect()] == [1.0, 1.0, None, 2.0]
    assert [(str(r.week_end), r.n_missing) for r in weekly.sparse_weeks(t, ["m01", "m02", "m03"], 2).collect()] == [("2000-01-14", 3)]
    gate = {r["column"]: r.over for r in weekly.check_missing(t, ["m01", "m02", "m03"], 0.5).collect()}
    assert gate == {"m01": False, "m02": True, "m03": True}
    assert [(r.weeks, round(r.m01, 3)) for r in weekly.coverage_by_year(t, ["m01"]).collect()] == [(3, 66.667)]
    near = weekly.nearest_within(spark.createDataFrame([("2000-01-10",), ("2000-01-20",)], "d string").select(F.to_date("d").alias("d")), "d", t, "week_end", 3).orderBy("d").collect()
    assert [str(r.week_end) for r in near] == ["2000-01-07", "None"]


def test_tests_do_not_depend_on_level_and_unit(spark):
    """Statistics stay when series are shifted by a million or multiplied by 1e-6 to 1e6."""
    from termforge.functions import linear

    r = np.random.default_rng(11)
    walk = np.cumsum(r.normal(size=300))
    plain = linear.adf(walk)
    assert plain[1] > 0.05  # a random walk
    assert linear.adf(walk + 1e6) == pytest.approx(plain, rel=1e-5) and linear.adf(walk * 1e6) == pytest.approx(plain, rel=1e-8) and linear.adf(walk * 1e-6) == pytest.approx(plain, rel=1e-8)
    assert linear.kpss(walk + 1e6) == pytest.approx(linear.kpss(walk), rel=1e-6)
    x, y = r.normal(size=300), r.normal(size=300)
    y[2:] += 0.3 * x[:-2]
    for a, b, scale, shift in ((1e6, 1e-6, 1e-7, 0.0), (1.0, 1e7, 1e-7, 1e6), (1e-6, 1.0, 1e-7, -1e3)):
        assert linear.granger(a * y + shift, b * x + shift, 3) == pytest.approx(linear.granger(y, x, 3), rel=1e-4)
        assert linear.projection_test(a * y + shift, b * x + shift, 4, 2) == pytest.approx(linear.projection_test(y, x, 4, 2), rel=1e-4)


def test_projection_plan_matches_the_plain_test(spark):
    """Window sums give the Wald numbers of the plain computation, for any unit of cause and effect."""
    from termforge.functions import linear
    from termforge.operators import hypothesis

    r = np.random.default_rng(12)
    x = r.normal(size=120)
    y = 0.5 * np.concatenate([[0, 0], x[:-2]]) + r.normal(size=120)
    units = {"plain": (1.0, 0.0), "large": (1e6, 0.0), "high": (1.0, 1e6), "small": (1e-6, 0.0)}
    rows = [(k, "y", FRIDAYS[i], float(a * x[i] + b), float(y[i])) for k, (a, b) in units.items() for i in range(120)] + [("flat", "y", FRIDAYS[i], 1.0, float(y[i])) for i in range(120)] + [("few", "y", FRIDAYS[i], float(x[i]), float(y[i])) for i in range(9)] + [("plain", "y", FRIDAYS[125], None, 1.0)]
    table = spark.createDataFrame(rows, "cause string, effect string, week_end date, x double, y double")
    for lags in (1, 2, 3):
        got = {(v.cause, v.horizon): v for v in hypothesis.projection_tests(table, (1, 4, 13), lags).collect()}
        for h in (1, 4, 13):
            wald, p, n = linear.projection_test(y, x, h, lags)
            for k in units:
                v = got[(k, h)]
                assert (v.wald_f, v.p_value, v.n) == pytest.approx((wald, p, n), rel=1e-5)
            assert got.get(("flat", h)) is None or got[("flat", h)].wald_f is None
        assert lags == 1 or got[("few", 1)].wald_f is None  # 8 or 7 rows for 2 * (2 * lags + 1)


@pytest.mark.parametrize("decay", [None, 0.95])
def test_exceedance_by_blocks_matches_the_join(spark, decay):
    """Dominance counts by blocks of residuals equal the sums over weeks joined with residuals; ties of price and barrier hit neither."""
    r = np.random.default_rng(13)
    weeks = 70
    pool = [(h, m, FRIDAYS[i], *(float(v) for v in np.round(r.normal(0, 0.03, 3), 3))) for h in (1, 4) for m in (0, 1) for i in range(0, weeks, 1 + m) for _ in range(1 + (i % 3 == 0))]
    pool += [(1, 0, FRIDAYS[3], 0.0, 0.0, 0.0)] * 3
    forecasts = [(FRIDAYS[i], h, m, 0.0, 0.1, 0.0, FRIDAYS[i + h]) for i in range(weeks) for h in (1, 4) for m in (0, 1)]
    panel = [(FRIDAYS[i], k, float(np.exp(r.normal(0, 0.02)))) for i in range(weeks) for k in (1, 3)]
    f = spark.createDataFrame(forecasts, "week_end date, horizon int, model int, beta0_hat double, beta1_hat double, beta2_hat double, t_plus_h date")
    p = spark.createDataFrame(pool, "horizon int, model int, realized_date date, r0 double, r1 double, r2 double")
    k = spark.createDataFrame(panel, "week_end date, maturity int, price double")
    joined = f.join(p, (f.horizon == p.horizon) & (f.model == p.model) & (p.realized_date <= f.week_end), "left").select(f["*"], "realized_date", "r0", "r1", "r2")
    slow = probability.pooled_exceedance(joined, k, [1, 3], [0.02, 0.05], 1.95, decay)
    order = ["horizon", "model", "maturity", "threshold", "week_end"]
    fast = probability.exceedance(f, p, k, [1, 3], [0.02, 0.05], 1.95, decay)
    a, b = (x.orderBy(*order).toPandas() for x in (fast, slow.select(fast.columns)))
    assert len(a) == weeks * 2 * 2 * 2 * 2
    for c in a.columns:
        assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-9, equal_nan=True) if a[c].dtype != object else (a[c].fillna("") == b[c].fillna("")).all()


def test_rolling_maps_are_near_exact_fits(spark):
    """Binned Newton fits of all dates against the exact fit of each date's own rows; the last fit outlives dates with too few rows."""
    from termforge.functions.linear import platt

    r = np.random.default_rng(14)
    rows = [("k", FRIDAYS[i], FRIDAYS[i + 3], float(p), int(r.uniform() < 0.15 + 0.6 * p)) for i in range(90) for p in r.uniform(0.02, 0.98, 8)]
    table = spark.createDataFrame(rows, "k string, week_end date, realized_date date, p double, actual int")
    for window in (None, 20):
        got = {x.week_end: x for x in calibrate.rolling(table, ["k"], window, FRIDAYS[80]).collect()}
        for i in (30, 55, 79):
            own = [x for x in rows if x[2] <= FRIDAYS[i] and (window is None or x[1] >= FRIDAYS[i - window])]
            x = got[FRIDAYS[i]]
            assert x.n_used == len(own) and x.n_dates_used == len({o[1] for o in own}) and x.in_domain
            a, b = platt(np.array([o[3] for o in own]), np.array([o[4] for o in own], float))
            grid = np.log(np.linspace(0.05, 0.95, 10) / (1 - np.linspace(0.05, 0.95, 10)))
            assert np.abs(1 / (1 + np.exp(-(a * grid + b))) - 1 / (1 + np.exp(-(x.a * grid + x.b)))).max() < 0.01
    # Rows stop long before the shock: dates whose window is empty have no fit, and the shock gets the last there was.
    thin = [x for x in rows if x[1] <= FRIDAYS[40] or x[1] >= FRIDAYS[78]]
    got = {x.week_end: x for x in calibrate.rolling(spark.createDataFrame(thin, table.schema), ["k"], 20, FRIDAYS[80]).collect()}
    assert got[FRIDAYS[78]].a is None and not got[FRIDAYS[78]].in_domain
    assert got[FRIDAYS[85]].a == got[FRIDAYS[40]].a is not None and not got[FRIDAYS[85]].in_domain


def test_log_tails_do_not_underflow(spark):
    from termforge.functions.columns import chi2_log_tail, log_gamma_half
    from termforge.functions.special import chi2_log_sf

    rows = [(float(x), int(df)) for x in (0.01, 0.5, 3.0, 11.0, 12.0, 60.0, 1_400.0, 4_600.0, 1e6) for df in (1, 2, 3, 10, 25)]
    got = spark.createDataFrame(rows, "x double, df int").select("x", "df", chi2_log_tail(F.col("x"), F.col("df")).alias("t"), log_gamma_half(F.col("df")).alias("g")).collect()
    for r in got:
        assert r.g == pytest.approx(math.lgamma(r.df / 2), abs=1e-12)
        assert r.t == pytest.approx(chi2_log_sf(r.x, r.df), rel=1e-9, abs=1e-11)
    # ten degrees of freedom have a closed form
    x = 4_600.0
    want = -x / 2 + math.log(sum((x / 2) ** k / math.factorial(k) for k in range(5)))
    assert next(r.t for r in got if (r.x, r.df) == (x, 10)) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("decay", [None, 0.97])
def test_iterated_forecasts_match_step_by_step_fits(spark, decay):
    from termforge.functions import linear
    from termforge.operators import gram

    r = np.random.default_rng(15)
    y = np.zeros((60, 2))
    for t in range(1, 60):
        y[t] = [0.3, 5.0] + np.array([[0.6, 0.01], [2.0, 0.3]]) @ y[t - 1] + r.normal(size=2) * [0.1, 2.0]
    rows = [("k", FRIDAYS[t], float(y[t, 0]), float(y[t, 1])) for t in range(60)] + [("k", FRIDAYS[60], None, 1.0)]
    table = spark.createDataFrame(rows, "k string, week_end date, a double, b double")
    for lags in (1, 2):
        got = {(x.week_end, x.horizon): x for x in gram.iterated_forecasts(table, ["k"], ["a", "b"], (1, 5, 12), lags, decay).collect()}
        for t in (20, 59):
            coef, sigma = regress.weighted_var(y[: t + 1], lags, decay or 1.0)
            for h in (1, 5, 12):
                x = got[(FRIDAYS[t], h)]
                assert (x.forecast_a, x.forecast_b) == pytest.approx(tuple(linear.var_forecast(y[: t + 1], coef, lags, h)), rel=1e-6)
                c = linear.forecast_covariance(coef, sigma, lags, h)
                assert (x.s_00, x.s_01, x.s_11) == pytest.approx((c[0, 0], c[0, 1], c[1, 1]), rel=1e-5, abs=1e-9)
        assert min(w for w, _ in got) == FRIDAYS[lags + 2 * lags + 2]


def test_orders_come_from_one_aggregation(spark):
    """Criteria and residual tests of all orders against plain fits, for columns of very different units."""
    from termforge.functions import linear
    from termforge.operators import hypothesis

    r = np.random.default_rng(16)
    y = np.zeros((150, 2))
    for t in range(2, 150):
        y[t] = 0.5 * y[t - 1] - 0.3 * y[t - 2] + r.normal(size=2)
    y = y * [1e-3, 1e4] + [5.0, 1e6]
    table = spark.createDataFrame([(FRIDAYS[t], float(y[t, 0]), float(y[t, 1])) for t in range(150)], "week_end date, a double, b double").repartition(3)
    want = linear.lag_criteria(y, 4)
    got = sorted(hypothesis.select_lag(table, ["a", "b"], 4).collect())
    for x, w in zip(got, want):
        assert (x.p, x.aic, x.bic, x.hq) == pytest.approx(w, rel=1e-6)
    assert [x.chosen for x in got] == [w == min(want, key=lambda v: v[2]) for w in want]
    for x in hypothesis.lag_robustness(table, ["a", "b"], 4).collect():
        e = linear.var_fit(y, x.p)[1]
        least = [min(q for _, _, q in linear.ljung_box(e[:, k], 2 * x.p)) for k in range(2)]
        assert x.min_p == pytest.approx(min(least), rel=1e-4) and x.n_failures == sum(v < 0.05 for v in least) and x.worst_series == "ab"[int(np.argmin(least))]


def test_specification_tests_only_what_failed(spark):
    from termforge.operators import hypothesis

    r = np.random.default_rng(17)
    noise = r.normal(size=200)
    walk, twice = np.cumsum(noise), np.cumsum(np.cumsum(r.normal(size=200)))
    rows = []
    for name, y in (("noise", noise), ("walk", walk), ("twice", twice), ("flat", np.ones(200)), ("few", noise[:20])):
        for transform, values in (("level", y), ("z52W", y), ("d1W", np.append(np.nan, np.diff(y)))):
            rows += [(FRIDAYS[t], name, transform, None if values[t] != values[t] else float(values[t])) for t in range(len(y))]
    table = spark.createDataFrame(rows, "week_end date, series string, transform string, value double")
    got = {}
    for x in hypothesis.specification(table, ("level", "z52W", "d1W")).orderBy("series", "step").collect():
        got.setdefault(x.series, []).append((x.transform, x.verdict == "UNDEFINED", x.chosen))
    assert got["noise"] == [("level", False, True)]
    assert [t for t, _, _ in got["walk"]] == ["level", "z52W", "d1W"] and got["walk"][-1][2] and not got["walk"][0][2]
    assert not any(c for _, _, c in got["twice"][:2])
    assert all(u and not c for _, u, c in got["flat"] + got["few"]) and len(got["flat"]) == 3


def test_decay_is_chosen_within_the_plan(spark):
    for rows in ([(1.0, 0.3, 80.0), (2.0, 0.1, 70.0), (3.0, 0.2, 90.0)], [(1.0, 0.1, 80.0), (2.0, 0.2, 90.0), (3.0, 0.3, 90.0)], [(1.0, 0.10002, 80.0), (2.0, 0.1, 70.0), (3.0, 0.10001, 60.0)]):
        grid = spark.createDataFrame(rows, "decay double, mean_rmse double, agreement_pct double")
        got = curve.chosen_decay(grid).first()
        listed = grid.collect()
        assert (got.decay, got.chosen_by) == curve.choose_decay(listed, listed)
    assert curve.chosen_decay(grid.limit(0)).count() == 0


def test_many_files_are_one_plan(spark, tmp_path):
    """Files of different widths, headers and quoting under one glob; later files win; the plan doesn't grow with the files."""
    from termforge.sources import readers

    for i in range(60):
        name, quoted = f"f{i:03d}.csv", i % 3 == 0
        cells = [f'"{1_000 + i:,}.5"' if quoted else f"{1_000 + i}.5", "n/a" if i % 2 else "7"]
        extra = ("", "") if i % 4 else (",Third", ",3")
        (tmp_path / name).write_text(f"﻿Day of {i},\"First, of {i}\",Second{extra[0]}\r\n2020-01-{1 + i % 28:02d},{','.join(cells)}{extra[1]}\n\nno date,1,2\n")
    (tmp_path / "q.txt").write_text('a,b,"c"\n"x, ""y""","p\\", q",\n')
    assert [r.cells for r in readers.scan_files(spark, f"{tmp_path}/q.txt").collect()] == [['x, "y"', 'p", q', ""]]
    (tmp_path / "only.csv").write_text("Date\n2020-01-01\n")
    (tmp_path / "empty.csv").write_text("")
    got = {str(r.day): r for r in readers.read_price_files(spark, f"{tmp_path}/*.csv").collect()}
    assert len(got) == 28 and len(next(iter(got.values()))) == 4
    for d in range(28):
        last = max(i for i in range(60) if i % 28 == d)
        r = got[f"2020-01-{d + 1:02d}"]
        texts = [i for i in range(60) if i % 28 == d]
        assert r.m01 == 1_000 + last + 0.5 and r.m02 == (7 if last % 2 == 0 else None) and r.m03 == (3 if last % 4 == 0 else None) and texts
    listed = [f"{tmp_path}/f{i:03d}.csv" for i in reversed(range(60))]
    assert {str(r.day): r.m01 for r in readers.read_price_files(spark, listed).collect()}["2020-01-01"] == 1_000.5  # the list's last file
    plan = readers.read_price_files(spark, listed, width=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 2  # headers and lines, however many files
    with pytest.raises(ValueError):
        readers.read_price_files(spark, f"{tmp_path}/only.csv")
    with pytest.raises(ValueError):
        readers.read_cash_files(spark, f"{tmp_path}/*.csv")
