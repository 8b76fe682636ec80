import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from counterspark import config as cfg
from counterspark.functions import special as sf
from counterspark.operators import bootstrap as bs
from counterspark.operators import diagnostics as dg
from counterspark.operators import excess as ex
from counterspark.operators import frequency as fq
from counterspark.operators import impute, metrics, validate
from counterspark.operators import splits as sp
from counterspark.sources.series import batch, densify, ingest, specs

from .conftest import daily, long


def grid(spark, dates, y=1.0):
    return long(spark, pd.DataFrame({"ds": pd.to_datetime(dates), "y": np.arange(len(dates)) * 1.0 + y}))


# ---- configuration


def test_deep_merge_replaces_lists_and_copies():
    base = {"a": {"b": 1, "c": [1, 2]}}
    out = cfg.deep_merge(base, {"a": {"c": [3]}})
    assert out == {"a": {"b": 1, "c": [3]}} and base["a"]["c"] == [1, 2]


def test_yaml_and_overrides(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("bootstrap:\n  n_sim: 7\n")
    assert cfg.load_config(str(p))["bootstrap"]["n_sim"] == 7
    assert cfg.load_config(str(p), {"bootstrap": {"n_sim": 9}})["bootstrap"]["block_length"] == 14
    assert cfg.model_config(cfg.DEFAULTS, "none") == {}


@pytest.mark.parametrize("section", [{"split_method": "percent", "test_days": 3}, {"split_method": "days", "test_pct": 0.1}, {"split_method": "months"}])
def test_foreign_split_keys_raise(section):
    with pytest.raises(ValueError, match="split_method"):
        cfg.split_config(section)


def test_split_config_defaults_and_override():
    assert cfg.split_config({"split_method": "percent"}) == ("percent", {"test_pct": 0.20, "holdout_pct": 1.0})
    assert cfg.split_config({"split_method": "percent"}, "days") == ("days", {"test_days": 365, "holdout_days": 365})


def test_tuning_config():
    assert cfg.tuning_config(cfg.DEFAULTS)["test_pct"] == 0.10
    with pytest.raises(ValueError, match="not accepted"):
        cfg.tuning_config({"tuning": {"test_days": 3}})


# ---- grids


@pytest.mark.parametrize("freq,alias,m", [("D", "D", 7), ("W-SAT", "W-SAT", 52), ("MS", "MS", 12), ("h", "h", None), ("QS", "QS-OCT", None), ("ME", "ME", 12)])
def test_frequency(spark, freq, alias, m):
    r = fq.resolve_frequency(grid(spark, pd.date_range("2021-01-01", periods=30, freq=freq))).first()
    assert (r["alias"], r["m"], r["error"]) == (alias, m, None)
    assert fq.SeriesFrequency.from_alias(alias).seasonal_period == m


def test_irregular_grids_have_errors(spark):
    d = pd.date_range("2021-01-01", periods=30).tolist()
    err = lambda x: fq.resolve_frequency(grid(spark, x)).first()["error"]
    assert "regular grid" in err(d[:10] + d[11:])
    assert "Duplicate" in err(d + [d[4]])
    assert "At least 3" in err(d[:2])
    r = fq.first_departure(grid(spark, d[:10] + d[12:])).first()
    assert (r["modal_gap_s"], r["gap_s"], r["ds"]) == (86400, 3 * 86400, d[12].to_pydatetime())


def test_densify(spark):
    d = pd.date_range("2021-01-01", periods=10).delete([3, 4])
    out = densify(grid(spark, d), "1 day")
    assert out.count() == 10 and out.where("y is null").count() == 2


# ---- nulls


@pytest.mark.parametrize("holes", [[0, 1], [3, 4, 5], [9], [0, 4, 9]])
def test_interpolation_equals_pandas(spark, holes):
    y = pd.Series(np.arange(10.0) ** 2)
    y[holes] = np.nan
    s = long(spark, pd.DataFrame({"ds": pd.date_range("2021-01-01", periods=10), "y": y}))
    got = impute.interpolate(s).orderBy("ds").toPandas()["y"]
    np.testing.assert_allclose(got, y.interpolate().bfill().ffill(), rtol=0, atol=1e-12)


def test_missing_policies(spark):
    s = long(spark, pd.DataFrame({"ds": pd.date_range("2021-01-01", periods=4), "y": [1.0, np.nan, 3.0, 4.0]}))
    assert impute.apply_missing(s, "drop").count() == 3
    with pytest.raises(ValueError, match="1 missing"):
        impute.apply_missing(s, "error")
    with pytest.raises(ValueError, match="missing_data"):
        impute.apply_missing(s, "guess")


# ---- splits


def count_splits(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_percent_split_rounds_half_even(spark):
    d = pd.date_range("2019-01-06", periods=181 + 52, freq="W-SUN")
    s = grid(spark, d)
    got = count_splits(sp.assign_splits(s, specs(spark, [("s", str(d[181]))])))
    assert got == {"train": 145, "test": 36, "holdout": 52}


def test_days_split_is_calendar_and_inclusive(spark):
    pdf, event = daily(1095, 400)
    got = count_splits(sp.assign_splits(long(spark, pdf), specs(spark, [("s", str(event))]), "days", test_days=365, holdout_days=364))
    assert got == {"train": 730, "test": 365, "holdout": 365, "unused": 35}


def test_observation_split_and_errors(spark):
    pdf, event = daily(100, 30)
    s, e = long(spark, pdf), specs(spark, [("s", str(event))])
    assert count_splits(sp.assign_splits(s, e, "observations", test_obs=10, holdout_obs=5)) == {"train": 90, "test": 10, "holdout": 5, "unused": 25}
    for bad in ({"test_obs": 3}, {"test_obs": 0, "holdout_obs": 1}, {"test_obs": 1, "holdout_obs": 1, "test_pct": 0.2}):
        with pytest.raises(ValueError):
            sp.assign_splits(s, e, "observations", **bad)


def test_short_and_empty_test_window_notes(spark):
    pdf, event = daily(100, 30)
    s = long(spark, pdf)
    note = sp.test_window_notes(sp.assign_splits(s, specs(spark, [("s", str(event))]), "observations", test_obs=10, holdout_obs=5)).first()["note"]
    assert "only 10" in note
    early = sp.assign_splits(s, specs(spark, [("s", "2018-01-01")]))
    assert "EMPTY" in sp.test_window_notes(early).first()["note"]


def test_folds_do_not_overlap(spark):
    pdf, _ = daily(300, 0)
    rows = long(spark, pdf).selectExpr("*", "row_number() over (order by ds) - 1 as pos")
    test, least, skip = sp.fold_sizes(300, "percent", 4, test_pct=0.1, min_train_pct=0.5, skip_pct=0.0)
    f = sp.fold_rows(rows, sp.fold_layout(spark, 300, 4, test, least, skip)).toPandas()
    for _, g in f.groupby("fold"):
        assert g[g.part == "train"].pos.max() + 1 == g[g.part == "test"].pos.min() and (g.part == "test").sum() == 30
    with pytest.raises(ValueError, match="exceeds 1"):
        sp.fold_sizes(300, "percent", 6, test_pct=0.1, min_train_pct=0.5, skip_pct=0.0)
    with pytest.raises(ValueError, match="too few"):
        sp.fold_layout(spark, 10, 3, 5, 20, 0)


# ---- validation


def summary(spark, pdf, event, **kw):
    s = ingest(spark.createDataFrame(pdf), covariate_cols=[c for c in pdf if c not in ("ds", "y")])
    cov = [c for c in pdf if c not in ("ds", "y")]
    return validate.findings(validate.summarise(s, specs(spark, [("series", str(event))]), cov), cov, **kw).first()


def test_validation_findings(spark):
    pdf, event = daily(60, 20)
    assert summary(spark, pdf, event)["error"] is None
    assert "zero variance" in summary(spark, pdf.assign(y=50.0), event)["error"]
    assert "Covariate 'c'" in summary(spark, pdf.assign(c=[np.nan] + [1.0] * 79), event)["error"]
    assert any("outside" in w for w in summary(spark, pdf, "2030-01-01")["warnings"])
    assert any("issing" in w for w in summary(spark, pdf.assign(y=np.where(np.arange(80) % 3 == 0, np.nan, pdf.y)), event)["warnings"])
    assert "test_days" in summary(spark, pdf, event, split_method="days", test_days=60)["error"]
    assert "test_obs" in summary(spark, pdf, event, split_method="observations", test_obs=60, holdout_obs=1)["error"]
    with pytest.raises(ValueError, match="test_pct"):
        summary(spark, pdf, event, test_pct=1.0)


@pytest.mark.parametrize("p,match", [({"start_offset": 0}, "do not say"), ({"start_offset_days": 0, "end_offset_obs": 1}, "mixes"), ({"name": "x"}, "no offsets")])
def test_period_keys(p, match):
    with pytest.raises(ValueError, match=match):
        validate.validate_excess_periods([p])


def test_check_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, y double")
    with pytest.raises(ValueError, match="Date column"):
        validate.check_columns(df, "2020-01-01", "ds", "y", [])
    with pytest.raises(ValueError, match="event"):
        validate.check_columns(df, 5, "a", "y", [])


def test_batch_source_names_missing_keys(spark):
    with pytest.raises(ValueError, match="lacks"):
        batch([{"series_id": "a"}])
    pdf, event = daily(30, 5)
    s, e = batch([{"series_id": i, "df": spark.createDataFrame(pdf), "intervention_date": event} for i in "ab"])
    assert s.count() == 70 and e.count() == 2


# ---- metrics


def pairs(spark, rows):
    return spark.createDataFrame([("s", float(a), float(p)) for a, p in rows], "series_id string, y double, yhat double")


def test_error_metrics_exact(spark):
    r = metrics.error_metrics(pairs(spark, [(3, 1), (3, 2), (3, 3)]), ["series_id"]).first()
    assert r["rmse"] == pytest.approx(math.sqrt(5 / 3)) and r["mae"] == 1.0
    zero = metrics.error_metrics(pairs(spark, [(0, 1), (3, 2), (3, 3)]), ["series_id"]).first()
    assert zero["mape"] is None and zero["n_zero"] == 1


def test_mase(spark):
    train = grid(spark, pd.date_range("2021-01-01", periods=14)).withColumn("y", (F.col("y") - 1) * 2 + 10)
    scale = metrics.seasonal_naive_mae(train, 7)
    assert scale.first()["mase_denominator"] == 14
    same = metrics.seasonal_naive_mae(train.withColumn("p", F.lit(7)), "p").first()
    assert same["mase_denominator"] == 14
    got = metrics.with_mase(metrics.error_metrics(pairs(spark, [(40, 39), (42, 44)]), ["series_id"]), scale).first()
    assert got["mase"] == pytest.approx(1.5 / 14)


def test_metrics_seasonality():
    assert metrics.metrics_seasonality("auto", 100, 7) == 7
    with pytest.warns(UserWarning, match="two cycles"):
        assert metrics.metrics_seasonality("auto", 60, 52) == 1
    with pytest.warns(UserWarning, match="No dominant"):
        assert metrics.metrics_seasonality("auto", 60, None) == 1
    with pytest.raises(ValueError, match="needs more"):
        metrics.metrics_seasonality(52, 52, 52)


# ---- bootstrap


def test_block_resampling():
    e = np.arange(100.0)
    r = bs.resample_blocks(e, 14, np.random.default_rng(1))
    assert len(r) == 100 and all(np.all(np.diff(r[i:i + 14]) == 1) for i in range(0, 84, 14))
    assert set(bs.resample_blocks(e[:14], 14, np.random.default_rng(1))) <= set(e[:14])


def test_confidence_methods(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=200)
    sims = spark.createDataFrame([("s", 1, int(i), float(x)) for i, x in enumerate(v)] + [("s", 1, 999, None)], "series_id string, ds int, sim int, yhat_sim double")
    preds = spark.createDataFrame([("s", 1, 0.5)], "series_id string, ds int, yhat double")
    q = bs.confidence(preds, sims, ["series_id", "ds"]).first()
    assert (q["conf_lo"], q["conf_hi"]) == pytest.approx(tuple(np.percentile(v, [2.5, 97.5])))
    s = bs.confidence(preds, sims, ["series_id", "ds"], "symmetric_sd").first()
    assert s["conf_hi"] == pytest.approx(0.5 + 1.959963984540054 * v.std())
    with pytest.raises(ValueError, match="ci_method"):
        bs.confidence(preds, sims, ["series_id", "ds"], "other")
    for f in (bs.nppi_block_length, bs.grid_search_block_length):
        with pytest.raises(NotImplementedError):
            f([1])


# ---- excess


def excess_inputs(spark, effect=10.0):
    rng = np.random.default_rng(3)
    ds = pd.date_range("2021-01-01", periods=60)
    yhat = 100 + rng.normal(0, 2, 60)
    y = yhat + np.where(np.arange(60) >= 30, effect, 0)
    sims = yhat[:, None] + rng.normal(0, 3, (60, 10))
    p = pd.DataFrame({"series_id": "s", "ds": ds, "y": y, "yhat": yhat, "conf_lo": yhat - 1, "conf_hi": yhat + 1, "intervention_ts": ds[30]})
    s = pd.DataFrame([("s", d, k, sims[i, k]) for i, d in enumerate(ds) for k in range(10)], columns=["series_id", "ds", "sim", "yhat_sim"])
    cast = lambda df: df.withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    return cast(spark.createDataFrame(p)).withColumn("intervention_ts", F.col("intervention_ts").cast("timestamp_ntz")), cast(spark.createDataFrame(s)), y, yhat, sims


def test_excess_equals_numpy(spark):
    preds, sims, y, yhat, m = excess_inputs(spark)
    o = ex.excess_obs(preds, sims).orderBy("date").toPandas()
    np.testing.assert_allclose(o["excess_ci_lo"], np.percentile(y[30:, None] - m[30:], 2.5, axis=1))
    np.testing.assert_allclose(o["excess_pct"], (y - yhat)[30:] / yhat[30:] * 100)
    per = ex.excess_period(preds, sims, [{"name": "week", "start_offset_days": 0, "end_offset_days": 7}, {"name": "four", "start_offset_obs": 0, "end_offset_obs": 3}, {"name": "none", "start_offset_obs": 99}])
    p = per.orderBy("period_no").toPandas()
    assert p["period"].tolist() == ["Full holdout", "week", "four"] and p["n_obs"].tolist() == [30, 8, 4]
    np.testing.assert_allclose(p["excess_ci_hi"][0], np.percentile(y[30:].sum() - m[30:].sum(0), 97.5))
    a = ex.ate_summary(per).toPandas().set_index("metric")
    assert a.loc["Total ATE", "estimate"] == pytest.approx(300) and a.loc["Mean ATE per observation", "estimate"] == pytest.approx(10)


def test_no_holdout_gives_empty_tables(spark):
    preds, sims, *_ = excess_inputs(spark)
    later = preds.withColumn("intervention_ts", F.lit("2030-01-01").cast("timestamp_ntz"))
    per = ex.excess_period(later, sims)
    assert ex.excess_obs(later, sims).count() == per.count() == ex.ate_summary(per).count() == 0


# ---- diagnostics


def test_diagnostics(spark):
    e = np.random.default_rng(5).normal(size=200)
    f = spark.createDataFrame(pd.DataFrame({"series_id": "s", "pos": np.arange(200), "residual": e}))
    got = dg.residual_acf(f).orderBy("lag").toPandas()
    np.testing.assert_allclose(got["acf"], sf.acf(e, 100), atol=1e-12)
    lb = dg.ljung_box(f, 7).first()
    assert lb["ljung_box_lags"] == 14
    r = sf.acf(e, 14)
    assert lb["ljung_box_stat"] == pytest.approx(200 * 202 * sum(r**2 / (200 - np.arange(1, 15))))
    t = dg.tidy(f, "m", 7, "D").toPandas()
    assert set(t["section"]) == {"summary", "acf", "ljung_box", "shapiro", "params"} and (t["status"] == "ok").all()
    short = dg.tidy(f.where("pos < 10"), "m", 7, "D").toPandas()
    assert (short[short.section == "ljung_box"]["status"] == "not_computed").all() and (short[short.section == "acf"]["status"] == "not_computed").all()
    assert dg.residual_pacf(f).count() == 99 and dg.residual_qq(f).count() == 200


def test_special_functions():
    assert sf.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert sf.chi2_sf(30, 10) == pytest.approx(0.000856641, rel=1e-6)
    w, p = sf.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.7888, abs=1e-4) and p == pytest.approx(0.0067, abs=1e-4)
    assert sf.derive_seed(42, "series_A") == 2089616679
    assert sf.pacf_yule_walker(np.array([0.5, 0.25, 0.125]))[1:] == pytest.approx([0, 0])


# ---- aliases, messages and draws


@pytest.mark.parametrize("alias", ["D", "2D", "W-MON", "W-SUN", "2W-WED", "B", "MS", "2MS", "ME", "BMS", "BME", "QS-OCT", "QS-NOV", "QE-DEC", "2QS-OCT", "YS-JAN", "YE-DEC", "5YS-JAN", "YS-APR", "h", "2h", "15min", "30s"])
def test_aliases_are_those_of_pandas(spark, alias):
    dates = pd.date_range("2020-01-01", periods=40, freq=alias)
    got = fq.resolve_frequency(grid(spark, dates)).first()
    assert got["error"] is None and got["alias"] == pd.infer_freq(dates)
    gone = fq.resolve_frequency(grid(spark, dates.delete(20))).first()
    assert gone["alias"] is None and "regular grid" in gone["error"]


def test_an_irregular_grid_names_the_first_date_out_of_step(spark):
    dates = pd.date_range("2020-01-01", periods=30).delete([10, 20])
    e = fq.resolve_frequency(grid(spark, dates), detail=True).first()["error"]
    assert "most steps are 1 day(s), but 2020-01-12 comes 2 day(s) after 2020-01-10" in e and "regular grid" in e
    assert fq.resolve_frequency(grid(spark, pd.date_range("2020-01-01", periods=5)), detail=True).first()["error"] is None


def test_all_missing_covariates_are_named(spark):
    df = spark.createDataFrame([(1, 2.0)], "ds int, y double")
    with pytest.raises(ValueError, match="not found: a, b"):
        validate.check_columns(df, "2020-01-01", "ds", "y", ["a", "b"])


@pytest.mark.parametrize("n", [1, 5, 13, 14, 15, 113])
def test_blocks_of_short_and_long_series(spark, n):
    r = spark.createDataFrame([("s", i, float(i)) for i in range(n)], "series_id string, pos int, residual double")
    sims = spark.range(60).selectExpr("cast(id as int) as sim")
    rows = bs.resample_blocks_sql(r, sims, 14).toPandas().sort_values(["sim", "pos"])
    assert len(rows) == 60 * n and (rows.groupby("sim")["pos"].apply(list).map(lambda x: x == list(range(n)))).all()
    e = rows["e"].to_numpy().reshape(60, n)
    if n <= 14:
        assert n == 1 or len({tuple(x) for x in e}) > 30
    else:
        for x in e:
            for b in range(0, n, 14):
                assert (np.diff(x[b:b + 14]) == 1).all()


def test_block_starts_are_uniform_and_independent(spark):
    sims = spark.range(400).selectExpr("cast(id as int) as sim", "explode(sequence(0, 9)) as b")
    rows = sims.select("sim", "b", *[bs.portable_start(F.lit(s), F.col("sim"), F.col("b"), F.lit(100)).alias(s) for s in ("x", "y")]).toPandas()
    x = rows.pivot(index="sim", columns="b", values="x").to_numpy().astype(float)
    y = rows.pivot(index="sim", columns="b", values="y").to_numpy().astype(float)
    assert x.min() == 0 and x.max() == 99
    chi = sum((c - 40) ** 2 / 40 for c in np.bincount(x.ravel().astype(int), minlength=100))
    assert 55 < chi < 155  # 99 degrees of freedom
    corr = lambda a, b: abs(np.corrcoef(a.ravel(), b.ravel())[0, 1])
    assert corr(x[:, :-1], x[:, 1:]) < 0.06 and corr(x[:-1], x[1:]) < 0.06 and corr(x, y) < 0.06
    assert len(set(np.diff(x, axis=1).ravel())) > 100  # no constant step from block to block


@pytest.mark.parametrize("name", ["excess_obs", "excess_period_days", "ate_summary", "batch_ate", "bootstrap_ci_quantile"])
def test_the_table_is_read_once(spark, name):
    import re

    from counterspark import queries as q

    from .conftest import SF

    spark.catalog.clearCache()
    plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and not re.search(r"(?m)^[\s:+|-]*Relation \[", plan)
    assert len({line.split("Scan parquet")[1] for line in plan.split("\n") if "Scan parquet" in line and "l_shipdate" in line}) == 1
    spark.catalog.clearCache()
