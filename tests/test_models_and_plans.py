import json
import numpy as np
import pandas as pd
import pytest

from counterspark import compare_models, run_batch, run_single_its, time_series_cv, tune_model
from counterspark.config import DEFAULTS
from counterspark.models.arima import resolve_m
from counterspark.models.base import resolve_yearly
from counterspark.models.registry import available_models, make_model, register
from counterspark.plans.batch import run_directory
from counterspark.plans.tuning import SEARCH_SPACES, sample_lhs, unflatten
from counterspark.sources.series import specs

from .conftest import SF, daily, long

FAST = {"bootstrap": {"n_sim": 12}, "models": {"prophet_xgb": {"xgb": {"n_estimators": 40}}, "neuralprophet": {"epochs": 30}}}


@pytest.mark.filterwarnings("ignore::UserWarning")
@pytest.mark.parametrize("name", ["arima", "prophet_xgb", "neuralprophet"])
def test_model_contract(name):
    pdf, _ = daily(800, 0)
    pdf["c"] = np.random.default_rng(1).normal(size=800)
    pdf["y"] += 5 * pdf["c"]
    train, target = pdf[:700], pdf[700:]
    m = make_model(name, DEFAULTS["models"][name], {"seasonal_period": 7})
    with pytest.raises(RuntimeError):
        m.predict(target)
    r = m.fit(train, covariate_cols=["c"])
    ok = np.isfinite(r.fitted_values)
    np.testing.assert_allclose((r.fitted_values + r.residuals)[ok], train["y"][ok])
    p = m.predict(target, covariate_cols=["c"])
    assert len(p.predicted) == 100 and np.isfinite(p.predicted).all()
    fresh = m.clone_fresh()
    assert not fresh.fitted and fresh.params == m.params and fresh.params is not m.params
    fresh.params["new"] = 1
    assert "new" not in m.params
    if name == "arima":  # a refit keeps the order
        assert fresh.fit(train, covariate_cols=["c"]).metadata["order"] == r.metadata["order"]


def test_rules():
    with pytest.warns(UserWarning, match="DISABLED"):
        assert not resolve_yearly("auto", np.arange(730.0))
    with pytest.warns(UserWarning, match="ENABLED"):
        assert resolve_yearly("auto", np.arange(731.0))
    assert resolve_m("auto", 500, 7) == 7 and resolve_m("auto", 500, 7, seasonal=False) == 1
    with pytest.warns(UserWarning, match="two cycles"):
        assert resolve_m(52, 60, 52) == 52
    with pytest.raises(ValueError, match="m must be"):
        resolve_m(0, 60, 52)
    with pytest.raises(ValueError, match="Unknown model"):
        make_model("nope")
    register("mine", type(make_model("trend_season")))
    assert "mine" in available_models()
    from counterspark.models.registry import MODELS

    del MODELS["mine"]


def test_lhs_and_unflatten():
    s = sample_lhs(SEARCH_SPACES["prophet_xgb"], 20, 1)
    for name, (lo, hi, kind, _) in SEARCH_SPACES["prophet_xgb"].items():
        v = [x[name] for x in s]
        assert min(v) >= lo and max(v) <= hi and (kind != "int" or all(isinstance(x, int) for x in v))
    assert unflatten({"a__b": 1, "a__c": 2, "d": 3}) == {"a": {"b": 1, "c": 2}, "d": 3}
    assert sample_lhs(SEARCH_SPACES["arima"], 5, 1) == sample_lhs(SEARCH_SPACES["arima"], 5, 1)


@pytest.mark.filterwarnings("ignore::UserWarning")
@pytest.mark.parametrize("effect,band", [(10, (3, 20)), (0, (-8, 8)), (-8, (-20, 0))])
def test_recovers_planted_effect(spark, effect, band):
    pdf, event = daily(1460, 365, effect, seed=2)
    r = run_single_its(spark.createDataFrame(pdf), str(event), config_overrides=FAST)
    mean = r.ate.set_index("metric").loc["Mean ATE per observation", "estimate"]
    assert band[0] < mean < band[1]
    assert "RMSE" in r.summary()
    r.batch.unpersist()


@pytest.mark.filterwarnings("ignore::UserWarning")
def test_single_run_writes_its_files(spark, tmp_path):
    pdf, event = daily(400, 60)
    r = run_single_its(spark.createDataFrame(pdf), str(event), model_name="arima", config_overrides=FAST, output_dir=str(tmp_path))
    names = {p.name for p in tmp_path.iterdir()}
    assert {"excess.csv", "excess_period.csv", "metrics.csv", "diagnostics.csv", "ate_summary.csv", "counterfactual.csv", "residual_acf.csv", "residual_qq.csv"} <= names
    m = pd.read_csv(tmp_path / "metrics.csv")
    assert m["window"].tolist() == ["train", "test"] and m["rmse"].notna().all()
    assert r.batch.boot.first()["n_successful"] == 12


def test_single_run_raises(spark):
    pdf, event = daily(100, 30)
    run = lambda df, **k: run_single_its(spark.createDataFrame(df), str(event), model_name="arima", config_overrides=FAST, **k)
    with pytest.raises(ValueError, match="zero variance"):
        run(pdf.assign(y=5.0))
    with pytest.raises(ValueError, match="regular grid"):
        run(pdf.drop(index=[50]))
    with pytest.raises(ValueError, match="missing"):
        run(pdf.assign(y=pdf.y.where(pdf.index != 7)))
    with pytest.raises(ValueError, match="Unknown model"):
        run_single_its(spark.createDataFrame(pdf), str(event), model_name="nope")
    with pytest.raises(ValueError, match="not found"):
        run(pdf, target_col="z")


@pytest.mark.filterwarnings("ignore::UserWarning")
def test_batch_isolates_failures(spark):
    good, event = daily(300, 40)
    s = long(spark, good, "good").unionByName(long(spark, good.drop(index=[20]), "gap")).unionByName(long(spark, good.assign(y=1.0), "flat"))
    out = run_batch(s, specs(spark, [(x, str(event)) for x in ("good", "gap", "flat")]), "arima", overrides=FAST)
    errors = {r["series_id"]: r["error"] for r in out.errors.collect()}
    assert set(errors) == {"gap", "flat"}
    assert {r["series_id"] for r in out.ate.collect()} == {"good"}
    again = run_batch(s, specs(spark, [("good", str(event))]), "arima", overrides=FAST)
    frames = [x.ate.orderBy("metric").toPandas() for x in (again, out)]
    pd.testing.assert_frame_equal(*frames, rtol=1e-9)  # sums add in any order
    out.unpersist(), again.unpersist()


@pytest.mark.filterwarnings("ignore::UserWarning")
def test_cv_tuning_and_comparison(spark):
    pdf, event = daily(500, 60)
    df = spark.createDataFrame(pdf)
    cv = time_series_cv(df, str(event), "arima", n_folds=3, test_obs=40, min_train_obs=200)
    assert len(cv.folds) == 3 and cv.summary_row["mean_rmse"] > 0 and pd.Timestamp(cv.cv_end_date) <= event
    assert (pd.to_datetime(cv.folds["test_end_ds"]) < pd.Timestamp(cv.cv_end_date)).all()
    for bad in ({"split_method": "days"}, {"test_pct": 0.1}):
        with pytest.raises(ValueError):
            time_series_cv(df, str(event), **bad)
    t = tune_model(df, str(event), "neuralprophet", n_trials=3, n_folds=2)
    assert len(t.trials) == 3 and t.best_value == t.trials["mean_rmse"].min()
    for bad in ({"n_trials": 0}, {"n_folds": 1}, {"metric": "r2"}):
        with pytest.raises(ValueError):
            tune_model(df, str(event), "arima", **bad)
    c = compare_models(df, str(event), ["arima", "nope"], config_overrides=FAST)
    assert c["error"].isna().tolist() == [True, False]


def test_run_directories_count_up(tmp_path):
    a, b = run_directory(tmp_path, 10), run_directory(tmp_path, 10)
    assert a.name.endswith(".v001_sim10") and b.name.endswith(".v002_sim10")


@pytest.mark.parametrize("name", ["arima_forecast", "hybrid_forecast", "arnet_forecast", "compare_models", "tune_trials"])
def test_registered_forecasts_use_the_package_defaults(spark, monkeypatch, name):
    from counterspark import queries
    from counterspark.plans import batch, tuning

    class Called(Exception):
        pass

    def stop(*args, overrides=None, config_overrides=None, n_trials=None, n_folds=5, **rest):
        raise Called(overrides, config_overrides, n_trials, n_folds)

    for module, f in ((batch, "run_batch"), (tuning, "compare_models"), (tuning, "tune_model")):
        monkeypatch.setattr(module, f, stop)
    with pytest.raises(Called) as e:
        queries.QUERIES[name](spark, SF)
    assert e.value.args == (None, None, None, 5)


def test_save_batch_anywhere(spark, tmp_path):
    from counterspark.plans.batch import run_batch, save_batch

    df, event = daily(120, 30)
    out = run_batch(long(spark, df), specs(spark, [("s", str(event))]), "arima", overrides={"bootstrap": {"n_sim": 4}})
    a, b = (save_batch(out, f"file://{tmp_path}/runs") for _ in range(2))
    assert a.endswith("v001_sim4") and b.endswith("v002_sim4")
    assert spark.read.parquet(f"{b}/ate").count() == 2 and spark.read.parquet(f"{b}/errors").count() == 0
    assert json.loads(spark.read.text(f"{a}/config").first()[0])["bootstrap"]["n_sim"] == 4
    out.unpersist()


def test_a_seasonality_too_long_fails_before_the_fit(spark):
    df, event = daily(60, 20)
    with pytest.raises(ValueError, match="needs more than 400"):
        run_single_its(spark.createDataFrame(df), event, model_name="arima", config_overrides={"metrics": {"seasonality": 400}, "bootstrap": {"n_sim": 2}})
    with pytest.raises(ValueError, match="integer"):
        run_single_its(spark.createDataFrame(df), event, model_name="arima", config_overrides={"metrics": {"seasonality": 0}, "bootstrap": {"n_sim": 2}})


def test_cross_validation_periods():
    from counterspark.plans.tuning import _periods

    f = {"error": None, "m": 7}
    assert _periods(f, "arima", {"m": "auto", "seasonal": True}, "auto", 100) == (7, {"m": 7, "seasonal": True})
    assert _periods(f, "arima", {"m": 12}, "auto", 100) == (7, {"m": 12})
    assert _periods(f, "arima", {"seasonal": False}, 3, 100) == (3, {"seasonal": False})
    gap = {"error": "not a regular grid", "m": None}
    with pytest.raises(ValueError, match="regular grid"):
        _periods(gap, "arima", {}, 3, 100)
    assert _periods(gap, "arima", {"m": 1}, 3, 100) == (3, {"m": 1})


def test_tuning_section_is_read(spark):
    from counterspark.plans.tuning import tune_model

    df, event = daily(160, 20)
    r = tune_model(spark.createDataFrame(df), event, "arima", config_overrides={"tuning": {"n_folds": 2, "metric": "mae", "seed": 3, "model_defaults": {"arima": 2}, "test_pct": 0.05}})
    assert (r.n_folds, r.metric, r.seed, len(r.trials)) == (2, "mae", 3, 2)
