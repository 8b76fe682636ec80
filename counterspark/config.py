"""Configuration: package defaults, a user's YAML, and overrides, merged in that order.

Window units are explicit everywhere: percent and observations count rows, days are
calendar time.  A key of another family than the chosen method raises; it is never
ignored.
"""

from __future__ import annotations

import copy
from typing import Any

# The defaults that users of such analyses know.
DEFAULTS: dict[str, Any] = {
    "data": {"date_col": "ds", "target_col": "y", "covariate_cols": [], "missing_data": "error"},
    "periods": {"split_method": "percent", "min_test_obs": 30},
    "models": {
        "prophet_xgb": {
            "prophet": {
                "yearly_seasonality": "auto", "weekly_seasonality": "auto", "daily_seasonality": False,
                "changepoint_prior_scale": 0.05, "seasonality_prior_scale": 10.0, "changepoint_range": 0.8,
            },
            "xgb": {
                "n_estimators": 300, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8,
                "colsample_bytree": 0.8, "min_child_weight": 3, "gamma": 1.0,
            },
        },
        "neuralprophet": {
            "n_lags": 14, "yearly_seasonality": "auto", "weekly_seasonality": "auto",
            "learning_rate": 0.01, "epochs": 100, "batch_size": 64, "n_hidden_layers": 0,
        },
        "arima": {
            "max_p": 5, "max_d": 2, "max_q": 5, "max_P": 2, "max_D": 1, "max_Q": 2,
            "seasonal": True, "m": "auto", "stepwise": True, "suppress_warnings": True,
        },
    },
    "bootstrap": {"method": "mbb", "n_sim": 1000, "block_length": 14, "ci_method": "quantile", "ci_level": 0.95},
    "metrics": {"seasonality": "auto"},
    "output": {
        "format": "csv", "plot_dpi": 150, "plot_figsize": [14, 6],
        "plot_colors": {
            "fit": "#2166AC", "counterfactual": "#B2182B", "intervention": "#4DAF4A",
            "holdout": "#FEE08B", "observed": "#333333",
        },
        "plot_font_sizes": {"title": 22, "axis_label": 20, "tick": 18, "legend": 18},
    },
    "excess_periods": [],
    "tuning": {
        "split_method": "percent", "n_folds": 5, "metric": "rmse", "seed": 42,
        "model_defaults": {"prophet_xgb": 100, "neuralprophet": 75, "arima": 100},
    },
}

#: The keys of each way to size windows, with their defaults (None: must be given).
SPLIT_KEYS = {
    "percent": {"test_pct": 0.20, "holdout_pct": 1.0},
    "days": {"test_days": 365, "holdout_days": 365},
    "observations": {"test_obs": None, "holdout_obs": None},
}

TUNING_KEYS = {
    "percent": {"test_pct": 0.10, "min_train_pct": 0.50, "skip_pct": 0.0},
    "observations": {"test_obs": 365, "min_train_obs": 730, "skip_obs": 0},
}

#: Keys that earlier configurations had; their unit was not said.
LEGACY_TUNING_KEYS = ("test_days", "min_train_days", "skip_days")


def deep_merge(base: dict, override: dict) -> dict:
    """A new dict: dicts merge key by key, anything else (lists too) is replaced whole."""
    out = copy.deepcopy(base)
    for key, value in override.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = deep_merge(out[key], value) if both else copy.deepcopy(value)
    return out


def load_config(path: str | None = None, overrides: dict | None = None) -> dict:
    out = copy.deepcopy(DEFAULTS)
    if path is not None:
        import yaml

        with open(path) as f:
            out = deep_merge(out, yaml.safe_load(f) or {})
    if out["bootstrap"].get("method", "mbb") != "mbb" or (overrides or {}).get("bootstrap", {}).get("method", "mbb") != "mbb":
        raise ValueError("bootstrap.method must be 'mbb'.")
    return deep_merge(out, overrides or {})


def model_config(config: dict, name: str) -> dict:
    """A copy of one model's parameters; empty for a model without any."""
    return copy.deepcopy(config.get("models", {}).get(name, {}))


def _family(given: dict, families: dict[str, dict], method: str, what: str) -> dict:
    """The arguments of ``method``'s family; foreign ones raise."""
    if method not in families:
        raise ValueError(f"split_method must be one of {sorted(families)}, got {method!r}.")
    known = {k for f in families.values() for k in f}
    foreign = sorted(k for k, v in given.items() if k in known and k not in families[method] and v is not None)
    if foreign:
        raise ValueError(f"{what} {foreign} do not apply to split_method={method!r}, which uses {list(families[method])}.")
    return {k: default if given.get(k) is None else given[k] for k, default in families[method].items()}


def split_config(periods: dict, split_method: str | None = None) -> tuple[str, dict]:
    """(method, its arguments) from the ``periods`` section; ``split_method`` overrides the section's."""
    method = split_method or periods.get("split_method", "percent")
    return method, _family(periods, SPLIT_KEYS, method, "periods config keys")


def split_arguments(split_method: str, **given) -> dict:
    """Checked arguments for a split: no foreign ones, each in its range."""
    out = _family(given, SPLIT_KEYS, split_method, "Arguments")
    if split_method == "percent":
        if not all(0 < v <= 1 for v in out.values()):
            raise ValueError(f"test_pct and holdout_pct must be in (0, 1], got {out}.")
    else:
        if any(v is None for v in out.values()):
            raise ValueError("split_method='observations' requires explicit test_obs and holdout_obs.")
        if min(out.values()) < 1:
            raise ValueError(f"{' and '.join(out)} must be >= 1, got {out}.")
    return out


def tuning_config(config: dict) -> dict:
    """The tuning section with its family's defaults filled in."""
    section = copy.deepcopy(config.get("tuning", {}))
    legacy = [k for k in LEGACY_TUNING_KEYS if k in section]
    if legacy:
        raise ValueError(f"tuning keys {legacy} are not accepted: windows there are rows; use the _obs keys.")
    method = section.get("split_method", "percent")
    return {**section, "split_method": method, **_family(section, TUNING_KEYS, method, "tuning config keys")}
