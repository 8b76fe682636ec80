"""Plots: their data always, a picture where matplotlib is installed."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnostics as diag

COLOR_NAMES = ("fit", "counterfactual", "intervention", "holdout", "observed")


def plot_colors(colors) -> dict[str, str]:
    """Colours by role, from a dict or a sequence in the roles' order; missing ones keep the default."""
    from ..config import DEFAULTS

    base = dict(DEFAULTS["output"]["plot_colors"])
    given = colors if isinstance(colors, dict) else dict(zip(COLOR_NAMES, colors or ()))
    unknown = set(given) - set(base)
    if unknown:
        raise ValueError(f"unknown plot colours {sorted(unknown)}")
    return base | given


def counterfactual_data(batch) -> DataFrame:
    """ds, split, observed, fitted, predicted, limits: every line and ribbon of the picture."""
    fit = batch.fits.select("series_id", "ds", "split", "y", "fitted", "yhat", "intervention_ts")
    return fit.join(batch.preds.select("series_id", "ds", "conf_lo", "conf_hi"), ["series_id", "ds"], "left").select(
        "series_id", "ds", "split", F.col("y").alias("observed"), "fitted", F.col("yhat").alias("predicted"), "conf_lo", "conf_hi", "intervention_ts"
    )


def residuals_over_time(batch) -> DataFrame:
    return batch.fits.where("split = 'train'").select("series_id", "pos", "ds", "residual")


def save_plots(result, path: Path) -> list[Path]:
    """The counterfactual and four residual plots, as data files and, if possible, PNGs."""
    fits = result.batch.fits.where("split = 'train'")
    m = result.series_frequency.seasonal_period
    data = {
        "counterfactual": counterfactual_data(result.batch).orderBy("ds"),
        "residual_acf": diag.acf_plot_data(fits, m).orderBy("lag"),
        "residual_pacf": diag.residual_pacf(fits).orderBy("lag"),
        "residuals_over_time": residuals_over_time(result.batch).orderBy("ds"),
        "residual_qq": diag.residual_qq(fits).orderBy("i"),
    }
    out = []
    try:
        import matplotlib

        matplotlib.use("Agg")
    except ImportError:
        matplotlib = None
    for name, df in data.items():
        pdf = df.toPandas()
        file = path / f"{name}.csv"
        pdf.to_csv(file, index=False)
        out.append(file)
        if matplotlib is not None:
            out.append(_picture(name, pdf, path / f"{name}.png", result))
    return out


def _picture(name: str, df: pd.DataFrame, file: Path, result) -> Path:
    import matplotlib.pyplot as plt

    o, c = result.config["output"], plot_colors(result.config["output"].get("plot_colors"))
    fig, ax = plt.subplots(figsize=tuple(o["plot_figsize"]))
    if name == "counterfactual":
        ax.plot(df["ds"], df["observed"], color=c["observed"], label="Observed")
        ax.plot(df["ds"], df["fitted"], color=c["fit"], label="Fit")
        ax.plot(df["ds"], df["predicted"], color=c["counterfactual"], label="Expected")
        ax.fill_between(df["ds"], df["conf_lo"], df["conf_hi"], color=c["counterfactual"], alpha=0.2)
        ax.axvline(df["intervention_ts"].iloc[0], color=c["intervention"])
        t = result.metrics_test
        ax.set_title(f"{result.model_name}: test RMSE {t.get('rmse')}, MAPE {t.get('mape')}")
        ax.legend()
    elif name in ("residual_acf", "residual_pacf"):
        ax.stem(df["lag"], df.iloc[:, 2])
        if "band" in df:
            for s in (1, -1):
                ax.plot(df["lag"], s * df["band"], linestyle="--", color=c["fit"])
    elif name == "residuals_over_time":
        ax.plot(df["ds"], df["residual"], color=c["fit"])
    else:
        ax.plot(df["theoretical"], df["ordered"], "o")
        ax.plot(df["theoretical"], df["slope"] * df["theoretical"] + df["intercept"])
    fig.savefig(file, dpi=o["plot_dpi"])
    plt.close(fig)
    return file
