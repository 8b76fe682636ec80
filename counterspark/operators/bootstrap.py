"""Moving-block bootstrap: seeds, block resampling and confidence limits.

Simulations are rows.  ``resample_blocks_sql`` draws block starts from digests
that any SQL engine repeats; ``resample_blocks`` is the NumPy form used
inside model refits.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample_blocks(residuals: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of ``length`` from random starts, cut to the series' length; too short a series is drawn row by row."""
    n = len(residuals)
    if n - length < 1:
        return rng.choice(residuals, size=n, replace=True)
    starts = rng.integers(0, n - length + 1, size=-(-n // length))
    return residuals[(starts[:, None] + np.arange(length)).ravel()[:n]]


def portable_start(series: Column, sim: Column, block: Column, n_starts: Column) -> Column:
    """A block start in 0 .. n_starts - 1: 52 bits of the MD5 of (simulation, block, series), which any engine has."""
    digest = F.md5(F.concat_ws(":", sim.cast("string"), block.cast("string"), series))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") % n_starts.cast("bigint")


def resample_blocks_sql(residuals: DataFrame, sims: DataFrame, length: int) -> DataFrame:
    """(series_id, sim, pos, e): resampled residuals of each series for each simulation.

    A series no longer than a block is drawn row by row.  Each series' residuals (a bounded
    series, not the corpus) become one array, which the simulations read; no row is
    shuffled per simulation.
    """
    arrays = residuals.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "residual"))), lambda x: x["residual"]).alias("r"))
    n = F.size("r")
    arrays = arrays.withColumn("n", n).withColumn("len", F.when(n <= length, 1).otherwise(length))
    blocks = F.sequence(F.lit(0), F.expr("(n + len - 1) div len - 1").cast("int"))
    starts = F.transform(blocks, lambda b: portable_start(F.col("series_id"), F.col("sim"), b, F.col("n") - F.col("len") + 1).cast("int"))
    drawn = F.slice(F.flatten(F.transform(starts, lambda s: F.slice("r", s + 1, F.col("len")))), F.lit(1), F.col("n"))
    # a few hundred simulation numbers, made on the spot
    return arrays.join(F.broadcast(sims.select("sim"))).select("series_id", "sim", F.posexplode(drawn).alias("pos", "e"))


def limits(sims: DataFrame, by: list[str], value: Column, level: float = 0.95, prefix: str = "conf") -> DataFrame:
    """Exact percentile limits of ``value`` over simulations; nulls (failed fits) are skipped."""
    a = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(a), F.lit(1 - a)))
    return sims.groupBy(*by).agg(q.alias("_q")).select(*by, F.col("_q")[0].alias(f"{prefix}_lo"), F.col("_q")[1].alias(f"{prefix}_hi"))


def confidence(preds: DataFrame, sims: DataFrame, by: list[str], method: str = "quantile", level: float = 0.95, yhat: str = "yhat", sim_yhat: str = "yhat_sim") -> DataFrame:
    """``preds`` with conf_lo and conf_hi from its simulations."""
    if method == "quantile":
        ci = limits(sims, by, F.col(sim_yhat), level)
        return preds.join(ci, by, "left")
    if method != "symmetric_sd":
        raise ValueError(f"ci_method must be 'quantile' or 'symmetric_sd', got {method!r}.")
    z = NormalDist().inv_cdf(0.5 + level / 2)
    sd = sims.groupBy(*by).agg(F.stddev_pop(sim_yhat).alias("_sd"))
    return preds.join(sd, by, "left").withColumn("conf_lo", F.col(yhat) - z * F.col("_sd")).withColumn("conf_hi", F.col(yhat) + z * F.col("_sd")).drop("_sd")


def fixed_block_length(length: int = 14) -> int:
    if length < 1:
        raise ValueError(f"block length must be >= 1, got {length}.")
    return length


def nppi_block_length(residuals) -> int:
    raise NotImplementedError("Non-parametric plug-in block length is not implemented; use fixed_block_length.")


def grid_search_block_length(*args, **kwargs) -> int:
    raise NotImplementedError("Grid-search block length is not implemented; use fixed_block_length.")
