"""Windows of a series around its event: train, test, holdout, and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import split_arguments


def assign_splits(series: DataFrame, specs: DataFrame, split_method: str = "percent", **sizes) -> DataFrame:
    """``series`` with ``pos`` (0-based, by date), ``split`` and ``intervention_ts``.

    ``split`` is train, test, holdout or unused; what a model predicts is test and
    holdout.  Counts use half-even rounding and never fall below one row.
    """
    args = split_arguments(split_method, **sizes)
    s = Window.partitionBy("series_id")
    df = series.join(specs, "series_id")
    df = df.withColumn("pos", F.row_number().over(s.orderBy("ds")) - 1)
    pre = F.col("ds") < F.col("intervention_ts")
    if split_method == "days":
        test_from = F.col("intervention_ts") - F.make_dt_interval(F.lit(int(args["test_days"])))
        until = F.col("intervention_ts") + F.make_dt_interval(F.lit(int(args["holdout_days"])))
        split = F.when(F.col("ds") < test_from, "train").when(pre, "test").when(F.col("ds") <= until, "holdout")
        return df.withColumn("split", F.coalesce(split, F.lit("unused")))
    df = df.withColumn("_pre", F.count_if(pre).over(s)).withColumn("_all", F.count("*").over(s))
    if split_method == "percent":
        n_test = F.greatest(F.lit(1), F.bround(F.col("_pre") * F.lit(float(args["test_pct"]))).cast("int"))
        n_hold = F.greatest(F.lit(1), F.bround((F.col("_all") - F.col("_pre")) * F.lit(float(args["holdout_pct"]))).cast("int"))
    else:
        n_test, n_hold = F.lit(int(args["test_obs"])), F.lit(int(args["holdout_obs"]))
    split = (
        F.when(F.col("pos") < F.col("_pre") - n_test, "train").when(F.col("pos") < F.col("_pre"), "test")
        .when(F.col("pos") < F.col("_pre") + n_hold, "holdout")
    )
    return df.withColumn("split", F.coalesce(split, F.lit("unused"))).drop("_pre", "_all")


def test_window_notes(splits: DataFrame, min_test_obs: int = 30) -> DataFrame:
    """(series_id, n_train, n_test, n_holdout, note): a note where the test window is empty or short."""
    n = splits.groupBy("series_id").agg(*[F.count_if(F.col("split") == x).alias(f"n_{x}") for x in ("train", "test", "holdout")])
    note = (
        F.when(F.lit(min_test_obs <= 0), None)
        .when(F.col("n_test") == 0, "Test window is EMPTY: no observations fall in the test period.")
        .when(F.col("n_test") < min_test_obs, F.concat(F.lit("Test window has only "), F.col("n_test").cast("string"), F.lit(f" observations (< min_test_obs={min_test_obs}).")))
    )
    return n.withColumn("note", note)


def fold_sizes(n: int, split_method: str, n_folds: int, **sizes) -> tuple[int, int, int]:
    """(test rows, smallest training rows, skipped rows) of a cross-validation."""
    if split_method == "observations":
        return sizes["test_obs"], sizes["min_train_obs"], sizes["skip_obs"]
    if split_method != "percent":
        raise ValueError(f"split_method must be 'percent' or 'observations' here, got {split_method!r}: folds are sized in rows.")
    test, least, skip = sizes["test_pct"], sizes["min_train_pct"], sizes["skip_pct"]
    if least + n_folds * test > 1:
        raise ValueError(f"min_train_pct + n_folds * test_pct = {least + n_folds * test:.3f} exceeds 1.")
    size = lambda p: max(1, int(round(p * n)))
    return size(test), size(least), max(0, int(round(skip * n)))


def fold_layout(spark, n: int, n_folds: int, test: int, least: int, skip: int) -> DataFrame:
    """(fold, train_end, test_end): training rows are before train_end, test rows from there to test_end."""
    rows = []
    for i in range(n_folds):
        start = least + i * (test + skip)
        if start + test > n:
            break
        rows.append((i, start, start + test))
    if not rows:
        raise ValueError(f"{n} rows are too few for one fold of {least} training and {test} test rows.")
    return spark.createDataFrame(rows, "fold int, train_end int, test_end int")


def fold_rows(series: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows (with ``pos``) of every fold with ``part`` train or test: a range join with the few folds."""
    inside = F.col("pos") < F.col("test_end")
    # one row per fold, so the broadcast is bounded by n_folds
    return series.join(F.broadcast(folds), inside).withColumn("part", F.when(F.col("pos") < F.col("train_end"), "train").otherwise("test"))


def cv_end_date(series: DataFrame, specs: DataFrame, split_method: str = "percent", **sizes) -> DataFrame:
    """(series_id, cv_end_date): the first test date of the run's own split, the event if it has none."""
    splits = assign_splits(series, specs, split_method, **sizes)
    first = F.min(F.when(F.col("split") == "test", F.col("ds")))
    return splits.groupBy("series_id").agg(F.coalesce(first, F.min("intervention_ts")).alias("cv_end_date"))
