"""Proof that a series is a complete regular grid, and its seasonal period.

Gaps come from one ``lag`` over each series; a single aggregate classifies and proves
them.  A series with nulls, duplicates or gaps gets an ``error``, never a fill.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The dominant seasonal period of each family of frequencies.
SEASONAL_PERIODS = {"D": 7, "W": 52, "M": 12, "MS": 12, "ME": 12}

# Weekdays and months as aliases end in them.
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


@dataclass(frozen=True)
class SeriesFrequency:
    alias: str
    offset: object = field(default=None, compare=False)

    @classmethod
    def from_alias(cls, alias: str) -> SeriesFrequency:
        return cls(alias)

    @property
    def seasonal_period(self) -> int | None:
        return SEASONAL_PERIODS.get(self.alias.split("-")[0])


def seasonal_period(alias: Column) -> Column:
    """The dominant seasonal period of a frequency alias, null where none is mapped."""
    family = F.split(alias, "-")[0]
    out = F.lit(None).cast("int")
    for name, m in SEASONAL_PERIODS.items():
        out = F.when(family == name, m).otherwise(out)
    return out


def gaps(series: DataFrame) -> DataFrame:
    """Each date with the one before it and the seconds between them."""
    w = Window.partitionBy("series_id").orderBy("ds")
    out = series.select("series_id", "ds", F.lag("ds").over(w).alias("prev"))
    seconds = F.unix_timestamp(F.col("ds").cast("timestamp")) - F.unix_timestamp(F.col("prev").cast("timestamp"))
    return out.withColumn("gap_s", seconds)


def _month_position(c: str) -> dict[str, Column]:
    """Where in its month a date stands: on the first or last day (S, E), or on the first or last weekday (BS, BE)."""
    day, last, weekday = F.dayofmonth(c), F.last_day(c), F.weekday(F.col(c))
    last_weekday = F.date_sub(last, F.greatest(F.lit(0), F.weekday(last) - 4))
    return {
        "S": day == 1, "BS": (day == 1) & (weekday < 5) | (weekday == 0) & (day <= 3),
        "E": F.to_date(c) == last, "BE": F.to_date(c) == last_weekday,
    }


def _counted(n: Column, alias: Column) -> Column:
    """``alias`` with a step of more than one before it."""
    return F.concat(F.when(n == 1, "").otherwise(n.cast("int").cast("string")), alias)


def resolve_frequency(series: DataFrame, detail: bool = False) -> DataFrame:
    """(series_id, n, alias, m, error): ``alias`` where the grid is proven, else why it is not.

    ``detail``: an irregular grid's error names the first date out of step, for one more look at that series.
    """
    months = (F.year("ds") * 12 + F.month("ds")) - (F.year("prev") * 12 + F.month("prev"))
    midnight = F.date_trunc("day", "ds") == F.col("ds")
    g = gaps(series).withColumn("months", months)
    day, hour, minute = 86_400, 3_600, 60
    business = (F.weekday("ds") < 5) & (F.col("prev").isNull() | (F.col("gap_s") == F.when(F.weekday("ds") == 0, 3 * day).otherwise(day)))
    per = g.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ds").isNull()).alias("n_null"),
        F.count_if(F.col("gap_s") == 0).alias("n_dup"),
        F.min("gap_s").alias("lo"), F.max("gap_s").alias("hi"),
        F.min("months").alias("mlo"), F.max("months").alias("mhi"),
        *[F.bool_and(where & midnight).alias(f"at_{k}") for k, where in _month_position("ds").items()],
        F.bool_and(business & midnight).alias("business"),
        F.min("ds").alias("first"),
        F.expr("mode(gap_s, true)").alias("modal"),
    )
    step = F.col("lo") == F.col("hi")
    lo, mlo = F.col("lo"), F.col("mlo")
    monthly = (mlo == F.col("mhi")) & (mlo > 0)
    name = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), at.cast("int"))
    month = F.month("first")
    # the last of the quarter-months by which the quarters of a year are named: Jan, Apr, Jul, Oct go by OCT
    quarter = name(MONTHS, F.when(month % 3 == 0, 12).when(month % 3 == 2, 11).otherwise(10))
    alias = F.lit(None).cast("string")
    for k, letters in reversed([("S", ("", "S")), ("BS", ("B", "S")), ("E", ("", "E")), ("BE", ("B", "E"))]):
        pre, post = letters
        kind = lambda unit: F.lit(f"{pre}{unit}{post}")  # noqa: E731, B023
        here = (
            F.when(mlo % 12 == 0, _counted(mlo / 12, F.concat(kind("Y"), F.lit("-"), name(MONTHS, month))))
            .when(mlo % 3 == 0, _counted(mlo / 3, F.concat(kind("Q"), F.lit("-"), quarter)))
            .otherwise(_counted(mlo, kind("M")))
        )
        alias = F.when(monthly & F.col(f"at_{k}"), here).otherwise(alias)
    every = lambda n: step & (lo > 0) & (F.pmod(lo, F.lit(n)) == 0)
    alias = F.coalesce(
        alias,
        F.when(every(7 * day), _counted(lo / (7 * day), F.concat(F.lit("W-"), name(WEEKDAYS, F.weekday("first") + 1))))
        .when(every(day), _counted(lo / day, F.lit("D")))
        .when(F.col("business"), "B")
        .when(every(hour), _counted(lo / hour, F.lit("h")))
        .when(every(minute), _counted(lo / minute, F.lit("min")))
        .when(step & (lo > 0), _counted(lo, F.lit("s"))),
    )
    error = (
        F.when(F.col("n_null") > 0, F.concat(F.col("n_null").cast("string"), F.lit(" date(s) are missing (NaT).")))
        .when(F.col("n") < 3, F.concat(F.lit("At least 3 dates are needed to infer a frequency, got "), F.col("n").cast("string"), F.lit(".")))
        .when(F.col("n_dup") > 0, F.concat(F.lit("Duplicate dates: "), F.col("n_dup").cast("string"), F.lit(".")))
        .when(F.col("alias").isNull(), F.lit("The dates are not a regular grid. Fill or aggregate the series to a regular grid first."))
    )
    out = per.withColumn("alias", alias).withColumn("error", error)
    if detail:
        odd = out.where("error like 'The dates are not%'").select("series_id")
        time = lambda c: F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), " 00:00:00$", "")
        gap = lambda c: F.when(F.pmod(F.col(c), F.lit(day)) == 0, F.concat((F.col(c) / day).cast("int").cast("string"), F.lit(" day(s)"))).otherwise(F.concat(F.col(c).cast("string"), F.lit(" s")))
        first = first_departure(series.join(odd, "series_id", "left_semi"))
        first = first.select("series_id", F.concat(
            F.lit("The dates are not a regular grid: most steps are "), gap("modal_gap_s"), F.lit(", but "), time("ds"), F.lit(" comes "), gap("gap_s"), F.lit(" after "), time("prev"),
            F.lit(". Fill or aggregate the series to a regular grid first."),
        ).alias("_detail"))
        out = out.join(first, "series_id", "left").withColumn("error", F.coalesce("_detail", "error"))
    out = out.withColumn("alias", F.when(F.col("error").isNull(), F.col("alias")))
    return out.select("series_id", "n", "alias", seasonal_period(F.col("alias")).alias("m"), "error", "modal")


def first_departure(series: DataFrame) -> DataFrame:
    """(series_id, modal_gap_s, prev, ds, gap_s) of the first gap that is not the modal one, of irregular series."""
    g = gaps(series).where("gap_s is not null")
    modal = g.groupBy("series_id").agg(F.expr("mode(gap_s, true)").alias("modal_gap_s"))
    odd = g.join(modal, "series_id").where("gap_s <> modal_gap_s")
    first = odd.groupBy("series_id", "modal_gap_s").agg(F.min(F.struct("ds", "prev", "gap_s")).alias("x"))
    return first.select("series_id", "modal_gap_s", "x.prev", "x.ds", "x.gap_s")
