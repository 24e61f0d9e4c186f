"""Totals over trailing periods from prefix sums per entity, forward-filled over the calendar."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 6
HUGE = 1e25  # from here on a reading counts as infinite
READING = f"decimal(32,{SCALE})"
MONEY = f"decimal(38,{SCALE})"
MINUS = 1 << 32  # what an infinite reading below zero adds to ``odd``; one above zero adds 1


def daily_totals(readings: DataFrame) -> DataFrame:
    """(mo_id, at INT day number, total DECIMAL, odd LONG): equal values of one day count once, different ones add up.

    Totals are exact decimals of six places, so that differences of prefix sums carry no rounding error. What no such decimal can hold, infinite values and those of HUGE and
    more, is a reading too: its total is infinite, and ``odd`` counts it, so that it leaves a trailing period again. Both steps combine on the map side.
    """
    at = F.unix_date("day")
    values = readings.select("mo_id", at.alias("at"), "value").distinct()
    amount = F.when(F.abs("value") < HUGE, F.round(F.col("value"), SCALE).cast(READING)).otherwise(F.lit(0).cast(READING))
    odd = F.when(F.col("value") >= HUGE, 1).when(F.col("value") <= -HUGE, MINUS).otherwise(0).cast("long")
    return values.groupBy("mo_id", "at").agg(F.sum(amount).cast(MONEY).alias("total"), F.sum(odd).alias("odd"))


def as_double(total: Column, odd: Column) -> Column:
    """A total with its infinite readings: infinite of their sign, NaN with both signs."""
    up, down = odd.bitwiseAND(MINUS - 1) > 0, odd >= MINUS
    return F.when(up & down, F.lit(float("nan"))).when(up, F.lit(float("inf"))).when(down, F.lit(float("-inf"))).otherwise(total.cast("double"))


def trailing_runs(days: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Runs of days with equal trailing totals: (mo_id, from_at, to_at, first_at, last_at, total_w, odd_w, days_w for each w).

    The prefix sum P of an entity only changes on days of reading, so P(d) - P(d - w) only changes on days of
    reading and w days after them. The prefix is therefore forward-filled run by run instead of day by day: each reading is
    entered once for itself and once for each window's far end, one sorted pass gives all prefix sums, and the
    runs between neighbouring entries cover every calendar day of the entity's span exactly once. ``days_w`` counts the days with a reading.
    A run's rows per entity are bounded by days of its span, whatever share of all rows the entity has.
    """
    entry = lambda w: F.struct(F.lit(w).alias("lag"), (F.col("at") + w).alias("at"))
    own_days = days.repartition("mo_id")  # bounded by the calendar by now; serves the sums and the windows
    steps = own_days.select("mo_id", "total", "odd", F.explode(F.array(*map(entry, (0, *windows)))).alias("e"))
    own = lambda w: F.col("e.lag") == w
    sums = [F.sum(F.when(own(w), F.col("total"))).alias(f"s{w}") for w in (0, *windows)]
    counts = [F.sum(F.when(own(w), 1).otherwise(0)).alias(f"n{w}") for w in (0, *windows)]
    counts += [F.sum(F.when(own(w), F.col("odd")).otherwise(0)).alias(f"o{w}") for w in (0, *windows)]
    events = steps.groupBy("mo_id", F.col("e.at").alias("at")).agg(*sums, *counts)
    path = Window.partitionBy("mo_id").orderBy("at")
    so_far = path.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("mo_id")
    prefix = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(so_far)
    filled = events.select(
        "mo_id",
        F.col("at").alias("from_at"),
        (F.lead("at").over(path) - 1).alias("until_at"),
        F.min(F.when(F.col("n0") > 0, F.col("at"))).over(whole).alias("first_at"),
        F.max(F.when(F.col("n0") > 0, F.col("at"))).over(whole).alias("last_at"),
        *[prefix(f"s{w}").alias(f"p{w}") for w in (0, *windows)],
        *[prefix(f"n{w}").alias(f"c{w}") for w in (0, *windows)],
        *[prefix(f"o{w}").alias(f"q{w}") for w in (0, *windows)],
    )
    return filled.where(F.col("from_at") <= F.col("last_at")).select(
        "mo_id",
        "from_at",
        F.least(F.coalesce("until_at", "last_at"), "last_at").alias("to_at"),
        "first_at",
        "last_at",
        *[(F.col("p0") - F.col(f"p{w}")).alias(f"total_{w}") for w in windows],
        *[(F.col("c0") - F.col(f"c{w}")).alias(f"days_{w}") for w in windows],
        *[(F.col("q0") - F.col(f"q{w}")).alias(f"odd_{w}") for w in windows],
    )


def each_day(runs: DataFrame, low: Column | None = None) -> DataFrame:
    """One row per calendar day of the runs, from ``low`` on where it lies inside a run; adds ``at``."""
    start = F.col("from_at") if low is None else F.greatest("from_at", low)
    return runs.where(start <= F.col("to_at")).withColumn("at", F.explode(F.sequence(start, F.col("to_at"))))


def on_day(at: Column) -> Column:
    """STRING like ``2023-07-15`` of a day number."""
    return F.date_from_unix_date(at).cast("string")


def daily_report(days: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """(mo_id, on_day, total_w, avg_w, days_w): every calendar day of every entity's span.

    ``avg_w`` is the total by calendar days: by w, or by the days since the span's first while those are fewer.
    """
    rows = each_day(trailing_runs(days, windows))
    total = lambda w: as_double(F.col(f"total_{w}"), F.col(f"odd_{w}"))
    out = [total(w).alias(f"total_{w}") for w in windows]
    out += [(total(w) / F.least(F.lit(w), F.col("at") - F.col("first_at") + 1)).alias(f"avg_{w}") for w in windows]
    return rows.select("mo_id", on_day(F.col("at")).alias("on_day"), *out, *[F.col(f"days_{w}").cast("long").alias(f"days_{w}") for w in windows])


def window_totals(days: DataFrame, windows: DataFrame) -> DataFrame:
    """(mo_id, window, total, avg, days): totals over named windows of whole months.

    ``windows`` has window, window_start, window_end (first days of first and last month) and computed_at; of
    several computations of a window the latest counts, a window without id or bounds not at all. The total is the difference of the two prefix
    values forward-filled to the window's ends; ``avg`` divides by the window's calendar days. An entity has a row for each
    window that overlaps its span. The window's ends join the days as rows, months against months, without a cross join.
    """
    latest = windows.where("window IS NOT NULL AND window_start IS NOT NULL AND window_end IS NOT NULL").groupBy("window").agg(
        F.max(F.struct(F.coalesce("computed_at", F.lit("0001-01-01").cast("timestamp")), "window_start", "window_end")).alias("w")
    )
    bounds = latest.select("window", F.unix_date(F.col("w.window_start")).alias("low"), F.unix_date(F.last_day("w.window_end")).alias("high"))
    covered = bounds.where("low <= high").withColumn("month", F.explode(F.sequence(F.date_from_unix_date("low"), F.date_from_unix_date("high"), F.expr("interval 1 month"))))
    months = days.repartition("mo_id").groupBy("mo_id", F.trunc(F.date_from_unix_date("at"), "month").alias("month")).agg(F.sum("total").cast(MONEY).alias("total"), F.sum("odd").alias("odd"), F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"))
    path = Window.partitionBy("mo_id").orderBy("month")
    so_far = path.rowsBetween(Window.unboundedPreceding, 0)
    runs = months.select(
        "mo_id",
        "month",
        F.coalesce(F.lead("month").over(path), F.add_months("month", 1)).alias("next_month"),
        F.sum("total").over(so_far).alias("p"),
        F.sum("n").over(so_far).alias("c"),
        F.sum("odd").over(so_far).alias("q"),
        (F.sum("total").over(so_far) - F.col("total")).alias("p_before"),
        (F.sum("n").over(so_far) - F.col("n")).alias("c_before"),
        (F.sum("odd").over(so_far) - F.col("odd")).alias("q_before"),
    )
    # The prefix of every month of the span, forward-filled through months without a reading.
    filled = runs.withColumn("m", F.explode(F.sequence("month", F.add_months("next_month", -1), F.expr("interval 1 month")))).select(
        "mo_id", F.col("m").alias("month"), "p", "c", "q", F.when(F.col("m") == F.col("month"), F.col("q_before")).otherwise(F.col("q")).alias("q0"), F.when(F.col("m") == F.col("month"), F.col("p_before")).otherwise(F.col("p")).alias("p0"), F.when(F.col("m") == F.col("month"), F.col("c_before")).otherwise(F.col("c")).alias("c0")
    )
    ends = filled.join(covered, "month").groupBy("mo_id", "window", "low", "high").agg((F.max("c") - F.min("c0")).alias("days"), F.max_by("p", "month").alias("p_end"), F.min_by("p0", "month").alias("p_start"), (F.max_by("q", "month") - F.min_by("q0", "month")).alias("odd"))
    total = as_double(F.col("p_end") - F.col("p_start"), F.col("odd"))
    return ends.select(
        "mo_id",
        "window",
        total.alias("total"),
        (total / (F.col("high") - F.col("low") + 1)).alias("avg"),
        F.col("days").cast("long").alias("days"),
    )


def concentrated_days(days: DataFrame, near: int = 7, far: int = 30, least_days: int = 10, share: str = "0.6") -> DataFrame:
    """(mo_id, on_day): days whose ``near`` trailing total is more than ``share`` of the ``far`` one.

    Counted from the ``far``-th day of the span on, and only with at least ``least_days`` days of reading in the far window. Totals are compared exactly; an infinite far total has more than any share
    of it below it only if it is negative and the near one isn't.
    """
    part = Fraction(share)
    more = F.col(f"total_{near}") * F.lit(part.denominator).cast("decimal(6,0)") > F.col(f"total_{far}") * F.lit(part.numerator).cast("decimal(6,0)")
    odd = F.col(f"odd_{far}")
    more = F.when(odd == 0, more).otherwise((odd.bitwiseAND(MINUS - 1) == 0) & (F.col(f"odd_{near}") == 0))
    full = F.col("first_at") + far - 1
    dense = (F.col(f"days_{far}") >= least_days) & more
    return each_day(trailing_runs(days, (near, far)).where(dense), full).select("mo_id", on_day(F.col("at")).alias("on_day"))
