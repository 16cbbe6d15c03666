"""Calendar ranges, buckets and histograms in a named zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Calendar presets in the order in which a timeline tries them; (start, end) as SQL over `d`, today.
PRESETS = {
    "today": ("{d}", "{d} + 1"),
    "yesterday": ("{d} - 1", "{d}"),
    "this_week": ("CAST(date_trunc('week', {d}) AS DATE)", "CAST(date_trunc('week', {d}) AS DATE) + 7"),
    "last_week": ("CAST(date_trunc('week', {d}) AS DATE) - 7", "CAST(date_trunc('week', {d}) AS DATE)"),
    "this_month": ("CAST(date_trunc('month', {d}) AS DATE)", "CAST(add_months(date_trunc('month', {d}), 1) AS DATE)"),
    "last_month": ("CAST(add_months(date_trunc('month', {d}), -1) AS DATE)", "CAST(date_trunc('month', {d}) AS DATE)"),
    "last_3_months": ("add_months({d}, -3)", "{d} + 1"),
    "last_6_months": ("add_months({d}, -6)", "{d} + 1"),
    "this_year": ("CAST(date_trunc('year', {d}) AS DATE)", "CAST(add_months(date_trunc('year', {d}), 12) AS DATE)"),
    "last_year": ("CAST(add_months(date_trunc('year', {d}), -12) AS DATE)", "CAST(date_trunc('year', {d}) AS DATE)"),
    "last_12_months": ("add_months({d}, -12)", "{d} + 1"),
    "last_2_years": ("add_months({d}, -24)", "{d} + 1"),
    "last_3_years": ("add_months({d}, -36)", "{d} + 1"),
}


def local_day(c: Column, zone: str) -> Column:
    return F.from_utc_timestamp(c, zone).cast("date")


def bounds(preset: str, today: str) -> tuple[Column, Column]:
    """First day and day after the last of a preset; month shifts clamp the day."""
    first, end = (F.expr(e.format(d=f"DATE'{today}'")) for e in PRESETS[preset])
    return first, end


def calendar_range(c: Column, preset: str, today: str, zone: str = "UTC") -> Column:
    """Whether an instant falls into a preset range; the end is exclusive."""
    a, b = bounds(preset, today)
    day = local_day(c, zone)
    return (day >= a) & (day < b)


def custom_range(c: Column, first: str, last: str, zone: str = "UTC") -> Column:
    """Both days inclusive."""
    return local_day(c, zone).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def inactive(df: DataFrame, group: str, ts: str, today: str, months: int = 3, zone: str = "UTC") -> DataFrame:
    """(group, last_day) of groups whose latest day lies before today minus some months."""
    last = df.groupBy(group).agg(F.max(local_day(F.col(ts), zone)).alias("last_day"))
    return last.where(F.col("last_day") < F.add_months(F.lit(today).cast("date"), -months))


def weekday_commits(df: DataFrame, key: list[str], ts: str, start: str, end: str, zone: str) -> DataFrame:
    """(weekday 1 = Sunday, n): different keys by local weekday in [start, end), all seven days."""
    day = local_day(F.col(ts), zone)
    own = df.where((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date"))).groupBy(*key).agg(F.min(ts).alias(ts))
    counts = own.groupBy(F.dayofweek(day).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    days = df.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("weekday"))
    return days.join(counts, "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("n"))


def periods(spark: SparkSession, today: str) -> DataFrame:
    """(period, rank, first_day, end_day): the presets as a table of thirteen rows."""
    rows = [spark.range(1).select(F.lit(p).alias("period"), F.lit(n).alias("rank"), *[x.alias(k) for x, k in zip(bounds(p, today), ("first_day", "end_day"), strict=True)]) for n, p in enumerate(PRESETS)]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def period_counts(df: DataFrame, ts: str, today: str, zone: str = "UTC") -> DataFrame:
    """(period, n) for the overlapping presets, each year, each month, and missing dates.

    Rows are counted by day first, so only days meet the thirteen periods.
    """
    days = df.groupBy(local_day(F.col(ts), zone).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    table = F.broadcast(periods(df.sparkSession, today))  # thirteen rows, always
    preset = days.join(table, (F.col("day") >= F.col("first_day")) & (F.col("day") < F.col("end_day"))).select("period", "n")
    year = days.where("day IS NOT NULL").select(F.date_format("day", "yyyy").alias("period"), "n")
    month = days.where("day IS NOT NULL").select(F.date_format("day", "yyyy-MM").alias("period"), "n")
    unknown = days.where("day IS NULL").select(F.lit("unknown").alias("period"), "n")
    return preset.union(year).union(month).union(unknown).groupBy("period").agg(F.sum("n").alias("n"))


def timeline_bucket(c: Column, today: str, zone: str = "UTC") -> Column:
    """The first preset that an instant falls into, else its month; unknown dates apart."""
    out = F.when(c.isNull(), "unknown")
    for p in PRESETS:
        out = out.when(calendar_range(c, p, today, zone), p)
    return out.otherwise(F.date_format(local_day(c, zone), "yyyy-MM"))
