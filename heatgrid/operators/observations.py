"""Station observations and dated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.functions import dates


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether coordinates (numbers or texts) are inside of (west, south, east, north); texts that are no numbers are not."""
    lon, lat = lon.try_cast("double"), lat.try_cast("double")
    return F.coalesce((lon > box[0]) & (lon < box[2]) & (lat > box[1]) & (lat < box[3]), F.lit(False))


def active_stations(stations: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Stations whose first and last years are in the given ranges."""
    return stations.where(F.col("first_year").between(*first) & F.col("last_year").between(*last))


def daily_day_night(obs: DataFrame, station: str, when: str, value: str) -> DataFrame:
    """Mean per station, date and day or night, with week and season."""
    t = F.col(when)
    own = obs.select(station, F.to_date(t).alias("date"), dates.day_or_night(t).alias("day_night"), F.col(value).alias("v"), dates.week_of_year(t).alias("week"), dates.quarter_season(t).alias("season"))
    return own.groupBy(station, "date", "day_night", "week", "season").agg(F.avg("v").alias("mean"))


def monthly_daytime(daily: DataFrame, station: str) -> DataFrame:
    """Monthly means of the daily means by day."""
    return daily.where("day_night = 'day'").groupBy(station, dates.first_of_month(F.col("date")).alias("month")).agg(F.avg("mean").alias("mean"), F.count("*").alias("days"))


def monthly(obs: DataFrame, unit: str, when: str, value: str) -> DataFrame:
    """Mean, largest and least value of each unit and month."""
    return obs.groupBy(unit, dates.first_of_month(F.to_date(when)).alias("month")).agg(F.avg(value).alias("mean"), F.max(value).alias("largest"), F.min(value).alias("least"))


#: Days are counted from 2^21 days before 1970; blocks of days have up to 2^22.
_FIRST, _BLOCKS = 1 << 21, 22


def _day(c: str) -> Column:
    return F.unix_date(F.to_date(F.col(c))).cast("long") + _FIRST


def _blocks(first: Column, end: Column) -> Column:
    """The blocks (size, number) of 2^size days that make up the days from first to before end: two of a size at most."""

    def of_size(size: Column) -> Column:
        whole = F.pow(F.lit(2.0), size).cast("long")
        low, high = F.floor((first + whole - 1) / whole), F.floor(end / whole)
        block = lambda when, number: F.when(when, F.struct(size.cast("int").alias("size"), number.cast("long").alias("number")))
        own = low % 2 == 1
        return F.array(block(own & (low < high), low), block((high % 2 == 1) & (low + own.cast("int") < high), high - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_BLOCKS)), of_size)))


def interval_nearest(events: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Intervals of the same key that hold the event's date, both ends included; of these those that start nearest to it, ties kept.

    Dates are taken as days; events and intervals without a key, a date or both ends go. An interval is made up of blocks
    of days, two of a size at most, and a block keeps the latest start of all intervals that have it. A day looks up its
    block of each size, and the latest start of all is the nearest. So rows follow events and intervals, however many of a
    key there are and however much they overlap; events and intervals meet by key and that start alone. Blocks are several
    for each interval, which Spark's estimates do not know, so these joins are by sort and never by a broadcast.
    """
    held = intervals.select(F.col(key).alias("__key"), _day(start).alias("__start"), _day(end).alias("__end")).where("__key IS NOT NULL AND __start <= __end")
    latest = held.select("__key", "__start", F.explode(_blocks(F.col("__start"), F.col("__end") + 1)).alias("__b")).groupBy("__key", "__b").agg(F.max("__start").alias("__latest"))
    days = events.select(F.col(key).alias("__key"), _day(at).alias("__day")).distinct()
    sizes = latest.select(F.col("__b.size").alias("__size")).distinct()  # _BLOCKS rows at most
    asked = days.crossJoin(F.broadcast(sizes)).withColumn("__b", F.struct(F.col("__size").alias("size"), F.floor(F.col("__day") / F.pow(F.lit(2.0), F.col("__size"))).alias("number")))
    found = asked.join(latest.hint("merge"), ["__key", "__b"]).groupBy("__key", "__day").agg(F.max("__latest").alias("__start"))
    own = events.withColumn("__day", _day(at))
    own = own.join(found.hint("merge"), (F.col(key) == F.col("__key")) & (own["__day"] == found["__day"])).drop(found["__day"]).drop("__key")
    ends = intervals.withColumns({"__begins": _day(start), "__ends": _day(end)})
    met = own.join(ends.withColumnRenamed(key, "__of").hint("merge"), (F.col(key) == F.col("__of")) & (F.col("__start") == F.col("__begins"))).where("__day <= __ends")
    rest = [c for c in events.columns if c != key] + [c for c in intervals.columns if c != key]
    return met.select(key, *rest, (F.col("__day") - F.col("__start")).cast("int").alias("days"))


def season_match(assessments: DataFrame, ndvi: DataFrame, key: str, at: str) -> DataFrame:
    """Seasonal values (key, year_season, value) for the season of each date."""
    return assessments.withColumn("year_season", dates.year_season(F.col(at))).join(ndvi, [key, "year_season"])
