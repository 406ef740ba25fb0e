"""Joins and aggregates along time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written


# Rows of a key beyond which an as-of join cuts its time into parts.
LARGE_KEY = 2_000_000


def asof_join(left: DataFrame, right: DataFrame, *, on: list[str], left_time: str, right_time: str, values: list[str], bucket: Callable[[Column], Column] | None = None, large: int = LARGE_KEY) -> DataFrame:
    """Left rows with the values of the latest right row of the same keys whose time is not after theirs.

    Union and one window pass: one shuffle by key, no range join. Right rows sort before left rows of the same time;
    of right rows of one time the largest values count. bucket: cuts time into parts (a month, a day) where a key is
    counted to have more than `large` rows, so that it is many tasks. Each part then begins with the last right row
    before it, found from one row per key and part.
    """
    names = left.columns
    if bucket:
        counted = left.select(*on).unionAll(right.select(*on)).groupBy(*on).agg(F.count("*").alias("n"))
        bucket = None if counted.filter(F.col("n") > large).isEmpty() else bucket
    part = (lambda t: bucket(t)) if bucket else (lambda t: F.lit(0))
    keys = [*on, "part"]
    l = left.select(F.struct(*names).alias("l"), *on, F.col(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("r")).withColumn("part", part(F.col("t")))
    empty = F.lit(None).cast(l.schema["l"].dataType).alias("l")
    r = right.select(empty, *on, F.col(right_time).alias("t"), F.lit(0).alias("side"), F.struct(*values).alias("r")).withColumn("part", part(F.col("t")))
    rows = l.unionByName(r)
    if bucket:
        ends = r.groupBy(*keys).agg(F.max(F.struct("t", "r")).alias("last")).unionByName(l.select(*keys).distinct().withColumn("last", F.lit(None)), allowMissingColumns=True).groupBy(*keys).agg(F.max("last").alias("last"))
        before = Window.partitionBy(*on).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and part
        carried = ends.withColumn("last", F.last("last", ignorenulls=True).over(before)).filter("last is not null")
        rows = rows.unionByName(carried.select(empty, *on, F.col("last.t").alias("t"), F.lit(-1).alias("side"), F.col("last.r").alias("r"), "part"))
    seen = F.last("r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("t", "side", "r").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("r", seen).filter("side = 1").select("l.*", *[F.col(f"r.{v}").alias(v) for v in values])


def convert(amounts: DataFrame, rates: DataFrame, *, currency: str = "currency", date: str = "date", amount: str = "amount") -> DataFrame:
    """amount_eur with the latest rate (units per EUR) on or before the date; EUR stays; null without a rate.

    Rows in EUR need no rate and are not shuffled; others meet their rates by currency and month.
    """
    r = rates.select(F.col("currency").alias(currency), F.col("date").alias("rate_date"), F.col("rate").cast("double").alias("rate"))
    is_eur = F.coalesce(F.col(currency) == "EUR", F.lit(False))
    joined = asof_join(amounts.filter(~is_eur), r, on=[currency], left_time=date, right_time="rate_date", values=["rate"], bucket=lambda t: F.trunc(t, "month"))
    foreign = joined.withColumn("amount_eur", F.try_divide(F.col(amount), F.col("rate")))
    return foreign.unionByName(amounts.filter(is_eur).withColumns({"rate": F.lit(None).cast("double"), "amount_eur": F.col(amount).cast(foreign.schema["amount_eur"].dataType)}))


def trailing(rows: DataFrame, *, key: str, time: Column, days: int, aggregates: dict[str, Column]) -> DataFrame:
    """aggregates over the rows of the same key in [time - days, time): a range frame, so one sort and no self-join.

    time: seconds, whole ones or with fractions, which are rounded (halves to the even second). The row itself and those of
    the same second are outside the window. A row without key or time has no others: each is apart.
    """
    w = Window.partitionBy(key, "__apart").orderBy("__t").rangeBetween(-days * 86400, -1)
    apart = F.when(F.col(key).isNull() | F.col("__t").isNull(), F.monotonically_increasing_id())
    x = rows.withColumn("__t", F.rint(time.cast("double")).cast("long")).withColumn("__apart", apart).withColumn("__t", F.coalesce("__t", F.lit(0).cast("long")))
    return x.withColumns({n: a.over(w) for n, a in aggregates.items()}).drop("__t", "__apart")


def _numbered_values(values: DataFrame, bins: int) -> DataFrame:
    """y, v, place: the distinct values of each year numbered from 0 in order. Bins, cut by approximate percentiles, are
    numbered apart and set off by the bins before them, so that a year is many tasks."""
    v = values.select("y", "v").distinct()
    cuts = v.groupBy("y").agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], 10000).alias("c"))  # one row a year
    v = v.join(F.broadcast(cuts), "y").withColumn("b", F.size(F.filter("c", lambda c: c < F.col("v")))).drop("c")
    sizes = v.groupBy("y", "b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("y").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("y", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    place = F.col("o") + F.row_number().over(Window.partitionBy("y", "b").orderBy("v")) - 1
    return v.join(F.broadcast(offsets), ["y", "b"]).select("y", "v", place.alias("place"))  # bins rows a year


def expanding_median(values: DataFrame, *, time: str, year: str, value: str, at: DataFrame, at_time: str, at_year: str, minimum: float = 0.0, bins: int = 256, parts: int = 64) -> DataFrame:
    """at + median_before and n_before: of value in at's year over rows strictly before at's time.

    The middle ranks are found digit by digit. Values are numbered in order within their year; a pass over one digit of
    the numbers, from the highest, sums along time how many earlier values have each digit below the digits found so
    far, and an asked time takes the digit that holds its rank. So a pass costs a row per value and asked time, there are
    as many passes as the count of values has digits (of 4 bits), and nothing grows with their product. Time is cut
    into `parts` a year that are summed apart, so the first pass, in which all of a year share a prefix, is many tasks.
    """
    y, t = F.col(year).alias("y"), F.col(time).alias("t")
    v = values.filter(F.col(value) >= minimum).select(y, t, F.col(value).cast("double").alias("v")).filter("y is not null and t is not null")
    v = written(v.groupBy("y", "t", "v").agg(F.count("*").alias("n")), "median-values")
    numbers = written(_numbered_values(v, bins), "median-numbers")
    cuts = F.broadcast(v.groupBy("y").agg(F.percentile_approx("t", [i / parts for i in range(1, parts)], 10000).alias("c")))  # one row a year
    asked = at.select(F.col(at_year).alias("y"), F.col(at_time).alias("t")).distinct().filter("y is not null and t is not null")
    in_part = lambda x: x.join(cuts, "y").withColumn("part", F.size(F.filter("c", lambda c: c < F.col("t")))).drop("c")
    none = F.lit(None).cast("long")
    held = in_part(v.join(numbers, ["y", "v"])).select("y", "part", "t", F.lit(1).alias("side"), "place", "n", none.alias("i"), none.alias("r"), none.alias("all"))
    asks = in_part(asked).select("y", "part", "t", F.lit(0).alias("side"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("n"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("i"), none.alias("r"), none.alias("all"))
    most = numbers.agg(F.max("place").alias("m")).first()["m"] or 0
    rows = written(held.unionByName(asks), "median-rows")
    for shift in range(4 * max(0, (most.bit_length() - 1) // 4), -1, -4):
        # Above the shift, places of values are whole; those of asked times are what has been found.
        prefix, digit = F.shiftright("place", shift + 4), F.shiftright("place", shift).bitwiseAND(F.lit(15))
        x = rows.withColumns({"prefix": prefix, "digit": digit})
        of_digit = [F.coalesce(F.sum(F.when(F.col("digit") == d, F.col("n"))), F.lit(0)).alias(f"d{d}") for d in range(16)]
        per = x.groupBy("y", "prefix", "part").agg(*of_digit)
        earlier = Window.partitionBy("y", "prefix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
        carried = per.select("y", "prefix", "part", F.array(*[F.coalesce(F.sum(f"d{d}").over(earlier), F.lit(0)) for d in range(16)]).alias("before"))
        along = Window.partitionBy("y", "prefix", "part").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)  # asked rows come before values of their time
        inside = F.array(*[F.coalesce(F.sum(F.when((F.col("digit") == d) & (F.col("side") == 1), F.col("n"))).over(along), F.lit(0)) for d in range(16)])
        x = x.withColumn("inside", inside)
        asks = x.filter("side = 0").join(carried, ["y", "prefix", "part"])
        asks = asks.withColumn("counts", F.zip_with("inside", "before", lambda a, b: a + b)).withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c))
        asks = asks.withColumns({"all": F.coalesce("all", "total"), "r": F.coalesce("r", F.when(F.col("i") == 0, F.expr("(total - 1) div 2")).otherwise(F.expr("total div 2")))}).filter(F.col("all") > 0)
        upto = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.aggregate(F.slice("counts", F.lit(1), k), F.lit(0).cast("long"), lambda s, c: s + c))
        asks = asks.withColumn("upto", upto).withColumn("d", F.size(F.filter("upto", lambda u: u <= F.col("r"))))
        found = F.col("place") + F.shiftleft(F.col("d").cast("long"), shift)
        asks = asks.select("y", "part", "t", "side", found.alias("place"), "n", "i", (F.col("r") - F.when(F.col("d") > 0, F.get("upto", F.col("d") - 1)).otherwise(F.lit(0))).alias("r"), "all")
        rows = written(rows.filter("side = 1").unionByName(asks), "median-rows") if shift else asks
    middle = rows.filter("side = 0").join(numbers, ["y", "place"]).groupBy("y", "t").agg(F.avg("v").alias("median_before"), F.max("all").alias("n_before"))
    middle = middle.select(F.col("y").alias("__y"), F.col("t").alias("__at"), "median_before", "n_before")
    return at.join(middle, (F.col("__y") == F.col(at_year)) & (F.col("__at") == F.col(at_time)), "left").drop("__y", "__at")
