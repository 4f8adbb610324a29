"""Numbers and times as the reports print them. Numbers are rounded by their exact binary value, ties to even, as Python and C do (Spark's own formats round what Java prints, half up). From 2^52 units of the last place on they are Java's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.text import let

#: Splits a double into two halves whose products with small whole numbers are exact.
SPLIT = float((1 << 27) + 1)


def rounded(x: Column, scale: int) -> Column:
    """x * scale as the nearest whole number, for 0 <= x * scale < 2^52 and a scale of at most 2^26: the product's rounding error is known exactly, and decides."""
    high = let(x * SPLIT, lambda t: t - (t - x))

    def nearest(h: Column) -> Column:
        product = x * float(scale)
        error = (h * float(scale) - product) + (x - h) * float(scale)
        floor = F.floor(product).cast("double")
        return let(F.struct(floor.alias("f"), ((product - floor) - 0.5 + error).alias("d")), lambda s: s["f"] + F.when(s["d"] > 0, 1).when(s["d"] < 0, 0).otherwise(s["f"] % 2))

    return let(high, nearest).cast("long")


def fixed(c: Column, digits: int) -> Column:
    """The number with so many digits behind the point; null stays null."""
    scale = 10**digits

    def text(x: Column) -> Column:
        size = F.abs(x)
        whole = lambda n: F.call_function("div", n, F.lit(scale).cast("long")).cast("string")
        part = lambda n: F.concat(F.lit("."), F.lpad((n % scale).cast("string"), digits, "0")) if digits else F.lit("")
        exact = let(rounded(size, scale), lambda n: F.concat(F.when(x < 0, "-").otherwise(""), whole(n), part(n)))
        return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x < 0, "-inf").otherwise("inf")).when(size < float(1 << 52) / scale, exact).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))

    return let(c.cast("double"), text)


def percent(c: Column, digits: int) -> Column:
    """A share as a percentage with its sign."""
    return F.concat(fixed(c.cast("double") * 100.0, digits), F.lit("%"))


def iso_utc(ts: Column) -> Column:
    """A time in UTC with its offset; microseconds only where there are some."""
    seconds = (F.unix_micros(ts.cast("timestamp")).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    wall = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).cast("string")
    part = lambda t: F.when(F.length(t) > 19, F.concat(F.lit("."), F.rpad(F.substr(t, F.lit(21)), 6, "0"))).otherwise("")
    return let(wall, lambda t: F.concat(F.replace(F.left(t, F.lit(19)), F.lit(" "), F.lit("T")), part(t), F.lit("+00:00")))


def utc_day(ts: Column) -> Column:
    """The date of a time in UTC."""
    return F.left(iso_utc(ts), F.lit(10))
