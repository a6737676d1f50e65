"""Time conversions; all arithmetic on whole numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by))


def ns_to_timestamp(ns: Column) -> Column:
    """Nanoseconds since the epoch as a timestamp, rounded to the microsecond."""
    return F.timestamp_micros(_div(ns + 500, 1000))


def ns_to_seconds_text(ns: Column) -> Column:
    """Nanoseconds since the epoch as decimal seconds with six places."""
    micros = _div(ns + 500, 1000)
    return F.concat(
        _div(micros, 1000000).cast("string"),
        F.lit("."),
        F.lpad((micros % 1000000).cast("string"), 6, "0"),
    )


def epoch_seconds(moment: Column) -> Column:
    """Whole seconds since the epoch, rounded to the nearest."""
    return _div(F.unix_micros(moment) + 500000, 1000000)


def hours_before(anchor: Column, hours: int) -> Column:
    """``anchor`` less some hours, as the search form shows it."""
    return F.date_format(anchor - F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd HH:mm")


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def grid_date(seconds: Column) -> Column:
    """Epoch seconds as the result grid shows them."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MMM-dd HH:mm")


def microsecond_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")
