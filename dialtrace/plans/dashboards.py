"""Dashboard aggregates over the last days of the capture table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialtrace.functions.net import ip_text


def latest(capture: DataFrame) -> DataFrame:
    """The newest time as one row; only the newest day is read for it."""
    newest_day = capture.agg(F.max("date")).scalar()
    return capture.where(F.col("date") == newest_day).agg(F.max("datetime").alias("now"))


def last_days(capture: DataFrame, days: int = 1, now: str | None = None) -> DataFrame:
    """Rows of the last ``days``, counted back from ``now`` or else from the newest row."""
    end = F.lit(now).cast("timestamp") if now else latest(capture).scalar()
    start = end - F.make_dt_interval(days=F.lit(days))
    return capture.where((F.col("datetime") >= start) & (F.col("date") >= F.to_date(start)))


def _counted(rows: DataFrame, label: Column) -> DataFrame:
    return rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("value"))


def _is_method(name: str) -> Column:
    return F.col("request_method") == name


def by_method(rows: DataFrame) -> DataFrame:
    return _counted(rows.where(F.col("request_method").isNotNull()), F.col("request_method"))


def by_source(rows: DataFrame, method: str = "REGISTER") -> DataFrame:
    """Requests per source address; grouped by the number, shown dotted."""
    grouped = rows.where(_is_method(method)).groupBy("source_ip").agg(F.count(F.lit(1)).alias("value"))
    return grouped.select(ip_text(F.col("source_ip")).alias("label"), "value")


def by_agent(rows: DataFrame, method: str = "REGISTER") -> DataFrame:
    return _counted(rows.where(_is_method(method)), F.coalesce("user_agent", F.lit("unknown")))


def with_codecs(rows: DataFrame, sdp: DataFrame) -> DataFrame:
    """Messages and their codecs.

    The day is part of the key although the id alone decides: a time limit on the
    messages then prunes the codec table as well.
    """
    return rows.join(sdp, ["id", "date"])


def by_request_codec(rows: DataFrame, sdp: DataFrame) -> DataFrame:
    narrow = rows.where(_is_method("INVITE")).select("id", "date")
    return _counted(with_codecs(narrow, sdp), F.col("codec"))


def by_response_codec(rows: DataFrame, sdp: DataFrame) -> DataFrame:
    narrow = rows.where(F.col("response_code") == 200).select("id", "date")
    return _counted(with_codecs(narrow, sdp), F.col("codec"))


def per_hour(rows: DataFrame) -> DataFrame:
    """Good and malformed rows of each hour."""
    hour = F.date_trunc("hour", "datetime")
    counted = rows.groupBy(hour.alias("hour")).agg(
        F.count_if(F.col("malformed") == 0).alias("ok"), F.count_if(F.col("malformed") == 1).alias("mal")
    )
    return counted.select(F.date_format("hour", "yyyy-MM-dd HH:00").alias("label"), "ok", "mal")


def dashboard(capture: DataFrame, sdp: DataFrame, type: str, days: int = 1, now: str | None = None) -> DataFrame:
    """Content of one dashboard: ``label, value``, or ``label, ok, mal`` per hour."""
    rows = last_days(capture, days, now)
    if type == "method":
        return by_method(rows)
    if type == "ip":
        return by_source(rows)
    if type == "ua":
        return by_agent(rows)
    if type == "sdp-codec-req":
        return by_request_codec(rows, sdp)
    if type == "sdp-codec-resp":
        return by_response_codec(rows, sdp)
    if type == "data-per-hour":
        return per_hour(rows)
    raise ValueError(f"unknown dashboard type: {type}")


# fixed value: entries of a top list
TOP = 10


def top_users(rows: DataFrame, method: str, party: str) -> DataFrame:
    """Users with most requests of a method, by ``from`` or ``to``: ``phone, count``."""
    users = rows.where(_is_method(method) & F.col(f"`{party}`").isNotNull())
    counted = users.groupBy(F.col(f"`{party}`").alias("phone")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), F.asc("phone")).limit(TOP)


def top_register(rows: DataFrame) -> DataFrame:
    return top_users(rows, "REGISTER", "from")


def top_caller(rows: DataFrame) -> DataFrame:
    return top_users(rows, "INVITE", "from")


def top_called(rows: DataFrame) -> DataFrame:
    return top_users(rows, "INVITE", "to")


def with_share(segments: DataFrame) -> DataFrame:
    """Percentage of each segment in the whole; the whole comes as a scalar, not by a window."""
    whole = segments.agg(F.sum("value")).scalar()
    return segments.withColumn("share", F.col("value") / whole * F.lit(100.0))


def group_small(segments: DataFrame, threshold: float = 1, unit: str = "percentage", label: str = "Other") -> DataFrame:
    """Merges segments of at most ``threshold`` (percent, or absolute value) into one."""
    if unit == "percentage":
        small = with_share(segments).withColumn("grouped", F.col("share") <= threshold)
    else:
        small = segments.withColumn("grouped", F.col("value") <= threshold)
    named = small.select(F.when(F.col("grouped"), label).otherwise(F.col("label")).alias("label"), "value", "grouped")
    return named.groupBy("label", "grouped").agg(F.sum("value").alias("value"))


def sort_segments(segments: DataFrame, order: str = "value-desc") -> DataFrame:
    """``none``, or ``value`` / ``label`` with ``-asc`` / ``-desc``; labels without regard to case."""
    folded = F.lower("label")
    keys = {
        "value-asc": [F.asc("value"), F.asc("label")],
        "value-desc": [F.desc("value"), F.asc("label")],
        "label-asc": [folded.asc(), F.asc("label")],
        "label-desc": [folded.desc(), F.desc("label")],
    }
    return segments if order == "none" else segments.orderBy(*keys[order])
