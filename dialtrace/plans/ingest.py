"""Packets to capture rows: the same plan serves batch and stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialtrace import schemas
from dialtrace.functions.time import ns_to_timestamp
from dialtrace.operators.headers import parse, sdp_codecs, with_text
from dialtrace.operators.validate import accepted, rejected, with_malformed


def to_capture(packets: DataFrame) -> DataFrame:
    """One CAPTURE row per accepted packet; narrow, no shuffle."""
    return capture_rows(with_malformed(parse(accepted(packets))))


def capture_rows(checked: DataFrame) -> DataFrame:
    return checked.select(
        F.col("pkt_id").alias("id"),
        ns_to_timestamp(F.col("timestamp_ns")).alias("datetime"),
        *[F.col(f"`{c}`") for c in ("from", "to", "callid", "callid_rc", "user_agent", "request_method")],
        "response_code",
        F.col("src_ip").alias("source_ip"),
        F.col("src_port").alias("source_port"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("dst_port").alias("destination_port"),
        "malformed",
        F.concat("text", F.coalesce("report", F.lit(""))).alias("msg"),
    ).select(*[f"`{c}`" for c in schemas.columns(schemas.CAPTURE)])


def to_sdp(packets: DataFrame) -> DataFrame:
    """One row per codec line of each accepted packet, with the day of the packet."""
    return with_text(accepted(packets)).select(
        F.col("pkt_id").alias("id"),
        F.explode(sdp_codecs(F.col("text"))).alias("codec"),
        F.to_date(ns_to_timestamp(F.col("timestamp_ns"))).alias("date"),
    )


def checked_with_codecs(packets: DataFrame) -> DataFrame:
    """Parsed and validated packets with the list of their codecs: all that the stored tables take from a packet."""
    parsed = parse(accepted(packets))
    return with_malformed(parsed.withColumn("codecs", sdp_codecs(F.col("text"))))


def codec_rows(checked: DataFrame) -> DataFrame:
    """The rows of :func:`to_sdp` from packets that are parsed already."""
    return checked.select(
        F.col("pkt_id").alias("id"), F.explode("codecs").alias("codec"), F.to_date(ns_to_timestamp(F.col("timestamp_ns"))).alias("date")
    )


def to_rejects(packets: DataFrame) -> DataFrame:
    """Packets that do not reach the parser, with the reason and the day of the packet."""
    return rejected(packets).withColumn("date", F.to_date(ns_to_timestamp(F.col("timestamp_ns"))))
