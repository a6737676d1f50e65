"""Queries for packet filters and message validation."""

from pyspark.sql import functions as F

from dialtrace.operators import filters, validate
from dialtrace.operators.headers import with_headers
from dialtrace.registry import inputs, oracle
from dialtrace.registry.base import query
from dialtrace.registry.headers import decoded, parsed
from dialtrace.registry.sources import FLAT_REASONS


@query("drop_empty_payload", oracle.on("packets", "SELECT pkt_id, len FROM packets WHERE payload_offset < len"))
def drop_empty_payload(spark, sf_dir):
    return inputs.packets(spark, sf_dir).where(validate.has_payload()).select("pkt_id", "len")


@query("ipv4_only", oracle.on("packets", "SELECT pkt_id, ip_version FROM packets WHERE ip_version = 4"))
def ipv4_only(spark, sf_dir):
    return inputs.packets(spark, sf_dir).where(validate.is_ipv4()).select("pkt_id", "ip_version")


def _wrong_lengths(spark, sf_dir):
    """Packets, every 107th announcing a byte more than it has."""
    longer = F.when(F.col("pkt_id") % 107 == 0, F.col("len") + 1).otherwise(F.col("len"))
    return inputs.packets(spark, sf_dir).withColumn("len", longer)


@query(
    "length_rejects",
    oracle.on("packets", "SELECT pkt_id, CAST(len + 1 AS INTEGER) AS len, 'length mismatch' AS reason FROM packets "
              "WHERE pkt_id % 107 = 0 AND payload_offset < len + 1 AND ip_version = 4"),
)
def length_rejects(spark, sf_dir):
    df = validate.rejected(_wrong_lengths(spark, sf_dir)).where("reason = 'length mismatch'")
    return df.select("pkt_id", "len", "reason")


@query(
    "accepted_packets",
    oracle.on("packets", "SELECT pkt_id FROM packets WHERE payload_offset < len AND ip_version = 4 AND pkt_id % 107 <> 0"),
)
def accepted_packets(spark, sf_dir):
    return validate.accepted(_wrong_lengths(spark, sf_dir)).select("pkt_id")


def _packet_filter(name, where, condition):
    @query(name, oracle.on("packets", f"SELECT pkt_id, src_ip, dst_ip FROM packets WHERE {where}"))
    def run(spark, sf_dir):
        return inputs.packets(spark, sf_dir).where(condition()).select("pkt_id", "src_ip", "dst_ip")

    run.__name__ = name


_SRC, _DST = oracle.ip("src_ip"), oracle.ip("dst_ip")
_packet_filter("filter_host", f"{_SRC} = '10.0.2.2' OR {_DST} = '10.0.2.2'", lambda: filters.host("10.0.2.2"))
_packet_filter("filter_source_host", f"{_SRC} = '10.0.2.2'", lambda: filters.host("10.0.2.2", "src"))
_packet_filter(
    "filter_net",
    "(src_ip & 4294967040) = 167772672 OR (dst_ip & 4294967040) = 167772672",
    lambda: filters.net("10.0.2.0/24"),
)
_packet_filter("filter_target_net", "(dst_ip & 4294901760) = 3232235520", lambda: filters.net("192.168.0.0/16", "dst"))
_packet_filter("filter_port", "src_port = 1030 OR dst_port = 1030", lambda: filters.port(1030))
_packet_filter(
    "filter_port_range", "(src_port >= 1030 AND src_port <= 1040)", lambda: filters.port_range(1040, 1030, "src")
)
_packet_filter("filter_length", "len <= 400 AND len >= 300", lambda: filters.at_most(400) & filters.at_least(300))
_packet_filter(
    "filter_combined",
    f"(({_SRC} LIKE '10.0.1.%' OR {_DST} LIKE '10.0.1.%') AND NOT (src_port = 5060)) OR len >= 600",
    lambda: (filters.net("10.0.1.0/24") & ~filters.port(5060, "src")) | filters.at_least(600),
)


@query("valid_utf8", oracle.on("decoded", "SELECT pkt_id, utf8_ok, text FROM decoded"))
def valid_utf8(spark, sf_dir):
    return decoded(spark, sf_dir).select("pkt_id", "utf8_ok", "text")


@query("malformed_rules", oracle.on("checked", "SELECT pkt_id, CAST(malformed AS INTEGER) AS malformed, reasons, nullif(report, '') AS report FROM checked"))
def malformed_rules(spark, sf_dir):
    return validate.with_malformed(parsed(spark, sf_dir)).select("pkt_id", "malformed", "reasons", "report")


@query("flat_malformed_rules", oracle.on("parsed", f"SELECT pkt_id, {FLAT_REASONS} AS reasons FROM parsed"))
def flat_malformed_rules(spark, sf_dir):
    df = with_headers(decoded(spark, sf_dir), keep_host=True)
    return df.select("pkt_id", validate.flat_malformed_reasons().alias("reasons"))


@query(
    "agent_deny_list",
    oracle.on("capture", "SELECT id, user_agent FROM capture WHERE user_agent IS DISTINCT FROM 'friendly-scanner'"),
)
def agent_deny_list(spark, sf_dir):
    return inputs.capture(spark, sf_dir).where(validate.allowed_agent(F.col("user_agent"))).select("id", "user_agent")
