"""Table layouts shared by the batch and the streaming jobs."""

from pyspark.sql import types as T

PACKET = (
    "pkt_id BIGINT, timestamp_ns BIGINT, src_ip BIGINT, src_port INT, dst_ip BIGINT, dst_port INT, "
    "ip_version INT, payload_offset INT, len INT, pkt_hex STRING"
)

ENVELOPE = (
    "timestamp_ns BIGINT, "
    "ip STRUCT<src: STRUCT<ip: BIGINT, port: INT>, dst: STRUCT<ip: BIGINT, port: INT>, payload_offset: INT>, "
    "sip STRUCT<call_id: STRING, `to`: STRING, `from`: STRING, sip_method: STRING, status_code: INT, "
    "rc_session_id: STRING, ua: STRING, maxfwd: STRING, cseq: STRUCT<number: STRING, method: STRING>>, "
    "raw STRUCT<pkt: STRING>"
)

FLAT_ENVELOPE = (
    "data STRUCT<source_ip: STRING, source_port: STRING, destination_ip: STRING, destination_port: STRING, "
    "`from`: STRING, `to`: STRING, callid: STRING, callid_rc: STRING, request_method: STRING, "
    "response_code: STRING, user_agent: STRING, cseq: STRING, maxfwd: STRING, via: STRING, "
    "enc_name: ARRAY<STRING>, micro_ts: STRING, msg: STRING>, malformed_data STRING"
)

CAPTURE = (
    "id BIGINT, datetime TIMESTAMP, `from` STRING, `to` STRING, callid STRING, callid_rc STRING, "
    "user_agent STRING, request_method STRING, response_code INT, source_ip BIGINT, source_port INT, "
    "destination_ip BIGINT, destination_port INT, malformed INT, msg STRING"
)

SDP = "id BIGINT, codec STRING"

REJECT = f"{PACKET}, reason STRING, date DATE"

METRIC = "ts TIMESTAMP, metric STRING, sensor STRING, value DOUBLE"


def columns(ddl: str) -> list[str]:
    """Column names of one of the layouts above."""
    return T.StructType.fromDDL(ddl).names
