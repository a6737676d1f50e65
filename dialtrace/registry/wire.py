"""Packet records derived from the ``events`` table.

One SIP message per event and seven consecutive events per dialog, with
retransmissions and faults at fixed places. The statement runs in Spark and in
the SQL engine that checks the results; ``{events}`` and ``@US@`` are the only
parts that differ.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialtrace import schemas
from dialtrace.session import use_utc

WIRE_SQL = """
WITH e AS (
  SELECT event_id, @US@ AS ts_us, CAST(floor(event_id / 7) AS BIGINT) AS d, event_id % 7 AS k, event_id % 50 AS m FROM {events}
), p AS (
  SELECT *, d % 97 AS caller, (d * 31) % 89 AS callee, d % 5 = 0 AS is_reg, 0 AS retrans FROM e
  UNION ALL
  SELECT event_id + 1000000000, ts_us + 500000, d, k, m, d % 97, (d * 31) % 89, d % 5 = 0, 1 FROM e WHERE event_id % 11 = 0
), s AS (
  SELECT *,
    CASE WHEN is_reg THEN CASE k WHEN 0 THEN 'REGISTER' WHEN 2 THEN 'REGISTER' WHEN 4 THEN 'OPTIONS' ELSE '' END
         ELSE CASE k WHEN 0 THEN 'INVITE' WHEN 4 THEN 'ACK' WHEN 5 THEN 'BYE' ELSE '' END END AS meth,
    CASE WHEN is_reg THEN CASE k WHEN 1 THEN '401 Unauthorized' WHEN 3 THEN '200 OK' WHEN 5 THEN '200 OK' WHEN 6 THEN '503 Service Unavailable' ELSE '' END
         ELSE CASE k WHEN 1 THEN '100 Trying' WHEN 2 THEN '180 Ringing' WHEN 3 THEN '200 OK' WHEN 6 THEN '200 OK' ELSE '' END END AS stat,
    CASE WHEN is_reg THEN CASE k WHEN 1 THEN 'REGISTER' WHEN 3 THEN 'REGISTER' ELSE 'OPTIONS' END
         ELSE CASE WHEN k IN (1, 2, 3) THEN 'INVITE' ELSE 'BYE' END END AS cs_resp,
    (CASE d % 4 WHEN 0 THEN '+1' WHEN 1 THEN '1' WHEN 2 THEN '+' ELSE '' END) || '650555' || lpad(CAST(caller AS STRING), 4, '0') AS u_from,
    '408555' || lpad(CAST(callee AS STRING), 4, '0') AS u_to
  FROM p
), t AS (
  SELECT *, chr(13) || chr(10) AS nl,
    167772160 + 256 * (caller % 4) + caller AS ip_a, 3232235776 + callee % 16 AS ip_b FROM s
), msg AS (
  SELECT *,
    (CASE WHEN meth <> '' THEN meth || ' sip:' || u_to || '@pbx.example.com SIP/2.0' ELSE 'SIP/2.0 ' || stat END) || nl ||
    'Via: SIP/2.0/UDP 10.0.0.1:5060;branch=z9hG4bK' || CAST(d AS STRING) || '-' || CAST(k AS STRING) || nl ||
    (CASE WHEN meth = '' THEN '' WHEN m = 31 THEN 'Max-Forwards: ' || nl WHEN m = 13 THEN 'Max-Forwards: 300' || nl ELSE 'Max-Forwards: 70' || nl END) ||
    (CASE WHEN m = 29 THEN 'From: ' ELSE 'From: <sip:' || u_from || '@pbx.example.com>;tag=a' || CAST(d AS STRING) END) || nl ||
    'To: <sip:' || u_to || '@pbx.example.com>' || nl ||
    (CASE WHEN m = 7 THEN '' ELSE 'Call-ID: call-' || CAST(d AS STRING) || '@pbx.example.com' || nl END) ||
    'CSeq: ' || (CASE WHEN m = 17 THEN '4294967296' ELSE CAST(1 + k AS STRING) END) || ' ' || (CASE WHEN meth <> '' THEN meth ELSE cs_resp END) || nl ||
    (CASE d % 3 WHEN 0 THEN '' WHEN 1 THEN 'p-rc-session-id: call-' || CAST(d - 1 AS STRING) || nl ELSE 'p-rc-session-id: sess-' || CAST(CAST(floor(d / 6) AS BIGINT) AS STRING) || nl END) ||
    (CASE WHEN meth = '' THEN '' ELSE 'User-Agent: ' || (CASE d % 6 WHEN 0 THEN 'friendly-scanner' WHEN 1 THEN 'softphone/1.0' WHEN 2 THEN 'softphone/2.0' WHEN 3 THEN 'deskphone' ELSE 'gateway' END) || nl END) ||
    (CASE WHEN NOT is_reg AND k IN (0, 3) THEN 'Content-Type: application/sdp' || nl || nl || 'v=0' || nl || 'm=audio 13276 RTP/AVP 0 8 101' || nl ||
        'a=rtpmap:0 PCMU/8000' || nl || (CASE WHEN d % 2 = 0 OR k = 0 THEN 'a=rtpmap:8 PCMA/8000' || nl ELSE '' END) || (CASE WHEN d % 3 = 0 THEN 'a=rtpmap:18 G729/8000' || nl ELSE '' END) || 'a=rtpmap:101 telephone-event/8000' || nl
      ELSE nl END) AS text
  FROM t
)
SELECT event_id AS pkt_id, ts_us * 1000 AS timestamp_ns,
  CASE WHEN (meth <> '') THEN ip_a ELSE ip_b END AS src_ip, CASE WHEN (meth <> '') THEN 1024 + caller ELSE 5060 END AS src_port,
  CASE WHEN (meth <> '') THEN ip_b ELSE ip_a END AS dst_ip, CASE WHEN (meth <> '') THEN 5060 ELSE 1024 + caller END AS dst_port,
  CASE WHEN m = 41 THEN 6 ELSE 4 END AS ip_version, 42 AS payload_offset,
  CASE WHEN m = 43 THEN 42 ELSE 42 + CAST(length(hex(text)) / 2 AS INT) + CASE WHEN m = 23 THEN 1 ELSE 0 END END AS len,
  repeat('00', 42) || CASE WHEN m = 43 THEN '' ELSE lower(hex(text)) || CASE WHEN m = 23 THEN 'ff' ELSE '' END END AS pkt_hex
FROM msg
"""


def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PACKET rows for the ``events`` of one scale-factor folder."""
    use_utc(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    rows = spark.sql(WIRE_SQL.replace("@US@", "unix_micros(CAST(ts AS TIMESTAMP))"), events=events)
    return rows.to(_packet_schema())


def _packet_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schemas.PACKET)


def text_wire(packets: DataFrame) -> DataFrame:
    """The delimited text form; every 101st packet loses its last field."""
    head = F.concat_ws(
        "|",
        F.col("timestamp_ns").cast("string"),
        F.concat_ws(":", F.col("src_ip").cast("string"), F.col("src_port").cast("string")),
        F.concat_ws(":", F.col("dst_ip").cast("string"), F.col("dst_port").cast("string")),
    )
    tail = F.concat_ws(":", F.col("payload_offset").cast("string"), F.col("pkt_hex"))
    return packets.select(
        "pkt_id",
        F.when(F.col("pkt_id") % 101 == 0, head).otherwise(F.concat_ws("|", head, tail)).alias("value"),
    )
