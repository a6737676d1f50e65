"""Common table expressions for the checking SQL.

They restate the derived input and the stages up to the capture table in plain
SQL, so that an oracle statement shares no code with the Spark plans but for the
statement that derives the packets.
"""

from dialtrace.registry.wire import WIRE_SQL

_WIRE = WIRE_SQL.replace("@US@", "epoch_us(ts)").replace("{events}", "events")

_PACKETS = f"""
wire AS ({_WIRE}),
packets AS (
  SELECT CAST(pkt_id AS BIGINT) AS pkt_id, CAST(timestamp_ns AS BIGINT) AS timestamp_ns,
    CAST(src_ip AS BIGINT) AS src_ip, CAST(src_port AS INTEGER) AS src_port,
    CAST(dst_ip AS BIGINT) AS dst_ip, CAST(dst_port AS INTEGER) AS dst_port,
    CAST(ip_version AS INTEGER) AS ip_version, CAST(payload_offset AS INTEGER) AS payload_offset,
    CAST(len AS INTEGER) AS len, pkt_hex
  FROM wire
)"""

_DECODED = r"""
accepted AS (
  SELECT * FROM packets WHERE payload_offset < len AND ip_version = 4 AND length(pkt_hex) = 2 * len
),
decoded AS (
  SELECT *, right(pkt_hex, 2) <> 'ff' AS utf8_ok,
    CASE WHEN right(pkt_hex, 2) = 'ff'
      THEN decode(unhex(substr(pkt_hex, 85, length(pkt_hex) - 86))) || chr(65533)
      ELSE decode(unhex(substr(pkt_hex, 85))) END AS text
  FROM accepted
)"""

_PARSED = r"""
parsed AS (
  SELECT *,
    nullif(regexp_extract(text, '^([A-Z]+) sip:', 1), '') AS request_method,
    CAST(nullif(regexp_extract(text, '^SIP/2\.0 (\d+)', 1), '') AS INTEGER) AS response_code,
    nullif(regexp_extract(text, '\nFrom: <sip:([^@]+)@', 1), '') AS "from",
    nullif(regexp_extract(text, '\nTo: <sip:([^@]+)@', 1), '') AS "to",
    nullif(regexp_extract(text, '\nCall-ID: ([^@\r\n]+)@', 1), '') AS callid,
    nullif(regexp_extract(text, '\np-rc-session-id: ([^\r\n]+)', 1), '') AS callid_rc,
    nullif(regexp_extract(text, '\nUser-Agent: ([^\r\n]+)', 1), '') AS user_agent,
    CASE WHEN contains(text, 'Max-Forwards:') THEN trim(regexp_extract(text, '\nMax-Forwards:([^\r\n]*)', 1)) END AS maxfwd,
    nullif(regexp_extract(text, '\nCSeq: (\d+) ', 1), '') AS cseq_number,
    nullif(regexp_extract(text, '\nCSeq: \d+ ([A-Z]+)', 1), '') AS cseq_method
  FROM decoded
)"""

_CHECKED = r"""
checked AS (
  SELECT *,
    CASE WHEN reasons <> '' THEN 1 ELSE 0 END AS malformed,
    CASE WHEN reasons <> '' THEN chr(10) || chr(10) || chr(10) || 'MALFORMED REASON:' || chr(10) || reasons || ' ' || chr(10) || chr(10)
      || 'RAW PACKET:' || chr(10) || pkt_hex ELSE '' END AS report
  FROM (
    SELECT *, CASE WHEN NOT utf8_ok THEN 'include non UTF8 symbols in payload_data' ELSE concat_ws(' |' || chr(10),
      CASE WHEN callid IS NULL THEN 'required headers ''Call-ID'' is None or empty' END,
      CASE WHEN "from" IS NULL THEN 'required headers ''From'' is None or empty' END,
      CASE WHEN "to" IS NULL THEN 'required headers ''To'' is None or empty' END,
      CASE WHEN cseq_number IS NULL THEN 'required headers ''CSeq number'' is None or empty' END,
      CASE WHEN CAST(cseq_number AS HUGEINT) > 4294967295 THEN 'the CSeq sequence number is >2**32-1' END,
      CASE WHEN cseq_method IS NULL THEN 'required headers ''CSeq method'' is None or empty' END,
      CASE WHEN request_method IS NOT NULL AND maxfwd = '' THEN 'required headers ''Max-Forwards'' is empty' END,
      CASE WHEN request_method IS NOT NULL AND TRY_CAST(maxfwd AS HUGEINT) > 255 THEN 'Max-Forwards header value is >255' END
    ) END AS reasons
    FROM parsed
  )
)"""

_CAPTURE = r"""
capture AS (
  SELECT pkt_id AS id, make_timestamp(timestamp_ns // 1000) AS datetime, "from", "to", callid, callid_rc, user_agent,
    request_method, response_code, src_ip AS source_ip, src_port AS source_port, dst_ip AS destination_ip,
    dst_port AS destination_port, CAST(malformed AS INTEGER) AS malformed, text || report AS msg
  FROM checked
)"""

_SDP = r"""
sdp AS (
  SELECT pkt_id AS id, unnest(regexp_extract_all(text, '\na=rtpmap:\d+ ([\w-]+)/\d+', 1)) AS codec FROM decoded
)"""

# dotted address of a number, for use as a macro in the statements
_IP = "((({0}) >> 24) & 255)::VARCHAR || '.' || ((({0}) >> 16) & 255)::VARCHAR || '.' || ((({0}) >> 8) & 255)::VARCHAR || '.' || (({0}) & 255)::VARCHAR"

_STAGES = {
    "packets": [_PACKETS],
    "decoded": [_PACKETS, _DECODED],
    "parsed": [_PACKETS, _DECODED, _PARSED],
    "checked": [_PACKETS, _DECODED, _PARSED, _CHECKED],
    "capture": [_PACKETS, _DECODED, _PARSED, _CHECKED, _CAPTURE],
    "sdp": [_PACKETS, _DECODED, _PARSED, _CHECKED, _CAPTURE, _SDP],
}


def ip(expression: str) -> str:
    return f"({_IP.format(expression)})"


def endpoint(address: str, port: str) -> str:
    return f"({_IP.format(address)} || ':' || coalesce({port}, 0)::VARCHAR)"


def on(stage: str, body: str, *more: str) -> str:
    """Statement over the tables up to ``stage``; ``more`` are further table expressions."""
    return "WITH " + ",\n".join([*_STAGES[stage], *more]) + "\n" + body


# CRC-32 by table lookup, read as a signed number, modulo the palette size
COLOURS = f"""
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, n: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS entries
),
endpoint_pairs AS (
  SELECT DISTINCT {endpoint('source_ip', 'source_port')} AS source, {endpoint('destination_ip', 'destination_port')} AS destination FROM capture
),
checksums AS (
  SELECT source, destination, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(source || ' ' || destination, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8))) AS crc
  FROM endpoint_pairs, crc_table
),
colours AS (
  SELECT source, destination, crc,
    CAST((((CASE WHEN crc >= 2147483648 THEN crc - 4294967296 ELSE crc END) % 1000) + 1000) % 1000 AS BIGINT) AS colour
  FROM checksums
),
shaped AS (
  SELECT id, datetime, CAST(floor((epoch_us(datetime) + 500000) / 1000000.0) AS BIGINT) AS date, source AS source_ip, destination AS destination_ip,
    callid, coalesce(request_method, '') || coalesce(response_code::VARCHAR, '') AS method, "from" AS from_user, "to" AS to_user, malformed,
    colour, CASE malformed WHEN 1 THEN 'malformed' ELSE 'ordinary' END AS palette,
    c.source_ip AS source_number, c.destination_ip AS destination_number, source_port, destination_port, callid_rc, request_method
  FROM capture c JOIN colours p ON p.source = {endpoint('c.source_ip', 'source_port')} AND p.destination = {endpoint('c.destination_ip', 'destination_port')}
)"""

RESULT = "id, datetime, date, source_ip, destination_ip, callid, method, from_user, to_user, malformed, colour, palette"


def matching(where: str = "true", grouping: bool = True) -> str:
    """Table expression ``found``: search results before paging."""
    grouped = "QUALIFY row_number() OVER (PARTITION BY callid ORDER BY datetime, id) = 1" if grouping else ""
    return f"{COLOURS},\nfound AS (SELECT * FROM shaped WHERE {where} {grouped})"


def searched(where: str = "true", grouping: bool = True, rows: int = 10, page: int = 1) -> str:
    """One page of a search with the total of all pages."""
    body = f"""SELECT {RESULT}, CAST((SELECT count(*) FROM found) AS BIGINT) AS total FROM found
      ORDER BY datetime, id LIMIT {rows} OFFSET {max(page - 1, 0) * rows}"""
    return on("capture", body, matching(where, grouping))
