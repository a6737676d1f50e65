"""SIP and SDP header extraction as column expressions.

Headers are looked for in the header block only (everything before the first
blank line), at the start of a line, without regard to case; the first one wins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialtrace.functions.text import empty_to_null, payload_bytes

# fixed values: request methods with a counter of their own
METHODS = [
    "INVITE", "ACK", "BYE", "CANCEL", "OPTIONS", "REGISTER", "PRACK",
    "SUBSCRIBE", "NOTIFY", "PUBLISH", "INFO", "REFER", "MESSAGE", "UPDATE",
]


def header_block(text: Column) -> Column:
    """Header lines with plain line ends, continuation lines joined."""
    lines = F.replace(F.ltrim(F.regexp_replace(text, r"^[\r\n]+", "")), F.lit("\r\n"), F.lit("\n"))
    head = F.substring_index(lines, "\n\n", 1)
    return F.replace(F.replace(head, F.lit("\n "), F.lit(" ")), F.lit("\n\t"), F.lit(" "))


def header(head: Column, *names: str) -> Column:
    """Value of the first header with one of the names; NULL if missing or empty."""
    return empty_to_null(F.regexp_extract(head, rf"(?im)^(?:{'|'.join(names)})[ \t]*:([^\r\n]*)", 1))


def uri_user(head: Column, *names: str) -> Column:
    """User part of the SIP address in an address header, with or without display name."""
    pattern = (
        rf"(?im)^(?:{'|'.join(names)})[ \t]*:[ \t]*"
        r'(?:(?:"[^"\r\n]*")?[^<"\r\n]*<)?sips?:([^@:>\s]+)(?::[^@>\s]*)?@'
    )
    return empty_to_null(F.regexp_extract(head, pattern, 1))


def method(head: Column) -> Column:
    return empty_to_null(F.regexp_extract(head, r"^([A-Z]+) [^\r\n]* SIP/2\.0", 1))


def status_code(head: Column) -> Column:
    """Response code; NULL for requests and for code 0."""
    digits = F.regexp_extract(head, r"^SIP/2\.0 +([0-9]{1,9})\b", 1)
    return F.nullif(F.nullif(digits, F.lit("")).cast("int"), F.lit(0))


def from_user(head: Column) -> Column:
    return uri_user(head, "from", "f")


def to_user(head: Column) -> Column:
    return uri_user(head, "to", "t")


def call_id(head: Column, keep_host: bool = False) -> Column:
    value = header(head, "call-id", "i")
    return value if keep_host else F.substring_index(value, "@", 1)


def session_id(head: Column) -> Column:
    return header(head, "p-rc-session-id")


def user_agent(head: Column) -> Column:
    return header(head, "user-agent")


def max_forwards_line(head: Column) -> Column:
    return F.regexp_extract(head, r"(?im)^max-forwards[ \t]*:[^\r\n]*", 0)


def max_forwards(line: Column) -> Column:
    """Text of the header: NULL if missing, empty if present without a value."""
    return F.when(line != "", F.trim(F.substr(line, F.instr(line, ":") + 1)))


# number and method of a CSeq header; the first group tells an empty header from a missing one
_CSEQ = r"(?im)^(cseq)[ \t]*:[ \t]*([0-9]*)[ \t]*([A-Za-z]*)"


def cseq(name: Column, number: Column, verb: Column) -> Column:
    """``struct<number, method>``, parts NULL when absent; NULL without the header."""
    return F.when(
        name != "",
        F.struct(
            F.when(number != "", number).alias("number"),
            F.when(verb != "", verb).alias("method"),
        ),
    )


def via_values(head: Column) -> Column:
    """All Via header values in order."""
    return F.regexp_extract_all(head, F.lit(r"(?im)^(?:via|v)[ \t]*:[ \t]*([^\r\n]*)"), F.lit(1))


def via_hops(head: Column) -> Column:
    """Via hops as ``array<struct<version, protocol, host, port>>``; a header may list several."""
    hop = r"^SIP */ *([0-9.]+) */ *([A-Za-z]+) +(\[[^\]]*\]|[^\s:;]+) *(?:: *([0-9]+))?"
    hops = F.flatten(F.transform(via_values(head), lambda v: F.split(v, r"[ \t]*,[ \t]*")))
    return F.transform(
        hops,
        lambda v: F.struct(
            empty_to_null(F.regexp_extract(v, hop, 1)).alias("version"),
            empty_to_null(F.regexp_extract(v, hop, 2)).alias("protocol"),
            empty_to_null(F.regexp_extract(v, hop, 3)).alias("host"),
            empty_to_null(F.regexp_extract(v, hop, 4)).alias("port"),
        ),
    )


def last_via(head: Column) -> Column:
    """Text of the last Via header; NULL without one."""
    return empty_to_null(F.try_element_at(via_values(head), F.lit(-1)))


def sdp_codecs(text: Column) -> Column:
    """Codec names of the ``a=rtpmap`` lines, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(r"(?dim)^a=rtpmap:[0-9]+ ([\w-]+)/[0-9]+"), F.lit(1))


def with_text(packets: DataFrame) -> DataFrame:
    """Adds the decoded payload (``text``), its validity and the header block.

    Each step is its own projection, so that the decoding happens once per row
    whatever number of headers is taken from it.
    """
    raw = payload_bytes(F.col("pkt_hex"), F.col("payload_offset")).cast("string")
    return (
        packets.withColumn("raw_text", raw)
        .withColumns({"utf8_ok": F.is_valid_utf8("raw_text"), "text": F.make_valid_utf8("raw_text")})
        .drop("raw_text")
        .withColumn("head", header_block(F.col("text")))
    )


def with_headers(decoded: DataFrame, keep_host: bool = False) -> DataFrame:
    """Adds one column per header that the capture table and the validation use."""
    head = F.col("head")
    found = decoded.withColumns(
        {
            "request_method": method(head),
            "response_code": status_code(head),
            "from": from_user(head),
            "to": to_user(head),
            "callid": call_id(head, keep_host),
            "callid_rc": session_id(head),
            "user_agent": user_agent(head),
            "maxfwd_line": max_forwards_line(head),
            **{f"cseq_{part}": F.regexp_extract(head, _CSEQ, i) for i, part in ((1, "name"), (2, "number"), (3, "verb"))},
        }
    )
    return found.withColumns(
        {
            "maxfwd": max_forwards(F.col("maxfwd_line")),
            "cseq": cseq(F.col("cseq_name"), F.col("cseq_number"), F.col("cseq_verb")),
        }
    ).drop("maxfwd_line", "cseq_name", "cseq_number", "cseq_verb")


def parse(packets: DataFrame, keep_host: bool = False) -> DataFrame:
    return with_headers(with_text(packets), keep_host)
