"""Packet checks before parsing and message checks after it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialtrace.functions.text import all_digits, digits_exceed
from dialtrace.operators.headers import last_via

# fixed values: limits, reasons and report forms
MAX_CSEQ = 4294967295
MAX_FORWARDS = 255
DENIED_AGENTS = ["friendly-scanner"]
INVALID_UTF8 = "include non UTF8 symbols in payload_data"
NO_CALL_ID = "required headers 'Call-ID' is None or empty"
NO_FROM = "required headers 'From' is None or empty"
NO_TO = "required headers 'To' is None or empty"
NO_CSEQ = "required headers 'CSeq' is None or empty"
NO_CSEQ_NUMBER = "required headers 'CSeq number' is None or empty"
CSEQ_RANGE = "the CSeq sequence number is >2**32-1"
NO_CSEQ_METHOD = "required headers 'CSeq method' is None or empty"
EMPTY_MAX_FORWARDS = "required headers 'Max-Forwards' is empty"
MAX_FORWARDS_RANGE = "Max-Forwards header value is >255"
REASON_SEPARATOR = " |\n"
REPORT = "\n\n\nMALFORMED REASON:\n%s \n\nRAW PACKET:\n%s"
FLAT_REPORT = "Malformed reason: %s \nData: \n%s"
FLAT_INVALID_UTF8 = " include non UTF8 symbols in payload_data |"
FLAT_NO_HEADER = " required headers is None or empty |"
FLAT_EMPTY_AGENT = " user agent defined but empty |"
FLAT_NO_MAX_FORWARDS = " Max-Forwards header required for SIP requests |"


def has_payload() -> Column:
    return F.col("payload_offset") < F.col("len")


def is_ipv4() -> Column:
    return F.col("ip_version") == 4


def length_agrees() -> Column:
    """The bytes present are as many as the packet header says."""
    return F.length("pkt_hex") == F.col("len") * 2


def reject_reason() -> Column:
    """Why a packet does not reach the parser; NULL if it does."""
    return (
        F.when(~has_payload(), "empty payload")
        .when(~is_ipv4(), "not IPv4")
        .when(~length_agrees(), "length mismatch")
    )


def accepted(packets: DataFrame) -> DataFrame:
    """Packets that go to the parser: tests on raw columns only, ahead of any decoding."""
    return packets.where(has_payload() & is_ipv4() & length_agrees())


def rejected(packets: DataFrame) -> DataFrame:
    return packets.withColumn("reason", reject_reason()).where(F.col("reason").isNotNull())


def malformed_reasons() -> Column:
    """Violated rules of a parsed message as joined text, empty for a good one.

    Empty headers are NULL here already.
    Invalid UTF-8 hides all further rules. The Max-Forwards rules hold for
    requests, and a missing Max-Forwards header is no violation.
    """
    number, verb = F.col("cseq.number"), F.col("cseq.method")
    request = F.col("request_method").isNotNull()
    has_cseq = F.col("cseq").isNotNull()
    rules = [
        (F.col("callid").isNull(), NO_CALL_ID),
        (F.col("`from`").isNull(), NO_FROM),
        (F.col("`to`").isNull(), NO_TO),
        (~has_cseq, NO_CSEQ),
        (has_cseq & number.isNull(), NO_CSEQ_NUMBER),
        (digits_exceed(number, MAX_CSEQ), CSEQ_RANGE),
        (has_cseq & verb.isNull(), NO_CSEQ_METHOD),
        (request & (F.col("maxfwd") == ""), EMPTY_MAX_FORWARDS),
        (request & digits_exceed(F.col("maxfwd"), MAX_FORWARDS), MAX_FORWARDS_RANGE),
    ]
    # concat_ws skips the NULLs of rules that hold, and unlike an array filter it is compiled
    found = F.concat_ws(REASON_SEPARATOR, *[F.when(rule, F.lit(reason)) for rule, reason in rules])
    return F.when(F.col("utf8_ok"), found).otherwise(F.lit(INVALID_UTF8))


def reason_list(reasons: Column) -> Column:
    """The joined reasons as an array."""
    return F.when(reasons == "", F.array().cast("array<string>")).otherwise(F.split(reasons, r" \|\n"))


def malformed_report(reasons: Column, pkt_hex: Column) -> Column:
    """Text that is stored behind a malformed message; NULL for a good one."""
    return F.when(reasons != "", F.format_string(REPORT, reasons, pkt_hex))


def with_malformed(parsed: DataFrame) -> DataFrame:
    return (
        parsed.withColumn("reasons", malformed_reasons())
        .withColumn("malformed", F.when(F.col("reasons") != "", 1).otherwise(0))
        .withColumn("report", malformed_report(F.col("reasons"), F.col("pkt_hex")))
    )


def flat_malformed_reasons() -> Column:
    """Rule text of the flat envelope: empty text if nothing is wrong.

    Here Via is required as well, a User-Agent header must not be empty, and a
    request needs a Max-Forwards number.
    """
    head = F.col("head")
    missing = (
        F.col("callid").isNull()
        | F.col("`from`").isNull()
        | F.col("`to`").isNull()
        | F.col("cseq.number").isNull()
        | F.col("cseq.method").isNull()
        | last_via(head).isNull()
    )
    empty_agent = head.rlike(r"(?im)^user-agent[ \t]*:[ \t]*$")
    no_forwards = F.col("request_method").isNotNull() & ~F.coalesce(all_digits(F.col("maxfwd")), F.lit(False))
    rules = [
        (~F.col("utf8_ok"), FLAT_INVALID_UTF8),
        (missing, FLAT_NO_HEADER),
        (empty_agent, FLAT_EMPTY_AGENT),
        (no_forwards, FLAT_NO_MAX_FORWARDS),
    ]
    return F.concat(*[F.when(rule, F.lit(reason)).otherwise(F.lit("")) for rule, reason in rules])


def allowed_agent(user_agent: Column) -> Column:
    """False for user agents on the deny list; a missing one is allowed."""
    return ~F.coalesce(user_agent.isin(DENIED_AGENTS), F.lit(False))
