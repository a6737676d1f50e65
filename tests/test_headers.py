"""Header extraction on whole messages of several shapes."""

import pytest
from pyspark.sql import functions as F

from dialtrace.operators import headers as h
from tests import make

INVITE = (
    "INVITE sip:conf@192.0.2.48 SIP/2.0\n"
    "Via: SIP/2.0/UDP 198.51.100.103:5070;rport;branch=z9hG4bKPj1\n"
    "Max-Forwards: 70\n"
    "User-Agent: edge_20.103\n"
    'From: "7005550100" <sip:7005550100@192.0.2.16>;tag=198.51.100.103-5070\n'
    'To: "conf" <sip:conf@192.0.2.48>\n'
    "Contact: <sip:other@198.51.100.103:5070;transport=udp>\n"
    "Call-ID: aaaa-bbbb-cccc\n"
    "CSeq: 1581 INVITE\n"
    "p-rc-session-id: 999x5DYR\n"
    "Content-Type: application/sdp\n"
    "\n"
    "v=0\nm=audio 13276 RTP/AVP 0 3 8 101\n"
    "a=rtpmap:0 pcma/8000\na=rtpmap:3 gsm/8000\na=rtpmap:8 pcmu/8000\na=rtpmap:101 telephone-event/8000\na=sendrecv\n"
)

INFO = (
    "INFO sip:+12025550164@198.51.100.47:5070;transport=udp SIP/2.0\r\n"
    "Via: SIP/2.0/UDP 192.0.2.49;rport;branch=z9hG4bKH\r\n"
    "Max-Forwards: 70\r\n"
    'From: "conf" <sip:conf@192.0.2.49>;tag=F\r\n'
    'To: "+12025550164" <sip:+12025550164@198.51.100.90>;tag=d\r\n'
    "Call-ID: ac27de05\r\n"
    "CSeq: 83253780 INFO\r\n"
    "User-Agent: HMP-1.2.3-\r\n"
    "Content-Type: application/msml+xml\r\n"
    "\r\n"
    '<?xml version="1.0"?>\r\n<msml>\r\nTo: <sip:body@example.com>\r\nVia: SIP/2.0/TCP body\r\n</msml>\r\n'
)

TWO_HOPS = (
    "INVITE sip:9011972@198.51.100.103:5070 SIP/2.0\r\n"
    "Record-Route: <sip:192.0.2.16;lr>\r\n"
    "To: 9011972<sip:9011972@192.0.2.16>\r\n"
    "From: 8888<sip:8888@192.0.2.16>;tag=5460\r\n"
    "Via: SIP/2.0/UDP 192.0.2.16;branch=z9hG4bK30\r\n"
    "Via: SIP/2.0/UDP 203.0.113.12:5070;branch=z9hG4bK-2b;rport=5070\r\n"
    "Call-ID: 2bfb77e6@host.example\r\n"
    "CSeq: 1 INVITE\r\n"
    "Max-Forwards: 69\r\n"
    "User-Agent: sipcli/v1.8\r\n\r\n"
)


def parse_one(spark, text, **options):
    df = h.parse(make.packets(spark, make.packet(1, text)), **options)
    return df.withColumns({"via": h.via_hops(F.col("head")), "codecs": h.sdp_codecs(F.col("text"))}).first()


def test_invite_with_sdp(spark):
    row = parse_one(spark, INVITE)
    assert (row["request_method"], row["response_code"]) == ("INVITE", None)
    assert (row["from"], row["to"]) == ("7005550100", "conf")
    assert (row["callid"], row["callid_rc"]) == ("aaaa-bbbb-cccc", "999x5DYR")
    assert (row["user_agent"], row["maxfwd"]) == ("edge_20.103", "70")
    assert tuple(row["cseq"]) == ("1581", "INVITE")
    assert row["codecs"] == ["pcma", "gsm", "pcmu", "telephone-event"]
    assert [tuple(v) for v in row["via"]] == [("2.0", "UDP", "198.51.100.103", "5070")]


def test_header_lines_in_the_body_do_not_count(spark):
    row = parse_one(spark, INFO)
    assert row["to"] == "+12025550164"
    assert row["user_agent"] == "HMP-1.2.3-"
    assert len(row["via"]) == 1
    assert row["via"][0]["port"] is None
    assert row["codecs"] == []


def test_two_hops_and_bare_display_name(spark):
    row = parse_one(spark, TWO_HOPS)
    assert (row["from"], row["to"]) == ("8888", "9011972")
    assert [v["host"] for v in row["via"]] == ["192.0.2.16", "203.0.113.12"]
    assert row["callid"] == "2bfb77e6"
    assert parse_one(spark, TWO_HOPS, keep_host=True)["callid"] == "2bfb77e6@host.example"


def test_blank_line_before_the_start_line(spark):
    assert parse_one(spark, "\r\n\r\n" + TWO_HOPS)["request_method"] == "INVITE"


def test_response(spark):
    row = parse_one(spark, "SIP/2.0 486 Busy Here\r\nCSeq: 7 INVITE\r\n\r\n")
    assert (row["request_method"], row["response_code"]) == (None, 486)


@pytest.mark.parametrize(
    ("line", "user"),
    [
        ("From: sip:alice@example.com;tag=1", "alice"),
        ("FROM : <sips:bob:secret@example.com>", "bob"),
        ("f: <sip:carol@example.com>", "carol"),
        ('From: "sip:wrong@example.com" <sip:right@example.com>', "right"),
        ('From: "a <b>" <sip:dave@example.com>', "dave"),
        ("From:\r\n <sip:folded@example.com>", "folded"),
        ("From: <sip:example.com>", None),
        ("From: ", None),
        ("X-From: <sip:eve@example.com>", None),
    ],
)
def test_from_forms(spark, line, user):
    row = parse_one(spark, f"BYE sip:x@y SIP/2.0\r\n{line}\r\nCall-ID: 1\r\n\r\n")
    assert row["from"] == user


def test_first_header_wins(spark):
    row = parse_one(spark, "BYE sip:x@y SIP/2.0\r\nCall-ID: one\r\nCall-ID: two\r\n\r\n")
    assert row["callid"] == "one"


def test_missing_and_empty_max_forwards_differ(spark):
    assert parse_one(spark, "BYE sip:x@y SIP/2.0\r\n\r\n")["maxfwd"] is None
    assert parse_one(spark, "BYE sip:x@y SIP/2.0\r\nMax-Forwards:\r\n\r\n")["maxfwd"] == ""
    assert parse_one(spark, "BYE sip:x@y SIP/2.0\r\nMax-Forwards:  x1 \r\n\r\n")["maxfwd"] == "x1"


def test_cseq_parts(spark):
    assert parse_one(spark, "BYE sip:x@y SIP/2.0\r\n\r\n")["cseq"] is None
    assert tuple(parse_one(spark, "BYE sip:x@y SIP/2.0\r\nCSeq:\r\n\r\n")["cseq"]) == (None, None)
    assert tuple(parse_one(spark, "BYE sip:x@y SIP/2.0\r\nCSeq: 5\r\n\r\n")["cseq"]) == ("5", None)
    assert tuple(parse_one(spark, "BYE sip:x@y SIP/2.0\r\nCSeq: BYE\r\n\r\n")["cseq"]) == (None, "BYE")


def test_via_list_in_one_header(spark):
    row = parse_one(spark, "BYE sip:x@y SIP/2.0\r\nv: SIP/2.0/TLS [2001:db8::1]:5061, SIP/2.0/UDP h.example\r\n\r\n")
    assert [tuple(v) for v in row["via"]] == [("2.0", "TLS", "[2001:db8::1]", "5061"), ("2.0", "UDP", "h.example", None)]


def test_text_that_is_no_sip(spark):
    row = parse_one(spark, "hello")
    assert (row["request_method"], row["response_code"], row["callid"], row["cseq"]) == (None, None, None, None)
