import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialtrace.functions import net, text
from dialtrace.operators import validate
from dialtrace.operators.headers import parse, with_headers, with_text
from tests import make

GOOD = {
    "start": "BYE sip:x@y SIP/2.0", "via": "Via: SIP/2.0/UDP h", "from": "From: <sip:a@b>", "to": "To: <sip:c@d>",
    "call": "Call-ID: 1", "cseq": "CSeq: 1 BYE", "fwd": "Max-Forwards: 70",
}


def lines(**changes) -> str:
    return "\r\n".join(v for v in {**GOOD, **changes}.values() if v) + "\r\n\r\n"


def reasons(spark, data):
    df = parse(make.packets(spark, make.packet(1, data)))
    return df.select(validate.reason_list(validate.malformed_reasons()).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        ({}, []),
        ({"call": ""}, [validate.NO_CALL_ID]),
        ({"from": "From: "}, [validate.NO_FROM]),
        ({"to": ""}, [validate.NO_TO]),
        ({"cseq": ""}, [validate.NO_CSEQ]),
        ({"cseq": "CSeq: BYE"}, [validate.NO_CSEQ_NUMBER]),
        ({"cseq": "CSeq: 4294967295 BYE"}, []),
        ({"cseq": "CSeq: 4294967296 BYE"}, [validate.CSEQ_RANGE]),
        ({"cseq": "CSeq: 0000000004294967295 BYE"}, []),
        ({"cseq": f"CSeq: {'9' * 60} BYE"}, [validate.CSEQ_RANGE]),
        ({"cseq": "CSeq: 9"}, [validate.NO_CSEQ_METHOD]),
        ({"fwd": "Max-Forwards:"}, [validate.EMPTY_MAX_FORWARDS]),
        ({"fwd": "Max-Forwards: 256"}, [validate.MAX_FORWARDS_RANGE]),
        ({"fwd": "Max-Forwards: 255"}, []),
        ({"fwd": "Max-Forwards: many"}, []),
        ({"fwd": ""}, []),
        ({"start": "SIP/2.0 200 OK", "fwd": "Max-Forwards: 999"}, []),
        ({"call": "", "from": "", "cseq": "CSeq:"}, [validate.NO_CALL_ID, validate.NO_FROM, validate.NO_CSEQ_NUMBER, validate.NO_CSEQ_METHOD]),
    ],
)
def test_rules(spark, changes, expected):
    assert reasons(spark, lines(**changes)) == expected


def test_invalid_utf8_hides_the_rest(spark):
    assert reasons(spark, lines(call="").encode() + b"\xff") == [validate.INVALID_UTF8]


def test_report(spark):
    df = validate.with_malformed(parse(make.packets(spark, make.packet(1, lines(call="", to="")))))
    row = df.first()
    expected = f"\n\n\nMALFORMED REASON:\n{validate.NO_CALL_ID} |\n{validate.NO_TO} \n\nRAW PACKET:\n{row['pkt_hex']}"
    assert (row["malformed"], row["report"]) == (1, expected)


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        ({}, ""),
        ({"via": ""}, validate.FLAT_NO_HEADER),
        ({"fwd": ""}, validate.FLAT_NO_MAX_FORWARDS),
        ({"fwd": "", "start": "SIP/2.0 200 OK"}, ""),
        ({"ua": "User-Agent: "}, validate.FLAT_EMPTY_AGENT),
        ({"to": "", "fwd": "Max-Forwards:"}, validate.FLAT_NO_HEADER + validate.FLAT_NO_MAX_FORWARDS),
    ],
)
def test_flat_rules(spark, changes, expected):
    df = with_headers(with_text(make.packets(spark, make.packet(1, lines(**changes)))), keep_host=True)
    assert df.select(validate.flat_malformed_reasons()).first()[0] == expected


def test_packet_tests(spark):
    rows = [
        make.packet(1, "x"),
        make.packet(2, "", payload_offset=42),
        make.packet(3, "x", ip_version=6),
        make.packet(4, "x", len=99),
    ]
    df = make.packets(spark, *rows)
    assert [r["pkt_id"] for r in validate.accepted(df).collect()] == [1]
    found = {r["pkt_id"]: r["reason"] for r in validate.rejected(df).collect()}
    assert found == {2: "empty payload", 3: "not IPv4", 4: "length mismatch"}


# one job per property: all examples in one frame
@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("0123456789x", max_size=14), min_size=1, max_size=50), st.sampled_from([255, 4294967295]))
def test_digits_exceed(spark, values, limit):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(text.digits_exceed(F.col("v"), limit)).collect()]
    assert [bool(g) for g in got] == [v.isdigit() and int(v) > limit for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=50))
def test_addresses_round_trip(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint").withColumn("t", net.ip_text(F.col("n")))
    rows = df.withColumn("back", net.ip_number(F.col("t"))).collect()
    assert all(r["n"] == r["back"] == net.ip_literal(r["t"]) for r in rows)


@pytest.mark.parametrize("bad", ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "a.b.c.d", "1..2.3", "1.2.3.-4"])
def test_bad_addresses(spark, bad):
    assert net.ip_literal(bad) is None
    assert spark.createDataFrame([(bad,)], "t string").select(net.ip_number(F.col("t"))).first()[0] is None


def test_escapes(spark):
    df = spark.createDataFrame([("é<日>&'\"",)], "t string")
    row = df.select(text.html_escape(F.col("t")), text.ascii_html(F.col("t"))).first()
    assert row[0] == "é&lt;日&gt;&amp;&#39;&quot;"
    assert row[1] == "&#233;&lt;&#26085;&gt;&amp;'\""
