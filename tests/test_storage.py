"""Record formats, stored tables, upkeep, and the shape of the plans over them."""

import pytest
from pyspark.sql import functions as F

from dialtrace import maintenance, session
from dialtrace.operators.headers import parse
from dialtrace.operators.validate import accepted, with_malformed
from dialtrace.plans import callflow, dashboards
from dialtrace.plans.ingest import capture_rows, to_capture
from dialtrace.registry import inputs
from dialtrace.sources import records, tables
from tests import make


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_envelope_round_trip(spark, packets):
    direct = to_capture(packets)
    through = capture_rows(
        with_malformed(records.parsed_from_envelope(records.decode_envelope(records.encode_envelope(parse(accepted(packets))))))
    )
    assert through.exceptAll(direct).count() == 0 and through.count() == direct.count()


def test_envelope_escapes_quotes(spark):
    text = 'BYE sip:x@y SIP/2.0\r\nUser-Agent: a "quoted" \\ agent\r\nCall-ID: 1\r\n\r\n'
    encoded = records.encode_envelope(parse(make.packets(spark, make.packet(1, text))))
    assert records.decode_envelope(encoded).select("sip.ua").first()[0] == 'a "quoted" \\ agent'


@pytest.mark.parametrize("bad", ["", "{", "[]", "nonsense", None, '{"timestamp_ns": "x"}'])
def test_broken_envelopes_are_rejected(spark, bad):
    df = spark.createDataFrame([(1, bad)], "pkt_id bigint, value string")
    assert records.decode_envelope(df).count() == 0
    assert records.envelope_rejects(df).count() == 1


@pytest.mark.parametrize(
    ("line", "good"),
    [
        ("1700000000000000000|1:2|3:4|1:00ff", True),
        ("1|1:2|3:4|0:", True),
        ("1|1:2|3:4|1:00|ff", True),
        ("1|1:2|3:4", False),
        ("1|1:2:3|3:4|0:00", False),
        ("1|1|3:4|0:00", False),
        ("x|1:2|3:4|0:00", False),
        ("1|1:2|3:4|0:00:11", False),
        ("", False),
        (None, False),
    ],
)
def test_text_lines(spark, line, good):
    df = spark.createDataFrame([(line,)], "value string")
    assert records.read_text_wire(df).count() == (1 if good else 0)
    assert records.text_wire_rejects(df).count() == (0 if good else 1)


def test_expired_days_are_dropped_whole(spark):
    rows = [make.message(i, 86_400 * i + 3600, "a") for i in range(5)]
    database = "db_expiry"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{session.work_dir(spark, 'expiry')}'")
    maintenance.create_capture_table(spark, f"{database}.t", make.capture(spark, rows))
    dropped = maintenance.drop_expired_days(spark, f"{database}.t", "2024-01-04 12:00:00")
    assert dropped == ["2024-01-01", "2024-01-02"]
    left = spark.table(f"{database}.t")
    assert sorted(r["id"] for r in left.collect()) == [2, 3, 4]
    fresh = maintenance.unexpired(left, now="2024-01-04 12:00:00")
    assert sorted(r["id"] for r in fresh.collect()) == [3, 4]


def test_retention_bound_is_exclusive(spark):
    df = make.capture(spark, [make.message(1, 0, "a"), make.message(2, 1, "a"), make.message(3, 86_400, "a")])
    assert sorted(r["id"] for r in maintenance.unexpired(df).collect()) == [2, 3]


def test_statistics(spark, capture):
    database = "db_stats"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{session.work_dir(spark, 'stats')}'")
    maintenance.create_capture_table(spark, f"{database}.t", capture)
    maintenance.refresh_statistics(spark, f"{database}.t")
    stats = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {database}.t").collect()}
    assert f"{capture.count()} rows" in stats["Statistics"]


def test_working_folder_follows_the_session(spark):
    assert session.work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert session.work_dir(spark, "x") != session.work_dir(spark, "x")


def test_parsing_is_one_compiled_stage_without_shuffle(spark, packets):
    plan = plan_of(to_capture(packets))
    assert "Exchange" not in plan and "Python" not in plan
    assert all(line.lstrip(" :+-").startswith("*(1)") for line in plan.splitlines() if "+- " in line and "FileScan" not in line and "ColumnarToRow" not in line)


def test_packet_tests_reach_the_scan(spark, packets):
    assert "EqualTo(ip_version,4)" in plan_of(to_capture(packets))


def test_search_columns_only(spark, capture):
    plan = plan_of(dashboards.by_method(dashboards.last_days(capture, 1, "2024-01-30 00:00:00")))
    assert "ReadSchema: struct<datetime:timestamp,request_method:string>" in plan
    assert "PartitionFilters: [isnotnull(date" in plan


def test_time_limit_prunes_the_codec_table_too(spark, sf_dir, capture):
    recent = dashboards.last_days(capture, 1, "2024-01-30 00:00:00")
    plan = plan_of(dashboards.by_request_codec(recent, inputs.sdp(spark, sf_dir)))
    scan = next(line for line in plan.splitlines() if "codec" in line and "FileScan" in line)
    assert "date" in scan.split("PartitionFilters:")[1].split("]")[0]


def test_flows_use_equality_joins(spark, capture):
    plan = plan_of(callflow.call_flows(capture))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "SinglePartition" not in plan


def test_appending_keeps_earlier_rows(spark):
    path = session.work_dir(spark, "append")
    tables.append_capture(make.capture(spark, [make.message(1, 0, "a")]).drop("date"), path)
    tables.append_capture(make.capture(spark, [make.message(2, 90_000, "b")]).drop("date"), path)
    stored = tables.read_capture(spark, path)
    assert {(r["id"], str(r["date"])) for r in stored.collect()} == {(1, "2024-01-01"), (2, "2024-01-02")}
    assert stored.select(F.max("date")).count() == 1
