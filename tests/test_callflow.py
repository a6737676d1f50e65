"""Correlation and flows against a literal evaluation, and with very uneven groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dialtrace.operators import correlate
from dialtrace.operators.dedup import without_retransmissions
from dialtrace.plans import callflow
from dialtrace.session import keep
from tests import make


def literal_members(rows, seed):
    """Ids of the flow of one seed row: one lookup after the other."""
    callid = next((r["callid"] for r in rows if r["id"] == seed), None)
    if not callid:
        return None
    named = [r["callid_rc"] for r in rows if r["callid"] == callid and r["callid_rc"]]
    rc = min(named) if named else None
    keys = {callid} | ({rc} if rc else set())
    keys |= {r["callid"] for r in rows if r["callid_rc"] == (rc or callid) and r["callid"]}
    return {r["id"] for r in rows if r["callid"] in keys or r["callid_rc"] in keys}


def check_all_seeds(df):
    rows = df.select("id", "callid", "callid_rc").collect()
    members = defaultdict(set)
    for r in callflow.flow_members(df).collect():
        assert r["id"] not in members[r["session"]]
        members[r["session"]].add(r["id"])
    sessions = {r["id"]: r["session"] for r in callflow.seed_flows(df).collect()}
    for r in rows:
        expected = literal_members(rows, r["id"])
        if expected is None:
            assert r["id"] not in sessions
        else:
            assert members[sessions[r["id"]]] == expected


def test_random_correlations(spark):
    rng = random.Random(7)
    names = [None, "a", "b", "c", "d", "e", "f", "g"]
    for _ in range(3):
        rows = [make.message(i, i, rng.choice(names), rng.choice([None, *names])) for i in range(60)]
        check_all_seeds(make.capture(spark, rows))


def test_fixture_correlations(spark, capture):
    check_all_seeds(capture)


def hot_rows():
    """A third of all rows in one call, many calls of one session, copies of one message."""
    rows = [make.message(i, i * 0.01, "hot", "s") for i in range(3000)]
    rows += [make.message(10_000 + i, i * 0.02, f"c{i}", "s") for i in range(1500)]
    rows += [make.message(20_000 + i, 5 + i * 0.01, "copies", "s", msg="same") for i in range(2500)]
    rows += [make.message(30_000 + i, i, None, None) for i in range(1500)]
    rows += [make.message(40_000 + i, i, f"alone{i}", None) for i in range(500)]
    random.Random(1).shuffle(rows)
    return rows


def literal_flow(rows, session_keys):
    found = [r for r in rows if r[4] in session_keys or r[5] in session_keys]
    first = {}
    for r in sorted(found, key=lambda r: (r[1], r[0])):
        first.setdefault((r[2], r[3], r[9], r[10], r[11], r[12], r[14]), r)
    ordered = sorted(first.values(), key=lambda r: (r[1], r[0]))[:1000]
    return [r[0] for r in ordered]


@pytest.fixture(scope="module")
def hot(spark):
    rows = hot_rows()
    return rows, keep(make.capture(spark, rows), "hot")


def test_hot_flow_is_cut_exactly(spark, hot):
    rows, df = hot
    keys = {"s", "hot", "copies"} | {f"c{i}" for i in range(1500)}
    flows = callflow.call_flows(df)
    got = [r["id"] for r in flows.where("session = 's'").orderBy("number").collect()]
    assert got == literal_flow(rows, keys)
    assert len(got) == 1000
    texts = {r["session"]: r for r in callflow.flow_texts(flows).collect()}
    assert texts["s"]["limit_reached"] and texts["s"]["flow"].endswith(callflow.LIMIT_MARKER)
    assert not texts["alone3"]["limit_reached"]
    assert flows.where("session LIKE 'alone%'").count() == 500


def test_single_flow_equals_batch_flow_on_all_paths(spark, hot, monkeypatch):
    rows, df = hot
    expected = callflow.call_flows(df).where("session = 's'").orderBy("number").collect()
    for listed, broadcast in ((10_000, 10_000), (10, 10_000), (10, 10)):
        monkeypatch.setattr(callflow, "MAX_LISTED_KEYS", listed)
        monkeypatch.setattr(callflow, "MAX_BROADCAST_KEYS", broadcast)
        assert callflow.call_flow(df, 10_003).orderBy("number").collect() == expected


def test_flow_of_a_message_without_call_id_is_empty(spark, hot):
    assert callflow.call_flow(hot[1], 30_001).count() == 0


def test_export_of_a_table_that_was_loaded_twice(spark):
    df = make.capture(spark, [make.message(i, i, "a") for i in range(5)] + [make.message(9, 3, "b")])
    once = {r["session"]: r["document"] for r in callflow.export_flows(callflow.call_flows(df), df).collect()}
    twice = df.unionByName(df)
    found = {r["session"]: r["document"] for r in callflow.export_flows(callflow.call_flows(twice), twice).collect()}
    assert found == once and set(found) == {"a", "b"}


def test_lanes_and_spans(spark):
    ips = {"a": 1, "b": 2, "c": 3}
    hops = ["ab", "ba", "bc", "ca", "cc"]
    rows = [
        make.message(i, i, "x", None, source_ip=ips[s], destination_ip=ips[t]) for i, (s, t) in enumerate(hops)
    ]
    flow = callflow.call_flow(make.capture(spark, rows), 0)
    lanes = {r["ip"]: r["lane"] for r in callflow.lanes(flow).collect()}
    assert lanes == {"0.0.0.1": 1, "0.0.0.2": 2, "0.0.0.3": 3}
    spans = [(r["left_lane"], r["span"]) for r in callflow.lane_spans(flow).orderBy("number").collect()]
    assert spans == [(1, 1), (1, 1), (2, 1), (1, 2), (3, 1)]


def test_null_parts_of_the_checksum(spark):
    rows = [
        make.message(1, 1, "a", None, **{"from": None, "msg": "m"}),
        make.message(2, 2, "b", None, **{"from": None, "msg": "n"}),
        make.message(3, 3, "c", None, source_port=None, msg="p"),
        make.message(4, 4, "c", None, source_port=0, msg="p"),
    ]
    df = make.capture(spark, rows)
    assert sorted(r["id"] for r in without_retransmissions(df).collect()) == [1, 2, 3]
    assert sorted(r["id"] for r in without_retransmissions(df, null_collapses=True).collect()) == [1, 3]


@pytest.mark.parametrize(
    ("code", "colour", "arrow"),
    [
        (None, "black", "->"), (99, "black", "-->"), (100, "DodgerBlue", "-->"), (198, "DodgerBlue", "-->"), (199, "black", "-->"),
        (200, "LimeGreen", "->"), (299, "black", "-->"), (302, "yellow", "-->"), (399, "black", "-->"), (404, "red", "->"),
        (698, "red", "->"), (699, "black", "-->"), (800, "black", "-->"),
    ],
)
def test_styles(spark, code, colour, arrow):
    df = spark.createDataFrame([(code,)], "code int")
    assert tuple(df.select(callflow.status_colour(F.col("code")), callflow.status_arrow(F.col("code"))).first()) == (colour, arrow)


def test_pairs_are_keyed_without_nested_loops(spark, capture):
    plan = correlate.pair_sessions(correlate.call_pairs(capture))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
