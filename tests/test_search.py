import pytest
from pyspark.sql import functions as F

from dialtrace.operators import filters
from dialtrace.operators.ranking import numbered
from dialtrace.plans import dashboards, search
from tests import make


@pytest.mark.parametrize("grouping", [0, 1])
def test_deep_pages_equal_shallow_pages(spark, capture, monkeypatch, grouping):
    everything = [r["id"] for r in search.matches(capture, grouping).orderBy("datetime", "id").collect()]
    monkeypatch.setattr(search, "HEAP_ROWS", 0)
    for limit, offset in ((7, 0), (50, 100), (33, len(everything) - 10), (5, len(everything))):
        page = search.take_page(search.matches(capture, grouping), limit, offset)
        assert [r["id"] for r in page.collect()] == everything[offset : offset + limit]


def test_deep_grouped_search(spark, capture, monkeypatch):
    shallow = search.search(capture, rows=20, page=4).collect()
    monkeypatch.setattr(search, "HEAP_ROWS", 0)
    assert search.search(capture, rows=20, page=4).collect() == shallow


def test_deep_pages_with_missing_times_and_ties(spark, monkeypatch):
    seconds = [-7200.5, -0.25, 0, 0, 0.25, 3599.75, 3600, 86400]
    rows = [make.message(i, seconds[i % 8], str(i % 9), **({"datetime": None} if i % 5 == 0 else {})) for i in range(60)]
    df = make.capture(spark, rows + rows[:6])
    monkeypatch.setattr(search, "HEAP_ROWS", 0)
    for grouping in (0, 1):
        everything = [r["id"] for r in search.matches(df, grouping).orderBy("datetime", "id").collect()]
        for limit, offset in ((4, 0), (4, 2), (9, 10), (5, 40), (70, 1)):
            page = search.take_page(search.matches(df, grouping), limit, offset)
            assert [r["id"] for r in page.collect()] == everything[offset : offset + limit]


def test_deep_page_inside_one_second(spark, monkeypatch):
    monkeypatch.setattr(search, "HEAP_ROWS", 0)
    df = make.capture(spark, [make.message(i, 5 + (i % 7) * 0.01, str(i)) for i in range(100)])
    expected = [r["id"] for r in df.orderBy("datetime", "id").collect()][40:60]
    assert [r["id"] for r in search.take_page(search.matches(df, 0), 20, 40).collect()] == expected


def test_defaults(spark, capture):
    first = search.search(capture).collect()
    assert len(first) == 10
    assert search.page_bounds("", "") == (10, 0)
    assert search.page_bounds("50", "3") == (50, 100)
    assert search.page_bounds(1000, 0) == (1000, 0)
    assert [r["id"] for r in search.search(capture, page=0).collect()] == [r["id"] for r in first]


def test_missing_call_ids_form_one_group(spark):
    rows = [make.message(i, i, None) for i in range(5)] + [make.message(9, 9, "a")]
    df = make.capture(spark, rows)
    assert [r["id"] for r in search.search(df).collect()] == [0, 9]
    assert search.total(df).first()[0] == 2
    assert search.total(df, grouping=0).first()[0] == 6


def test_grouping_comes_after_the_filter(spark):
    rows = [make.message(1, 1, "a", malformed=0), make.message(2, 2, "a", malformed=1)]
    assert [r["id"] for r in search.search(make.capture(spark, rows), malformed=1).collect()] == [2]


def test_empty_fields_do_not_filter(spark, capture):
    fields = dict.fromkeys(("malformed", "src_ip", "dst_ip", "sip_callid", "sip_method", "from_user", "to_user", "date_start", "date_end"), "")
    assert search.matches(capture, 0, **fields).count() == capture.count()


def test_bad_address_matches_nothing(spark, capture):
    assert search.matches(capture, 0, src_ip="10.0.0").count() == 0


def test_user_numbers(spark):
    stored = ["555", "+555", "+1555", "1555", "5550", "x555", None]
    df = make.capture(spark, [make.message(i, i, str(i), **{"from": v}) for i, v in enumerate(stored)])

    def ids(**fields):
        return sorted(r["id"] for r in search.matches(df, 0, **fields).collect())

    assert ids(from_user="555") == [0, 1, 2, 3]
    assert ids(from_user="55_") == [0, 1, 2, 3]
    assert ids(from_user="555%") == [0, 1, 2, 3, 4]
    assert ids(from_user="%555") == [0, 1, 2, 3, 5]


def test_case_insensitive(spark):
    df = make.capture(spark, [make.message(1, 1, "AbC "), make.message(2, 2, "abc", "x"), make.message(3, 3, "abd", "ABC")])
    assert search.matches(df, 0, sip_callid="abc").count() == 1
    assert search.matches(df, 0, sip_callid="abc", ci=True).count() == 3


def test_time_limits_are_inclusive_and_prune_days(spark, capture):
    moment = capture.orderBy("datetime").select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    found = search.matches(capture, 0, date_start=moment, date_end=moment)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "msg" not in plan


def test_address_filter_reaches_the_scan(spark, capture):
    plan = search.matches(capture, 0, src_ip="10.0.1.1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_ip,167772417)" in plan


def test_groups_are_cut_ahead_of_the_exchange(spark, capture):
    plan = search.matches(capture, 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [callid" in plan and "Partial" in plan


GRID = [(1, "Alpha", 5), (2, "beta", None), (3, None, 50)]


@pytest.mark.parametrize(
    ("rules", "match", "ids"),
    [
        ([], "all", [1, 2, 3]),
        ([], "any", [1, 2, 3]),
        ([("t", "contains", "LPH")], "all", [1]),
        ([("t", "beginwith", "B"), ("t", "endwith", "TA")], "all", [2]),
        ([("t", "equal", "alpha")], "all", []),
        ([("t", "notequal", "Alpha")], "all", [2, 3]),
        ([("n", "less", 50)], "all", [1, 2]),
        ([("n", "greaterorequal", "5")], "all", [1, 3]),
        ([("n", "equal", 5), ("t", "equal", "beta")], "any", [1, 2]),
        ([("t", "equal", "")], "all", [3]),
    ],
)
def test_grid_rules(spark, rules, match, ids):
    df = spark.createDataFrame(GRID, "id int, t string, n int")
    assert sorted(r["id"] for r in filters.rules_filter(df, rules, match).collect()) == ids


def test_net_bounds(spark):
    rows = [make.packet(i, "x", src_ip=ip, dst_ip=1) for i, ip in enumerate([167772159, 167772160, 184549375, 184549376])]
    df = make.packets(spark, *rows)
    assert [r["pkt_id"] for r in df.where(filters.net("10.1.2.3/8")).collect()] == [1, 2]
    assert df.where(filters.net("0.0.0.0/0")).count() == 4
    assert df.where(filters.net("9.255.255.255", "dst")).count() == 0
    assert df.where(filters.net("10")).count() == df.where(filters.net("10.0.0.0", mask="255.0.0.0")).count() == 2
    assert df.where(filters.net("10", "both")).count() == 0
    assert df.where(filters.host("10.0.0.0", "src")).count() == 1
    for bad in (lambda: filters.host("example.com"), lambda: filters.net("10.0.0.0", mask="255.0.255.0")):
        with pytest.raises(ValueError):
            bad()


def test_dashboard_with_fixed_end(spark, capture):
    codecs = None
    rows = dashboards.dashboard(capture, codecs, "method", days=2, now="2024-01-10 00:00:00")
    expected = capture.where("datetime >= '2024-01-08' AND request_method IS NOT NULL").groupBy("request_method").count()
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in expected.collect()}
    with pytest.raises(ValueError):
        dashboards.dashboard(capture, codecs, "unknown")


def test_rows_are_numbered_across_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.when(F.col("id") % 3 > 0, 5).alias("group"))
    placed = numbered(rows.repartition(5), ["group", "id"], "place", first=3).collect()
    expected = sorted(((r["group"] is not None, r["group"] or 0, r["id"]) for r in placed))
    assert [(r["group"] is not None, r["group"] or 0, r["id"]) for r in sorted(placed, key=lambda r: r["place"])] == expected
    assert sorted(r["place"] for r in placed) == list(range(3, 1003))


def test_numbers_by_weight_leave_room(spark):
    rows = spark.createDataFrame([(4, 10), (1, 0), (3, 5), (2, 7)], "id int, size int")
    placed = numbered(rows, ["id"], "at", 100, F.col("size")).orderBy("id").collect()
    assert [r["at"] for r in placed] == [100, 100, 107, 112]
    assert numbered(rows.where("id > 9"), ["id"], "at").count() == 0
