"""Traffic counters over packets and parsed messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialtrace.functions.net import symmetric_flow
from dialtrace.functions.time import ns_to_timestamp
from dialtrace.operators.headers import METHODS, parse
from dialtrace.operators.validate import reject_reason, with_malformed

# fixed value: preamble, checksum and gap around each frame on the wire
FRAMING_BYTES = 24


def channel(count: int = 4) -> Column:
    """Capture channel of a packet; both directions of a conversation share one."""
    spread = F.col("src_ip") + F.col("src_port") + F.col("dst_ip") + F.col("dst_port")
    return F.concat(F.lit("ch"), F.pmod(spread, F.lit(count)).cast("string"))


def message_kind() -> Column:
    return (
        F.when(F.col("request_method").isNotNull(), "request")
        .when(F.col("response_code").isNotNull(), "response")
        .otherwise("unknown")
    )


def kind_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(message_kind().alias("kind")).agg(F.count(F.lit(1)).alias("messages"))


def method_counts(parsed: DataFrame, by: list[Column]) -> DataFrame:
    """One column per request method, in a single pass."""
    return parsed.groupBy(*by).agg(
        *[F.count_if(F.col("request_method") == name).alias(name.lower()) for name in METHODS]
    )


def status_class_counts(parsed: DataFrame, by: list[Column]) -> DataFrame:
    """One column per response class, 1xx to 6xx."""
    code = F.col("response_code")
    return parsed.groupBy(*by).agg(
        *[
            F.count_if(code.between(n * 100, n * 100 + 99)).alias(f"status_{n}xx")
            for n in range(1, 7)
        ]
    )


def traffic(packets: DataFrame, by: list[Column]) -> DataFrame:
    return packets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("len") + FRAMING_BYTES).cast("bigint").alias("bytes")
    )


def rejects_by_reason(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("packets"))


def malformed_by_reason(checked: DataFrame, reasons: Column) -> DataFrame:
    """Messages per violated rule; a message counts once for each of its reasons."""
    return (
        checked.select(F.explode(reasons).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("messages"))
    )


def flow_traffic(packets: DataFrame) -> DataFrame:
    """Packets and bytes per conversation, both directions together."""
    key = symmetric_flow(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    counted = traffic(packets.withColumn("flow", key), [F.col("flow")])
    return counted.select(
        F.col("flow.low.ip").alias("low_ip"),
        F.col("flow.low.port").alias("low_port"),
        F.col("flow.high.ip").alias("high_ip"),
        F.col("flow.high.port").alias("high_port"),
        "packets",
        "bytes",
    )


def per_second(packets: DataFrame) -> DataFrame:
    """Packets and bytes per second and channel."""
    second = F.date_trunc("second", ns_to_timestamp(F.col("timestamp_ns")))
    return traffic(packets, [second.alias("ts"), channel().alias("sensor")])


def running(counts: DataFrame, values: list[str], by: str = "sensor", time: str = "ts") -> DataFrame:
    """Cumulative form of counters that are already summed up per time step.

    Totals of whole days are accumulated first and added to the running sums
    inside each day, so no task handles more than one day of a sensor, or one row
    per day.
    """
    dated = counts.withColumn("_day", F.to_date(time))
    days = dated.groupBy(by, "_day").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = W.partitionBy(by).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    carried = days.select(by, "_day", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    within = W.partitionBy(by, "_day").orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = dated.select(by, time, "_day", *[F.sum(v).over(within).alias(v) for v in values])
    return summed.join(carried, [by, "_day"]).select(
        by, time, *[(F.col(v) + F.col(f"_{v}")).cast("bigint").alias(v) for v in values]
    )


def interval_peak(packets: DataFrame) -> DataFrame:
    """Per second, the longest wait since the previous packet of a conversation, in microseconds.

    Waits inside one second of a conversation are found first; what remains is one
    row per conversation and second, over which the waits between seconds are
    taken. A conversation with very many packets is thereby split by time.
    """
    key = symmetric_flow(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    timed = packets.select(
        key.alias("flow"),
        F.unix_micros(ns_to_timestamp(F.col("timestamp_ns"))).alias("at"),
    ).withColumn("second", F.call_function("div", F.col("at"), F.lit(1000000)))
    inner = F.lag("at").over(W.partitionBy("flow", "second").orderBy("at"))
    seconds = (
        timed.withColumn("wait", F.col("at") - inner)
        .groupBy("flow", "second")
        .agg(F.max("wait").alias("wait"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    outer = F.col("first") - F.lag("last").over(W.partitionBy("flow").orderBy("second"))
    waits = seconds.select("second", F.greatest("wait", outer).alias("wait"))
    return waits.groupBy("second").agg(F.max("wait").alias("peak_us")).where(F.col("peak_us").isNotNull())


def as_metrics(counts: DataFrame, prefix: str, values: list[str]) -> DataFrame:
    """Counter columns as METRIC rows named ``prefix.name``."""
    wide = counts.select("ts", "sensor", *[F.col(v).cast("double").alias(v) for v in values])
    long = wide.unpivot(["ts", "sensor"], values, "metric", "value")
    return long.select("ts", F.concat(F.lit(f"{prefix}."), "metric").alias("metric"), "sensor", "value")


#: Gauges of a packet stream: those of the transport, and those of the messages in it.
TRAFFIC_GAUGES = ["packets", "bytes", "brokenPkts"]
SIP_GAUGES = ["request", "response", *[m.lower() for m in METHODS], *[f"status_{n}xx" for n in range(1, 7)], "malformed"]


def all_counts(packets: DataFrame) -> DataFrame:
    """All counters per second and channel, in one pass over the packets and one shuffle.

    Packets that do not reach the parser are counted as broken and parsed as if they
    had no bytes.
    """
    reason = reject_reason()
    tagged = packets.select("timestamp_ns", channel().alias("sensor"), "len", "payload_offset", reason.isNotNull().alias("broken"), F.when(reason.isNull(), F.col("pkt_hex")).alias("pkt_hex"))
    checked = with_malformed(parse(tagged))
    code, good = F.col("response_code"), ~F.col("broken")
    tests = {"brokenPkts": F.col("broken"), "request": message_kind() == "request", "response": message_kind() == "response", "malformed": F.col("malformed") == 1}
    tests |= {name.lower(): F.col("request_method") == name for name in METHODS}
    tests |= {f"status_{n}xx": code.between(n * 100, n * 100 + 99) for n in range(1, 7)}
    second = F.date_trunc("second", ns_to_timestamp(F.col("timestamp_ns")))
    return checked.groupBy(second.alias("ts"), "sensor").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.col("len") + FRAMING_BYTES).cast("bigint").alias("bytes"),
        *[F.count_if(test if name == "brokenPkts" else good & test).alias(name) for name, test in tests.items()],
    )


def all_gauges(packets: DataFrame) -> DataFrame:
    """METRIC rows of all running counters: ``capture.*`` of the transport, ``sip_stat.*`` of the messages."""
    wide = running(all_counts(packets), TRAFFIC_GAUGES + SIP_GAUGES)
    names = {**{v: f"capture.{v}" for v in TRAFFIC_GAUGES}, **{v: f"sip_stat.{v}" for v in SIP_GAUGES}}
    renamed = wide.select("ts", "sensor", *[F.col(v).cast("double").alias(name) for v, name in names.items()])
    long = renamed.unpivot(["ts", "sensor"], [F.col(f"`{name}`") for name in names.values()], "metric", "value")
    return long.select("ts", "metric", "sensor", "value")


def wait_sketches(packets: DataFrame, interval: str = "1 minute") -> DataFrame:
    """Per interval and channel a quantile sketch of the waits between the packets of a conversation, in microseconds.

    Sketches of parts are put together by ``kll_merge_agg_bigint``, so timings of any
    longer time, or of streams, need no second look at the packets.
    """
    key = symmetric_flow(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    return waits(packets, key).groupBy(F.window("ts", interval).start.alias("ts"), "sensor").agg(
        F.count(F.lit(1)).alias("waits"), F.kll_sketch_agg_bigint("wait").alias("sketch")
    )


def waits(packets: DataFrame, key: Column) -> DataFrame:
    """ts, sensor and wait of each packet but the first of its conversation.

    Rows are taken by conversation and day, so a conversation that never ends is split.
    The wait across midnight is not among them.
    """
    at = ns_to_timestamp(F.col("timestamp_ns"))
    timed = packets.select(key.alias("flow"), at.alias("ts"), channel().alias("sensor"), F.unix_micros(at).alias("at"))
    before = F.lag("at").over(W.partitionBy("flow", F.to_date("ts")).orderBy("at"))
    return timed.withColumn("wait", F.col("at") - before).where(F.col("wait").isNotNull()).select("ts", "sensor", "wait")


def wait_quantiles(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """METRIC rows of the quantiles of each channel over all intervals of the sketches."""
    merged = sketches.groupBy("sensor").agg(F.min("ts").alias("ts"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    wide = merged.select("ts", "sensor", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(r)).cast("double").alias(f"timing.wait_p{round(r * 100)}") for r in ranks])
    names = [f"timing.wait_p{round(r * 100)}" for r in ranks]
    long = wide.unpivot(["ts", "sensor"], [F.col(f"`{n}`") for n in names], "metric", "value")
    return long.select("ts", "metric", "sensor", "value")


def flush(metrics: DataFrame, interval: str = "60 seconds") -> DataFrame:
    """Last value of each gauge per interval."""
    return (
        metrics.groupBy(F.window("ts", interval).alias("w"), "metric", "sensor")
        .agg(F.max_by("value", "ts").alias("value"))
        .select(F.col("w.start").alias("ts"), "metric", "sensor", "value")
    )


def sampled(rows: DataFrame, rate: float = 0.1, key: str = "id") -> DataFrame:
    """A share ``rate`` of the rows, the same ones on every run."""
    spread = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return rows.where(spread < int(rate * 4294967296))
