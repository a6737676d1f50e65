"""Queries that run a stream to the end of its input and read its output back."""

from pyspark.sql import functions as F

from dialtrace import maintenance, schemas
from dialtrace.operators.headers import parse
from dialtrace.operators.validate import accepted
from dialtrace.registry import inputs, oracle
from dialtrace.registry.base import query
from dialtrace.registry.counting import FLUSHED
from dialtrace.registry.flows import CHECKSUM
from dialtrace.registry.sources import METRICS, RUNNING, SECONDS, metric_path
from dialtrace.session import work_dir
from dialtrace.sources import tables
from dialtrace.streaming import ingest as stream
from dialtrace.streaming import metrics as stream_metrics


def _run(spark, name, start):
    """Runs a stream into a fresh folder and returns that folder."""
    path = work_dir(spark, name)
    start(path, work_dir(spark, f"{name}-checkpoint")).awaitTermination()
    return path


def _packets(spark, sf_dir, files_per_trigger=None):
    return tables.stream_packets(spark, inputs.packet_path(spark, sf_dir), files_per_trigger)


@query("stream_ingest", oracle.on("capture", "SELECT * FROM capture"))
def stream_ingest(spark, sf_dir):
    packets = _packets(spark, sf_dir)
    path = _run(spark, "stream-capture", lambda out, state: stream.ingest(packets, out, state))
    return tables.read_capture(spark, path).drop("date")


_FAULTY = """faulty AS (
  SELECT pkt_id, CASE WHEN payload_offset >= len2 THEN 'empty payload' WHEN ip_version <> 4 THEN 'not IPv4' WHEN length(pkt_hex) <> 2 * len2 THEN 'length mismatch' END AS reason,
    len2 AS len FROM (SELECT *, CAST(len + CASE WHEN pkt_id % 107 = 0 THEN 1 ELSE 0 END AS INTEGER) AS len2 FROM packets)
)"""


def _faulty_path(spark, sf_dir):
    """The packets, some of a length that does not agree with their bytes."""

    def write(path):
        wrong = inputs.packets(spark, sf_dir).withColumn("len", F.when(F.col("pkt_id") % 107 == 0, F.col("len") + 1).otherwise(F.col("len")))
        tables.write_packets(wrong, path)

    return inputs.stored(spark, sf_dir, "faulty-packets", write)


def _ingested(spark, sf_dir):
    def write(path):
        packets = tables.stream_packets(spark, _faulty_path(spark, sf_dir), 3)
        stream.ingest_all(packets, path, work_dir(spark, "ingest-all-checkpoint")).awaitTermination()

    return inputs.stored(spark, sf_dir, "ingest-all", write)


@query(
    "stream_capture_codecs_rejects",
    oracle.on(
        "sdp",
        """SELECT 'capture' AS stored_in, id, msg AS detail, malformed FROM capture WHERE id % 107 <> 0
        UNION ALL SELECT 'sdp', id, codec, NULL FROM sdp WHERE id % 107 <> 0
        UNION ALL SELECT 'rejects', pkt_id, reason, NULL FROM faulty WHERE reason IS NOT NULL""",
        _FAULTY,
    ),
)
def stream_capture_codecs_rejects(spark, sf_dir):
    """The three tables that one stream stores, next to one another."""
    path, none = _ingested(spark, sf_dir), F.lit(None).cast("int").alias("malformed")
    capture = stream.read_table(spark, path, "capture").select(F.lit("capture").alias("stored_in"), "id", F.col("msg").alias("detail"), "malformed")
    codecs = stream.read_table(spark, path, "sdp").select(F.lit("sdp").alias("stored_in"), "id", F.col("codec").alias("detail"), none)
    rejects = stream.read_table(spark, path, "rejects").select(F.lit("rejects").alias("stored_in"), F.col("pkt_id").alias("id"), F.col("reason").alias("detail"), none)
    return capture.unionByName(codecs).unionByName(rejects)


@query(
    "stream_tap",
    oracle.on(
        "capture",
        """SELECT CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS stored,
        CAST(count(reason) AS BIGINT) AS rejected, CAST((SELECT sum(malformed) FROM capture WHERE id % 107 <> 0) AS BIGINT) AS malformed FROM faulty""",
        _FAULTY,
    ),
)
def stream_tap(spark, sf_dir):
    """What came into the stream and what became of it, summed over its epochs."""
    account = stream.read_table(spark, _ingested(spark, sf_dir), "account")
    return account.agg(*[F.sum(c).alias(c) for c in ("packets", "bytes", "stored", "rejected", "malformed")])


@query(
    "stream_rate_limit",
    oracle.on("capture", "SELECT CAST(count(*) AS BIGINT) AS stored, CAST(sum(malformed) AS BIGINT) AS malformed FROM capture"),
)
def stream_rate_limit(spark, sf_dir):
    """Ingest in bounded micro-batches: slower input, nothing dropped."""

    limited = _packets(spark, sf_dir, files_per_trigger=3)
    path = _run(spark, "stream-limited", lambda out, state: stream.ingest(limited, out, state))
    return tables.read_capture(spark, path).agg(F.count(F.lit(1)).alias("stored"), F.sum("malformed").alias("malformed"))


def _counted(spark, name, packets):
    path = _run(spark, name, lambda out, state: stream_metrics.write_partials(packets, stream_metrics.second_counters, out, state))
    return stream_metrics.read_counters(spark, path)


def _newest_first(spark, sf_dir):
    """The packets in four quarters that arrive in reverse order of time, about one in each micro-batch."""

    def write(path):
        ordered = inputs.packets(spark, sf_dir)
        cuts = ordered.select(F.percentile_approx("timestamp_ns", [0.25, 0.5, 0.75]).alias("cuts")).first()["cuts"]
        for low, high in reversed(list(zip([0, *cuts], [*cuts, 2**63 - 1], strict=True))):
            quarter = ordered.where((F.col("timestamp_ns") >= low) & (F.col("timestamp_ns") < high))
            quarter.repartitionByRange(2, "timestamp_ns").write.mode("append").parquet(path)

    return tables.stream_packets(spark, inputs.stored(spark, sf_dir, "newest-first", write), 2)


@query("stream_late_counters", oracle.on("packets", "SELECT ts, sensor, packets, bytes FROM seconds", SECONDS))
def stream_late_counters(spark, sf_dir):
    return _counted(spark, "stream-late-seconds", _newest_first(spark, sf_dir))


@query(
    "stream_late_dedup",
    oracle.on("capture", f'SELECT DISTINCT {CHECKSUM} AS chsumm, "from" AS from_user, callid, msg FROM capture'),
)
def stream_late_dedup(spark, sf_dir):
    return _deduplicated(spark, "stream-late-dedup", _newest_first(spark, sf_dir))


@query("stream_second_counters", oracle.on("packets", "SELECT ts, sensor, packets, bytes FROM seconds", SECONDS))
def stream_second_counters(spark, sf_dir):
    return _counted(spark, "stream-seconds", _packets(spark, sf_dir))


@query(
    "stream_gauge_flush",
    oracle.on("packets", "SELECT ts, metric, sensor, value FROM flushed", SECONDS, RUNNING, METRICS, FLUSHED),
)
def stream_gauge_flush(spark, sf_dir):
    gauges = spark.readStream.schema(schemas.METRIC).parquet(metric_path(spark, sf_dir))
    path = _run(spark, "stream-gauges", lambda out, state: stream_metrics.write_partials(gauges, stream_metrics.last_gauges, out, state))
    return stream_metrics.read_gauges(spark, path)


@query(
    "stream_dedup",
    oracle.on("capture", f'SELECT DISTINCT {CHECKSUM} AS chsumm, "from" AS from_user, callid, msg FROM capture'),
)
def stream_dedup(spark, sf_dir):
    """Which copy stays depends on arrival, so only what the copies share is shown."""

    return _deduplicated(spark, "stream-dedup", _packets(spark, sf_dir))


def _deduplicated(spark, name, packets):
    path = _run(spark, name, lambda out, state: stream.ingest_deduplicated(packets, out, state))
    return stream.read_deduplicated(spark, path).select("chsumm", F.col("`from`").alias("from_user"), "callid", "msg")


@query(
    "traffic_tap",
    oracle.on("decoded", "SELECT CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes FROM accepted"),
)
def traffic_tap(spark, sf_dir):
    """Counts taken on the way of the packets to the published form."""
    tapped, seen = stream_metrics.tap(accepted(inputs.packets(spark, sf_dir)))
    parse(tapped).select("pkt_id", "callid").write.mode("overwrite").parquet(work_dir(spark, "tapped"))
    return spark.createDataFrame([(seen.get["packets"], seen.get["bytes"])], "packets BIGINT, bytes BIGINT")


@query(
    "retention",
    oracle.on("capture", "SELECT id, datetime FROM capture WHERE datetime > (SELECT max(datetime) FROM capture) - INTERVAL 1 DAY"),
)
def retention(spark, sf_dir):
    return maintenance.unexpired(inputs.capture(spark, sf_dir)).select("id", "datetime")


def _table(spark, sf_dir, name):
    """A catalog table of the capture rows, in a database of its own below the working folder."""
    location = work_dir(spark, name)
    database = "dialtrace_" + location.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{location}'")
    maintenance.create_capture_table(spark, f"{database}.{name}", inputs.capture(spark, sf_dir))
    return f"{database}.{name}"


@query(
    "drop_expired_days",
    oracle.on(
        "capture",
        """SELECT CAST(datetime AS DATE) AS date, CAST(count(*) AS BIGINT) AS stored FROM capture
        WHERE CAST(datetime AS DATE) >= CAST(TIMESTAMP '2024-01-16 12:00:00' - INTERVAL 1 DAY AS DATE) GROUP BY 1""",
    ),
)
def drop_expired_days(spark, sf_dir):
    table = _table(spark, sf_dir, "expiring")
    maintenance.drop_expired_days(spark, table, "2024-01-16 12:00:00")
    return spark.table(table).groupBy("date").agg(F.count(F.lit(1)).alias("stored"))


@query(
    "delete_expired",
    oracle.on("capture", "SELECT id, datetime FROM capture WHERE datetime > TIMESTAMP '2024-01-16 12:00:00' - INTERVAL 1 DAY"),
)
def delete_expired(spark, sf_dir):
    """What is left in the table after whole days are dropped and the border day is written anew."""
    table = _table(spark, sf_dir, "retained")
    maintenance.delete_expired(spark, table, "2024-01-16 12:00:00")
    return spark.table(table).select("id", "datetime")


_MEASURED = ["id", "source_ip", "source_port", "destination_ip", "destination_port", "response_code", "malformed"]


@query(
    "table_statistics",
    oracle.on(
        "capture",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max,
        (count(*) - count({c}))::VARCHAR AS num_nulls FROM capture"""
            for c in _MEASURED
        ),
    ),
)
def table_statistics(spark, sf_dir):
    table = _table(spark, sf_dir, "analysed")
    maintenance.refresh_statistics(spark, table)
    rows = []
    for column in _MEASURED:
        found = maintenance.column_statistics(spark, table, column)
        rows.append((column, found["min"], found["max"], found["num_nulls"]))
    return spark.createDataFrame(rows, "column_name STRING, min STRING, max STRING, num_nulls STRING")
