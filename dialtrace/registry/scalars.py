"""Queries for scalar functions."""

from pyspark.sql import functions as F

from dialtrace.functions import net, text, time
from dialtrace.registry import inputs, oracle
from dialtrace.registry.base import query
from dialtrace.registry.headers import parsed


@query("ipv4_number", oracle.on("capture", "SELECT id, source_ip AS source, CAST(NULL AS BIGINT) AS overflow, CAST(NULL AS BIGINT) AS words FROM capture"))
def ipv4_number(spark, sf_dir):
    """Dotted text back to numbers; an octet too large and other text give NULL."""
    rows = inputs.capture(spark, sf_dir).select(
        "id", "request_method", net.ip_text(F.col("source_ip")).alias("dotted")
    )
    return rows.select(
        "id",
        net.ip_number(F.col("dotted")).alias("source"),
        net.ip_number(F.regexp_replace("dotted", "^[0-9]+", "256")).alias("overflow"),
        net.ip_number(F.coalesce("request_method", F.lit("response"))).alias("words"),
    )


@query(
    "html_escape",
    oracle.on(
        "capture",
        """SELECT id, replace(replace(replace(replace(replace(msg, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '"', '&quot;') AS escaped FROM capture""",
    ),
)
def html_escape(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select("id", text.html_escape(F.col("msg")).alias("escaped"))


@query(
    "ascii_html",
    oracle.on(
        "capture",
        "SELECT id, replace(replace(replace(replace(msg, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(65533), '&#65533;') AS escaped FROM capture",
    ),
)
def ascii_html(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select("id", text.ascii_html(F.col("msg")).alias("escaped"))


@query("json_round_trip", oracle.on("capture", "SELECT id, to_json({'msg': msg, 'callid': callid})::VARCHAR AS encoded, msg AS decoded FROM capture"))
def json_round_trip(spark, sf_dir):
    encoded = F.to_json(F.struct("msg", "callid"), {"ignoreNullFields": "false"})
    df = inputs.capture(spark, sf_dir).select("id", encoded.alias("encoded"))
    return df.withColumn("decoded", F.from_json("encoded", "msg STRING, callid STRING")["msg"])


@query(
    "text_tests",
    oracle.on(
        "parsed",
        """SELECT pkt_id, trim(' ' || coalesce(maxfwd, '') || ' ') AS trimmed, maxfwd IS NULL OR maxfwd = '' AS is_blank,
        regexp_full_match(maxfwd, '[0-9]+') AS is_number, regexp_full_match(cseq_method, '[0-9]+') AS verb_is_number FROM parsed""",
    ),
)
def text_tests(spark, sf_dir):
    maxfwd = F.col("maxfwd")
    return parsed(spark, sf_dir).select(
        "pkt_id",
        F.trim(F.concat(F.lit(" "), F.coalesce(maxfwd, F.lit("")), F.lit(" "))).alias("trimmed"),
        text.blank(maxfwd).alias("is_blank"),
        text.all_digits(maxfwd).alias("is_number"),
        text.all_digits(F.col("cseq.method")).alias("verb_is_number"),
    )


@query(
    "null_handling",
    oracle.on(
        "capture",
        """SELECT id, coalesce(callid_rc, callid, '') AS session, CASE WHEN response_code IS NULL THEN 0 ELSE response_code END AS code,
        "from" || '/' || callid AS joined FROM capture""",
    ),
)
def null_handling(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select(
        "id",
        F.coalesce("callid_rc", "callid", F.lit("")).alias("session"),
        F.ifnull("response_code", F.lit(0)).alias("code"),
        F.concat(F.col("`from`"), F.lit("/"), "callid").alias("joined"),
    )


@query(
    "hours_before",
    oracle.on("capture", "SELECT id, strftime(datetime - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS start FROM capture"),
)
def hours_before(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select("id", time.hours_before(F.col("datetime"), 1).alias("start"))


@query(
    "micros_between",
    oracle.on("capture", "SELECT id, epoch_us(datetime) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS micros FROM capture"),
)
def micros_between(spark, sf_dir):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return inputs.capture(spark, sf_dir).select("id", time.micros_between(start, F.col("datetime")).alias("micros"))


@query(
    "grid_date",
    oracle.on("capture", "SELECT id, strftime(to_timestamp(floor((epoch_us(datetime) + 500000) / 1000000.0)) AT TIME ZONE 'UTC', '%Y-%b-%d %H:%M') AS shown FROM capture"),
)
def grid_date(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select("id", time.grid_date(time.epoch_seconds(F.col("datetime"))).alias("shown"))
