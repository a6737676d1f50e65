"""Small frames for tests."""

from dialtrace import schemas


def packet(pkt_id: int, text: str | bytes, ts_ns: int = 1_700_000_000_000_000_000, **fields) -> tuple:
    data = text if isinstance(text, bytes) else text.encode()
    offset = fields.get("payload_offset", 42)
    values = {
        "pkt_id": pkt_id, "timestamp_ns": ts_ns, "src_ip": 167772161, "src_port": 1024, "dst_ip": 3232235777,
        "dst_port": 5060, "ip_version": 4, "payload_offset": offset, "len": offset + len(data),
        "pkt_hex": "00" * offset + data.hex(),
    }
    values.update(fields)
    return tuple(values[c] for c in schemas.columns(schemas.PACKET))


def packets(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PACKET)


def message(mid: int, second: float, callid: str | None, rc: str | None = None, **fields) -> tuple:
    from datetime import datetime, timedelta, timezone

    values = {
        "id": mid, "datetime": datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second),
        "from": "650", "to": "408", "callid": callid, "callid_rc": rc, "user_agent": None, "request_method": "INVITE",
        "response_code": None, "source_ip": 167772161, "source_port": 5060, "destination_ip": 167772162,
        "destination_port": 5060, "malformed": 0, "msg": f"INVITE {mid}",
    }
    values.update(fields)
    return tuple(values[c] for c in schemas.columns(schemas.CAPTURE))


def capture(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schemas.CAPTURE).withColumn("date", F.to_date("datetime"))
