"""Capture savefiles: a data source writer and a two-step parallel scan.

The savefile layout is sequential, so Python reads and writes the framing; the
headers inside a frame are built and taken apart by Spark expressions.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from dialtrace.operators.ranking import numbered
from dialtrace.session import keep

# fixed values: savefile layout
MAGIC_MICRO = 0xA1B2C3D4
MAGIC_NANO = 0xA1B23C4D
VERSION = (2, 4)
SNAPLEN = 16384
# no record is longer than this in a sound file; the header's length is only what was asked for
MOST_RECORD = 1 << 20
LINKTYPE_ETHERNET = 1
FILE_HEADER = 24
RECORD_HEADER = 16


def _open_fs(path: str):
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, inner


def _local_uri(path: str) -> str:
    # Spark lists local files as file:/x, Arrow wants file:///x
    return "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path


# ---------------------------------------------------------------- frame bytes


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.hex(number.cast("bigint")), digits, "0")


def _little_endian(number: Column) -> Column:
    text = _hex(number, 8)
    return F.concat(*[F.substring(text, start, 2) for start in (7, 5, 3, 1)])


def _checksum(words: list[Column]) -> Column:
    """One's complement sum of 16-bit words."""
    total = words[0]
    for word in words[1:]:
        total = total + word
    for _ in range(2):
        total = total.bitwiseAND(0xFFFF) + F.shiftright(total, 16)
    return F.lit(0xFFFF) - total


def ethernet_frame() -> Column:
    """Hex of an Ethernet, IP and UDP frame around the payload of a packet row.

    IPv6 rows carry their addresses in mapped form.
    """
    payload = F.substr(F.col("pkt_hex"), F.col("payload_offset") * 2 + 1)
    size = F.call_function("div", F.length(payload), F.lit(2))
    src, dst = F.col("src_ip"), F.col("dst_ip")
    udp = F.concat(_hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4), _hex(size + 8, 4), F.lit("0000"))
    words = [
        F.lit(0x4500).cast("bigint"), size + 28, F.lit(0x4000), F.lit(0x4011),
        F.shiftright(src, 16), src.bitwiseAND(0xFFFF), F.shiftright(dst, 16), dst.bitwiseAND(0xFFFF),
    ]
    ipv4 = F.concat(
        F.lit("4500"), _hex(size + 28, 4), F.lit("000040004011"), _hex(_checksum(words), 4), _hex(src, 8), _hex(dst, 8)
    )
    mapped = "00000000000000000000FFFF"
    ipv6 = F.concat(
        F.lit("60000000"), _hex(size + 8, 4), F.lit("1140"), F.lit(mapped), _hex(src, 8), F.lit(mapped), _hex(dst, 8)
    )
    four = F.col("ip_version") == 4
    ethernet = F.concat(F.lit("00" * 12), F.when(four, "0800").otherwise("86DD"))
    return F.concat(ethernet, F.when(four, ipv4).otherwise(ipv6), udp, payload)


def savefile_records(packets: DataFrame) -> DataFrame:
    """One binary savefile record per packet, with its whole frame."""
    framed = packets.withColumn("frame", ethernet_frame()).withColumn(
        "size", F.call_function("div", F.length("frame"), F.lit(2))
    )
    second = F.call_function("div", F.col("timestamp_ns"), F.lit(1000000000))
    record = F.concat(
        _little_endian(second),
        _little_endian(F.col("timestamp_ns") % 1000000000),
        _little_endian(F.col("size")),
        _little_endian(F.col("size")),
        F.col("frame"),
    )
    return framed.select(F.unhex(record).alias("record"))


# ---------------------------------------------------------------- writer


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class SavefileSource(DataSource):
    """``df.write.format("savefile").save(path)`` for a single binary ``record`` column."""

    @classmethod
    def name(cls) -> str:
        return "savefile"

    def writer(self, schema, overwrite):
        return _SavefileWriter(self.options["path"])


class _SavefileWriter(DataSourceArrowWriter):
    """One file per task, written aside and moved in place when the job commits.

    A task that is repeated after the loss of an executor writes another file, and
    only the files of the committed attempts are moved.
    """

    def __init__(self, path: str):
        self.path = _local_uri(path)
        self.staging = f"{self.path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, batches) -> WriterCommitMessage:
        name, out = f"part-{uuid.uuid4().hex}.pcap", None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                fs, inner = _open_fs(self.staging)
                fs.create_dir(inner, recursive=True)
                out = fs.open_output_stream(f"{inner}/{name}")
                out.write(struct.pack("<IHHiIII", MAGIC_NANO, *VERSION, 0, 0, SNAPLEN, LINKTYPE_ETHERNET))
            for record in batch.column(0):
                out.write(record.as_py())
        if out is None:
            return _Written(None)
        out.close()
        return _Written(name)

    def commit(self, messages) -> None:
        fs, staging = _open_fs(self.staging)
        _, target = _open_fs(self.path)
        for message in messages:
            if message is not None and message.name:
                fs.move(f"{staging}/{message.name}", f"{target.rstrip('/')}/{message.name}")

    def abort(self, messages) -> None:
        """Files left aside start with an underscore in their folder and are never read."""


def write_savefiles(packets: DataFrame, path: str) -> None:
    """Appends the packets as nanosecond savefiles, one per task."""
    packets.sparkSession.dataSource.register(SavefileSource)
    savefile_records(packets).write.format("savefile").mode("append").save(path)


# ---------------------------------------------------------------- scan


def _layout(header: bytes) -> tuple[str, bool]:
    """Byte order and whether fractions are nanoseconds, from the magic number."""
    for order in "<>":
        magic = struct.unpack(f"{order}I", header[:4])[0]
        if magic in (MAGIC_MICRO, MAGIC_NANO):
            return order, magic == MAGIC_NANO
    raise ValueError("not a capture savefile")


def _index(split_bytes: int):
    """Finds record boundaries: one row per run of records of about ``split_bytes``.

    A run has the number of its records and their least and greatest time. What cannot
    be read gives a row with a reason: a file of another kind or link type, and the
    bytes from a record on that is cut or has an impossible length.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                rows = []
                fs, inner = _open_fs(_local_uri(path))
                with fs.open_input_stream(inner, buffer_size=1 << 20) as source:
                    head = source.read(FILE_HEADER)
                    try:
                        order, nano = _layout(head)
                        link = struct.unpack(f"{order}I", head[20:24])[0] & 0xFFFF
                        reason = None if link == LINKTYPE_ETHERNET else f"link type {link}"
                    except (ValueError, struct.error):
                        order, nano, reason = "<", False, "not a capture savefile"
                    start = position = FILE_HEADER if reason is None else 0
                    scale = 1 if nano else 1000
                    records, least, most = 0, None, None
                    while reason is None and (header := source.read(RECORD_HEADER)):
                        second, fraction, kept = struct.unpack(f"{order}III", header[:12]) if len(header) == RECORD_HEADER else (0, 0, 0)
                        if kept > MOST_RECORD:
                            reason = "impossible record length"
                        elif len(header) < RECORD_HEADER or len(source.read(kept)) < kept:
                            reason = "cut record"
                        else:
                            position += RECORD_HEADER + kept
                            records, at = records + 1, second * 1_000_000_000 + fraction * scale
                            least, most = (at, at) if least is None else (min(least, at), max(most, at))
                        if position - start >= split_bytes:
                            rows.append((path, start, position, order, nano, None, records, least, most))
                            start, records, least, most = position, 0, None, None
                    if position > start:
                        rows.append((path, start, position, order, nano, None, records, least, most))
                    if reason is not None:
                        rows.append((path, position, None, order, nano, reason, 0, None, None))
                columns = ["path", "start", "end", "byte_order", "nano", "reason", "records", "least_ns", "most_ns"]
                yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("end", "least_ns", "most_ns")})

    return run


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of the given runs, numbered from ``first_id``; each run is read at once, its size is bounded."""
    columns = ["pkt_id", "timestamp_ns", "len", "frame"]
    for frame in frames:
        for run in frame.itertuples(index=False):
            fs, inner = _open_fs(_local_uri(run.path))
            with fs.open_input_file(inner) as source:
                data = source.read_at(run.end - run.start, run.start)
            header = struct.Struct(f"{run.byte_order}IIII")
            scale = 1 if run.nano else 1000
            rows, held, at, number = [], 0, 0, run.first_id
            while at + RECORD_HEADER <= len(data):
                second, fraction, kept, size = header.unpack_from(data, at)
                at += RECORD_HEADER
                rows.append((number, second * 1_000_000_000 + fraction * scale, size, data[at : at + kept]))
                at += kept
                number += 1
                held += kept
                if held >= 4 << 20:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def _number(text: Column, byte: Column | int, size: int) -> Column:
    """Big-endian number of ``size`` bytes at a byte offset of a hex text."""
    start = (F.lit(byte) if isinstance(byte, int) else byte) * 2 + 1
    return F.conv(F.substr(text, start, F.lit(size * 2)), 16, 10).cast("bigint")


def packet_columns(frames: DataFrame) -> DataFrame:
    """PACKET columns of numbered Ethernet frames that carry UDP or TCP over IP.

    A frame without IP gets version 0, so that the IPv4 test drops it.
    """
    hexed = frames.select("pkt_id", "timestamp_ns", F.col("len").cast("int").alias("len"), F.lower(F.hex("frame")).alias("pkt_hex"))
    text = F.col("pkt_hex")
    tagged = F.substring(text, 25, 4) == "8100"
    at_ip = hexed.withColumn("_ip", F.when(tagged, 18).otherwise(14))
    ip = F.col("_ip")
    carries_ip = F.substr(text, ip * 2 - 3, F.lit(4)).isin("0800", "86dd")
    version = F.when(carries_ip, F.shiftright(_number(text, ip, 1), 4).cast("int")).otherwise(0)
    sized = at_ip.withColumn("ip_version", version).withColumns(
        {
            "_l4": F.when(F.col("ip_version") == 4, ip + _number(text, ip, 1).bitwiseAND(15).cast("int") * 4).otherwise(ip + 40),
            "_protocol": F.when(F.col("ip_version") == 4, _number(text, ip + 9, 1)).otherwise(_number(text, ip + 6, 1)),
        }
    )
    l4, four = F.col("_l4"), F.col("ip_version") == 4
    tcp_header = F.shiftright(_number(text, l4 + 12, 1), 4).cast("int") * 4
    return sized.select(
        "pkt_id",
        "timestamp_ns",
        F.when(four, _number(text, ip + 12, 4)).alias("src_ip"),
        _number(text, l4, 2).cast("int").alias("src_port"),
        F.when(four, _number(text, ip + 16, 4)).alias("dst_ip"),
        _number(text, l4 + 2, 2).cast("int").alias("dst_port"),
        "ip_version",
        (l4 + F.when(F.col("_protocol") == 6, tcp_header).otherwise(8)).alias("payload_offset"),
        "len",
        "pkt_hex",
    )


_RUN = "path string, start long, end long, byte_order string, nano boolean, reason string, records long, least_ns long, most_ns long"


def _runs(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(_index(split_bytes), _RUN)


def _packets(runs: DataFrame) -> DataFrame:
    spread = runs.select("path", "start", "end", "byte_order", "nano", "first_id").repartition(runs.sparkSession.sparkContext.defaultParallelism, "path", "start")
    return packet_columns(spread.mapInPandas(_decode, "pkt_id long, timestamp_ns long, len long, frame binary"))


def read_savefiles(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """PACKET rows, without an id, of the savefiles in a folder, whatever their names.

    A first pass reads record headers only as far as memory goes and cuts each file
    into runs; the runs are spread over the cluster and decoded. So a single large
    file is decoded by many tasks. ``savefile_rejects`` lists what cannot be read.
    """
    runs = _runs(spark, path, split_bytes).where("reason IS NULL")
    return _packets(runs.withColumn("first_id", F.lit(0).cast("bigint"))).drop("pkt_id")


def index_savefiles(spark: SparkSession, path: str, first_id: int = 1, split_bytes: int = 64 << 20) -> DataFrame:
    """The runs of the savefiles in a folder, one row each, for ``indexed_packets``.

    ``first_id`` of a run is the id of its first packet. Ids count the packets in order
    of file name and place in the file, without gaps, and depend on the files alone, not
    on the size of runs. ``least_ns`` and ``most_ns`` are the times of a run. The index
    is stored, so the files are gone through once, however often they are read after.
    """
    runs = _runs(spark, path, split_bytes).where("reason IS NULL").drop("reason")
    placed = numbered(runs, ["path", "start"], "first_id", first_id, F.col("records"))
    return keep(placed, "savefile-index")


def runs_between(index: DataFrame, since_ns: int | None = None, until_ns: int | None = None) -> DataFrame:
    """The runs that may hold a packet at ``since_ns`` or later and at ``until_ns`` or earlier."""
    after = F.lit(True) if since_ns is None else F.col("most_ns") >= since_ns
    return index.where(after if until_ns is None else after & (F.col("least_ns") <= until_ns))


def indexed_packets(index: DataFrame, since_ns: int | None = None, until_ns: int | None = None) -> DataFrame:
    """PACKET rows of an index of savefiles, both limits of time included.

    Only runs with packets of that time are read. A packet has the same id whatever
    the limits are.
    """
    found = _packets(runs_between(index, since_ns, until_ns))
    if since_ns is not None:
        found = found.where(F.col("timestamp_ns") >= since_ns)
    return found if until_ns is None else found.where(F.col("timestamp_ns") <= until_ns)


def savefile_rejects(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """path, offset and reason of each part of the files that ``read_savefiles`` cannot read."""
    return _runs(spark, path, split_bytes).where("reason IS NOT NULL").select("path", F.col("start").alias("offset"), "reason")
