import struct

import pytest
from pyspark.sql import functions as F

from dialtrace import schemas
from dialtrace.plans.ingest import to_capture
from dialtrace.session import work_dir
from dialtrace.sources import pcap
from tests import make

COLUMNS = ["timestamp_ns", "src_ip", "src_port", "dst_ip", "dst_port", "payload"]


def with_payload(df):
    return df.withColumn("payload", F.substr("pkt_hex", F.col("payload_offset") * 2 + 1)).select(*COLUMNS)


def test_round_trip(spark, packets):
    path = work_dir(spark, "pcap")
    four = packets.where("ip_version = 4")
    pcap.write_savefiles(four, path)
    back = pcap.read_savefiles(spark, path)
    assert with_payload(back).exceptAll(with_payload(four)).count() == 0
    assert back.count() == four.count()


def test_appending_twice_keeps_both(spark, packets):
    path = work_dir(spark, "pcap")
    pcap.write_savefiles(packets, path)
    pcap.write_savefiles(packets, path)
    assert pcap.read_savefiles(spark, path).count() == 2 * packets.count()


def test_small_runs_give_the_same_packets(spark, packets):
    path = work_dir(spark, "pcap")
    pcap.write_savefiles(packets.coalesce(1), path)
    whole = with_payload(pcap.read_savefiles(spark, path))
    pieces = with_payload(pcap.read_savefiles(spark, path, split_bytes=2000))
    assert whole.exceptAll(pieces).count() == 0 and whole.count() == pieces.count() == packets.count()


def test_long_frames_stay_whole(spark):
    path = work_dir(spark, "pcap")
    pcap.write_savefiles(make.packets(spark, make.packet(1, "x" * 20_000)), path)
    row = pcap.read_savefiles(spark, path).first()
    assert row["len"] == 42 + 20_000
    assert len(row["pkt_hex"]) == 2 * (42 + 20_000)


def test_what_cannot_be_read_is_listed(spark, tmp_path):
    head = lambda link: struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    whole = struct.pack("<IIII", 1, 0, len(frame()), len(frame())) + frame()
    (tmp_path / "dump.out").write_bytes(head(1) + whole + whole[:-3])
    (tmp_path / "cooked").write_bytes(head(113) + whole)
    (tmp_path / "damaged.pcap").write_bytes(head(1) + whole + struct.pack("<IIII", 1, 0, 2**31, 2**31) + b"zz")
    (tmp_path / "notes.txt").write_bytes(b"hello")
    assert pcap.read_savefiles(spark, str(tmp_path)).count() == 2
    found = {(r["path"].rsplit("/", 1)[1], r["offset"], r["reason"]) for r in pcap.savefile_rejects(spark, str(tmp_path)).collect()}
    at = 24 + len(whole)
    assert found == {("dump.out", at, "cut record"), ("cooked", 0, "link type 113"), ("damaged.pcap", at, "impossible record length"), ("notes.txt", 0, "not a capture savefile")}


def frame(vlan=False, options=b"", protocol=17, ethertype=b"\x08\x00", payload=b"hello"):
    ip = bytes([0x40 | (5 + len(options) // 4), 0, 0, 0, 0, 0, 0, 0, 64, protocol, 0, 0, 10, 0, 0, 1, 192, 168, 1, 1]) + options
    l4 = struct.pack(">HHHH", 5060, 5070, 13, 0)
    if protocol == 6:
        l4 = struct.pack(">HHIIBBHHH", 5060, 5070, 0, 0, 0x60, 0, 0, 0, 0) + b"\x00" * 4
    tag = b"\x81\x00\x00\x05" if vlan else b""
    return b"\x00" * 12 + tag + ethertype + ip + l4 + payload


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize(("magic", "scale"), [(pcap.MAGIC_MICRO, 1000), (pcap.MAGIC_NANO, 1)])
def test_foreign_files(spark, tmp_path, order, magic, scale):
    frames = [frame(), frame(vlan=True), frame(options=b"\x01" * 8), frame(protocol=6), frame(ethertype=b"\x08\x06")]
    data = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, body in enumerate(frames):
        data += struct.pack(f"{order}IIII", 1_700_000_000, i, len(body), len(body)) + body
    data += struct.pack(f"{order}IIII", 1_700_000_000, 9, 500, 500) + b"cut off"
    (tmp_path / "a.pcap").write_bytes(data)
    rows = pcap.read_savefiles(spark, str(tmp_path)).orderBy("timestamp_ns").collect()
    assert [r["timestamp_ns"] - 1_700_000_000_000_000_000 for r in rows] == [i * scale for i in range(5)]
    for r in rows[:4]:
        assert (r["src_ip"], r["src_port"], r["dst_ip"], r["dst_port"], r["ip_version"]) == (167772161, 5060, 3232235777, 5070, 4)
        assert bytes.fromhex(r["pkt_hex"])[r["payload_offset"] :] == b"hello"
    assert rows[4]["ip_version"] == 0


def test_header_checksum(spark, packets):
    path = work_dir(spark, "pcap")
    pcap.write_savefiles(packets.where("ip_version = 4"), path)
    for row in pcap.read_savefiles(spark, path).collect():
        header = bytes.fromhex(row["pkt_hex"])[14:34]
        total = sum(struct.unpack(">10H", header))
        while total >> 16:
            total = (total & 0xFFFF) + (total >> 16)
        assert total == 0xFFFF


def times(spark, tmp_path, name, *seconds):
    data = struct.pack("<IHHiIII", pcap.MAGIC_NANO, 2, 4, 0, 0, 65535, 1)
    for second in seconds:
        data += struct.pack("<IIII", second, second, len(frame()), len(frame())) + frame()
    (tmp_path / name).write_bytes(data)


def test_ids_follow_the_files_whatever_the_runs(spark, tmp_path):
    times(spark, tmp_path, "b", *range(100, 140))
    times(spark, tmp_path, "a", *range(139, 99, -1))
    times(spark, tmp_path, "c")
    (tmp_path / "d").write_bytes(b"hello")
    expected = [(7 + i, s * 1_000_000_001) for i, s in enumerate([*range(139, 99, -1), *range(100, 140)])]
    for size in (1, 200, 1000, 64 << 20):
        index = pcap.index_savefiles(spark, str(tmp_path), first_id=7, split_bytes=size)
        assert sorted((r["pkt_id"], r["timestamp_ns"]) for r in pcap.indexed_packets(index).collect()) == expected


def test_limits_of_time_leave_runs_out_and_ids_as_they_are(spark, tmp_path):
    times(spark, tmp_path, "a", *range(100, 200))
    index = pcap.index_savefiles(spark, str(tmp_path), split_bytes=10 * (16 + len(frame())))
    assert index.count() == 10
    since, until = 120 * 1_000_000_001, 139 * 1_000_000_001
    assert pcap.runs_between(index, since, until).count() == 2
    assert pcap.runs_between(index, since).count() == 8
    assert pcap.runs_between(index, until_ns=until).count() == 4
    found = pcap.indexed_packets(index, since, until)
    assert found.columns == schemas.columns(schemas.PACKET)
    assert sorted(r["pkt_id"] for r in found.collect()) == list(range(21, 41))
    assert pcap.indexed_packets(index, since + 1, until - 1).count() == 18
    assert pcap.indexed_packets(index, until + 10**12).count() == 0


def test_packets_read_back_go_to_the_capture_table(spark, tmp_path):
    times(spark, tmp_path, "a", 1, 2, 3)
    rows = to_capture(pcap.indexed_packets(pcap.index_savefiles(spark, str(tmp_path)))).orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3] and {r["source_port"] for r in rows} == {5060}


def test_no_savefiles_have_no_packets(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    index = pcap.index_savefiles(spark, str(tmp_path))
    assert index.count() == 0 and pcap.indexed_packets(index).count() == 0
