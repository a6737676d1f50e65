"""Checksums: retransmission key and endpoint colour."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: colours per palette
PALETTE_SIZE = 1000


def message_checksum(null_collapses: bool = False) -> Column:
    """SHA-1 over addresses, parties and text of a capture row.

    A missing port counts as ``0``. Any other missing part counts as empty text,
    or with ``null_collapses`` makes the checksum NULL.
    """
    parts = ["from", "to", "source_ip", "source_port", "destination_ip", "destination_port", "msg"]
    pieces = []
    for name in parts:
        piece = F.col(f"`{name}`").cast("string")
        if name.endswith("_port"):
            piece = F.coalesce(piece, F.lit("0"))
        elif not null_collapses:
            piece = F.coalesce(piece, F.lit(""))
        pieces.append(piece)
    return F.sha1(F.concat(*pieces))


def signed_crc32(text: Column) -> Column:
    """CRC-32 read as a signed 32-bit number."""
    crc = F.crc32(F.encode(text, "UTF-8"))
    return F.when(crc >= 2147483648, crc - 4294967296).otherwise(crc)


def colour_bucket(source: Column, destination: Column) -> Column:
    """Palette position of a pair of endpoints."""
    return F.pmod(signed_crc32(F.trim(F.concat(source, F.lit(" "), destination))), F.lit(PALETTE_SIZE))


def palette(malformed: Column) -> Column:
    return F.when(malformed == 1, "malformed").otherwise("ordinary")
