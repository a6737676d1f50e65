"""IPv4 and endpoint expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_text(ip: Column) -> Column:
    """Dotted text of an unsigned 32-bit address; NULL outside that range."""
    octets = [F.shiftright(ip, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)]
    return F.when(ip.between(0, 4294967295), F.concat_ws(".", *octets))


# fixed value: a number from 0 to 255, leading zeros allowed
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def ip_number(text: Column) -> Column:
    """Address of a dotted quad as a number; NULL for anything else."""
    parts = [F.split_part(text, F.lit("."), F.lit(i)).cast("bigint") for i in (1, 2, 3, 4)]
    value = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    # the test keeps the casts away from text that holds no numbers
    return F.when(text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), value)


def ip_literal(text: str) -> int | None:
    """The same conversion for one search argument, so the filter stays on the raw column."""
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        return None
    a, b, c, d = (int(p) for p in parts)
    return (a << 24) + (b << 16) + (c << 8) + d


def endpoint(ip: Column, port: Column) -> Column:
    """``a.b.c.d:port``; a missing port shows as 0, a missing address as NULL."""
    return F.concat(ip_text(ip), F.lit(":"), F.coalesce(port, F.lit(0)).cast("string"))


def symmetric_flow(ip_a: Column, port_a: Column, ip_b: Column, port_b: Column) -> Column:
    """One key for both directions of a conversation."""
    a, b = F.struct(ip_a.alias("ip"), port_a.alias("port")), F.struct(ip_b.alias("ip"), port_b.alias("port"))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
