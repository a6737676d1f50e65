"""Text expressions: bytes, escapes, emptiness tests, display forms."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload_bytes(pkt_hex: Column, payload_offset: Column) -> Column:
    """Payload of a hex-coded packet."""
    return F.unhex(F.substr(pkt_hex, payload_offset * 2 + 1))


def hex_text(data: Column) -> Column:
    """Lower-case hex form of binary data."""
    return F.lower(F.hex(data))


def printable(text: Column) -> Column:
    """Drop every character outside printable ASCII and ASCII white space."""
    return F.regexp_replace(text, r"[^\x20-\x7E\t\n\x0B\x0C\r]", "")


def empty_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def blank(text: Column) -> Column:
    """True for NULL or empty text."""
    return text.isNull() | (text == "")


def all_digits(text: Column) -> Column:
    return (text != "") & (F.translate(text, "0123456789", "") == "")


def digits_exceed(text: Column, limit: int) -> Column:
    """Whether a run of digits, however long, is a number above ``limit``.

    Padded to one length, digits compare as text; a longer run loses its tail, but
    its first digit already decides.
    """
    width = len(str(limit)) + 1
    padded = F.lpad(F.ltrim(text, F.lit("0")), width, "0")
    return all_digits(text) & (padded > str(limit).zfill(width))


def html_escape(text: Column) -> Column:
    """The five HTML entities; the ampersand goes first."""
    # fixed values
    entities = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;"))
    for char, entity in entities:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def ascii_html(text: Column) -> Column:
    """Three HTML entities, and a numeric reference for every non-ASCII character."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    spelled = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(F.ascii(c) < 128, c).otherwise(
                F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))
            ),
        ),
        "",
    )
    # plain ASCII, by far the usual case, skips the per-character work
    return F.when(text.rlike(r"[^\x00-\x7F]"), spelled).otherwise(text)


def first_line(text: Column) -> Column:
    return F.substring_index(F.substring_index(text, "\n", 1), "\r", 1)


def message_label(method: Column, code: Column) -> Column:
    """Request method or response code of a message."""
    return F.concat(F.coalesce(method, F.lit("")), F.coalesce(code.cast("string"), F.lit("")))


def flow_note(msg: Column) -> Column:
    """First line of a message as shown next to its arrow."""
    return F.trim(F.replace(html_escape(first_line(F.coalesce(msg, F.lit("")))), F.lit("SIP/2.0"), F.lit("")))
