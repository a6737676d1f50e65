"""Packet filters, search predicates and grid rules as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialtrace.functions.net import ip_literal

SIDES = {"src": ("src",), "dst": ("dst",), "either": ("src", "dst"), "both": ("src", "dst")}


def _on_sides(direction: str, field: str, test) -> Column:
    tests = [test(F.col(f"{side}_{field}")) for side in SIDES[direction]]
    return reduce(and_ if direction == "both" else or_, tests)


def _address(text: str) -> int:
    number = ip_literal(text)
    if number is None:
        raise ValueError(f"not an IPv4 address: {text}")
    return number


def host(address: str, direction: str = "either") -> Column:
    number = _address(address)
    return _on_sides(direction, "ip", lambda ip: ip == number)


def net(network: str, direction: str = "either", mask: str | None = None) -> Column:
    """Addresses of a network, as a range so that the test reaches the Parquet scan.

    ``a.b.c.d/len``, an address with a ``mask``, or one to four leading numbers that
    stand for 8 bits each.
    """
    address, _, bits = network.partition("/")
    parts = address.split(".")
    number = _address(".".join(parts + ["0"] * (4 - len(parts))))
    if mask:
        size = (1 << 32) - _address(mask)
        if size & (size - 1):
            raise ValueError(f"not a network mask: {mask}")
    else:
        size = 1 << (32 - (int(bits) if bits else 8 * len(parts)))
    first = number // size * size
    return _on_sides(direction, "ip", lambda ip: ip.between(first, first + size - 1))


def port(number: int, direction: str = "either") -> Column:
    return _on_sides(direction, "port", lambda p: p == number)


def port_range(low: int, high: int, direction: str = "either") -> Column:
    return _on_sides(direction, "port", lambda p: p.between(min(low, high), max(low, high)))


def at_most(length: int) -> Column:
    return F.col("len") <= length


def at_least(length: int) -> Column:
    return F.col("len") >= length


# fixed values: dialling prefixes a number may be stored with
NUMBER_PREFIXES = ["", "+", "+1", "1"]


def text_equals(column: Column, value: str, ci: bool = False) -> Column:
    """Equality; with ``ci`` regardless of case and trailing blanks."""
    return F.collate(column, "UTF8_LCASE_RTRIM") == F.lit(value) if ci else column == value


def user_number(column: Column, number: str, ci: bool = False) -> Column:
    """A user number with any of the prefixes; ``%`` and ``_`` act as wildcards."""
    column = F.collate(column, "UTF8_LCASE_RTRIM") if ci else column
    forms = [prefix + number for prefix in NUMBER_PREFIXES]
    exact = [column == form for form in forms] if ci else [column.isin(forms)]
    if not any(c in number for c in "%_\\"):
        return reduce(or_, exact)
    if ci:
        column = F.collate(column, "UTF8_LCASE")
    return reduce(or_, exact + [column.like(form) for form in forms])


def malformed_only() -> Column:
    return F.col("malformed") == 1


def address_is(column: str, text: str) -> Column:
    """Equality with a dotted address, converted on the literal side; no row matches bad text."""
    number = ip_literal(text)
    return F.lit(False) if number is None else F.col(column) == number


def call_is(value: str, ci: bool = False) -> Column:
    return text_equals(F.col("callid"), value, ci) | text_equals(F.col("callid_rc"), value, ci)


def since(moment: str) -> list[Column]:
    start = F.lit(moment).cast("timestamp")
    return [F.col("datetime") >= start, F.col("date") >= F.to_date(start)]


def until(moment: str) -> list[Column]:
    end = F.lit(moment).cast("timestamp")
    return [F.col("datetime") <= end, F.col("date") <= F.to_date(end)]


def all_of(tests: list[Column]) -> Column:
    """Conjunction; true for no tests."""
    return reduce(and_, tests, F.lit(True))


def search_filter(
    malformed: str | int | None = None,
    src_ip: str | None = None,
    dst_ip: str | None = None,
    sip_callid: str | None = None,
    sip_method: str | None = None,
    from_user: str | None = None,
    to_user: str | None = None,
    date_start: str | None = None,
    date_end: str | None = None,
    src_port: int | None = None,
    dst_port: int | None = None,
    ci: bool = False,
) -> Column:
    """Conjunction of the search fields that are given and not empty.

    The time limits come with the matching limits on the partition column.
    """
    tests: list[Column] = []
    if str(malformed) == "1":
        tests.append(malformed_only())
    if src_ip:
        tests.append(address_is("source_ip", src_ip))
    if dst_ip:
        tests.append(address_is("destination_ip", dst_ip))
    if sip_callid:
        tests.append(call_is(sip_callid, ci))
    if sip_method:
        tests.append(text_equals(F.col("request_method"), sip_method, ci))
    if from_user:
        tests.append(user_number(F.col("`from`"), from_user, ci))
    if to_user:
        tests.append(user_number(F.col("`to`"), to_user, ci))
    if date_start:
        tests.extend(since(date_start))
    if date_end:
        tests.extend(until(date_end))
    if src_port not in (None, ""):
        tests.append(F.col("source_port") == int(src_port))
    if dst_port not in (None, ""):
        tests.append(F.col("destination_port") == int(dst_port))
    return all_of(tests)


_COMPARE = {
    "equal": lambda a, b: a == b,
    "notequal": lambda a, b: a != b,
    "less": lambda a, b: a < b,
    "lessorequal": lambda a, b: a <= b,
    "greater": lambda a, b: a > b,
    "greaterorequal": lambda a, b: a >= b,
}


def grid_rule(df: DataFrame, field: str, op: str, value) -> Column:
    """One grid rule. A missing value counts as empty text; text searches ignore case."""
    column = F.col(f"`{field}`")
    text = F.coalesce(column.cast("string"), F.lit(""))
    wanted = str(value)
    if op == "contains":
        return F.contains(F.lower(text), F.lit(wanted.lower()))
    if op == "beginwith":
        return F.startswith(F.lower(text), F.lit(wanted.lower()))
    if op == "endwith":
        return F.endswith(F.lower(text), F.lit(wanted.lower()))
    compare = _COMPARE[op]
    numeric = isinstance(df.schema[field].dataType, T.NumericType)
    try:
        number = float(wanted) if numeric else None
    except ValueError:
        number = None
    if number is None:
        return compare(text, F.lit(wanted))
    return F.coalesce(compare(column, F.lit(int(number) if number.is_integer() else number)), compare(F.lit(""), F.lit(wanted)))


def rules_filter(df: DataFrame, rules: list[tuple], match: str = "all") -> DataFrame:
    """Rows that satisfy all, or with ``match="any"`` at least one, of ``(field, op, value)`` rules."""
    tests = [grid_rule(df, *rule) for rule in rules]
    if not tests:
        return df
    return df.where(reduce(or_ if match == "any" else and_, tests))
