"""Pseudonyms for personal data: keyed permutations within the format of each value."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialtrace.llm.common import with_text

#: Setting of a session that holds the secret key of its pseudonyms.
KEY_SETTING = "spark.dialtrace.pseudonymKey"
ROUNDS = 8


def session_key(spark: SparkSession) -> str:
    """The session's secret key; a fresh one if it has none, under which values stay linked in one run only."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


#: The form of each kind, in order of precedence.
FORMS: dict[str, str] = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|token|secret|api[_-]?key)\b\s*[=:]\s*\"?[A-Za-z0-9+/_-]{8,})",
    "phone": r"(?<![0-9])\+1[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    # any other country code and 7 to 15 digits
    r"|(?<![0-9A-Za-z])\+[2-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9])"
    # North America without a +, with separators
    r"|(?<![0-9+]|[0-9][.-])(?:1[ .-])?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"
    # national numbers behind a 0, with separators, 9 to 12 digits, no dates
    r"|(?<![0-9+]|[0-9][./-])(?![0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}(?![0-9]))(?=\(?0[1-9](?:[ ()/.-]{0,2}[0-9]){7,10}(?![ .-]?[0-9]))"
    r"\(?0[1-9][0-9]{0,4}(?:\)[ ./-]?|[ ./-])[0-9]{2,8}(?:[ ./-][0-9]{2,8}){0,4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
ANY_FORM = "|".join(FORMS.values())
#: What every form contains; a text without it is not looked at further.
HINT = r"[0-9@]|(?i:password|passwd|token|secret|api[_-]?key)"

#: The Gregorian calendar repeats after 400 years, 146,097 days = 189 * 773.
DAYS_A, DAYS_B, FIRST_DAY = 189, 773, "1800-01-01"


def keyed(key: str, *parts: Column) -> Column:
    """SHA-256 of key and parts as 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel_numbers(a: Column, b: Column, mod_a: int, mod_b: int, key: str, kind: str) -> Column:
    """A keyed permutation of pairs below (mod_a, mod_b), as a struct of a and b.

    Rounds shift one half by a keyed function of the other, in turn, so each round can be undone.
    """

    def shift(i: Column, other: Column, mod: int) -> Column:
        return F.conv(F.substring(keyed(key, F.lit(kind), i, other), 1, 12), 16, 10).cast("bigint") % mod

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 1, (s["a"] + shift(i, s["b"], mod_a)) % mod_a).otherwise(s["a"])
        right = F.when(i % 2 == 0, (s["b"] + shift(i, s["a"], mod_b)) % mod_b).otherwise(s["b"])
        return F.struct(left.alias("a"), right.alias("b"))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


#: What a character may turn into.
DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shifted(text: Column, other: Column, i: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """Each character of ``text`` moved within its alphabet by a keyed function of ``other``; the rest stays."""

    def move(c: Column, place: Column) -> Column:
        block = keyed(key, F.lit(kind), i, F.length(text), (place / 32).cast("int"), other)
        by = F.conv(F.substr(block, (place % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        moved = c
        for letters in reversed(alphabets):
            at = F.instr(F.lit(letters), c)
            moved = F.when(at > 0, F.substr(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(moved)
        return moved

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), move), "")


def feistel_text(value: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """A keyed permutation of the texts that share length and the alphabet of each character."""
    half = (F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1).alias("b"))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 1, shifted(s["a"], s["b"], i, key, kind, alphabets)).otherwise(s["a"])
        right = F.when(i % 2 == 0, shifted(s["b"], s["a"], i, key, kind, alphabets)).otherwise(s["b"])
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(value: Column, digits: Column) -> Column:
    """The value with its digits replaced in order, separators as they were."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def put(c: Column, i: Column) -> Column:
        nth = F.length(digits_of(F.substr(value, F.lit(1), i + 1)))
        return F.when(c.rlike("^[0-9]$"), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, put), "")


def luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Sum of the digits, every second one doubled, counted from the right."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(digits) - 1 - i + doubled_first) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), worth), F.lit(0), lambda s, x: s + x)


def card(value: Column, key: str) -> Column:
    """A card number with a right check digit becomes another one; others give null."""
    digits = digits_of(value)
    new = feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", (DIGITS,))
    # named once, as the check digit needs it again
    whole = F.transform(F.array(new), lambda n: F.concat(n, ((F.lit(10) - luhn_sum(n, F.lit(1)) % 10) % 10).cast("string")))[0]
    return F.when(luhn_sum(digits, F.lit(0)) % 10 == 0, refill(value, whole))


#: The country codes of E.164 with one or two digits; all others have three.
COUNTRY = "^(7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def phone(value: Column, key: str) -> Column:
    """Country code and separators stay, and an area code of North America still starts with 2 to 9.

    Other numbers keep their country code, or 0 and one digit of a national one, and the rest
    is permuted. One number of North America has one pseudonym with and without +1.
    """
    america = F.regexp_extract(digits_of(value), "^1?([2-9][0-9]{9})$", 1)
    is_america = (america != "") & (~value.startswith("+") | value.startswith("+1"))
    all_digits = digits_of(value)
    code = F.when(value.startswith("+"), F.when(all_digits.rlike(COUNTRY), F.regexp_extract(all_digits, COUNTRY, 1)).otherwise(F.substring(all_digits, 1, 3)))
    head = F.coalesce(code, F.substring(all_digits, 1, 2))
    other = F.concat(head, feistel_text(F.substr(all_digits, F.length(head) + 1), key, "phone", (DIGITS,)))
    digits = america
    a, b = F.substring(digits, 1, 5).cast("bigint") - 20000, F.substring(digits, 6, 5).cast("bigint")
    moved = F.transform(F.array(feistel_numbers(a, b, 80000, 100000, key, "phone")), lambda s: F.concat(
        F.regexp_extract(all_digits, "^(1?)[2-9][0-9]{9}$", 1), (s["a"] + 20000).cast("string"), F.lpad(s["b"].cast("string"), 5, "0")))[0]
    return refill(value, F.when(is_america, moved).otherwise(other))


def ip(value: Column, key: str) -> Column:
    """An address with four numbers up to 255 becomes another one; others give null."""
    at = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    moved = F.transform(F.array(feistel_numbers(at[0] * 256 + at[1], at[2] * 256 + at[3], 65536, 65536, key, "ip")), lambda s: F.concat_ws(
        ".", (s["a"] / 256).cast("int").cast("string"), (s["a"] % 256).cast("string"),
        (s["b"] / 256).cast("int").cast("string"), (s["b"] % 256).cast("string")))[0]
    return F.when(~F.exists(at, lambda x: x > 255), moved)


def date(value: Column, key: str) -> Column:
    """A day of 1800 to 2199 becomes another one in the same form; what is no such day gives null.

    The forms are 2024-01-31, 31/01/2024 and 31.01.2024, and 01/31/2024 where that is the only reading.
    A day or month of one digit is a form without leading zeros.
    """

    def moved(form: str) -> Column:
        day = F.to_date(F.try_to_timestamp(value, F.lit(form)))
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        pair = feistel_numbers((n / DAYS_B).cast("int"), n % DAYS_B, DAYS_A, DAYS_B, key, "date")
        back = F.transform(F.array(pair), lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS_B + s["b"]).cast("int")), form))[0]
        return F.when((n >= 0) & (n < DAYS_A * DAYS_B), back)

    iso = F.when(value.contains("-"), moved("yyyy-MM-dd"))
    full = F.length(value) == 10
    dots = F.when(value.contains("."), F.when(full, moved("dd.MM.yyyy")).otherwise(moved("d.M.yyyy")))
    slashes = F.when(value.contains("/"), F.when(full, F.coalesce(moved("dd/MM/yyyy"), moved("MM/dd/yyyy"))).otherwise(F.coalesce(moved("d/M/yyyy"), moved("M/d/yyyy"))))
    return F.coalesce(iso, dots, slashes)


def email(value: Column, key: str) -> Column:
    """The part before the last @ is permuted, letters to letters and digits to digits; the domain stays."""
    local = F.regexp_extract(value, "^(.*)@", 1)
    return F.concat(feistel_text(local, key, "email", (DIGITS, LOWER, UPPER)), F.substr(value, F.length(local) + 1))


def secret(value: Column, key: str) -> Column:
    """Access keys and the values behind password, token and the like; hexadecimal values stay so."""
    head = F.regexp_extract(value, r"^(AKIA|[A-Za-z_-]+\s*[=:]\s*\"?)", 1)
    tail = F.substr(value, F.length(head) + 1)
    return F.concat(head, F.when(tail.rlike("^[0-9a-f]+$"), feistel_text(tail, key, "hex", (HEX,)))
                    .otherwise(feistel_text(tail, key, "secret", (DIGITS, LOWER, UPPER))))


def ssn(value: Column, key: str) -> Column:
    """A number with a possible area, group and serial becomes another one of that form; others give null."""
    valid = value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    area, group, serial = (F.split(value, "-")[i].cast("bigint") for i in range(3))
    # areas 001-899 without 666, groups 01-99, serials 0001-9999
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel_numbers(place, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    back = F.transform(F.array(pair), lambda s: F.concat_ws(
        "-", F.lpad((s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad(((s["b"] / 9999).cast("int") + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")))[0]
    return F.when(valid, back)


KINDS: dict[str, Callable[[Column, str], Column]] = {
    "email": email, "secret": secret, "phone": phone, "card": card, "ip": ip, "date": date, "ssn": ssn,
}


def replacement(value: Column, key: str) -> Column:
    """kind and new text of one match; both null if it does not pass its test."""
    kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(KINDS):
        is_it = value.rlike(f"^(?:{FORMS[name]})$")
        kind, new = F.when(is_it, F.lit(name)).otherwise(kind), F.when(is_it, KINDS[name](value, key)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The documents with personal data replaced, and n_pii and pii_kinds.

    Emails, secrets, telephone, card and social security numbers, network addresses and
    dates are found in the whole text, tested where they can be (check digit, ranges,
    calendar), and permuted by a keyed Feistel network over exactly the values of that
    form. Equal values so get equal pseudonyms in every document, unequal ones unequal
    pseudonyms, and a pseudonym passes the same test. What fails its test stays.

    A missing text stays missing with n_pii 0; repeated rows are treated alike; all
    columns of the documents are returned, with n_pii and pii_kinds replaced if there.
    An empty table gives no rows. Whoever has the key can invert the pseudonyms.
    """
    docs = docs.drop("n_pii", "pii_kinds")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = rows.select(
        "row",
        F.when(F.col("row.text").rlike(HINT), F.regexp_extract_all("row.text", F.lit(ANY_FORM), F.lit(0))).alias("found"),
    )
    put = found.select(
        "row",
        "found",
        F.when(F.size("found") > 0, F.transform("found", lambda x: replacement(x, key))).alias("put"),
    )
    # the text between the matches, and behind each the new value or else the match
    filled = F.zip_with("found", "put", lambda x, p: F.coalesce(p["new"], x))
    text = F.when(
        F.size("put") > 0,
        F.array_join(F.zip_with(F.split(F.col("row.text"), ANY_FORM, -1), filled, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), ""),
    ).otherwise(F.col("row.text"))
    kinds = F.transform(F.filter("put", lambda p: p["new"].isNotNull()), lambda p: p["kind"])
    new = put.select("row", text.alias("new_text"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))
    return with_text(
        new, "row", F.col("new_text"), F.size("kinds").cast("bigint").alias("n_pii"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("pii_kinds")
    )
