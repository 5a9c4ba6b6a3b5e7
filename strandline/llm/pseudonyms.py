"""Format-preserving pseudonyms for personal data, in native columns only.

Numbers and dates are validated and then moved by a keyed Feistel permutation
within their own format, so that a value has one pseudonym in every document,
two values never share one, and the result validates as well:

- payment cards (13 to 19 digits, Luhn): all digits but the last are permuted, the last is the check digit;
- phone numbers (country code kept): their digits;
- social security numbers: the 888 931 098 valid ones;
- IBANs: the account's digits, with new check digits;
- IPv4 addresses: the 32 bits;
- dates (ISO, or day.month.year) from 1900 to 2099: the 73 049 days.

E-mail addresses have no number to permute: the address, in lower case, becomes a keyed
digest of 128 bits at ``example.invalid``.  What does not validate stays as it is.

A half of a Feistel pair moves by a keyed digest of the other half, modulo its
own range, so any product of two ranges is a domain and no cycle walking is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import spread

ROUNDS = 8
#: The 73 049 days from 1900-01-01 to 2099-12-31 are 17 * 4297.
DAYS = (17, 4297)
FIRST_DAY = "1900-01-01"

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,20}\.[A-Za-z][A-Za-z]+"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
DATE = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}\.\d{2}\.\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
#: Alternatives go from the strictest to the loosest, so that a number takes no digits of what follows it.
PHONE = (
    r"\+\d{1,3}[ -]\(\d{3}\) \d{3}-\d{4}\b|\+1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}\b|"
    r"\+\d{1,3}[ .-](?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}\b|\+\d{8,15}\b"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}\b|\b\d{3}[ .-]\d{3}[ .-]\d{4}\b"
)
IBAN = r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b"
CARD = r"\b\d{13,19}\b|\b\d{4}[ -]\d{4}\b(?:[ -]\d{4}\b){2}|\b\d{4}[ -]\d{6}[ -]\d{5}\b"
ANY = "|".join((EMAIL, IBAN, IPV4, DATE, SSN, PHONE, CARD))
#: The e-mail part starts at the start of a run, which keeps the search linear in very long runs.
_JAVA_ANY = ANY.replace("[A-Za-z0-9._%+-]+@", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@", 1)
KINDS = ("email", "iban", "ipv4", "date", "ssn", "phone", "card")


def _digest(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *parts), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(value: Column, left: Column, right: Column, key: str, kind: str) -> Column:
    """The place of ``value`` in a keyed permutation of 0 .. left * right - 1."""
    start = F.struct(F.call_function("div", value, right).cast("bigint").alias("a"), (value % right).cast("bigint").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        move = _number(_digest(key, kind, left.cast("string"), right.cast("string"), r.cast("string"), F.when(even, s["b"]).otherwise(s["a"]).cast("string")))
        return F.struct(
            F.when(even, (s["a"] + move % left) % left).otherwise(s["a"]).cast("bigint").alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + move % right) % right).cast("bigint").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["a"] * right + s["b"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("bigint")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.split(form, ""), start, put, lambda s: s["out"])


def _permuted(digits: Column, key: str, kind: str) -> Column:
    """``digits`` (a string of up to 18) permuted among strings of its length."""
    n = F.length(digits)
    low = F.floor(n / 2)
    moved = feistel(digits.cast("bigint"), _power(low), _power(n - low), key, kind)
    return F.lpad(moved.cast("string"), n, "0")


def _luhn_sum(digits: Column, first_doubled: int) -> Column:
    """The Luhn sum; of the digits from the right, every second one from ``first_doubled`` on is doubled."""

    def add(s: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((s["n"] + 1).alias("n"), (s["sum"] + F.when(s["n"] % 2 == first_doubled, twice).otherwise(d)).alias("sum"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum")), add, lambda s: s["sum"])


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = _permuted(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = ((F.lit(10) - _luhn_sum(body, 0) % 10) % 10).cast("string")
    return F.when(_luhn_sum(digits, 1) % 10 == 0, _filled(m, F.concat(body, check)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays: the digits before the first separator, or two of an unparted number."""
    digits = _digits(m)
    code = F.when(~m.startswith("+"), 0).when(m.rlike(r"^\+\d+$"), 2).otherwise(F.length(F.regexp_extract(m, r"^\+(\d{1,3})", 1)))
    own = F.length(digits) - code
    made = F.concat(F.substr(digits, F.lit(1), code), _permuted(F.substr(digits, code + 1, own), key, "phone"))
    return F.when(own.between(6, 14), _filled(m, made))


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's number: letters count 10 to 35."""

    def add(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.when(digit, s * 10 + c.try_cast("int")).otherwise(s * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """Country and letters stay, the account's digits are permuted (beyond fifteen in two parts), the check digits follow."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(plain, 1, 2), F.substr(plain, F.lit(5), F.length(plain) - 4)
    digits = _digits(account)
    n = F.length(digits)
    some = F.substr(digits, F.lit(1), F.least(n, F.lit(15)))
    rest = F.substr(digits, F.lit(16), F.greatest(n - 15, F.lit(0)))
    moved = F.concat(_permuted(some, key, "iban"), F.when(n > 15, _permuted(rest, key, "iban2")).otherwise(""))
    fresh = _filled(account, moved)
    check = F.lpad((F.lit(98) - _mod97(F.concat(fresh, country, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(country, check, fresh)
    spaced = F.aggregate(
        F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(whole, s["at"], F.lit(1)))).alias("out"), F.when(c == " ", s["at"]).otherwise(s["at"] + 1).alias("at")), lambda s: s["out"],
    )
    valid = (F.length(plain).between(15, 34)) & (n > 0) & (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1)
    return F.when(valid, spaced)


def _ssn(m: Column, key: str) -> Column:
    """Permuted among the valid numbers: 898 areas (001 to 899 but 666), 99 groups and 9999 serials, none of them zero."""
    area, group, serial = (F.substring(m, at, n) for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    number = lambda c: c.cast("bigint")
    rank = number(area) - F.when(number(area) > 666, 2).otherwise(1)
    value = (rank * 99 + number(group) - 1) * 9999 + number(serial) - 1

    def shown(v: Column) -> Column:
        high = F.call_function("div", v, F.lit(9999))
        place = F.call_function("div", high, F.lit(99))
        digits = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", digits(place + F.when(place >= 665, 2).otherwise(1), 3), digits(high % 99 + 1, 2), digits(v % 9999 + 1, 4))

    moved = F.transform(F.array(feistel(value, F.lit(898 * 99), F.lit(9999), key, "ssn")), shown)
    return F.when(valid, moved[0])


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x)
    moved = F.transform(F.array(feistel(value, F.lit(65_536), F.lit(65_536), key, "ipv4")), lambda v: F.concat_ws(".", *[F.shiftright(v, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]))
    return F.when(F.array_max(octets) < 256, moved[0])


def _date(m: Column, key: str) -> Column:
    dotted = F.substring(m, 3, 1) == "."
    iso = F.when(dotted, F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2))).otherwise(m)
    day = F.date_diff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    moved = F.transform(
        F.array(F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(day, F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date").cast("int"))),
        lambda d: F.when(dotted, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")),
    )
    return F.when(day.between(0, DAYS[0] * DAYS[1] - 1), moved[0])


def _kind(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    out = F.when(m.contains("@"), "email")
    for name, pattern in (("iban", IBAN), ("ipv4", IPV4), ("date", DATE), ("ssn", SSN), ("phone", PHONE)):
        out = out.when(whole(pattern), name)
    return out.otherwise("card")


def _pseudonym(kind: Column, m: Column, key: str) -> Column:
    """The pseudonym of a match; null if it does not validate."""
    email = F.concat(F.lit("u"), F.substring(_digest(key, "email", F.lower(m)), 1, 32), F.lit("@example.invalid"))
    made = {"email": email, "iban": _iban(m, key), "ipv4": _ipv4(m, key), "date": _date(m, key), "ssn": _ssn(m, key), "phone": _phone(m, key), "card": _card(m, key)}
    out = F.when(kind == "email", made["email"])
    for name in KINDS[1:]:
        out = out.when(kind == name, made[name])
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out_col: str = "found") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and ``out_col``: the (kind, value, pseudonym) of what was replaced, in order.

    Null stays null with nothing found; empty texts stay empty; repeated rows and
    equal values are treated alike; an empty table stays empty.  Other columns may
    have any name but ``out_col``.  The key is a secret of the caller.
    """
    text = F.col(f"`{text_col}`")
    names = docs.columns
    # Few texts hold a digit next to what a value needs; the others never meet the full pattern.
    hit = text.rlike(r"@|\d[\d ().-]{5}")
    rows = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), text.alias("_t"), F.when(hit, F.regexp_extract_all(text, F.lit(_JAVA_ANY), F.lit(0))).alias("_m"))
    rows = rows.withColumn("_made", F.transform("_m", lambda m: F.struct(_kind(m).alias("kind"), m.alias("value"))))
    rows = rows.withColumn("_made", F.transform("_made", lambda x: F.struct(x["kind"], x["value"], _pseudonym(x["kind"], x["value"], key).alias("pseudonym"))))
    between = F.split("_t", _JAVA_ANY, -1)
    joined = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get("_made", i)["pseudonym"], F.get("_m", i), F.lit("")))), "")
    changed = F.exists("_made", lambda x: x["pseudonym"].isNotNull())
    rows = rows.withColumn("_out", F.when(changed, joined).otherwise(F.col("_t")))
    found = F.coalesce(F.filter("_made", lambda x: x["pseudonym"].isNotNull()), F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>"))
    return rows.select(*[F.col("_out").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in names], found.alias(out_col))
