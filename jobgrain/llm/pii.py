"""Personal data replaced by format-preserving pseudonyms from a keyed Feistel network.

A match is validated (checksums, calendar, number ranges) and then permuted among
the values of its own format: digits stay digits, a card number stays one of the
same length with a right check digit, a date stays a date. The permutation depends
only on the key and the format, so equal values stay equal in all documents and
different values stay different. With the key it can be undone. Every format is
permuted within its valid values: numbers are counted among them, and a day that a
layout can't hold is permuted on until one comes that it can.

Only column expressions are used. A text is cut at its matches once, and the rounds
run on the matches alone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Days from 1900 to 2099, as a product, so that a day number falls into two halves.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 17, 4_297
# More steps than a walk to a day of the layout ever takes: each one fails for 2 of 5 days, and there are 73,049.
WALK = 64
# US social security numbers: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9_999

# What may be personal. A text is searched once for all of them; what matched is validated afterwards.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ACCESS_KEY = r"AKIA[A-Z0-9]{16}"
SECRET = r"(?i:password|passwd|secret|api_?key|token)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-]{8,}[\"']?"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
ISO_DATE = r"(?<![\d-])(?:19|20)\d{2}-\d{2}-\d{2}(?![\d-])"
DOT_DATE = r"(?<![\d.])\d{2}\.\d{2}\.(?:19|20)\d{2}(?!\d|\.\d)"
SLASH_DATE = r"(?<![\d/])\d{2}/\d{2}/(?:19|20)\d{2}(?![\d/])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"
PATTERNS = (EMAIL, ACCESS_KEY, SECRET, IPV4, ISO_DATE, DOT_DATE, SLASH_DATE, IBAN, SSN, CARD, PHONE)
ANY = "|".join(PATTERNS)
# A text without any of these holds nothing that the patterns match.
HINT = r"[0-9@=:]|AKIA"


def permuted(left: Column, right: Column, a: Column, b: Column, key: Column, tag: Column, undo: bool = False) -> Column:
    """A keyed permutation of the pairs (left < a, right < b), as a struct of l and r.

    A Feistel network over two numbers: rounds add a keyed hash of one half to the
    other, modulo its size, in turns. `undo` runs the rounds backwards.
    """
    numbers = list(range(ROUNDS))[::-1 if undo else 1]

    def added(target: Column, other: Column, size: Column, number: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", key, tag, size.cast("string"), number.cast("string"), other.cast("string")), 256)
        moved = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size
        return F.pmod(target - moved if undo else target + moved, size)

    def turn(acc: Column, number: Column) -> Column:
        even = number % 2 == 0
        return F.struct(F.when(even, added(acc["l"], acc["r"], a, number)).otherwise(acc["l"]).alias("l"),
                        F.when(even, acc["r"]).otherwise(added(acc["r"], acc["l"], b, number)).alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in numbers]),
                       F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def permuted_string(value: Column, key: Column, tag: Column, base: int = 10, undo: bool = False) -> Column:
    """A keyed permutation of the strings of one length over the digits of a base: up to 34 digits, or 22 of base 36."""
    n = F.length(value)
    u = F.floor(n / 2).cast("int")
    size = lambda m: F.pow(F.lit(10), m).cast("long") if base == 10 else F.conv(F.concat(F.lit("1"), F.repeat(F.lit("0"), m)), base, 10).cast("long")
    number = lambda x: F.coalesce(F.conv(x, base, 10).cast("long"), F.lit(0))
    pair = permuted(number(F.substring(value, F.lit(1), u)), number(F.substring(value, u + 1, n - u)), size(u), size(n - u), key,
                    F.concat_ws("|", tag, n.cast("string")), undo)
    text = lambda x, m: F.when(m > 0, F.lpad(F.conv(x.cast("string"), 10, base), m, F.lit("0"))).otherwise(F.lit(""))
    return F.transform(F.array(pair), lambda p: F.concat(text(p["l"], u), text(p["r"], n - u)))[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _filled(shape: Column, symbols: Column, kind: str) -> Column:
    """`shape` with its characters of class `kind` replaced, in order, by `symbols`."""
    outside = f"[^{kind}]"
    places = F.sequence(F.lit(1), F.length(shape))
    return F.array_join(F.transform(places, lambda i: F.when(
        F.substring(shape, i, F.lit(1)).rlike(outside), F.substring(shape, i, F.lit(1))).otherwise(
        F.substring(symbols, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), outside, "")), F.lit(1)))), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counted once."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda acc, x: acc + x)


def _card(m: Column, key: Column, undo: bool) -> Column:
    """First digit kept, the rest permuted, the check digit made right again."""
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 1), permuted_string(F.substring(d, F.lit(2), F.length(d) - 2), key, F.lit("card"), undo=undo))
    return F.transform(F.array(body), lambda x: _filled(
        m, F.concat(x, F.pmod(-_luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")), "0-9"))[0]


def _mod97(account: Column) -> Column:
    """An account number (letters count as 10 to 35) modulo 97."""
    def more(acc: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return F.when(value > 9, (acc * 100 + value) % 97).otherwise((acc * 10 + value) % 97)

    return F.aggregate(F.filter(F.split(account, ""), lambda c: c != ""), F.lit(0), more)


def _moved(account: Column, check: Column) -> Column:
    return F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 2), check)


def _iban(m: Column, key: Column, undo: bool) -> Column:
    """Country and letters kept, the other digits permuted, the check digits made right again."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    rest = F.substring(plain, F.lit(5), F.length(plain))
    new = F.concat(F.substring(plain, 1, 4), _filled(rest, permuted_string(_digits(rest), key, F.lit("iban"), undo=undo), "0-9"))
    return F.transform(F.array(new), lambda x: _filled(m, F.concat(
        F.substring(x, 1, 2), F.lpad((F.lit(98) - _mod97(_moved(x, F.lit("00")))).cast("string"), 2, "0"),
        F.substring(x, F.lit(5), F.length(x))), "A-Z0-9"))[0]


def _ip(m: Column, key: Column, undo: bool) -> Column:
    part = [F.split_part(m, F.lit("."), F.lit(i)).cast("int") for i in range(1, 5)]
    two = F.lit(1 << 16)
    pair = permuted(part[0] * 256 + part[1], part[2] * 256 + part[3], two, two, key, F.lit("ip"), undo)
    return F.transform(F.array(pair), lambda p: F.concat_ws(".", *[
        F.shiftright(p[h], s).bitwiseAND(F.lit(255).cast("long")).cast("string") for h in ("l", "r") for s in (8, 0)]))[0]


def _day(day: Column, key: Column, undo: bool) -> Column:
    """The permutation of the days from 1900 to 2099, counted from 0."""
    pair = permuted(F.floor(day / DAYS_LOW), F.pmod(day, F.lit(DAYS_LOW)), F.lit(DAYS_HIGH), F.lit(DAYS_LOW), key, F.lit("date"), undo)
    return F.transform(F.array(pair), lambda p: (p["l"] * DAYS_LOW + p["r"]).cast("int"))[0]


def _date_of(day: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), day)


def _date(m: Column, layout: str, key: Column, undo: bool) -> Column:
    """The pseudonym of a day in its layout.

    Day/month is only read where month/day is no date, so its days lie behind the 12th:
    the permutation is repeated until it comes to such a day, and is one among them.
    """
    day = F.date_diff(F.try_to_date(m, layout), F.lit(FIRST_DAY).cast("date"))
    new = _day(day, key, undo)
    if layout == "dd/MM/yyyy":
        new = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), new, lambda acc, _: F.when(
            F.dayofmonth(_date_of(acc)) > 12, acc).otherwise(_day(acc, key, undo)))
    return F.date_format(_date_of(new), layout)


def _ssn(m: Column, key: Column, undo: bool) -> Column:
    """Permuted among the valid numbers: area and group as one number, the serial as the other."""
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    left = (area - F.when(area > 666, 2).otherwise(1)) * GROUPS + group - 1
    pair = permuted(left, serial - 1, F.lit(AREAS * GROUPS), F.lit(SERIALS), key, F.lit("ssn"), undo)

    def written(p: Column) -> Column:
        area = F.floor(p["l"] / GROUPS)
        number = area + F.when(area >= 665, 2).otherwise(1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in (
            (number, 3), (p["l"] % GROUPS + 1, 2), (p["r"] + 1, 4))])

    return F.transform(F.array(pair), written)[0]


def _email(m: Column, key: Column, undo: bool) -> Column:
    """The letters and digits of the local part permuted in lower case; long ones by a one-way keyed hash."""
    local = F.lower(F.substring_index(m, "@", 1))
    plain = F.regexp_replace(local, "[^0-9a-z]", "")
    new = F.when(F.length(plain) <= 22, F.lower(permuted_string(plain, key, F.lit("email"), 36, undo))).otherwise(
        F.rpad(F.sha2(F.concat_ws("|", key, plain), 256), F.length(plain), F.lit("x")))
    return F.concat(_filled(local, new, "0-9a-z"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: Column) -> Column:
    """The value of a named secret, one-way: a keyed hash of the same length."""
    name = F.regexp_extract(m, r"^([A-Za-z_]+\s*[=:]\s*[\"']?)", 1)
    end = F.regexp_extract(m, r"([\"']?)$", 1)
    value = F.substring(m, F.length(name) + 1, F.length(m) - F.length(name) - F.length(end))
    return F.concat(name, F.rpad(F.sha2(F.concat_ws("|", key, value), 256), F.length(value), F.lit("0")), end)


def _phone(m: Column, key: Column, undo: bool) -> Column:
    """The first digit kept (of a country code), the others permuted."""
    d = _digits(m)
    return _filled(m, F.concat(F.substring(d, 1, 1), permuted_string(
        F.substring(d, F.lit(2), F.length(d)), key, F.lit("phone"), undo=undo)), "0-9")


def pseudonym(m: Column, key: Column, undo: bool = False) -> Column:
    """The pseudonym of one match, or the match itself if it does not validate."""
    def is_(pattern: str) -> Column:
        return m.rlike(f"^(?:{pattern})$")

    d = _digits(m)
    plain = F.replace(m, F.lit(" "), F.lit(""))
    octets = F.forall(F.split(m, r"\."), lambda x: (x.cast("int") <= 255) & ~x.rlike("^0."))
    out = F.when(m.contains("@"), _email(m, key, undo))
    out = out.when(is_(ACCESS_KEY), F.concat(F.lit("AKIA"), F.upper(F.substring(F.sha2(F.concat_ws("|", key, m), 256), 1, 16))))
    out = out.when(is_(SECRET), _secret(m, key))
    for pattern, layout in ((ISO_DATE, "yyyy-MM-dd"), (DOT_DATE, "dd.MM.yyyy"), (SLASH_DATE, "MM/dd/yyyy")):
        out = out.when(is_(pattern) & F.try_to_date(m, layout).isNotNull(), _date(m, layout, key, undo))
    out = out.when(is_(SLASH_DATE) & F.try_to_date(m, "dd/MM/yyyy").isNotNull(), _date(m, "dd/MM/yyyy", key, undo))
    out = out.when(is_(IPV4) & octets, _ip(m, key, undo))
    out = out.when(is_(IBAN) & (F.length(_digits(F.substring(plain, F.lit(5), F.length(plain)))) > 1)
                   & (_mod97(_moved(plain, F.substring(plain, 3, 2))) == 1), _iban(m, key, undo))
    out = out.when(is_(SSN) & ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("0000$"),
                   _ssn(m, key, undo))
    out = out.when(is_(CARD) & (_luhn(d) % 10 == 0), _card(m, key, undo))
    out = out.when(is_(PHONE) & F.length(d).between(7, 15), _phone(m, key, undo))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", undo: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and n_pii, the number of values replaced, of every row.

    E-mail addresses (local part), IPv4 addresses, calendar dates from 1900 to 2099,
    IBANs, US social security numbers, payment cards and telephone numbers are
    permuted within their format; access keys and named secrets get a one-way hash of
    the same length. Numbers that fail their check, impossible dates and all other
    text stay as they are; so do IPv4 addresses with a leading zero. Dates in slashes are read as month/day where that is a
    date, else as day/month, and are written back as they are read; the pseudonym of a day is
    the same in all layouts, but for day/month where it falls on the 12th or before.
    `undo` with the same key gives back what was permuted, e-mail names in lower case.

    A null text stays null with n_pii 0, an empty one ''. Rows are independent:
    repeated rows give equal rows, extra columns are not looked at, an empty table
    gives an empty result, nothing is shuffled.
    """
    body = F.col("body")
    secret = F.lit(key)
    found = F.regexp_extract_all(body, F.lit(ANY), F.lit(0))
    rows = (docs.select("doc_id", F.col(text).alias("body"))
            .withColumn("found", F.when(body.rlike(HINT), found).otherwise(F.array().cast("array<string>")))
            .withColumn("new", F.transform("found", lambda m: pseudonym(m, secret, undo))))
    pieces = F.split(body, ANY, -1)
    joined = F.array_join(F.transform(pieces, lambda x, i: F.concat(x, F.coalesce(F.get("new", i), F.lit("")))), "")
    changed = F.filter(F.zip_with("found", "new", lambda x, y: x != y), lambda x: x)
    return rows.select("doc_id", F.when(F.size("found") > 0, joined).otherwise(body).alias("text"),
                       F.greatest(F.size(changed), F.lit(0)).alias("n_pii"))
