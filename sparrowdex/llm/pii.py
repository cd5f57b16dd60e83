"""Format-preserving pseudonyms for personal data (operator 5).

Validated numbers and dates are found in the text and replaced through a keyed Feistel network whose
domain is the format itself: card numbers stay card numbers of the same length with a right check
digit, dates stay dates, addresses stay addresses. The mapping is a permutation, so equal values stay
equal in all documents, different values stay different, and the holder of the key can invert it.
Digit strings that fail their validation (check digits, ranges, the calendar) are left as they are.

All of it is built from SQL functions: one pattern splits the text and lists the candidates, array
functions map these, and the text is put together again.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the Feistel network; even, so that the halves end where they began.
ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31 = 319 * 229, the two sides of the network for dates.
DAYS, DAY_SIDES = 73_049, (319, 229)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in the order in which they are tried at a place, with the pattern that finds candidates.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "phone_abroad": r"(?<![\d+])\+\d{1,3}[ .-]\(?\d{1,5}\)?(?:[ .-]?\d{2,5}){1,4}(?!\d)",
    "phone_trunk": r"(?<![\d.,+/-])(?<!\d )0\d{2,4}[ /-]\d{5,8}(?![\d.,/-]?\d)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "date": r"(?<![\d/-])(?:(?:19|20)\d{2}-\d{2}-\d{2}|\d{2}/\d{2}/(?:19|20)\d{2})(?![\d/-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _mixed(key: str, kind: str, *parts: Column, digits: int = 15) -> Column:
    """A keyed number below 16 ** digits."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long")


def _rounds(invert: bool) -> Column:
    steps = range(ROUNDS - 1, -1, -1) if invert else range(ROUNDS)
    return F.array(*(F.lit(i) for i in steps))


def feistel(a: Column, b: Column, side_a: Column, side_b: Column, key: str, kind: str, tweak: Column, invert: bool) -> Column:
    """A keyed permutation of the pairs 0 <= a < side_a, 0 <= b < side_b, as struct x, y."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"), side_a.cast("long").alias("m"), side_b.cast("long").alias("n"))

    def forward(s: Column, i: Column) -> Column:
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + _mixed(key, kind, tweak, i, s["y"]), s["m"]).alias("y"), s["n"].alias("m"), s["m"].alias("n"))

    def back(s: Column, i: Column) -> Column:
        return F.struct(F.pmod(s["y"] - _mixed(key, kind, tweak, i, s["x"]), s["n"]).alias("x"), s["x"].alias("y"), s["n"].alias("m"), s["m"].alias("n"))

    return F.aggregate(_rounds(invert), start, back if invert else forward)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permute_digits(digits: Column, key: str, kind: str, invert: bool) -> Column:
    """Another digit string of the same length (2 to 36 digits)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda e: F.rpad(F.lit("1"), e + 1, "0").cast("long")
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, n)
    out = feistel(left, right, power(half), power(n - half), key, kind, n, invert)
    joined = lambda s: F.concat(F.lpad(s["x"].cast("string"), half, "0"), F.lpad(s["y"].cast("string"), n - half, "0"))
    return F.element_at(F.transform(F.array(out), joined), 1)


def place_digits(text: Column, digits: Column) -> Column:
    """The text with its digits, in order, replaced by others."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(text, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last counted once."""
    from_end = F.split(F.reverse(digits), "")
    each = F.transform(from_end, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def valid_card(text: Column) -> Column:
    digits = digits_of(text)
    return (luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$")


def _card(text: Column, key: str, invert: bool) -> Column:
    digits = digits_of(text)
    body = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", invert)
    whole = F.transform(F.array(body), lambda d: F.concat(d, F.pmod(-luhn_sum(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")))
    return place_digits(text, F.element_at(whole, 1))


def _phone(text: Column, key: str, invert: bool) -> Column:
    """The last ten digits are permuted, the country code stays."""
    digits = digits_of(text)
    n = F.length(digits)
    return place_digits(text, F.concat(F.substr(digits, F.lit(1), n - 10), permute_digits(F.substr(digits, n - 9, F.lit(10)), key, "phone", invert)))


def _abroad(text: Column, key: str, invert: bool) -> Column:
    """All digits after the country code are permuted."""
    digits, code = digits_of(text), F.regexp_extract(text, r"^\+(\d+)", 1)
    return place_digits(text, F.concat(code, permute_digits(F.substr(digits, F.length(code) + 1, F.length(digits)), key, "phone_abroad", invert)))


def _trunk(text: Column, key: str, invert: bool) -> Column:
    """All digits after the leading 0 are permuted."""
    digits = digits_of(text)
    return place_digits(text, F.concat(F.lit("0"), permute_digits(F.substr(digits, F.lit(2), F.length(digits)), key, "phone_trunk", invert)))


def _ipv6(text: Column, key: str, invert: bool) -> Column:
    """Digits stay digits and letters a to f letters, in groups of the same lengths."""
    return permute_characters(text, key, "ipv6", invert, letters=6)


def _ip(text: Column, key: str, invert: bool) -> Column:
    part = F.split(text, r"\.")
    number = lambda i: F.element_at(part, i + 1).cast("int") * 256 + F.element_at(part, i + 2).cast("int")
    out = feistel(number(0), number(2), F.lit(65_536), F.lit(65_536), key, "ip", F.lit(0), invert)
    dotted = lambda s: F.concat_ws(".", *(x for v in ("x", "y") for x in (F.floor(s[v] / 256).cast("string"), (s[v] % 256).cast("string"))))
    return F.element_at(F.transform(F.array(out), dotted), 1)


def _mod97(text: Column) -> Column:
    """A string of digits and A-Z (as 10 to 35), modulo 97."""

    def step(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def valid_iban(text: Column) -> Column:
    return _mod97(F.concat(F.substr(text, F.lit(5), F.length(text)), F.substr(text, F.lit(1), F.lit(4)))) == 1


def _iban(text: Column, key: str, invert: bool) -> Column:
    """Country and kinds of characters stay; the check digits are made anew."""
    country, rest = F.substr(text, F.lit(1), F.lit(2)), F.substr(text, F.lit(5), F.length(text))
    body = permute_characters(rest, key, "iban", invert)
    check = lambda r: F.lpad((98 - _mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0")
    return F.element_at(F.transform(F.array(body), lambda r: F.concat(country, check(r), r)), 1)


def _day(text: Column) -> Column:
    """The date, or null if there is no such day; of two readings of d/d/y day first."""
    year, low, high = F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)
    iso = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    return F.when(text.like("____-%"), F.try_to_date(text, "yyyy-MM-dd")).otherwise(F.coalesce(iso(year, low, high), iso(year, high, low)))


def _date(text: Column, key: str, invert: bool) -> Column:
    """Dates by day number, in their format. Month-first dates are those that can only be read so, with a day
    from 13; they stay such dates: days to 28 move by (month of all years, day), later ones by the year, leap days
    by the leap year."""
    a, b = DAY_SIDES
    one = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    day = F.datediff(_day(text), F.lit("1900-01-01").cast("date"))
    moved = feistel(F.floor(day / b), day % b, F.lit(a), F.lit(b), key, "date", F.lit(0), invert)
    date = F.date_add(F.lit("1900-01-01").cast("date"), one(moved, lambda s: (s["x"] * b + s["y"]).cast("int")))
    year, low, high = F.substring(text, 7, 4).cast("int"), F.substring(text, 4, 2).cast("int"), F.substring(text, 1, 2).cast("int")
    early = feistel((year - 1900) * 12 + high - 1, low - 13, F.lit(2400), F.lit(16), key, "date", F.lit(1), invert)
    late = feistel(F.floor((year - 1900) / 10), year % 10, F.lit(20), F.lit(10), key, "date", F.concat_ws("/", high.cast("string"), low.cast("string")), invert)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    early = one(early, lambda s: F.concat_ws("/", two(s["x"] % 12 + 1), two(s["y"] + 13), (F.floor(s["x"] / 12) + 1900).cast("string")))
    late = one(late, lambda s: F.concat(F.substring(text, 1, 6), (s["x"] * 10 + s["y"] + 1900).cast("string")))
    nth = ((year - 1904) / 4).cast("int")  # of the 49 leap years
    leap = feistel(F.floor(nth / 7), nth % 7, F.lit(7), F.lit(7), key, "date", F.lit(2), invert)
    leap = one(leap, lambda s: F.concat(F.substring(text, 1, 6), (s["x"] * 28 + s["y"] * 4 + 1904).cast("string")))
    month_first = F.when((high == 2) & (low == 29), leap).when(low <= 28, early).otherwise(late)
    return F.when(text.like("____-%"), F.date_format(date, "yyyy-MM-dd")).when(low > 12, month_first).otherwise(F.date_format(date, "dd/MM/yyyy"))


def _ssn(text: Column, key: str, invert: bool) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(text, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    first = (area - 1 - (area > 666).cast("int")) * 99 + group - 1
    out = feistel(first, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", F.lit(0), invert)

    def written(s: Column) -> Column:
        rank = F.floor(s["x"] / 99) + 1
        area = rank + (rank >= 666).cast("int")
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((s["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["y"] + 1).cast("string"), 4, "0"))

    return F.element_at(F.transform(F.array(out), written), 1)


def permute_characters(text: Column, key: str, kind: str, invert: bool, letters: int = 26) -> Column:
    """Another string with the same kinds of characters: digits, the first small and capital ``letters``, and accented
    small letters stay within their kind, other characters stay themselves."""
    chars = F.split(text, "")
    base = lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).when(c.between("à", "ö"), 224).when(c.between("ø", "ÿ"), 248).otherwise(F.ascii(c))
    radix = lambda c: F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), letters).when(c.between("à", "ö"), 23).when(c.between("ø", "ÿ"), 8).otherwise(1)
    values, sides = F.transform(chars, lambda c: (F.ascii(c) - base(c)).cast("long")), F.transform(chars, lambda c: radix(c).cast("long"))
    n = F.size(chars)
    half = F.floor(n / 2).cast("int")
    cut = lambda x: (F.slice(x, F.lit(1), half), F.slice(x, half + 1, n))
    (xa, xb), (ra, rb) = cut(values), cut(sides)
    start = F.struct(xa.alias("x"), xb.alias("y"), ra.alias("m"), rb.alias("n"))
    said = lambda x: F.concat_ws(",", F.transform(x, lambda v: v.cast("string")))

    def forward(s: Column, i: Column) -> Column:
        moved = F.transform(s["x"], lambda v, j: F.pmod(v + _mixed(key, kind, n, i, j, said(s["y"]), digits=8), F.element_at(s["m"], j + 1)))
        return F.struct(s["y"].alias("x"), moved.alias("y"), s["n"].alias("m"), s["m"].alias("n"))

    def back(s: Column, i: Column) -> Column:
        moved = F.transform(s["y"], lambda v, j: F.pmod(v - _mixed(key, kind, n, i, j, said(s["x"]), digits=8), F.element_at(s["n"], j + 1)))
        return F.struct(moved.alias("x"), s["x"].alias("y"), s["n"].alias("m"), s["m"].alias("n"))

    out = F.aggregate(_rounds(invert), start, back if invert else forward, lambda s: F.concat(s["x"], s["y"]))
    return F.concat_ws("", F.transform(F.arrays_zip(out.alias("v"), chars.alias("c")), lambda p: F.when(radix(p["c"]) == 1, p["c"]).otherwise(F.chr((base(p["c"]) + p["v"]).cast("long")))))


def _email(text: Column, key: str, invert: bool) -> Column:
    """The local part is permuted, the domain stays."""
    return F.concat(permute_characters(F.substring_index(text, "@", 1), key, "email", invert), F.lit("@"), F.substring_index(text, "@", -1))


def kind_of(text: Column) -> Column:
    """The kind of a candidate that is valid, else null."""
    whole = lambda kind: text.rlike(rf"\A(?:{PATTERNS[kind]})\z")
    octets = F.forall(F.split(text, r"\."), lambda o: o.cast("int") <= 255)
    digits = digits_of(text)
    ssn = ~digits.rlike("^(000|666|9)|^...00|0000$")
    chosen = F.when(whole("email"), "email").when(whole("phone"), "phone")
    for kind, least, most in (("phone_abroad", 8, 15), ("phone_trunk", 8, 12)):
        chosen = chosen.when(whole(kind), F.when(F.length(digits).between(least, most), kind))
    chosen = chosen.when(whole("ipv6"), "ipv6").when(whole("ip"), F.when(octets, "ip"))
    chosen = chosen.when(whole("card"), F.when(valid_card(text), "card")).when(whole("ssn"), F.when(ssn, "ssn"))
    return chosen.when(whole("iban"), F.when(valid_iban(text), "iban")).when(whole("date"), F.when(_day(text).isNotNull(), "date"))


def pseudonymise(df: DataFrame, key: str, invert: bool = False, text_col: str = "text") -> DataFrame:
    """``df`` with the text rewritten, and a column ``pii`` of what was replaced: array of (kind, value).

    ``value`` is the pseudonym. A null text stays null and an empty one empty, with no replacements. Each row is
    rewritten by itself, and columns other than the text pass through; a column named ``pii`` is replaced.
    With ``invert`` and the same key the pseudonyms become the values again.
    """
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    makers = {"email": _email, "ssn": _ssn, "phone": _phone, "phone_abroad": _abroad, "phone_trunk": _trunk, "ipv6": _ipv6, "ip": _ip, "card": _card, "iban": _iban, "date": _date}

    def mapped(m: Column) -> Column:
        kind = kind_of(m)
        new = F.when(kind.isNull(), F.lit(None).cast("string"))
        for name, make in makers.items():
            new = new.when(kind == name, make(m, key, invert))
        return F.struct(F.when(new.isNotNull(), kind).alias("kind"), F.coalesce(new, m).alias("value"))

    work = df.withColumn("__found", F.transform(found, mapped))
    pieces = F.split(text, ANY, -1)
    rebuilt = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), F.col("__found.value").alias("v")), lambda z: F.array(z["p"], z["v"]))))
    some = F.coalesce(F.size("__found"), F.lit(0)) > 0
    kept = F.filter("__found", lambda x: x["kind"].isNotNull())
    none = F.array().cast("array<struct<kind:string,value:string>>")
    out = work.withColumn("pii", F.when(some, kept).otherwise(none)).withColumn(text_col, F.when(some, rebuilt).otherwise(text))
    return out.drop("__found")


def session_key(spark) -> str:
    """The secret of ``spark.sparrowdex.pseudonym.key``. Where it isn't set a random one is made for the session, so values are
    linked within it but by no later one, and can't be inverted after it."""
    name = "spark.sparrowdex.pseudonym.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(16))
    return spark.conf.get(name)


def op5_pseudonyms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key=session_key(spark))
