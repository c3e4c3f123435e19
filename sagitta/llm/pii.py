"""Personal data: format-preserving Feistel pseudonyms, in DataFrame operations alone.

What is found: e-mail addresses, telephone numbers, payment card numbers (13 to 19 digits with a right check digit),
US social security numbers and IBANs (validated), IPv4 addresses (numbers up to 255) and IPv6 addresses (whole ones, or with
one gap), dates that exist (day, month and year in the usual orders, also before a time) and secrets: whatever of 16
characters or more stands after a name such as token, client_secret or API_KEY, of any length and also if it looks like
a number. Telephone numbers after a plus sign may be in groups of any size; one with a single dot is taken for a decimal
number.

All kinds are permuted by keyed Feistel networks within their format, so equal values stay equal in all documents and
different ones stay different: a card becomes another card of as many digits and the same separators with a right check
digit, a date another date that exists, written alike; secrets and the names in e-mail addresses are permuted character by
character, digits among digits and letters among letters. An e-mail address ends in the reserved domain ``example``, so that it is
nobody's; letters' case does not tell addresses apart. Whoever knows the key can turn all of this back: the key comes from the session's setting
``spark.sagitta.pseudonyms.key``. Without it a key that anyone can read here is used, which hides nothing from them.

A text is cut at the matches of one pattern; what lies between stays byte for byte. Null texts stay null; empty texts, an
empty table, repeated rows and very long texts need no special care; all other columns, whatever their names, are passed through.
"""

from __future__ import annotations

import calendar
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.llm.common import fresh, let, read

KEY_SETTING, OPEN_KEY = "spark.sagitta.pseudonyms.key", "pseudonyms-1"
ROUNDS = 6

#: A secret's name and what stands before its value.
NAME = r"(?i:token|secret|password|passwd|apikey|api_key|api-key|access_key|key)\s{0,3}[=:]\s{0,3}[\"']?"
#: One pattern for each kind, in the order in which they are tried at a place.
PATTERNS = {
    "secret": rf"(?<![\p{{L}}\p{{N}}]){NAME}[A-Za-z0-9+/_=-]{{16,}}+(?:\.[A-Za-z0-9+/_=-]{{8,}}+)*+(?![\w.+-]{{0,64}}@)",
    "email": r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_+-](?:[\p{L}\p{N}_.+-]{0,62}[\p{L}\p{N}_+-])?@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}_-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{2,39}(?![\w:]|\.[0-9])",
    "date": r"(?<![\w.-])(?:(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|(?:19|20)[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})(?=T[0-9]{2}:|(?![\w-]|[.][0-9]))",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![\w-]|\.[0-9])|(?<![\w.+-])\+(?![0-9]+\.[0-9]+(?![ .-]?[0-9]))[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]){6,12}(?![\w-]|\.[0-9])",
    "card": r"(?<![\w.-])[0-9]{4}(?:[ -]?[0-9]){9,15}(?![\w-]|\.[0-9])",
}
ANY = "|".join(PATTERNS.values())
#: No match without one of these.
HINT = r"@|[0-9]{4}|[0-9]\.[0-9]|\+[0-9]|:[0-9A-Fa-f]{0,4}:|(?i:token|secret|passw|key)"
KINDS = list(PATTERNS)


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, OPEN_KEY)


def keyed(key: str, turn: Column, *parts: Column) -> Column:
    """64 hexadecimal digits of SHA-256 over the key, the round and the parts."""
    return F.sha2(F.concat_ws(":", F.lit(key), turn.cast("string"), *(p.cast("string") for p in parts)), 256)


def network(pair: Column, left: Callable[[Column, Column], Column], right: Callable[[Column, Column], Column], rounds: int) -> Column:
    """A Feistel network over a struct of l and r: in turn l becomes left(pair, turn) and r becomes right(pair, turn)."""
    def turned(p: Column, turn: Column) -> Column:
        return F.when(turn % 2 == 0, F.struct(left(p, turn).alias("l"), p.r.alias("r"))).otherwise(F.struct(p.l.alias("l"), right(p, turn).alias("r")))

    return F.aggregate(F.array(*(F.lit(k) for k in range(rounds))), pair, turned)


def feistel(value: Column, left: Column, right: Column, tag: Column, key: str, rounds: int = ROUNDS) -> Column:
    """value, a whole number under left * right (both up to 2**31), permuted within that domain.

    In turn each part has a keyed value of the other added, modulo its own size: an unbalanced network that needs no
    walk outside the domain. The keyed value has 60 bits and depends on the tag, which names the format.
    """
    value_of = lambda half, turn: F.conv(F.substring(keyed(key, turn, tag, half), 1, 15), 16, 10).cast("long")
    pair = F.struct(F.floor(value / right).cast("long").alias("l"), F.pmod(value, right).cast("long").alias("r"))
    out = network(pair, lambda p, t: F.pmod(p.l + value_of(p.r, t), left).cast("long"), lambda p, t: F.pmod(p.r + value_of(p.l, t), right).cast("long"), rounds)
    return let(out, lambda p: p.l * right + p.r)


#: Alphabets within which single characters are permuted.
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
STEP = 4


def _shifted(text: Column, stream: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moved on within its alphabet by the stream's next four hexadecimal digits; others stay."""
    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(stream, i * STEP + 1, F.lit(STEP)), 16, 10).cast("int")
        chain = None
        for a in alphabets:
            at = F.position(c, F.lit(a))
            moved = F.substr(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))) + 1, F.lit(1))
            chain = F.when(F.lit(a).contains(c), moved) if chain is None else chain.when(F.lit(a).contains(c), moved)
        return chain.otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def permuted_text(text: Column, tag: str, key: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER), rounds: int = ROUNDS) -> Column:
    """A text of any length permuted among those of its format: of each place's alphabet, other characters as they are.

    A Feistel network over the two halves: each character of one half moves on within its alphabet by keyed values of the other half.
    """
    def moved(part: Column, other: Column, turn: Column) -> Column:
        size = F.length(part)
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) * STEP / 64).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda b: keyed(key, turn, F.lit(tag), size, b, other)), "")
        return let(stream, lambda s: _shifted(part, s, alphabets))

    half = F.floor(F.length(text) / 2).cast("int")
    pair = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    out = network(pair, lambda p, t: moved(p.l, p.r, t), lambda p, t: moved(p.r, p.l, t), rounds)
    return let(out, lambda p: F.concat(p.l, p.r))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(digits: Column, tag: str, key: str) -> Column:
    """A string of 1 to 18 digits permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2)
    left, right = F.pow(F.lit(10.0), n - half).cast("long"), F.pow(F.lit(10.0), half).cast("long")
    return F.lpad(feistel(digits.cast("long"), left, right, F.concat(F.lit(tag), n.cast("string")), key).cast("string"), n, "0")


def in_format(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by digits, in order."""
    places = F.transform(F.split(shape, ""), lambda c: F.struct(c.alias("c"), c.rlike("^[0-9]$").alias("d")))
    put = lambda s, x: F.struct(F.concat(s.out, F.when(x.d, F.substring(digits, s.n, F.lit(1))).otherwise(x.c)).alias("out"), (s.n + x.d.cast("int")).alias("n"))
    return F.aggregate(places, F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), put, lambda s: s.out)


def check_sum(digits: Column, double_last: bool) -> Column:
    """The sum of the digits with every other one doubled (and cast out nines) from the end on."""
    first = 1 if double_last else 0
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * F.when((i + first) % 2 == 1, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def is_card(text: Column) -> Column:
    d = digits_of(text)
    return F.length(d).between(13, 19) & (F.length(F.regexp_replace(d, "(.)\\1*", "$1")) > 1) & (check_sum(d, False) % 10 == 0)


def new_card(text: Column, key: str) -> Column:
    """Another number with a right check digit. The first digit of 19 stays, so that the rest has a bounded domain."""
    def made(d: Column) -> Column:
        kept = F.when(F.length(d) > 18, F.substring(d, 1, 1)).otherwise("")
        body = F.concat(kept, permuted_digits(F.substr(d, F.length(kept) + 1, F.length(d) - F.length(kept) - 1), "card", key))
        return let(body, lambda b: F.concat(b, ((10 - check_sum(b, True) % 10) % 10).cast("string")))

    return in_format(text, let(digits_of(text), made))


def is_ip(text: Column) -> Column:
    return F.forall(F.split(text, "\\."), lambda p: p.cast("int") <= 255)


def new_ip(text: Column, key: str) -> Column:
    """Another address: the four numbers as one of 32 bits."""
    number = F.aggregate(F.split(text, "\\."), F.lit(0).cast("long"), lambda a, b: a * 256 + b.cast("long"))
    out = feistel(number, F.lit(65536).cast("long"), F.lit(65536).cast("long"), F.lit("ip"), key)
    return let(out, lambda x: F.concat_ws(".", *(F.pmod(F.shiftright(x, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0))))


def is_ipv6(text: Column) -> Column:
    """Eight groups, or fewer around one gap; of five hexadecimal digits at least, so that a time or ``1::2`` is none."""
    groups = F.filter(F.split(text, ":"), lambda g: g != "")
    gaps = F.size(F.regexp_extract_all(text, F.lit("(::)"), F.lit(1)))
    shape = F.when(gaps == 0, (F.size(groups) == 8) & ~text.rlike("^:|:$")).otherwise((gaps == 1) & F.size(groups).between(2, 7) & ~text.rlike(":::|^:[^:]|[^:]:$"))
    return shape & F.forall(groups, lambda g: F.length(g) <= 4) & (F.length(F.array_join(groups, "")) >= 5) & text.rlike("[0-9]")


def new_ipv6(text: Column, key: str) -> Column:
    """Another address with groups and gap alike, in lower case."""
    return permuted_text(F.lower(text), "ipv6", key, (HEX,))


def padded_digits(text: Column) -> Column:
    """The digits of a date, its day and month in two each."""
    return F.concat_ws("", F.transform(F.split(text, "[./-]"), lambda p: F.lpad(p, F.greatest(F.length(p), F.lit(2)), "0")))


def is_month_first(text: Column) -> Column:
    """Whether only reading the month first gives a date: then the second number is above 12."""
    return ~text.rlike("^[0-9]{4}") & (F.substring(padded_digits(text), 3, 2) > "12")


def date_of(text: Column) -> Column:
    """The date, null if there is none such: year first as it stands; else day first, or month first if only that exists."""
    def read_as(d: Column) -> Column:
        first, day, month = (F.try_to_timestamp(d, F.lit(f)) for f in ("yyyyMMdd", "ddMMyyyy", "MMddyyyy"))
        return F.when(text.rlike("^[0-9]{4}"), first).otherwise(F.coalesce(day, F.when(is_month_first(text), month))).cast("date")

    return let(padded_digits(text), read_as)


#: Dates are permuted among the days from 1900 to 2099.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1900-01-01", 49, 1490
#: Month and day of all days above the 12th but 29 February.
LATE_DAYS = [f"{m:02}{d:02}" for m in range(1, 13) for d in range(13, calendar.monthrange(1901, m)[1] + 1)]


def month_first_date(d: Column, key: str) -> Column:
    """MMddyyyy with a day above 12, permuted among such dates, as no date with the day first is written like one of them.

    29 February is permuted among the 49 leap years of the two centuries.
    """
    year, long = F.substring(d, 5, 4).cast("long") - 1900, lambda n: F.lit(n).cast("long")
    late = F.split(F.lit(",".join(LATE_DAYS)), ",")
    leap = let(feistel(F.floor(year / 4).cast("long") - 1, long(7), long(7), F.lit("leap"), key), lambda x: F.concat(F.lit("0229"), (1904 + 4 * x).cast("string")))
    value = year * len(LATE_DAYS) + F.array_position(late, F.substring(d, 1, 4)) - 1
    other = let(feistel(value, long(200), long(len(LATE_DAYS)), F.lit("late"), key), lambda x: F.concat(F.element_at(late, (F.pmod(x, long(len(LATE_DAYS))) + 1).cast("int")), (1900 + F.floor(x / len(LATE_DAYS))).cast("string")))
    return F.when(F.substring(d, 1, 4) == "0229", leap).otherwise(other)


def new_date(text: Column, key: str) -> Column:
    """Another date from 1 January 1900 on, among 73,010 days, written alike: without leading zeros if one is missing."""
    number = F.datediff(date_of(text), F.lit(FIRST_DAY).cast("date")).cast("long")
    out = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(number, F.lit(DAYS_LEFT).cast("long"), F.lit(DAYS_RIGHT).cast("long"), F.lit("date"), key).cast("int"))
    digits = F.when(text.rlike("^[0-9]{4}"), F.date_format(out, "yyyyMMdd")).when(is_month_first(text), month_first_date(padded_digits(text), key)).otherwise(F.date_format(out, "ddMMyyyy"))

    def written(d: Column) -> Column:
        sizes = F.when(text.rlike("^[0-9]{4}"), F.array(F.lit(4), F.lit(2), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(2), F.lit(4)))
        starts = F.when(text.rlike("^[0-9]{4}"), F.array(F.lit(1), F.lit(5), F.lit(7))).otherwise(F.array(F.lit(1), F.lit(3), F.lit(5)))
        parts = F.zip_with(starts, sizes, lambda a, n: F.substr(d, a, n))
        short = text.rlike("(?<![0-9])[0-9](?![0-9])")
        marks = F.regexp_extract_all(text, F.lit("([./-])"), F.lit(1))
        shown = F.transform(parts, lambda p: F.when(short, F.regexp_replace(p, "^0", "")).otherwise(p))
        return F.concat_ws("", F.zip_with(shown, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))))

    return let(digits, written)


def is_ssn(text: Column) -> Column:
    return ~text.rlike("^(000|666|9)|-00-|-0000$")


def new_ssn(text: Column, key: str) -> Column:
    """Another valid number: area 1 to 899 but 666, group 1 to 99, serial 1 to 9999."""
    area = F.substring(text, 1, 3).cast("long")
    value = ((area - 1 - (area > 666).cast("long")) * 99 + F.substring(text, 5, 2).cast("long") - 1) * 9999 + F.substring(text, 8, 4).cast("long") - 1
    out = feistel(value, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), F.lit("ssn"), key)

    def made(x: Column) -> Column:
        a = F.floor(x / (99 * 9999)).cast("long") + 1
        parts = (a + (a >= 666).cast("long"), F.pmod(F.floor(x / 9999), F.lit(99)) + 1, F.pmod(x, F.lit(9999)) + 1)
        return F.concat_ws("-", *(F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4), strict=True)))

    return let(out, made)


def _mod97(text: Column) -> Column:
    letters = F.split(F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4)), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(letters, F.lit(0), lambda a, c: let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def is_iban(text: Column) -> Column:
    return _mod97(F.replace(text, F.lit(" "), F.lit(""))) == 1


def new_iban(text: Column, key: str) -> Column:
    """The country and the letters stay; the digits of the account, in runs of up to 18, are permuted, the check is made anew."""
    def made(flat: Column) -> Column:
        body = F.substr(flat, F.lit(5))
        digits = digits_of(body)
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(18)), lambda i: let(F.substr(digits, i, F.lit(18)), lambda d: F.when(F.length(d) > 0, permuted_digits(d, "iban", key)).otherwise("")))
        new = F.concat(F.substring(flat, 1, 2), F.lit("00"), in_format(body, F.array_join(blocks, "")))
        return let(new, lambda x: F.concat(F.substring(x, 1, 2), F.lpad((98 - _mod97(x)).cast("string"), 2, "0"), F.substr(x, F.lit(5))))

    flat = let(F.replace(text, F.lit(" "), F.lit("")), made)
    places = F.split(text, "")
    put = lambda s, c: F.when(c == " ", F.struct(F.concat(s.out, c).alias("out"), s.n.alias("n"))).otherwise(F.struct(F.concat(s.out, F.substring(flat, s.n, F.lit(1))).alias("out"), (s.n + 1).alias("n")))
    return F.aggregate(places, F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), put, lambda s: s.out)


def new_phone(text: Column, key: str) -> Column:
    """The country code after a plus sign before a separator stays; up to 15 further digits are permuted."""
    def made(lead: Column) -> Column:
        rest = F.substr(text, F.length(lead) + 1)
        return F.concat(lead, in_format(rest, permuted_digits(F.substring(digits_of(rest), 1, 18), "phone", key)))

    return let(F.regexp_extract(text, r"^(\+[0-9]{1,3}[ .(-]+)?", 0), made)


def _permuted_name(text: Column, tag: str, key: str) -> Column:
    """A name in lower case; one with letters beyond a to z by its UTF-8 bytes as hexadecimal digits after ``x-``."""
    plain = let(text, lambda t: permuted_text(t, tag, key))
    return F.when(text.rlike("^[\\x00-\\x7F]*$"), plain).otherwise(F.concat(F.lit("x-"), let(F.lower(F.hex(F.encode(text, "UTF-8"))), lambda t: permuted_text(t, tag + "-bytes", key, (HEX,)))))


def new_email(text: Column, key: str) -> Column:
    """Name and domain, in lower case, are permuted on their own, so equal domains stay equal; the domain moves under ``example``."""
    low = F.lower(text)
    return F.concat(_permuted_name(F.substring_index(low, "@", 1), "name", key), F.lit("@"), _permuted_name(F.substring_index(low, "@", -1), "domain", key), F.lit(".example"))


def new_secret(text: Column, key: str) -> Column:
    """The name stays, the value is permuted character by character."""
    def made(lead: Column) -> Column:
        return F.concat(lead, let(F.substr(text, F.length(lead) + 1), lambda v: permuted_text(v, "secret", key)))

    return let(F.regexp_extract(text, f"^{NAME}", 0), made)


ALWAYS: Callable[[Column], Column] = lambda text: F.lit(True)
CHECKS = {"secret": ALWAYS, "email": ALWAYS, "iban": is_iban, "ipv6": is_ipv6, "date": lambda t: date_of(t).isNotNull(), "ip": is_ip, "ssn": is_ssn, "phone": ALWAYS, "card": is_card}
MADE = {"secret": new_secret, "email": new_email, "iban": new_iban, "ipv6": new_ipv6, "date": new_date, "ip": new_ip, "ssn": new_ssn, "phone": new_phone, "card": new_card}


def kind_of(match: Column) -> Column:
    """The kind of a match of ANY, null if its value fails its validation.

    A secret's match begins with its name, so it is told first and by itself; no two of the other patterns match the same text.
    """
    tests = {
        "secret": match.rlike(f"^{NAME}"),
        "email": match.contains("@"),
        "ipv6": match.rlike("^[0-9A-Fa-f:]*$") & match.contains(":"),
        "date": match.rlike("^(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})$"),
        "ip": match.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"),
        "ssn": match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "iban": match.rlike("^[A-Z]{2}[0-9]{2}"),
        "card": match.rlike("^[0-9]{4}(?:[ -]?[0-9]){9,15}$"),
        "phone": F.lit(True),
    }
    chain = None
    for kind, shape in tests.items():
        value = F.when(CHECKS[kind](match), F.lit(kind))
        chain = F.when(shape, value) if chain is None else chain.when(shape, value)
    return chain


def pseudonym(kind: Column, match: Column, key: str) -> Column:
    chain = None
    for k, make in MADE.items():
        chain = F.when(kind == k, make(match, key)) if chain is None else chain.when(kind == k, make(match, key))
    return chain.otherwise(match)


def pseudonymised(docs: DataFrame, text: str = "text", found: str | None = None, key: str | None = None) -> DataFrame:
    """docs with its text pseudonymised, and, if found is named, a column with the kinds of what was replaced.

    The key is the session's unless one is given.
    """
    key = key or key_of(docs.sparkSession)
    (held,) = fresh(docs, "parts")
    column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    matches = F.regexp_extract_all(column, F.lit(f"({ANY})"), F.lit(1))
    parts = F.when(column.rlike(HINT), F.transform(matches, lambda m: let(kind_of(m), lambda k: F.struct(k.alias("kind"), pseudonym(k, m, key).alias("new")))))
    named = docs.withColumn(held, parts)
    # matches stand between the pieces of the text: piece, match, piece ... piece
    joined = F.concat_ws("", F.zip_with(F.split(F.col(f"`{text}`"), ANY, -1), F.col(f"{held}.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))))
    changed = F.exists(F.col(f"{held}.kind"), lambda k: k.isNotNull())
    out = named.withColumn(text, F.when(F.coalesce(changed, F.lit(False)), joined).otherwise(F.col(f"`{text}`")))
    if found:
        out = out.withColumn(found, F.coalesce(F.filter(F.col(f"{held}.kind"), lambda k: k.isNotNull()), F.array().cast("array<string>")))
    return out.drop(held)


def _same(kind: str) -> Callable[[Column], Column]:
    return lambda k: k == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, and how many values of each kind were replaced."""
    out = pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), found="kinds")
    return out.select("doc_id", "text", *(F.size(F.filter("kinds", _same(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS))
