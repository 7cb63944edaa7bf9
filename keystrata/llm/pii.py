"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates are validated, mapped to a pair of residues, and the pair is permuted by a keyed
Feistel network: each round adds a keyed hash of one half to the other, modulo the half's size, so the
network is a bijection of exactly the valid values. Equal values get equal pseudonyms in every document,
different ones different pseudonyms. Separators stay where they were.

    card       13 to 19 digits with a valid check digit: the payload is permuted, the check digit made anew
    ssn        ddd-dd-dddd with a valid area, group and serial: within the valid ones
    phone      the ten digits after an optional country code
    ip         IPv4 with valid octets: all 32 bits
    date       yyyy-mm-dd, valid, 1800 to 2199: the day among the 146,097 of 400 years
               dd/mm/yyyy, valid: the same days, written day first
               mm/dd/yyyy that is no valid dd/mm/yyyy: the 88,497 days after the 12th, written month first

Each line is closed under its permutation: a date that can be read day first stays one, so no two dates share
a pseudonym. Mail addresses and secrets have no such format; they get keyed hashes of the same shape. Values
that are not valid, such as digits with a wrong check digit, an address with an octet of 300 or the 31st of
April, stay.

Text is cut once at the matches of one expression and put together again from the pieces between and the
pseudonyms, so every row is handled in place: no exchange, no join, no Python.

Edge cases: a null text stays null; an empty one stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import unused

ROUNDS = 10

# The shapes that are looked for.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
NUMBER = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{8,}|(?:ghp|gho|sk|xox[bp])[_-][A-Za-z0-9_-]{16,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])"
# The plus sign of a phone number and its bracket are looked for before plain digits.
ANY = "|".join([EMAIL, SECRET, IP, DATE, SSN, PHONE, NUMBER])
# Every match of ANY holds a match of this; texts without one are passed by.
HINT = r"[0-9@]|AKIA|(?:ghp|gho|sk|xox[bp])[_-]|[a-f]{32}|[A-F]{32}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digest(key: str, kind: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}/{kind}/"), value), 256)


def feistel(key: str, kind: str, x: Column, y: Column, a: Column, b: Column, finish: Callable[[Column, Column], Column]) -> Column:
    """finish(x', y') of the permuted pair in Z_a x Z_b; a and b are below 2^59."""
    state = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))

    def mixed(r: Column, half: Column, size: Column) -> Column:
        text = F.concat_ws("/", r.cast("string"), a.cast("string"), b.cast("string"), half.cast("string"))
        return F.pmod(F.conv(F.substring(digest(key, kind, text), 1, 14), 16, 10).cast("long"), size)

    def step(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, state(F.pmod(s["x"] + mixed(r, s["y"], a), a), s["y"])).otherwise(state(s["x"], F.pmod(s["y"] + mixed(r, s["x"], b), b)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state(x, y), step, lambda s: finish(s["x"], s["y"]))


def padded(n: Column, width: Column) -> Column:
    return F.lpad(n.cast("string"), width, F.lit("0"))


def power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """Another string of as many digits: two to 36."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    x, y = F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1, rest).cast("long")
    return feistel(key, kind, x, y, power_of_ten(half), power_of_ten(rest), lambda p, q: F.concat(padded(p, half), padded(q, rest)))


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """The check sum modulo 10; double_last doubles the last digit, as in a payload without its check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when((F.length(digits) - i) % 2 == (0 if double_last else 1), d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order."""
    at = lambda i: F.length(only_digits(F.substr(shape, F.lit(1), i)))
    char = lambda i: F.substr(shape, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(char(i).rlike("[0-9]"), F.substr(digits, at(i), F.lit(1))).otherwise(char(i))), "")


def number(key: str, m: Column) -> Column:
    """13 to 19 digits: a new payload and its check digit, if the check digit is right."""

    def card(d: Column) -> Column:
        payload = F.substr(d, F.lit(1), F.length(d) - 1)
        return let(permuted_digits(key, "card", payload), lambda p: F.concat(p, ((10 - luhn_sum(p, True)) % 10).cast("string")))

    return let(only_digits(m), lambda d: F.when(luhn_sum(d, False) == 0, refilled(m, card(d))).otherwise(m))


def phone(key: str, m: Column) -> Column:
    def body(d: Column) -> Column:
        code = F.length(d) - 10
        line = permuted_digits(key, "phone", F.substr(d, code + 1, F.lit(10)))
        return F.concat(F.substr(d, F.lit(1), code), line)

    return let(only_digits(m), lambda d: refilled(m, body(d)))


def ssn(key: str, m: Column) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x, y = F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1

    def text(p: Column, q: Column) -> Column:
        return F.concat_ws("-", padded(F.when(p >= 665, p + 2).otherwise(p + 1), F.lit(3)), padded(F.floor(q / 9999) + 1, F.lit(2)), padded(q % 9999 + 1, F.lit(4)))

    return F.when(valid, feistel(key, "ssn", x, y, F.lit(898), F.lit(99 * 9999), text)).otherwise(m)


def ip(key: str, m: Column) -> Column:
    def body(o: Column) -> Column:
        n = lambda i: F.element_at(o, i).cast("int")
        text = lambda p, q: F.concat_ws(".", *[v.cast("string") for v in (F.floor(p / 256), p % 256, F.floor(q / 256), q % 256)])
        valid = (n(1) <= 255) & (n(2) <= 255) & (n(3) <= 255) & (n(4) <= 255)
        return F.when(valid, feistel(key, "ip", n(1) * 256 + n(2), n(3) * 256 + n(4), F.lit(65536), F.lit(65536), text)).otherwise(m)

    return let(F.split(m, r"\."), body)


#: Days after the 12th of a month in 400 years, as 9 x 9,833.
LATE_DAYS = 9 * 9833


def date(key: str, m: Column) -> Column:
    """146,097 days from 1800-01-01, as 27 x 5,411. A slashed date is day first unless only month first is valid."""
    first = F.lit("1800-01-01").cast("date")

    def of(form: str, when: Column) -> Column:
        return F.when(when, F.try_to_date(m, form)) if hasattr(F, "try_to_date") else F.when(when, F.try_to_timestamp(m, F.lit(form)).cast("date"))

    def any_day(form: str) -> Callable[[Column], Column]:
        def build(d: Column) -> Column:
            n = F.date_diff(d, first)
            text = lambda p, q: F.date_format(F.date_add(first, (p * 5411 + q).cast("int")), form)
            return F.when(n.between(0, 146096), feistel(key, "date", F.floor(n / 5411), n % 5411, F.lit(27), F.lit(5411), text))

        return build

    def late_day(d: Column) -> Column:
        """Within the days after the 12th: numbered by leaving the first twelve days of each month out."""
        month = lambda d: (F.year(d) - 1800) * 12 + F.month(d) - 1
        days_before = lambda k: F.date_diff(F.add_months(first, k.cast("int")), first) - 12 * k
        n = days_before(month(d)) + F.dayofmonth(d) - 13

        def text(p: Column, q: Column) -> Column:
            def written(i: Column) -> Column:
                # A month has 18.4369 such days in the mean, and the true one is next to the quotient.
                near = F.floor(i * 4800 / LATE_DAYS).cast("int")
                ks = F.filter(F.sequence(near - 2, near + 2), lambda k: days_before(k) <= i)
                return let(F.array_max(ks), lambda k: F.date_format(F.date_add(F.add_months(first, k), (i - days_before(k) + 12).cast("int")), "MM/dd/yyyy"))

            return let(p * 9833 + q, written)

        return F.when(F.year(d).between(1800, 2199), feistel(key, "late", F.floor(n / 9833), n % 9833, F.lit(9), F.lit(9833), text))

    forms = [("yyyy-MM-dd", m.rlike("-"), any_day("yyyy-MM-dd")), ("dd/MM/yyyy", m.rlike("/"), any_day("dd/MM/yyyy")), ("MM/dd/yyyy", m.rlike("/"), late_day)]
    # A date that can be read day first never comes to the last form: it is out of range in both or in none.
    return F.coalesce(*[let(of(form, when), body) for form, when, body in forms], m)


def email(key: str, m: Column) -> Column:
    """A hashed local part at a hashed host of the reserved top-level domain."""
    low = F.lower(m)
    host = F.regexp_extract(low, "@(.*)$", 1)
    return F.concat(F.lit("u"), F.substring(digest(key, "mail", low), 1, 12), F.lit("@h"), F.substring(digest(key, "host", host), 1, 8), F.lit(".invalid"))


def secret(key: str, m: Column) -> Column:
    """A keyed hash of the same length; the case and a known prefix stay."""
    h = F.concat(digest(key, "secret", m), digest(key, "secret2", m), digest(key, "secret3", m), digest(key, "secret4", m))
    prefix = F.regexp_extract(m, r"^(AKIA|(?:ghp|gho|sk|xox[bp])[_-])", 1)
    body = F.substr(F.rpad(h, F.greatest(F.length(m), F.lit(256)), h), F.lit(1), F.length(m) - F.length(prefix))
    return F.concat(prefix, F.when(m == F.upper(m), F.upper(body)).otherwise(body))


def _is(m: Column, shape: str) -> Column:
    return m.rlike(f"^(?:{shape})$")


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of one match."""
    return (
        F.when(m.contains("@"), email(key, m))
        .when(_is(m, IP), ip(key, m))
        .when(_is(m, DATE), date(key, m))
        .when(_is(m, SSN), ssn(key, m))
        .when(_is(m, PHONE), phone(key, m))
        .when(_is(m, NUMBER), number(key, m))
        .otherwise(secret(key, m))
    )


def pseudonymize(text: Column, key: str) -> Column:
    """The text with all personal data replaced, as struct(text, found)."""
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    gaps = F.split(text, ANY, -1)

    def joined(ms: Column) -> Column:
        def built(rs: Column) -> Column:
            whole = F.array_join(F.zip_with(gaps, F.concat(rs, F.array(F.lit(""))), lambda g, r: F.concat(g, r)), "")
            changed = F.size(F.filter(F.zip_with(ms, rs, lambda m, r: m != r), lambda x: x))
            return F.struct(F.when(F.size(ms) == 0, text).otherwise(whole).alias("text"), changed.alias("found"))

        return let(F.transform(ms, lambda m: pseudonym(key, m)), built)

    plain = F.struct(text.alias("text"), F.lit(0).alias("found"))
    return F.when(text.rlike(HINT), let(matches, joined)).otherwise(plain)


def pii_columns(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with its text replaced and n_pii, the number of values replaced, added (an existing n_pii is replaced)."""
    rest = docs.drop("n_pii")
    both = unused(rest.columns, "_pii")
    out = rest.withColumn(both, pseudonymize(F.col(text), key))
    return out.withColumns({text: F.col(both)["text"], "n_pii": F.coalesce(F.col(both)["found"], F.lit(0))}).drop(both)


def pii_stage(docs: DataFrame, key: str) -> DataFrame:
    """All documents, with pseudonyms; n_chars follows the text. Columns stay as they are."""
    out = docs.withColumn("text", pseudonymize(F.col("text"), key)["text"])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
