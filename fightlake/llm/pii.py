r"""Format-preserving Feistel pseudonyms for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, telephone numbers, payment cards, IBANs, US social security numbers, IPv4
addresses, calendar dates and hexadecimal secrets. A match is replaced only if it is valid (Luhn, mod 97, calendar, ranges);
then a keyed permutation of its format replaces it, so equal values get equal pseudonyms in every document and different
ones different pseudonyms, and the result is valid again:

* Characters: a Feistel network of ``ROUNDS`` rounds over the two halves of the string. A half is added to a
  keystream from SHA-256 of key, round and other half, position by position within its alphabet (digits, a-z, A-Z, accented
  letters of each case, or hexadecimal digits). Signs stay where they are.
  E-mail addresses keep their domain; local parts that differ in case are different ones. Hexadecimal runs go through in
  parts of 64 digits.
* Telephone numbers: the digits after the country code are permuted and put back into the notation, so one number in several
  notations stays linked, with or without its country code.
* Cards and IBANs: the payload is permuted so, then the check digits are computed anew.
* Dates and social security numbers: the value's number in its range, as a pair of residues, goes through a Feistel
  network with modular sums, so every result is a date (or number) of the range. A date keeps its notation, so one date
  in two notations stays linked.

No shuffle, no Python on executors; documents without digits or ``@`` are passed by.

Defined cases: null text stays null with counts of 0; empty text, repeated rows and any number of matches need no
special treatment; invalid look-alikes stay; a null doc_id stays; an empty table gives an empty result; other columns
pass through, but for the counts, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: A key for trials; in production the caller gives a secret one.
TRIAL_KEY = "trial-key"

#: Alphabets that characters are permuted within.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ")
HEX = ("0123456789abcdef",)
#: Dates 1800-01-01 to 2199-12-31 are 189 * 773 days; social security numbers 898 * 99 * 9999.
#: Fixed value: country codes of the international numbering plan (those not named here have three digits).
COUNTRY = r"\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
FIRST_DAY, DAYS, SSNS = "1800-01-01", (189, 773), (898 * 99, 9999)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What a match of each kind looks like. A match is of the first kind whose pattern it is.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![\d.,/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d|\.\d)",
}


def _pattern() -> str:
    """One pattern for all kinds, with names for the groups that are referred to."""
    card = KINDS["card"].replace(r"([ -])\d{4}\1\d{4}\1", r"(?<a>[ -])\d{4}\k<a>\d{4}\k<a>").replace(r"([ -])\d{6}\2", r"(?<b>[ -])\d{6}\k<b>")
    return "|".join([*(p for k, p in KINDS.items() if k != "card"), card])


PATTERN = _pattern()


def _full(kind: str, m: Column) -> Column:
    return m.rlike(rf"\A(?:{KINDS[kind]})\z")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once (in a lambda, an expression is worked out wherever it stands)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stream(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(digest: Column, at: Column | int = 1, digits: int = 12) -> Column:
    return F.conv(F.substr(digest, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("long")


def _mapped(text: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """Each character of ``text`` (with its place from 0) through ``fn``."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: fn(F.substr(text, i + 1, F.lit(1)), i)), "")


def _added(half: Column, digest: Column, alphabets: tuple[str, ...]) -> Column:
    def char(c: Column, i: Column, digest: Column) -> Column:
        shift = _number(digest, 1 + 2 * (i % 32), 2)
        out = c
        for alphabet in reversed(alphabets):
            place = F.instr(F.lit(alphabet), c)
            out = F.when(place > 0, F.substr(F.lit(alphabet), ((place - 1 + shift) % len(alphabet) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return _let(digest, lambda d: _let(half, lambda h: _mapped(h, lambda c, i: _let(c, lambda x: char(x, i, d)))))


def permuted(text: Column, key: str, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """The keyed permutation of ``text`` among the strings of its form."""

    def run(t: Column) -> Column:
        middle = (F.length(t) / 2).cast("int")
        start = F.struct(F.substr(t, F.lit(1), middle).alias("l"), F.substr(t, middle + 1, F.length(t)).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))

    def step(acc: Column, i: Column) -> Column:
        return F.struct(acc["r"].alias("l"), _added(acc["l"], _stream(key, i, F.length(acc["l"]), acc["r"]), alphabets).alias("r"))

    return _let(text, run)


def permuted_number(n: Column, sizes: tuple[int, int], key: str) -> Column:
    """The keyed permutation of a number below ``sizes[0] * sizes[1]``."""
    a, b = sizes

    def step(acc: Column, i: Column) -> Column:
        def right(left: Column) -> Column:
            return F.struct(left.alias("l"), ((acc["r"] + _number(_stream(key, i, F.lit("r"), left))) % b).alias("r"))

        return _let((acc["l"] + _number(_stream(key, i, F.lit("l"), acc["r"]))) % a, right)

    def run(n: Column) -> Column:
        start = F.struct((n / b).cast("long").alias("l"), (n % b).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda acc: acc["l"] * b + acc["r"])

    return _let(n, run)


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 for a valid card."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = F.when(i % 2 == 1, d * 2).otherwise(d)
        return acc + F.when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits`` in order."""
    return _mapped(form, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, F.length(F.regexp_replace(F.substr(form, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c))


def _card(m: Column, key: str) -> Column:
    def checked(payload: Column) -> Column:
        return _let(F.concat(payload, F.lit("0")), lambda p: F.concat(payload, ((F.lit(10) - _luhn(p) % 10) % 10).cast("string")))

    def run(digits: Column) -> Column:
        new = _let(permuted(F.substr(digits, F.lit(1), F.length(digits) - 1), f"{key}/card"), checked)
        return F.when(_luhn(digits) % 10 == 0, _let(new, lambda n: _refilled(m, n)))

    return _let(F.regexp_replace(m, "[^0-9]", ""), run)


def _mod97(text: Column) -> Column:
    """The rest by 97 of the number that letters and digits (A is 10) write."""

    def add(acc: Column, i: Column) -> Column:
        place = F.instr(F.lit(ALPHABETS[0] + ALPHABETS[2]), F.substr(text, i + 1, F.lit(1))) - 1
        return F.when(place > 9, (acc * 100 + place) % 97).otherwise((acc * 10 + place) % 97)

    return F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    country = F.substr(m, F.lit(1), F.lit(2))

    def renewed(new: Column) -> Column:
        number = _let(F.concat(new, country, F.lit("00")), _mod97)
        spaced = _let(F.substr(m, F.lit(5), F.length(m)), lambda rest: _mapped(rest, lambda c, i: F.when(c == " ", c).otherwise(F.substr(new, F.length(F.replace(F.substr(rest, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))))
        return F.concat(country, F.lpad((F.lit(98) - number).cast("string"), 2, "0"), spaced)

    def run(plain: Column) -> Column:
        rest = F.substr(plain, F.lit(5), F.length(plain))
        valid = _let(F.concat(rest, F.substr(plain, F.lit(1), F.lit(4))), _mod97) == 1
        return F.when(valid, _let(permuted(rest, f"{key}/iban"), renewed))

    return _let(F.replace(m, F.lit(" "), F.lit("")), run)


def _date(m: Column, key: str) -> Column:
    def day(form: str) -> Column:
        return F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))

    def new(day: Column, form: str) -> Column:
        def run(n: Column) -> Column:
            moved = permuted_number(n.cast("long"), DAYS, f"{key}/date").cast("int")
            return F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved), form))

        return _let(day, run)

    # A date with slashes is day first where that is a date, else month first.
    day_first, month_first = new(day("dd/MM/yyyy"), "dd/MM/yyyy"), new(day("MM/dd/yyyy"), "MM/dd/yyyy")
    return F.when(m.contains("-"), new(day("yyyy-MM-dd"), "yyyy-MM-dd")).when(m.contains("/"), F.coalesce(day_first, month_first)).otherwise(new(day("dd.MM.yyyy"), "dd.MM.yyyy"))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))

    def written(n: Column) -> Column:
        new = (n / (99 * 9999)).cast("long")
        parts = ((new + 1 + (new >= 665).cast("long"), 3), ((n / 9999).cast("long") % 99 + 1, 2), (n % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), w, "0") for x, w in parts])

    return _let(permuted_number(((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1, SSNS, f"{key}/ssn"), written)


def _ip(m: Column, key: str) -> Column:
    octets = [F.split(m, r"\.")[i].cast("long") for i in range(4)]
    new = permuted(F.concat(*[F.lpad(F.lower(F.hex(o)), 2, "0") for o in octets]), f"{key}/ip", HEX)
    return _let(new, lambda n: F.concat_ws(".", *[_number(n, 1 + 2 * i, 2).cast("string") for i in range(4)]))


def _hex(m: Column, key: str) -> Column:
    parts = F.regexp_extract_all(F.lower(m), F.lit("[0-9a-f]{1,64}"), F.lit(0))  # each in time that doesn't grow with the run's length
    new = F.array_join(F.transform(parts, lambda p: permuted(p, f"{key}/hex", HEX)), "")
    return _let(new, lambda n: F.when(m == F.lower(m), n).otherwise(F.upper(n)))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permuted(F.substr(m, F.lit(1), at - 1), f"{key}/email"), F.substr(m, at, F.length(m)))


def _phone(m: Column, key: str) -> Column:
    def renewed(code: Column) -> Column:
        rest = F.substr(m, F.length(code) + 1, F.length(m))
        new = permuted(F.regexp_replace(rest, "[^0-9]", ""), f"{key}/phone")
        return F.concat(code, _let(rest, lambda form: _let(new, lambda n: _refilled(form, n))))

    return _let(F.regexp_extract(m, rf"^(?:{COUNTRY}|\+\d{{1,3}})", 0), renewed)


_MAKE = {"email": _email, "hex": _hex, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}
COUNTS = [f"n_{k}" for k in KINDS]


def pseudonymise(docs: DataFrame, key: str = TRIAL_KEY) -> DataFrame:
    """``docs`` with a pseudonym for each valid value in ``text``, and how many there were of each kind."""
    matches = F.when(F.col("row.text").rlike("[0-9@]"), F.regexp_extract_all("row.text", F.lit(PATTERN), F.lit(0)))

    def kind_of(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind in reversed(KINDS):
            out = F.when(_full(kind, m), F.lit(kind)).otherwise(out)
        return out

    def replaced(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind in KINDS:
            out = F.when(m["kind"] == kind, _MAKE[kind](m["was"], key)).otherwise(out)
        return F.struct(m["kind"].alias("kind"), m["was"].alias("was"), out.alias("new"))

    found = F.transform(F.transform("matches", lambda m: F.struct(kind_of(m).alias("kind"), m.alias("was"))), replaced)
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("matches", matches)
    rows = rows.withColumn("found", F.when(F.size("matches") > 0, found))
    pieces = F.zip_with(F.split("row.text", PATTERN, -1), "found", lambda p, f: F.concat(p, F.coalesce(f["new"], f["was"], F.lit(""))))
    rows = rows.withColumn("text", F.when(F.col("found").isNull(), F.col("row.text")).otherwise(F.array_join(pieces, "")))
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in COUNTS]

    def count(kind: str) -> Column:
        held = F.size(F.filter("found", lambda f: (f["kind"] == kind) & f["new"].isNotNull()))
        return F.greatest(F.coalesce(held, F.lit(0)), F.lit(0)).cast("long")

    return rows.select(*kept, *[count(k).alias(n) for k, n in zip(KINDS, COUNTS, strict=True)])
