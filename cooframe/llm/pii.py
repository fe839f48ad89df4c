"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions alone.

Each kind is found by its form and validated (checksum, ranges, calendar), then
permuted within its format by a keyed Feistel network, so equal values have
equal pseudonyms in every document, whatever notation a telephone number or a
date has, and different values different ones. A date keeps which side of the
12th of its month it is on: then day/month/year stays apart from
month/day/year, and each notation has as many pseudonyms as dates.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
SECRET = r"\b(?i:api[_-]?key|secret[_-]?key|access[_-]?key|token|secret|password|passwd)[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"'][A-Za-z0-9_+/=.-]{8,}[\"']"
#: Length of an IBAN by country.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_OWN = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _LENGTHS.items()) + ")(?![A-Za-z0-9])"
#: Of its country's own length; else of any, up to where one of the former begins.
IBAN = rf"(?<![A-Za-z0-9])(?:{_OWN}|[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_OWN}))?[A-Z0-9]{{4}}){{2,7}}(?:(?:\x20(?!{_OWN}))?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"
NANP = r"(?<![0-9+])\+1[0-9]{10}(?![0-9])|(?<![0-9+])(?:\+1[\x20.-]?(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}|(?:1[\x20.-])?(?:\([0-9]{3}\)[\x20]?[0-9]{3}|[2-9][0-9]{2}[\x20.-][2-9][0-9]{2}))[\x20.-][0-9]{4}(?![0-9])"
PHONE = r"(?<![0-9+])\+(?!1[\x20.(-])[1-9][0-9]{0,2}[\x20.-]?[0-9]{1,4}(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9])|(?<![0-9+])\+[1-9][0-9]{7,14}(?![0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
#: A run of groups of digits, up to where another kind begins; cards are sought within it.
CARD = rf"(?<![0-9])(?=[0-9](?:[\x20-]?[0-9]){{12}})[0-9]++(?:[\x20-](?!{EMAIL}|{DATE}|{SSN}|{IP}|{NANP})[0-9]++)*+"
ANY = "|".join((EMAIL, SECRET, IBAN, DATE, SSN, IP, NANP, PHONE, CARD))
#: A text without any of these characters holds nothing of the above.
GATE = r"""[@0-9"']"""
_AREA = 898  # 001 to 899 without 666


def _whole(x: str) -> str:
    return f"^(?:{x})$"


def _hash(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *parts), 512)


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value made once: a lambda's argument, however often it is used."""
    return F.transform(F.array(value), then)[0]


def permuted(n: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1: quotient and remainder by ``b`` take turns to move by a hash of the other."""

    def turn(s: Column, i: Column) -> Column:
        move = lambda x: F.conv(F.substring(_hash(key, kind, i.cast("string"), x.cast("string")), 1, 15), 16, 10).cast("long")
        left = F.when(i % 2 == 0, F.pmod(s["l"] + F.pmod(move(s["r"]), F.lit(a)), F.lit(a))).otherwise(s["l"])
        right = F.when(i % 2 == 1, F.pmod(s["r"] + F.pmod(move(s["l"]), F.lit(b)), F.lit(b))).otherwise(s["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    n = n.cast("long")
    start = F.struct(F.floor(n / b).cast("long").alias("l"), F.pmod(n, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def respelled(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of strings that keeps each character's class: digit, small or capital letter; others stay.

    The halves take turns to move, character by character, by a hash of the other half.
    """

    def moved(half: Column, other: Column, i: Column) -> Column:
        made = F.concat(_hash(key, kind, i.cast("string"), F.lit("a"), other), _hash(key, kind, i.cast("string"), F.lit("b"), other))

        def all_(stream: Column) -> Column:
            def one(c: Column, at: Column) -> Column:
                by = F.conv(F.substring(stream, (at % 64) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                code = F.ascii(c)
                within = lambda first, n: F.char(F.lit(first) + (code - first + by) % n)
                return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).otherwise(c)

            return F.array_join(F.transform(F.split(half, ""), one), "")

        return _bound(made, all_)

    def turn(s: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, moved(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"))

    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def poured(form: Column, new: Column, slot: str = "[0-9]") -> Column:
    """``form`` with its characters of the class ``slot`` replaced, in order, by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(s: Column, c: Column) -> Column:
        hit = c.rlike(f"^{slot}$")
        return F.struct(F.concat(s["out"], F.when(hit, F.substring(new, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(F.split(form, ""), start, put, lambda s: s["out"])


def _luhn_sum(number: Column, odd: int) -> Column:
    """Luhn sum of digits; every digit whose distance to the last is ``odd`` modulo 2 counts double."""

    def one(d: Column, i: Column) -> Column:
        v = F.ascii(d) - 48
        return F.when(i % 2 == odd, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), one), F.lit(0), lambda s, v: s + v)


def is_card(m: Column) -> Column:
    return _luhn_sum(digits(m), 1) % 10 == 0


def new_card(m: Column, key: str) -> Column:
    """The first digit stays, the check digit follows, the digits between are permuted."""
    n = digits(m)
    body = F.concat(F.substring(n, 1, 1), respelled(F.substring(n, F.lit(2), F.length(n) - 2), key, "card"))
    check = F.pmod(-_luhn_sum(body, 0), F.lit(10)).cast("string")
    return poured(m, F.concat(body, check))


def _part(kind: str | None, value: Column) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("kind"), value.alias("value"))


def card_parts(m: Column, key: str) -> Column:
    """A run of groups of digits as parts: from the left, the longest reading of whole groups with 13 to 19 digits that passes Luhn is a card.

    Readings one after another that are each as long as can be may have groups
    of any size; all others, of which there are many in a table of numbers,
    only groups of three digits or more.
    """

    def within(groups: Column) -> Column:
        reading = lambda i, e: F.rtrim(F.array_join(F.slice(groups, i, e - i + 1), ""), F.lit(" -"))

        def step(s: Column, i: Column) -> Column:
            def at(ends: Column) -> Column:
                fits = F.filter(ends, lambda e: is_card(reading(i, e)) & (((i == s["fresh"]) & (e == ends[0])) | F.forall(F.slice(groups, i, e - i + 1), lambda g: F.length(digits(g)) >= 3)))
                return F.transform(F.array(F.struct(F.get(fits, F.lit(0)).alias("end"), F.get(ends, F.lit(0)).alias("longest"))), put)[0]

            def put(x: Column) -> Column:
                card = reading(i, x["end"])
                rest = F.element_at(groups, x["end"])
                new = F.array(_part("card", new_card(card, key)), _part(None, F.substring(rest, F.length(digits(rest)) + 1, F.lit(1))))
                parts = F.concat(s["parts"], F.when(x["end"].isNotNull(), new).otherwise(F.array(_part(None, F.element_at(groups, i)))))
                skip = F.coalesce(x["end"], i)
                fresh = F.when(x["end"].isNotNull(), x["end"] + 1).when(i == s["fresh"], F.coalesce(x["longest"], i) + 1).otherwise(s["fresh"])
                return F.struct(parts.alias("parts"), skip.alias("skip"), fresh.alias("fresh"))

            ends = F.filter(F.sequence(F.least(i + 18, F.size(groups)), i, F.lit(-1)), lambda e: F.length(digits(reading(i, e))).between(13, 19))
            return F.when(i <= s["skip"], s).otherwise(F.transform(F.array(ends), at)[0])

        start = F.struct(F.array().cast("array<struct<kind:string,value:string>>").alias("parts"), F.lit(0).alias("skip"), F.lit(1).alias("fresh"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda s: s["parts"])

    return F.transform(F.array(F.regexp_extract_all(m, F.lit(r"[0-9]+[\x20-]?"), F.lit(0))), within)[0]


def _iban_rest(country_and_body: Column, check: Column) -> Column:
    """Remainder of an IBAN by 97, its first four places moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substring(country_and_body, F.lit(3), F.length(country_and_body)), F.substring(country_and_body, 1, 2), check)

    def step(s: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (s * 100 + v - 55) % 97).otherwise((s * 10 + v - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _iban_parts(m: Column) -> tuple[Column, Column]:
    flat = F.regexp_replace(m, " ", "")
    return F.concat(F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))), F.substring(flat, 3, 2)


def is_iban(m: Column) -> Column:
    body, check = _iban_parts(m)
    return (_iban_rest(body, check) == 1) & (F.length(body) >= 13)


def new_iban(m: Column, key: str) -> Column:
    """The country stays, the rest is permuted by class, the check digits follow."""
    body, _ = _iban_parts(m)
    new = F.concat(F.substring(body, 1, 2), respelled(F.substring(body, F.lit(3), F.length(body)), key, "iban"))
    check = F.lpad((98 - _iban_rest(new, F.lit("00"))).cast("string"), 2, "0")
    return poured(m, F.concat(F.substring(new, 1, 2), check, F.substring(new, F.lit(3), F.length(new))), "[A-Z0-9]")


def is_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)


def new_ip(m: Column, key: str) -> Column:
    n = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    new = permuted(n, 1 << 16, 1 << 16, key, "ip")
    byte = lambda k: F.pmod(F.shiftright(new, k), F.lit(256)).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def is_ssn(m: Column) -> Column:
    area, group, serial = (F.split(m, "-")[k].cast("int") for k in range(3))
    return (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)


def new_ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[k].cast("long") for k in range(3))
    n = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    new = permuted(n, _AREA, 99 * 9999, key, "ssn")
    area = F.floor(new / (99 * 9999)) + 1
    part = lambda x, k: F.lpad(x.cast("string"), k, "0")
    return F.concat_ws("-", part(area + F.when(area >= 666, 1).otherwise(0), 3), part(F.pmod(F.floor(new / 9999), F.lit(99)) + 1, 2), part(F.pmod(new, F.lit(9999)) + 1, 4))


def new_nanp(m: Column, key: str) -> Column:
    """North American numbers in any notation, by their last ten digits.

    Numbers whose area and exchange begin with 2 to 9 stay such numbers; all
    others, which only +1 or brackets mark, stay others.
    """
    flat = digits(m)
    ten = F.substring(flat, -10, 10)
    area, exchange, line = (F.substring(ten, k, n).cast("long") for k, n in ((1, 3), (4, 3), (7, 4)))
    usual = (area >= 200) & (exchange >= 200)
    inside = lambda n: ((F.floor(n / 8_000_000) + 200) * 1000 + F.pmod(F.floor(n / 10_000), F.lit(800)) + 200) * 10_000 + F.pmod(n, F.lit(10_000))
    inside = _bound(permuted(((area - 200) * 800 + exchange - 200) * 10_000 + line, 80_000, 80_000, key, "nanp"), inside)
    # others: areas below 200 with all exchanges, then the other areas with exchanges below 200
    at = F.when(area < 200, (area * 1000 + exchange) * 10_000 + line).otherwise(2_000_000_000 + ((area - 200) * 200 + exchange) * 10_000 + line)
    rest = lambda n: ((F.floor(n / 2_000_000) + 200) * 1000 + F.pmod(F.floor(n / 10_000), F.lit(200))) * 10_000 + F.pmod(n, F.lit(10_000))
    outside = _bound(permuted(at, 60_000, 60_000, key, "nanp-other"), lambda n: F.when(n < 2_000_000_000, n).otherwise(rest(n - 2_000_000_000)))
    new = F.when(usual, inside).otherwise(outside)
    return poured(m, F.concat(F.substring(flat, F.lit(1), F.length(flat) - 10), F.lpad(new.cast("string"), 10, "0")))


def is_phone(m: Column) -> Column:
    return F.length(digits(m)).between(8, 15)


def new_phone(m: Column, key: str) -> Column:
    """Other international numbers: the first two digits stay."""
    n = digits(m)
    return poured(m, F.concat(F.substring(n, 1, 2), respelled(F.substring(n, F.lit(3), F.length(n)), key, "phone")))


def _day(m: Column) -> Column:
    """The date that a text says, null if none: year-month-day, day.month.year, month/day/year or else day/month/year."""
    parse = lambda form: F.try_to_timestamp(m, F.lit(form)).cast("date")
    return F.when(m.contains("-"), parse("yyyy-MM-dd")).when(m.contains("."), parse("dd.MM.yyyy")).otherwise(F.coalesce(parse("MM/dd/yyyy"), parse("dd/MM/yyyy")))


def is_date(m: Column) -> Column:
    """Real days of 1900 to 2099."""
    return F.coalesce(F.year(_day(m)).between(1900, 2099), F.lit(False))


def _new_day(day: Column, key: str) -> Column:
    """The first 12 days of the 2,400 months are permuted among themselves, and the others among themselves.

    The others are among 2,400 times 19 places, of which few are no days; from
    such a place the permutation goes on to the next (after 24 moves the day
    would stay, with a probability below 1e-30).
    """
    month = (F.year(day) - 1900) * 12 + F.month(day) - 1
    date = lambda mm, d: F.make_date((F.floor(mm / 12) + 1900).cast("int"), (mm % 12 + 1).cast("int"), d.cast("int"))
    days = lambda mm: F.dayofmonth(F.last_day(date(mm, F.lit(1))))
    early = _bound(permuted(month * 12 + F.dayofmonth(day) - 1, 2400, 12, key, "date-early"), lambda n: date(F.floor(n / 12), F.pmod(n, F.lit(12)) + 1))
    there = lambda n: F.pmod(n, F.lit(19)) + 13 <= days(F.floor(n / 19))

    def walk(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(_bound(permuted(s["n"], 2400, 19, key, "date-late"), lambda n: F.struct(n.alias("n"), there(n).alias("done"))))

    start = F.struct((month * 19 + F.dayofmonth(day) - 13).cast("long").alias("n"), F.lit(False).alias("done"))
    late = F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, walk, lambda s: F.when(s["done"], date(F.floor(s["n"] / 19), F.pmod(s["n"], F.lit(19)) + 13)))
    return F.when(F.dayofmonth(day) <= 12, early).otherwise(F.coalesce(late, day))


def new_date(m: Column, key: str) -> Column:
    month_first = F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).isNotNull()
    form = lambda day: F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(m.contains("."), F.date_format(day, "dd.MM.yyyy")).when(month_first, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return _bound(_bound(_day(m), lambda day: _new_day(day, key)), form)


def new_email(m: Column, key: str) -> Column:
    """Local part and host are permuted by class, each on its own; the last label of the host stays."""
    host = F.substring_index(m, "@", -1)
    top = F.substring_index(host, ".", -1)
    inner = F.substring(host, F.lit(1), F.length(host) - F.length(top) - 1)
    return F.concat(respelled(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), respelled(inner, key, "host"), F.lit("."), top)


def new_secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[\"']([^\"']+)[\"']$", 1)
    head = F.regexp_extract(m, r"^(.*?[\"'])[^\"']+[\"']$", 1)
    return F.concat(head, respelled(value, key, "secret"), F.substring(m, -1, 1))


def _kinds(m: Column, key: str) -> list[tuple[str, Column, Column]]:
    is_ = lambda x: m.rlike(_whole(x))
    return [
        ("secret", is_(SECRET), new_secret(m, key)),
        ("email", m.contains("@"), new_email(m, key)),
        ("date", is_(DATE) & is_date(m), new_date(m, key)),
        ("ssn", is_(SSN) & is_ssn(m), new_ssn(m, key)),
        ("ip", is_(IP) & is_ip(m), new_ip(m, key)),
        ("iban", is_(IBAN) & is_iban(m), new_iban(m, key)),
        ("nanp", is_(NANP), new_nanp(m, key)),
        ("phone", m.startswith("+") & is_phone(m), new_phone(m, key)),
    ]


def replacements(text: Column, key: str) -> Column:
    """``array<array<struct<kind, value>>>``: for each candidate in turn its parts, each with kind and pseudonym; kind null where it is not valid and stays."""

    def one(m: Column) -> Column:
        out = None
        for kind, holds, new in _kinds(m, key):
            parts = F.array(_part(kind, new))
            out = F.when(holds, parts) if out is None else out.when(holds, parts)
        return out.when(m.rlike(r"^[0-9][0-9\x20-]*$"), card_parts(m, key)).otherwise(F.array(_part(None, m)))

    return F.when(text.rlike(GATE), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), one))


@lru_cache(maxsize=16)
def _found(_, text: str, key: str) -> Column:
    """The replacements in a column; the expression is large, so one context makes it once."""
    return F.coalesce(replacements(F.col(text), key), F.array().cast("array<array<struct<kind:string,value:string>>>"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the column ``text`` pseudonymised and ``pii array<struct<kind, value>>`` of the values put in.

    E-mail addresses, quoted secrets, IBANs, payment cards (Luhn), dates
    (calendar, 1900 to 2099), social security numbers, IPv4 addresses and
    telephone numbers are replaced; what fails its validation stays, after
    shorter readings of whole groups were tried for a card. A null
    text stays null; an empty one, and one without such data, stays as it is
    and has an empty ``pii``. Rows, their order of columns and all other
    columns stay; a column ``pii`` of the input is replaced. Nothing is
    shuffled.
    """
    column = F.col(text)
    found = docs.withColumn("pii", _found(docs.sparkSession.sparkContext, text, key))
    pieces = F.zip_with(F.split(column, ANY), F.col("pii"), lambda p, m: F.concat(p, F.coalesce(F.array_join(F.transform(m, lambda x: x["value"]), ""), F.lit(""))))
    done = found.withColumn(text, F.when(F.size("pii") > 0, F.array_join(pieces, "")).otherwise(column))
    return done.withColumn("pii", F.filter(F.flatten("pii"), lambda m: m["kind"].isNotNull()))
