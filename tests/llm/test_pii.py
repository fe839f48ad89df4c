import re

from pyspark.sql import functions as F

from cooframe.llm import pii, queries

from .helpers import AWKWARD, docs

SF = "/root/testdata/sf0.01"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def iban(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


CASES = {
    "card 4111 1111 1111 1111, 4111-1111-1111-1111; 4111111111111111": 3, "not a card 4111111111111112": 0, "mail a.b+c.42@Mail.example.com!": 1, "+1 (319) 555-5132 or (319) 555-5132, 319-555-5132": 3, "+1 (152) 555-8590 but not 152-555-8590": 1, "+44 20 7946 0958 +4915112345678": 2,
    "ip 10.0.0.1.": 1, "no ip 1.2.3.4.5 999.1.1.1 1.2.3": 0, "born 1984-02-29, 31.12.1999 and 12/31/1999": 3, "no date 1985-02-29 2250-01-01 2024": 0, "ssn 123-45-6789": 1, "no ssn 666-12-1234 000-12-1234 123-00-1234": 0,
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432": 2, "no IBAN GB83WEST12345698765432": 0, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b9"': 1, "plain text, 12 of 2024; it's \"quoted\" @ all": 0, "é a@b.de日本 4111111111111111日": 2,
}


def test_formats_stay_and_values_change(spark):
    texts = list(CASES)
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, list(enumerate(texts))), "k").collect()}
    for i, t in enumerate(texts):
        assert len(got[i].pii) == CASES[t], t
        assert (got[i].text == t) == (CASES[t] == 0)
        shape = lambda s: re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", s)))
        if "ip" not in t:
            assert shape(got[i].text) == shape(t)
        for m in got[i].pii:
            assert m.kind != "card" or luhn(m.value)
            assert m.kind != "iban" or iban(m.value)
    cards = [re.sub(r"\D", "", m.value) for m in got[0].pii]
    assert len(set(cards)) == 1 and cards[0] in got[16].text


def test_networks_are_permutations(spark):
    for a, b in ((17, 4297), (7, 13), (1, 50), (80, 80)):
        r = spark.range(a * b).select(pii.permuted(F.col("id"), a, b, "k", "t").alias("x")).agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()
        assert tuple(r) == (a * b, 0, a * b - 1)
    r = spark.range(26 * 260).select(F.concat(F.char(97 + F.col("id") % 26), F.lpad(F.floor(F.col("id") / 26).cast("string"), 3, "0")).alias("s")).select(pii.respelled(F.col("s"), "k", "t").alias("x"))
    assert r.distinct().count() == 26 * 260 and r.where(~F.col("x").rlike("^[a-z][0-9]{3}$")).count() == 0


def test_keys_matter_and_runs_agree(spark):
    d = docs(spark, [(1, "4111111111111111 and a@b.de")])
    one, two, other = (pii.pseudonymise(d, k).first().text for k in ("k", "k", "l"))
    assert one == two != other


def test_awkward_rows_and_columns(spark):
    d = docs(spark, AWKWARD)
    got = pii.pseudonymise(d, "k")
    assert set(got.columns) == set(d.columns) and got.count() == len(AWKWARD)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for i, t, *_ in AWKWARD)
    assert pii.pseudonymise(docs(spark, []), "k").collect() == []


def test_whole_table(spark):
    before = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    after = {r.doc_id: r for r in queries.op1_feistel_pseudonyms(spark, SF).collect()}
    assert set(before) == set(after)
    simple = re.compile(r"[\w.+-]+@[\w-]+\.example\.com|\b4\d{15}\b|\+1 \(\d{3}\) \d{3}-\d{4}|token = \"\w+\"|\b(?:\d{1,3}\.){3}\d{1,3}\b")
    found = 0
    for i, t in before.items():
        own = simple.findall(t)
        found += len(own)
        assert all(x not in after[i].text for x in own)
        if not own and not re.search(r"\d{3}", t):
            assert after[i].text == t
    assert found > 50


def test_valid_numbers_beside_other_groups(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9." + "aB3" * 5000
    clear = {
        "4111 1111 1111 1111 123": ("4111 1111 1111 1111", 1), "4111111111111111 12/26": ("4111111111111111", 1), "12 4111111111111111": ("4111111111111111", 1), "987654 4111 1111 1111 1111 2": ("4111 1111 1111 1111", 1), "4111111111111111 5500005555555559": ("5500005555555559", 2),
        "4111 1111 1111 1111 123-45-6789": ("123-45-6789", 2), "4111111111111111 10.0.0.1": ("10.0.0.1", 2), "4111111111111111 2024-05-01": ("2024-05-01", 2), "ES91 2100 0418 4502 0005 1332 EUR": ("2100 0418 4502 0005 1332", 1), "ES9121000418450200051332 100": ("21000418450200051332", 1),
        "AT611904300234573201 BIC": ("1904300234573201", 1), "AB12 ES91 2100 0418 4502 0005 1332": ("2100 0418 4502 0005 1332", 1), f'token = "{jwt}"': (jwt, 1),
    }
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, list(enumerate(clear))), "k").collect()}
    for i, (t, (value, n)) in enumerate(clear.items()):
        assert value not in got[i].text and len(got[i].pii) == n and len(got[i].text) >= len(t) - 6, (t, got[i])
        assert all(m.value in got[i].text for m in got[i].pii)
        assert all((m.kind != "card" or luhn(m.value)) and (m.kind != "iban" or iban(m.value)) for m in got[i].pii)
    assert got[0].text.endswith(" 123") and got[2].text.startswith("12 ") and got[8].text.endswith(" EUR") and got[10].text.endswith(" BIC")


def notations(column, *made):
    return F.concat_ws(" ; ", *made).alias(column)


def test_every_date_in_every_notation(spark):
    """All dates of 200 years, by brute force: one pseudonym a date in all notations, none twice, and every notation stays what it was."""
    import datetime

    forms = {"yyyy-MM-dd": "%Y-%m-%d", "dd.MM.yyyy": "%d.%m.%Y", "MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y"}
    days = spark.range(73_049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    rows = pii.pseudonymise(days.select("day", notations("text", *[F.date_format("day", f) for f in forms])), "k").select("day", F.split("text", " ; ").alias("own")).collect()
    for k in range(4):
        assert len({r.own[k] for r in rows}) == len(rows)
    for r in rows:
        read = [datetime.datetime.strptime(x, f).date() for x, f in zip(r.own[:3], forms.values())]
        assert len(set(read)) == 1 and (read[0].day > 12) == (r.day.day > 12)
        if r.day.day > 12:
            assert datetime.datetime.strptime(r.own[3], "%d/%m/%Y").date() == read[0]


def test_telephone_numbers_in_every_notation(spark):
    area, line = ((F.col("id") * 7919) % 800 + 200).cast("string"), F.lpad((F.col("id") % 10_000).cast("string"), 4, "0")
    marks = (("+1", "", ""), ("+1 (", ") ", "-"), ("", "-", "-"), ("(", ") ", "-"), ("1-", "-", "-"), ("+1.", ".", "."))
    rows = spark.range(20_000).select(notations("text", *[F.concat(F.lit(a), area, F.lit(b), F.lit("555"), F.lit(c), line) for a, b, c in marks]))
    found = [[re.sub(r"\D", "", x)[-10:] for x in r.own] for r in pii.pseudonymise(rows, "k").select(F.split("text", " ; ").alias("own")).collect()]
    assert all(len(set(x)) == 1 and re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", x[0]) for x in found) and len({x[0] for x in found}) == 20_000
    other = spark.range(10_000).select(F.concat(F.lit("(0"), F.lpad((F.col("id") % 100).cast("string"), 2, "0"), F.lit(") 155-"), line).alias("text"))
    found = [r.text for r in pii.pseudonymise(other, "k").collect()]
    assert len(set(found)) == 10_000 and all(re.fullmatch(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", x) and (x[1] in "01" or x[6] in "01") for x in found)


def test_hosts_of_addresses_are_linked_too(spark):
    a, b = (m.value for m in pii.pseudonymise(docs(spark, [(1, "ann@lee.example.org and bob@lee.example.org")]), "k").first().pii)
    assert a.split("@")[1] == b.split("@")[1] != "lee.example.org" and a.endswith(".org")
