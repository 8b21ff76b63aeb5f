"""Literal cases of the text functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls


def value(spark, function, *args):
    schema = ", ".join(f"c{i} string" for i in range(len(args)))
    df = spark.createDataFrame([args], schema)
    return df.select(function(*(F.col(f"c{i}") for i in range(len(args)))).alias("x")).first().x


@pytest.mark.parametrize(("text", "expected"), [
    ("pay of $90,000.00/yr - $120,000.00/yr", (90000, 120000, "USD", "YEAR")),
    ("£20 to £30 per hour", (20, 30, "GBP", "HOUR")),
    ("from €55k", (55000, None, "EUR", "YEAR")),
    ("win a $25 voucher", None),
    ("no numbers", None),
])
def test_salary(spark, text, expected):
    found = value(spark, T.salary, text)
    assert (tuple(found) if found else None) == expected


@pytest.mark.parametrize(("text", "expected"), [
    ("Hybrid or remote", "hybrid"), ("fully REMOTE", "remote"), ("this is not a remote job", None), ("work from the office", "onsite"),
    ("on site", "onsite"), ("remotely", None), ("", None),
])
def test_workplace(spark, text, expected):
    assert value(spark, T.workplace_type, text) == expected


@pytest.mark.parametrize(("place", "country", "hint"), [
    ("Wien, Österreich", "AT", "AT"), ("Austin, TX", None, "US"), ("Toronto, ON", None, "CA"), ("DE", "DE", "US"), ("London, UK", "UK", "GB"),
    ("Nowhere", None, None), (" , ", None, None), (None, None, None),
])
def test_country(spark, place, country, hint):
    assert value(spark, lambda c: T.country(c, F.lit(None).cast("string")), place) == country
    assert value(spark, T.country_hint, place) == hint
    assert value(spark, lambda c: T.country(c, F.lit("fr")), place) == "FR"


def test_phones(spark):
    text = "Telefon: +49 30 1234567, Rückfragen 030/7654321; Тел. 8 495 123-45-67 VAT DE123456789 on 2024-05-06, bare 0171 2345678."
    assert value(spark, T.phones, text) == ["+49 30 1234567", "030/7654321", "8 495 123-45-67"]
    assert "0171 2345678" in value(spark, lambda c: T.phones(c, "lenient"), text)
    assert value(spark, T.phones, "") == []


def test_emails_urls_and_profiles(spark):
    assert value(spark, T.emails, "A@B.io, a@b.io x@cdn.png y@mail.example.com") == ["a@b.io"]
    assert value(spark, T.urls, "HTTP://A.io:80/x#y http://a.io/x/ https://www.gstatic.com/q") == ["http://a.io/x"]
    found = value(spark, T.social_profiles, "https://mastodon.social/@a https://x.com/b https://x.com/c")
    assert found.twitter == ["https://x.com/b"] and found.mastodon == ["https://mastodon.social/@a"] and found.github == []
    assert value(spark, T.mailto, "mailto:Jobs@A.io?subject=x") == "jobs@a.io"


def test_skills_in_dictionary_order(spark):
    text = "node.js, SQL and C#. Golang/Go; dbt on Docker, machine learning (ML), not javascripted"
    assert value(spark, T.skills, text) == ["C#", "dbt", "Docker", "Go", "Machine Learning", "Node.js", "SQL"]


def test_html_text(spark):
    assert value(spark, T.strip_tags, "<p>a&amp;lt;b</p>\n\n\n\n<b>c</b>&nbsp;d") == "a<b\n\nc d"
    assert value(spark, T.without_query, "https://a/b?c=1") == "https://a/b"
    assert value(spark, T.without_query, "") is None


def test_dates_and_money(spark):
    assert value(spark, T.iso_date, "2024-02-03") == "2024-02-03T00:00:00.000Z"
    assert value(spark, T.iso_date, "soon") is None
    assert value(spark, lambda a, b: T.salary_range(a.cast("long"), b.cast("long"), F.lit("CHF")), "1000", "2000") == "CHF 1,000–CHF 2,000"


@pytest.mark.parametrize(("text", "expected"), [
    ("HTTP 429", "rate_limit"), ("server said 502", "server_error"), ("ETIMEDOUT", "timeout"), ("socket hang up", "network"), ("?", "other"),
])
def test_error_class(spark, text, expected):
    assert value(spark, T.error_class, text) == expected


def plain_phones(text):
    """The numbers of a text by one search for each prefix, link and international form."""
    flags = lambda p: re.compile(p.replace(r"\z", r"\Z"))
    for noise in (r"(?i)\b(?:ATU|DE|FR)[0-9]{8,12}\b", r"(?a)\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", r"(?a)\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}\b"):
        text = re.sub(noise, " ", text, flags=re.ASCII)
    found = [m.group() for m in flags(T.PHONE_INTERNATIONAL).finditer(text)] + [m[1] for m in flags(T.PHONE_SCHEME).finditer(text)]
    for prefix in T.PHONE_PREFIXES:
        found += [m.group(m.re.groups) for m in flags(prefix + T._BODY).finditer(text)]
    tidy = {re.sub(r"\.+$", "", re.sub(r"\s+", " ", p).strip()) for p in found}
    good = lambda p: 7 <= len(re.sub("[^0-9]", "", p)) <= 15 and not re.fullmatch(r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}", p)
    return sorted(filter(good, tidy))


def test_phones_in_one_pass_equal_one_search_for_each_prefix(spark):
    draw = random.Random(7)
    words = ["Tel", "tel:", "Telefon", "TÉLÉPHONE", "Mobile", "contact", "Contact us at", "call", "dial on", "M:", "(WA: ", "HP：", "טל.", "电话：", "联系电话", "هاتف", "الجوال", "تماس",
             "شماره تماس:", "Тел.", "МОБ", "звоните", "전화:", "電話：", "फोन", "ĐT:", "Số điện thoại", "SĐT", "Fale conosco", "İrtibat", "wa.me/", "Kontakt T:", "xTel", "cep",
             "rückfragen", ":", ".", " ", "\n", "-", ",", "and", "DE123456789", "2024-01-02", "12.03.2024", "(", ")", "+", "00"]
    number = lambda: "".join(draw.choice("0123456789") + draw.choice(["", "", "", " ", "-", "/", ". ", " ("]) for _ in range(draw.randint(3, 18)))
    texts = ["".join(draw.choice([draw.choice(words) + draw.choice([" ", "", ": "]), number() + " "]) for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    found = {r.text: r.phones for r in rows.select("text", T.phones(F.col("text")).alias("phones")).collect()}
    wrong = [(t, found[t], plain_phones(t)) for t in texts if sorted(found[t]) != plain_phones(t)]
    assert not wrong, wrong[:3]
    assert sum(map(bool, found.values())) > 500


@pytest.mark.parametrize(("raw", "found"), [
    ("Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05T10:00:00.000Z"), ("Mar 5, 2024 10:00 GMT+2", "2024-03-05T08:00:00.000Z"), ("2024/3/5", "2024-03-05T00:00:00.000Z"),
    ("5 March 2024", "2024-03-05T00:00:00.000Z"), ("march 5 2024", "2024-03-05T00:00:00.000Z"), ("3/5/2024 12:30 AM", "2024-03-05T00:30:00.000Z"),
    ("3/5/99", "1999-03-05T00:00:00.000Z"), ("5-Mar-24 12:00 PM PST", "2024-03-05T20:00:00.000Z"), ("Sept 5, 2024 at 7:05:09.5 -03:30", "2024-09-05T10:35:09.500Z"),
    ("Tue Mar 05 2024 10:00:00 GMT+0200 (CEST)", "2024-03-05T08:00:00.000Z"), ("Feb 31 2024", "2024-03-02T00:00:00.000Z"), ("Mon. Jan. 1, 2024", "2024-01-01T00:00:00.000Z"),
    ("2024-03-05", "2024-03-05T00:00:00.000Z"), ("2024-03-05T10:00:00+02:00", "2024-03-05T08:00:00.000Z"),
    ("Mar 2024", None), ("soon", None), ("", None), ("32 Mar 2024", None), ("13/5/2024", None), ("0/5/2024", None), ("Mar 5, 2024 13:00 PM", None), ("Mar 5, 2024 10:60", None),
    ("Mar 5, 2024 extra", None), ("Foo 5, 2024", None), ("5/6/7/8", None), ("2024/3/5/1", None), ("Mar 5, 2024 +99", None), (None, None),
])
def test_dates_in_other_forms(spark, raw, found):
    row = spark.createDataFrame([(raw,)], "x string").select(T.date_of(F.col("x")).alias("y"))
    assert row.first().y == found


def test_punycode_equals_the_codec(spark):
    draw = random.Random(11)
    pool = "abz09-" + "äößéñ" + "жшя" + "例日本" + "ليه" + "😀𝒳"
    labels = sorted({"".join(draw.choice(pool) for _ in range(draw.randint(1, 30))) for _ in range(400)} - {""})
    got = spark.createDataFrame([(x,) for x in labels], "x string").select("x", urls.punycode(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got if any(ord(c) > 127 for c in r.x)} == {x: x.encode("punycode").decode() for x in labels if any(ord(c) > 127 for c in x)}


@pytest.mark.parametrize(("raw", "found"), [
    ("http://A.example/../../b/./c/..", "http://a.example/b"), ("http://a.example/a/%2E%2e/b", "http://a.example/b"), ("http://a.example/.a/..b/...", "http://a.example/.a/..b/..."),
    ("http://a.example/a\\b c`{}", "http://a.example/a/b%20c%60%7B%7D"), ("https://a.example:443?x='\"<", "https://a.example/?x=%27%22%3C"), ("http://a.example:/", "http://a.example"),
    ("https://u:P@A.example/", "https://u:P@a.example"), ("http://faß.example/%zz", "http://xn--fa-hia.example/%zz"), ("ftp://A.example/", "ftp://A.example"), ("", ""),
    ("http://" + "ä" * 50 + ".example/" + "é" * 3_000, "http://" + "xn--" + ("ä" * 50).encode("punycode").decode() + ".example/" + "%C3%A9" * 3_000),
])
def test_urls_as_browsers_write_them(spark, raw, found):
    assert spark.createDataFrame([(raw,)], "x string").select(urls.normal_url(F.col("x")).alias("y")).first().y == found


@pytest.mark.parametrize(("raw", "found"), [
    ("https://A.example/p?b=2&utm_source=x&a=1#f", "https://a.example/p?a=1&b=2"), ("https://a.example/p/?trk=1", "https://a.example/p/"), ("https://a.example?", "https://a.example/"),
    ("https://a.example/?q=a%20b+c&q=%zz&&x", "https://a.example/?q=a+b+c&q=%25zz&x="), ("https://a.example/?a=b=c&A=1&B=2&á=3", "https://a.example/?a=b%3Dc&A=1&%C3%A1=3&B=2"),
    ("junk", "junk"), ("", ""),
])
def test_canonical_urls(spark, raw, found):
    assert spark.createDataFrame([(raw,)], "x string").select(urls.canonical_url(F.col("x")).alias("y")).first().y == found
