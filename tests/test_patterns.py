"""Patterns in the forms that Java searches fast, against the plain ones."""

import random
import re
import time

from pyspark.sql import functions as F

from tidemark.functions import patterns
from tidemark.functions import text as T
from tidemark.functions import urls
from tidemark.operators import html as H

CARD = r"""<li[\s\S]*?<div[^>]*data-entity-urn="urn:li:jobPosting:([0-9]+)"[\s\S]*?</li>"""


def test_cards_are_the_matches_of_the_plain_pattern(spark):
    draw = random.Random(3)
    parts = ["<li>", "<li class='a'>", "</li>", "</dd>", "<div>", '<div data-entity-urn="urn:li:jobPosting:7">', '<div data-entity-urn="urn:li:jobPosting:8" '
             'data-entity-urn="urn:li:jobPosting:9"', '<div data-entity-urn="urn:li:jobPosting:">', "\n", "x", ">", "ä\U0001f600"]
    pages = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(4000)]
    rows = spark.createDataFrame([(p,) for p in pages], "html string").repartition(4)
    found = {r.html: (r.blocks, r.ids) for r in rows.select("html", H.card_blocks(F.col("html")).alias("blocks"), F.transform(
        H.card_blocks(F.col("html")), lambda b: F.regexp_extract(b, H.CARD_HEAD, 1)).alias("ids")).collect()}
    wanted = {p: ([m.group() for m in re.finditer(CARD, p)], [m[1] for m in re.finditer(CARD, p)]) for p in pages}
    assert found == wanted and sum(bool(b) for b, _ in found.values()) > 300


def test_a_page_of_many_broken_cards_is_read_in_one_pass(spark):
    card = '<li><div data-entity-urn="urn:li:jobPosting:1"><h3 class="base-search-card__title">x</h3>' + "<p>text</p>" * 60 + "</div></dd>"
    begin = time.monotonic()
    facts = H.page_facts(spark.createDataFrame([(card * 300,)], "html string")).first()
    assert facts.drifted and facts.n_cards == 0 and time.monotonic() - begin < 20


def test_white_space_at_ends_and_within(spark):
    draw = random.Random(5)
    spaces = "\t\n\x0b\f\r \xa0       　﻿"
    texts = ["".join(draw.choices(spaces * 2 + "ab\x85​᠎<!~\x7fé", k=draw.randint(0, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    got = {r.t: (r.a, r.b) for r in rows.select("t", patterns.trimmed(F.col("t")).alias("a"), patterns.squeezed(F.col("t")).alias("b")).collect()}
    assert got == {t: (t.strip(spaces), re.sub(f"[{spaces}]+", " ", t).strip(" ")) for t in texts}


def test_places_end_with_their_last_part(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choices(["Germany", "tx", "UK", ",", ",", " ", "\xa0", "-", "+", "DE", "é"], k=draw.randint(0, 6))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    got = {r.t: (r.tail, bool(r.others)) for r in rows.select("t", T._tail(F.col("t"), lambda t, o: F.struct(t.alias("tail"), o.alias("others"))).alias("x")).select("t", "x.*").collect()}
    for t in texts:
        parts = [p for p in (p.strip(" \xa0") for p in t.split(",")) if p]
        assert got[t] == (parts[-1] if parts else None, len(parts) > 1), ascii(t)


def test_links_end_at_white_space_of_all_kinds(spark):
    text = "a https://x.io/ä?b https://y.io/c\xa0(HTTP://z.io/d)﻿http://w.io/e\x85f"
    found = spark.createDataFrame([(text,)], "t string").select(T.all_matches(F.col("t"), T.URL).alias("u"), T.all_matches(F.col("t"), T.LINK).alias("l")).first()
    assert found.u == found.l == ["https://x.io/ä?b", "https://y.io/c", "HTTP://z.io/d", "http://w.io/e\x85f"]


def test_kept_characters_are_one_set():
    assert not re.search("[a-z0-9]-[a-z0-9]", urls.PATH_KEPT + urls.QUERY_KEPT)
    for kept, plain in ((urls.PATH_KEPT, r"[!$%&'()*+,\-./0-9:;=@A-Z\[\]\\_a-z|~]"), (urls.QUERY_KEPT, r"[!$%&()*+,\-./0-9:;=?@A-Z\[\]\\^_`a-z{|}~]")):
        assert all(bool(re.match(kept, chr(c))) == bool(re.match(plain, chr(c))) for c in range(300))
