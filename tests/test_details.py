"""What details bring is computed once, and faster forms of patterns against the plain ones."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import reference_data as ref
from tidemark.functions import text as T
from tidemark.functions.patterns import WS
from tidemark.operators import html as H
from tidemark.operators import postings as P
from tidemark.plans.text_queries import detail_pages

WORDS = ["remote", "Hybrid", "on-site", "on site", "in office", "in-office", "work from the office", "work from office", "not", "isn't", "isn’t", "sql", "SQL.", "node.js", "node.jsx",
         "c#", ".net", "java", "javascript", "machine learning", "machine", "go", "é", "A!", "b?", "c.", "\n", " ", " ", "-", "•", "• ", ",", ""]


def texts():
    draw = random.Random(17)
    return sorted({"".join(w + draw.choice([" ", " ", "", "  ", " "]) for w in draw.choices(WORDS, k=draw.randint(0, 8))) for _ in range(3000)})


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(t,) for t in texts()], "t string").repartition(4).cache()


def found(rows, column):
    return {r.t: r.x for r in rows.select("t", column.alias("x")).collect()}


def seconds(rows, column):
    def once():
        begin = time.monotonic()
        rows.select(column.alias("x")).write.format("noop").mode("overwrite").save()
        return time.monotonic() - begin

    return min(once() for _ in range(3))


def test_skills_of_two_sources_are_found_once(spark):
    text = " ".join(f"word{i} sql and node.js" for i in range(4_000))
    rows = spark.createDataFrame([(text,)] * 20, "t string").repartition(4).cache()
    rows.count()
    one, both = T.skills(F.col("t")), T.merged_skills(F.array(F.lit("Go")), T.skills(F.col("t")))
    assert rows.select(both.alias("x")).first().x == ["Go", "Node.js", "SQL"]
    assert seconds(rows, both) < 8 * seconds(rows, one)


def test_a_filter_on_descriptions_does_not_read_pages_again(spark, small):
    pages = detail_pages(spark, small)
    items = P.as_postings(pages, {"sourceJobId": F.col("sourceJobId")})
    whole = P.with_details(items, H.details(pages)).where("description is not null").select("sourceJobId", "description")
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(H.DESCRIPTION) == 1 and whole.count() == pages.count()


def test_workplaces_are_those_of_the_plain_patterns(rows):
    word = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    has = lambda p, t: re.search(p.replace("B", word), t, re.ASCII)

    def plain(t):
        t = t.lower()
        if has("BhybridB", t):
            return "hybrid"
        if has("BremoteB", t) and not has(rf"B(?:no|not|non|never|isn['’]?t|aren['’]?t|without)B[{WS}A-Za-z0-9_]{{0,12}}BremoteB", t):
            return "remote"
        return "onsite" if has(rf"Bon[-{WS}]?siteB|Bin[-{WS}]officeB|Bwork from (?:the )?officeB", t) else None

    got = found(rows, T.workplace_type(F.col("t")))
    assert got == {t: plain(t) for t in texts()} and len(set(got.values())) == 4


def test_skills_are_those_of_one_search_for_each_term(rows):
    def plain(t):
        t = " " + re.sub("[^a-z0-9+#.]+", " ", t.lower()) + " "
        own = {T.skill_label(s) for s in ref.SKILL_TERMS if re.search(f"(?<= ){re.escape(s)}(?=[ .])", t)}
        return [label for label in T._LABELS if label in own]

    assert found(rows, T.skills(F.col("t"))) == {t: plain(t) for t in texts()}


def test_first_sentences_end_at_the_first_stop(rows):
    def plain(t):
        first = re.split(f"(?<=[.!?])[{WS}]+", re.sub(f"[{WS}]+", " ", t).strip(" "))[0]
        return re.sub(f"^[-•·–][{WS}]*", "", first)

    assert found(rows, T.first_sentence(F.col("t"))) == {t: plain(t) for t in texts()}


def test_the_first_match_of_a_page_counts(spark):
    page = ('<div class="show-more-less-html__markup">  One<br>two</div> <button><div class="show-more-less-html__markup">Three</div><button>'
            '<span class="posted-time-ago__text"> </span><span class="posted-time-ago__text">2 days ago</span><figcaption class="num-applicants__caption">1,200</figcaption>')
    both = H.details(spark.createDataFrame([("a", page), ("b", "<p>x</p>"), ("c", None)], "id string, html string")).orderBy("id").collect()
    assert [(r.id, r.description, r.descriptionHtml, r.postedRelative, r.applicantCount) for r in both] == [
        ("a", "One two", "One<br>two", None, 1200), ("b", None, None, None, None), ("c", None, None, None, None)]


def test_posters_with_missing_parts(spark):
    start = '<div class="message-the-recruiter">'
    name, link = '<h3 class="base-main-card__title"><!--x--> A &amp;amp; <b>B</b> </h3>', '<a class="base-card__full-link" href="https://a.example/p?a=1&amp;b"></a>'
    empty, photo = '<h3 class="base-main-card__title"> </h3>', '<img data-delayed-url="https://i.example/?a&amp;b">'
    pages = [name, link, empty + photo, start + name, start + empty + link + photo, start + empty + photo, start + link.replace("a.example", "b.example") + link, ""]
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, html string").select("id", H.poster(F.col("html")).alias("p")).orderBy("id").collect()
    assert [r.p and tuple(r.p) for r in rows] == [
        None, None, None, ("A & B", None, None, None), (None, None, "https://a.example/p?a=1&amp;b", "https://i.example/?a&b"), None,
        (None, None, "https://b.example/p?a=1&amp;b", None), None]


@pytest.mark.parametrize(("tags", "promoted", "easy"), [
    ("", False, False), ("<b>Promoted</b>", True, False), ("<b>Easy</b><i>Apply</i>", False, False), ("<b>Easy Apply</b>Promoveret", True, True),
    ('<i title="Promoted Easy Apply">', False, False), ("NotPromoted Easy Applyx", False, False)])
def test_words_of_cards(spark, tags, promoted, easy):
    card = f'<li><div data-entity-urn="urn:li:jobPosting:1"><a class="base-card__full-link" href="?q">{tags}</a></div></li>'
    row = H.cards(spark.createDataFrame([(card,)], "html string")).first()
    assert (row.isPromoted, row.isEasyApplyOnCard, row.jobUrl, row.companyUrl) == (promoted, easy, "", None)


@pytest.mark.parametrize(("text", "expected"), [
    ("$1,000.50k – 2m to $9 per year", (1_000_500, 2_000_000, "USD", "YEAR")), ("€20/hr to 30K", (20, 30_000, "EUR", "HOUR")), ("£5 to £4", (4, 5, "GBP", "HOUR")),
    ("€7 an hour | £9", (7, None, "EUR", "HOUR")), ("pay $5|$6", None), (None, None)])
def test_groups_of_pay(spark, text, expected):
    found = spark.createDataFrame([(text,)], "t string").select(T.salary(F.col("t")).alias("x")).first().x
    assert (tuple(found) if found else None) == expected
