"""Queries on text extraction and landed HTML.  HTML is rendered from relational rows, which are the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import html as H
from tidemark.operators import postings as P
from tidemark.plans.postings import SQL, postings, table
from tidemark.plans.registry import query
from tidemark.sources import landing


def _joined(values: Column) -> Column:
    return F.array_join(values, "|")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("""SELECT doc_id, array_to_string(list_distinct(list_sort(list_filter(list_transform(
  regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\\.[a-zA-Z]{2,})+'), lambda x: lower(x)),
  lambda x: NOT regexp_matches(x, '@(.*\\.)?(example|twitter|facebook|linkedin|test|googleapis|cloudflare|wixpress|googletagmanager|google-analytics)\\.com$')))), '|')
  AS emails FROM documents""")
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", _joined(F.array_sort(T.emails(F.col("text")))).alias("emails"))


@query(f"""WITH {SQL} SELECT k, CASE WHEN k % 4 = 0 THEN 'hr' || c_custkey || '@corp.example.org' ELSE '' END AS emails FROM base""")
def posting_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.coalesce(T.emails(F.col("description")), F.array().cast("array<string>"))
    return postings(spark, sf_dir).select("k", _joined(found).alias("emails"))


def _contact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = (F.lit(1_000_000) + k % 1_000_000).cast("string")
    text = F.concat(
        F.lit("Posted 2024-01-02 by DE123456789. Tel.: 030 "), number, F.lit(", or +43 664 "), F.substring(number, 1, 3), F.lit(" "),
        F.substring(number, 4, 4), F.lit("; bare 0664 "), number, F.lit(" too."),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), number.alias("number"))


_NUMBER = "CAST(1000000 + o_orderkey % 1000000 AS VARCHAR)"
_INTL = f"'+43 664 ' || substr({_NUMBER}, 1, 3) || ' ' || substr({_NUMBER}, 4, 4)"


@query(f"SELECT o_orderkey, {_INTL} || '|030 ' || {_NUMBER} AS phones FROM orders")
def phones_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contact_text(spark, sf_dir).select("o_orderkey", _joined(T.phones(F.col("text"))).alias("phones"))


@query(f"SELECT o_orderkey, {_INTL} || '|030 ' || {_NUMBER} || '|0664 ' || {_NUMBER} AS phones FROM orders")
def phones_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contact_text(spark, sf_dir).select("o_orderkey", _joined(T.phones(F.col("text"), "lenient")).alias("phones"))


@query("""SELECT o_orderkey, 'https://github.com/u' || o_orderkey || '|https://x.com/p' || o_orderkey || '|https://x.com/q' AS urls,
  'https://github.com/u' || o_orderkey AS github, 'https://x.com/q' AS twitter, '' AS xing FROM orders""")
def urls_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("See https://X.com/q/#top, (https://github.com/u"), k, F.lit(") https://cdn.jsdelivr.net/x https://x.com/p"), k,
                    F.lit(". HTTPS://x.com/Q and https://www.linkedin.com/in/a"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    rows = rows.withColumn("social", T.social_profiles(F.col("text"), T.OWN_HOSTS, ("github", "twitter", "xing")))
    return rows.select("o_orderkey", _joined(T.urls(F.col("text"), T.OWN_HOSTS)).alias("urls"),
                       *(_joined(F.col("social")[p]).alias(p) for p in ("github", "twitter", "xing")))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_replace(
  substr(url, length(regexp_extract(url, '^(https?://[^/?#]*)', 1)) + 1), '#.*$', ''), '/+$', ''), '^$', '') AS url FROM pages""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normal_url(F.col("url")).alias("url"))


@query(f"""WITH {SQL} SELECT k, CASE k % 6 WHEN 0 THEN 'SQL' WHEN 1 THEN 'Power Bi' WHEN 2 THEN 'Spark' WHEN 3 THEN 'Project Management'
  WHEN 4 THEN '' ELSE 'Node.js' END AS skills FROM base""")
def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("\n", "title", "description")
    return postings(spark, sf_dir).select("k", _joined(T.skills(text)).alias("skills"))


@query(f"""WITH {SQL} SELECT k, "salaryMin" AS low, "salaryMin" + 5000 AS high, 'USD' AS currency, 'YEAR' AS period FROM base WHERE k % 4 = 0""")
def salary_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings(spark, sf_dir).select("k", T.salary(F.col("description")).alias("s")).where("s is not null")
    return rows.select("k", F.col("s.min").alias("low"), F.col("s.max").alias("high"), "s.currency", "s.period")


@query(f"""WITH {SQL} SELECT k, CASE k % 6 WHEN 2 THEN 'remote' WHEN 5 THEN 'hybrid' ELSE 'none' END AS workplace FROM base""")
def workplace_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("\n", "title", "description")
    return postings(spark, sf_dir).select("k", F.coalesce(T.workplace_type(text), F.lit("none")).alias("workplace"))


@query(f"""WITH {SQL} SELECT k, CASE k % 6 WHEN 0 THEN 'DE' WHEN 1 THEN 'DE' WHEN 2 THEN '-' WHEN 3 THEN 'UK' WHEN 4 THEN 'XX' ELSE '-' END AS country,
  CASE k % 6 WHEN 0 THEN 'DE' WHEN 1 THEN 'DE' WHEN 2 THEN 'US' WHEN 3 THEN 'GB' ELSE '-' END AS hint,
  CASE WHEN k % 2 = 0 THEN 'AT' ELSE CASE k % 6 WHEN 1 THEN 'DE' WHEN 3 THEN 'UK' ELSE '-' END END AS hinted FROM base""")
def country_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, none = F.col("location"), F.lit(None).cast("string")
    dash = lambda c, n: F.coalesce(c, F.lit("-")).alias(n)
    return postings(spark, sf_dir).select(
        "k", dash(T.country(place, none), "country"), dash(T.country_hint(place), "hint"),
        dash(T.country(place, F.when(F.col("k") % 2 == 0, "at")), "hinted"))


@query(f"""WITH {SQL} SELECT k, substr(title || ' · ' || company || ' · ' || location || CASE WHEN description IS NULL THEN '' ELSE ' — We build feeds.' END, 1, 280)
  AS summary FROM base""")
def ai_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return postings(spark, sf_dir).select("k", T.summary(c("title"), c("company"), c("location"), c("description")).alias("summary"))


@query(f"""WITH {SQL} SELECT k, '## ABOUT US' || chr(10) || chr(10) || '- ' || title || chr(10) || '- ' || company || chr(10) || '## What you do'
  || chr(10) || location AS markdown FROM base""")
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("ABOUT US\n\n\n\n• "), "title", F.lit("\n*  "), "company", F.lit("\nWhat you do: \n  "), "location", F.lit("\n\n"))
    return postings(spark, sf_dir).select("k", T.markdown(text).alias("markdown"))


@query(r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '),
  '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_sha FROM pages""")
def html_strip_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text_sha"))


@query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1), lambda x: replace(x, '&amp;', '&')), '|')
  AS links FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", _joined(H.links(F.col("html"))).alias("links"))


def _escaped(c: Column) -> Column:
    return T.escape_slack(F.coalesce(c, F.lit("")))


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages of ten cards rendered from postings: query_ordinal, start, http_status, country_hint, html."""
    rows = postings(spark, sf_dir)
    k = F.col("k")
    card = F.concat(
        F.lit('<li class="c">\n <div class="base-card" data-entity-urn="urn:li:jobPosting:'), k.cast("string"),
        F.lit('" data-tracking-id="t'), (k % 9).cast("string"), F.lit('">\n <a class="x base-card__full-link y" href="'), "jobUrl",
        F.lit('?refId=1&amp;trk=2"></a>\n <h3 class="base-search-card__title">\n  '), _escaped(F.col("title")), F.lit(" &amp; more\n </h3>"),
        F.lit('<h4 class="base-search-card__subtitle"><a class="h" href="'), "companyUrl", F.lit('">\n '), _escaped(F.col("company")),
        F.lit('\n</a></h4><span class="job-search-card__location">'), "location", F.lit('</span><time class="d" datetime="'),
        F.substring("postedAt", 1, 10), F.lit('">x</time>'),
        F.when(k % 3 == 0, '<span class="job-posting-benefits__text"> Early &lt;applicant </span>').otherwise(""),
        F.when(k % 5 == 0, "<b>Promoted</b>").otherwise(""), F.when(k % 7 == 0, "<i>Easy Apply</i>").otherwise(""), F.lit("</div></li>"),
    )
    page = F.floor(k / 40).cast("int")
    cells = rows.select(page.alias("page"), k, card.alias("card"))
    # A page has the cards of forty keys at most.
    pages = cells.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda x: x["card"]), "\n").alias("html"))
    return pages.select(F.col("page").alias("query_ordinal"), F.lit(0).alias("start"), F.lit(200).alias("http_status"),
                        F.lit(None).cast("string").alias("country_hint"), F.concat(F.lit("<ul>"), "html", F.lit("</ul>")).alias("html"))


_CARD_SQL = f"""WITH {SQL} SELECT "sourceJobId", title || ' & more' AS title, company, split_part("companyUrl", '?', 1) AS "companyUrl", location,
  substr("postedAt", 1, 10) AS "postedAtIso", "jobUrl", 't' || (k % 9) AS "trackingId", k % 5 = 0 AS "isPromoted", k % 7 = 0 AS "isEasyApplyOnCard",
  CASE WHEN k % 3 = 0 THEN 'Early <applicant' ELSE '' END AS benefits"""


@query(_CARD_SQL + " FROM base")
def card_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = landing.scan_cards(card_pages(spark, sf_dir))
    return cards.select("sourceJobId", "title", "company", "companyUrl", "location", "postedAtIso", "jobUrl", "trackingId", "isPromoted",
                        "isEasyApplyOnCard", F.coalesce(_joined(F.col("postingBenefits")), F.lit("")).alias("benefits"))


@query(f"""WITH {SQL} SELECT "sourceJobId", sha256('linkedin.com:' || "sourceJobId") AS "jobId", 'supplier-' || (c_custkey % 100) AS "companyId",
  'https://www.linkedin.com/company/supplier-' || (c_custkey % 100) || '/' AS "companyLinkedIn",
  CASE k % 6 WHEN 0 THEN 'DE' WHEN 1 THEN 'DE' WHEN 3 THEN 'UK' WHEN 4 THEN 'XX' ELSE '-' END AS country,
  substr("postedAt", 1, 10) || 'T00:00:00.000Z' AS "postedAt", CASE WHEN k % 7 = 0 THEN 'onsite' ELSE 'unknown' END AS "applyType",
  sha256(concat_ws(chr(10), title || ' & more', company, location, substr("postedAt", 1, 10) || 'T00:00:00.000Z', '')) AS "contentHash"
FROM base""")
def transform_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.transform_cards(landing.scan_cards(card_pages(spark, sf_dir)), "2024-01-01T00:00:00.000Z")
    return rows.select("sourceJobId", "jobId", "companyId", "companyLinkedIn", F.coalesce("country", F.lit("-")).alias("country"),
                       "postedAt", "applyType", "contentHash")


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages rendered from the postings that have a description."""
    rows = postings(spark, sf_dir).where("description is not null")
    k = F.col("k")
    item = lambda label, value: F.concat(
        F.lit('<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">\n ' + label
              + ' </h3><span class="a description__job-criteria-text b">\n '), value, F.lit(" </span></li>"))
    html = F.concat(
        F.lit('<span class="posted-time-ago__text x"> 3 days\n ago </span><figcaption class="num-applicants__caption">Over '),
        F.format_number((k % 5000).cast("double"), 0), F.lit(' applicants</figcaption><div class="show-more-less-html__markup"><p>'),
        _escaped(F.col("description")), F.lit("</p><br>Second&nbsp;line</div>\n<button>Show</button><ul>"),
        item("Seniority level", F.when(k % 3 == 0, "Entry level").otherwise("Director")), item("Employment type", F.lit("Full-time")),
        item("Job function", F.lit("A &amp; B")), item("Industries", F.when(k % 8 == 0, "Remote sensing").otherwise("Other")), F.lit("</ul>"),
        F.when(k % 12 == 0, F.concat(
            F.lit('<div class="message-the-recruiter"><a class="base-card__full-link" href="https://portal.example/in/p'), k.cast("string"),
            F.lit('"></a><img data-delayed-url="https://i.example/a?b&amp;c"><h3 class="base-main-card__title"><!----> Ann &amp; <b>Lee</b> </h3>'
                  '<h4 class="base-main-card__subtitle">Lead</h4></div>'))).otherwise(""),
    )
    return rows.select("sourceJobId", html.alias("html"))


@query(f"""WITH {SQL} SELECT "sourceJobId", description || chr(32) || ' Second line' AS description_, "salaryMin", "salaryMin" + 5000 AS "salaryMax",
  CASE WHEN k % 3 = 0 THEN 'Entry level' ELSE 'Director' END AS "seniorityLevel", 'Full-time' AS "employmentType", 'A & B' AS "jobFunction",
  k % 5000 AS "applicantCount", CASE WHEN k % 8 = 0 THEN 'remote' ELSE '-' END AS "workplaceType", '3 days ago' AS "postedRelative",
  CASE WHEN k % 12 = 0 THEN 'Ann & Lee' ELSE '-' END AS poster, CASE WHEN k % 12 = 0 THEN 'https://i.example/a?b&c' ELSE '-' END AS photo
FROM base WHERE description IS NOT NULL""".replace("description || chr(32) || ' Second line' AS description_", "description || ' Second line' AS description"))
def detail_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = H.details(detail_pages(spark, sf_dir))
    dash = lambda c, n: F.coalesce(c, F.lit("-")).alias(n)
    return d.select("sourceJobId", "description", F.col("salary.min").alias("salaryMin"), F.col("salary.max").alias("salaryMax"), "seniorityLevel",
                    "employmentType", "jobFunction", "applicantCount", dash(F.col("workplaceType"), "workplaceType"), "postedRelative",
                    dash(F.col("poster.name"), "poster"), dash(F.col("poster.photo"), "photo"))


@query(f"""WITH {SQL} SELECT "sourceJobId", description || ' Second line' AS description, "salaryMin", 'description_extract' AS "salarySource",
  'hr' || c_custkey || '@corp.example.org' AS emails, CASE WHEN k % 8 = 0 THEN 'remote' WHEN k % 6 = 2 THEN 'remote' ELSE '-' END AS "workplaceType"
FROM base WHERE description IS NOT NULL""")
def detail_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = P.transform_cards(landing.scan_cards(card_pages(spark, sf_dir)), "2024-01-01T00:00:00.000Z")
    whole = P.with_details(items, H.details(detail_pages(spark, sf_dir)))
    return whole.where("description is not null").select(
        "sourceJobId", "description", "salaryMin", "salarySource", _joined(F.col("extractedEmails")).alias("emails"),
        F.coalesce("workplaceType", F.lit("-")).alias("workplaceType"))


def company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation pages rendered from suppliers: (slug, html)."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    org = F.concat(
        F.lit('{"@type": "Organization", "name": "'), "s_name", F.lit('", "slogan": "We &amp; you", "numberOfEmployees": {"value": '),
        (key * 3).cast("string"), F.lit('}, "logo": {"contentUrl": "https://l.example/'), key.cast("string"),
        F.lit('"}, "address": {"addressLocality": "City '), F.col("s_nationkey").cast("string"), F.lit('", "postalCode": 7}}'),
    )
    wrapped = F.when(key % 3 == 0, F.concat(F.lit('{"@graph": [{"@type": "WebPage"}, '), org, F.lit("]}"))).when(
        key % 3 == 1, F.concat(F.lit("[[1], "), org, F.lit("]"))).otherwise(org)
    html = F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json"> '), wrapped, F.lit(" </script>"))
    return s.select(F.concat(F.lit("supplier-"), key.cast("string")).alias("slug"), html.alias("html"))


@query(f"""WITH {SQL} SELECT k, coalesce(s_name, '-') AS company_name, coalesce(s_suppkey * 3, 0) AS employees, coalesce('City ' || s_nationkey, '-') AS city,
  CASE WHEN s_suppkey IS NULL THEN '-' ELSE 'We & you' END AS slogan, coalesce('https://l.example/' || s_suppkey, '-') AS logo
FROM base LEFT JOIN supplier ON s_suppkey = c_custkey % 100""")
def company_jsonld_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = H.organisations(company_pages(spark, sf_dir))
    rows = postings(spark, sf_dir).withColumns({"company": F.lit(None).cast("string")})
    known = {c: F.col(c) for c in ("sourceJobId", "title", "company", "companyUrl", "location", "jobUrl")}
    items = P.as_postings(rows, known, "k")
    whole = P.with_companies(items, companies)
    dash = lambda c, n: F.coalesce(c, F.lit("-")).alias(n)
    return whole.select("k", dash(F.col("company"), "company_name"), F.coalesce("companyEmployeeCount", F.lit(0)).alias("employees"),
                        dash(F.col("companyAddress.city"), "city"), dash(F.col("companySlogan"), "slogan"), dash(F.col("companyLogo"), "logo"))


@query(f"""WITH {SQL} SELECT k, length(title) AS n_title, description IS NULL AS bare FROM base""")
def json_without_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_fields(postings(spark, sf_dir))


@query(f"""WITH {SQL} SELECT k, length(title) AS n_title, description IS NULL AS bare FROM base""")
def json_without_empty_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """json_without_empty over every posting."""
    return _json_fields(postings(spark, sf_dir))


def _json_fields(rows: DataFrame) -> DataFrame:
    known = {c: F.col(c) for c in ("sourceJobId", "title", "company", "description")}
    shaped = P.without_empty(P.as_postings(rows, known, "k"))
    text = P.as_json(shaped).select(F.col("json"))
    field = lambda n: F.get_json_object("json", f"$.{n}")
    return text.select(field("k").cast("long").alias("k"), F.length(field("title")).cast("long").alias("n_title"),
                       (~F.contains("json", F.lit('"description"'))).alias("bare"))
