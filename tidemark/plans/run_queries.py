"""Queries on whole runs, limits, related pages, shapes, messages, failures, baselines and the rarer forms of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import reference_data as ref
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import changes as C
from tidemark.operators import html as H
from tidemark.operators import ordering
from tidemark.operators import postings as P
from tidemark.operators import statistics as S
from tidemark.plans import pipeline, sinks
from tidemark.plans.postings import NOW, RUNS_SQL, SQL, current_run, postings, prior_state, table
from tidemark.plans.registry import query
from tidemark.plans.spec import RunSpec
from tidemark.plans.text_queries import card_pages, detail_pages
from tidemark.sources import landing, migration, runs, searched, state
from tidemark.sources.shared import new_folder, written

SCRAPED = "2024-01-01T00:00:00.000Z"
#: The cards of card_pages in SQL: page, place in the page, key.
_CARDS_SQL = f"""{SQL}, cards AS (
  SELECT *, CAST(floor(k / 40) AS BIGINT) AS page, row_number() OVER (PARTITION BY floor(k / 40) ORDER BY k) - 1 AS pos FROM base
)"""


def _choice(key: Column, values: list[Column]) -> Column:
    """One of the values, by the key."""
    out = values[-1]
    for i, value in enumerate(values[:-1]):
        out = F.when(key % len(values) == i, value).otherwise(out)
    return out


def _or_dash(value: Column | str, name: str) -> Column:
    return F.coalesce(value, F.lit("-")).alias(name)


@query(f"""WITH {_CARDS_SQL}, p AS (SELECT page, CASE WHEN page % 5 = 0 THEN 0 ELSE count(*) END AS n FROM cards GROUP BY page)
SELECT page, n::INT AS n_cards, n = 10 AS has_next, page % 5 = 0 AS drifted FROM p""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page has markup in which the cards are not found."""
    page = F.col("query_ordinal").cast("long")
    broken = F.when(page % 5 == 0, F.replace("html", F.lit("</li>"), F.lit("</dd>"))).otherwise(F.col("html"))
    pages = card_pages(spark, sf_dir).select(page.alias("page"), broken.alias("html"))
    return H.page_facts(pages).select("page", "n_cards", "has_next", "drifted")


@query(f"""WITH {_CARDS_SQL}, main AS (SELECT *, page * 100000 + pos AS o FROM cards WHERE page % 2 = 0),
seeds AS (SELECT k, row_number() OVER (ORDER BY o) - 1 AS rank FROM main ORDER BY o LIMIT 25),
firsts AS (SELECT page, min(k) AS k FROM main GROUP BY page)
SELECT "sourceJobId", CASE WHEN page % 4 = 0 THEN 'AT' ELSE '-' END AS hint, o AS scan_ordinal FROM main
UNION ALL SELECT c."sourceJobId", '-', 2147483647::BIGINT * 100000 + s.rank * 100 + c.pos FROM cards c JOIN firsts f ON c.page = f.page + 1 JOIN seeds s ON s.k = f.k""")
def related_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages are searched, odd ones are related to the first card of the page before; 25 seeds are followed."""
    pages = card_pages(spark, sf_dir)
    page = F.col("query_ordinal")
    main = pages.where(page % 2 == 0).withColumn("country_hint", F.when(page % 4 == 0, "AT"))
    first = main.select((page + 1).alias("query_ordinal"), F.regexp_extract("html", H.CARD, 1).alias("seed_id"))
    related = pages.where(page % 2 == 1).join(first, "query_ordinal").select("seed_id", "html")
    # A page that is also searched brings nothing new.
    again = main.select(F.regexp_extract("html", H.CARD, 1).alias("seed_id"), "html")
    found = landing.scan_cards(main, 0, related.unionByName(again), 25)
    return found.select("sourceJobId", _or_dash("countryHint", "hint"), "scan_ordinal")


@query(f"""WITH {_CARDS_SQL} SELECT "sourceJobId", k % 4 = 0 AND row_number() OVER (ORDER BY k) <= 200 AS enriched FROM cards""")
def enrichment_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details are looked up for the first 200 postings of the scan."""
    run = RunSpec.from_dict({"keywords": "x", "enrichDetails": True, "maxResults": 200})
    landed = pipeline.Landed(card_pages(spark, sf_dir), detail_pages(spark, sf_dir))
    held: list[DataFrame] = []
    items = pipeline.items_of(run, landed, SCRAPED, held)
    return written(items.select("sourceJobId", F.col("description").isNotNull().alias("enriched")), held)


@query(f"""WITH {_CARDS_SQL}, new AS (SELECT page * 100000 + pos AS emit_order, "sourceJobId", 'NEW' AS "changeType" FROM cards WHERE page % 3 = 0
  ORDER BY k LIMIT 50)
SELECT -1 AS emit_order, "sourceJobId", 'EXPIRED' AS "changeType" FROM cards WHERE page % 3 = 1 UNION ALL SELECT * FROM new""")
def run_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over different pages: what is gone comes first, then the first 50 new postings in scan order."""
    pages = card_pages(spark, sf_dir)
    part = F.col("query_ordinal") % 3
    one = RunSpec.from_dict({"keywords": "x", "incrementalMode": True, "maxResults": 0})
    two = RunSpec.from_dict({"keywords": "x", "incrementalMode": True, "maxResults": 50, "emitExpired": True})
    first = pipeline.run_incremental(one, pipeline.Landed(pages.where(part != 0)), SCRAPED, C.empty_state(spark), C.Coverage(False, "no_prior_state"))
    known = written(first.state, first.held)
    second = pipeline.run_incremental(two, pipeline.Landed(pages.where(part != 1)), NOW, known, C.Coverage(True))
    return written(second.rows.select("emit_order", "sourceJobId", "changeType"), second.held)


@query("""WITH r AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'max_results_cap' WHEN event_id % 5 = 0 THEN 'page_cap' WHEN event_id % 3 > 0 THEN 'failed_pages'
  WHEN event_id % 11 = 0 THEN 'fallback_degraded' WHEN event_id % 13 = 0 THEN 'pagination_metadata_missing' ELSE '-' END AS reason FROM events)
SELECT reason, count(*)::BIGINT AS runs FROM r GROUP BY reason""")
def coverage_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    reason = C.incomplete_because(e % 7 == 0, e % 5 == 0, e % 3, e % 11 == 0, e % 13 != 0)
    return table(spark, sf_dir, "events").groupBy(_or_dash(reason, "reason")).agg(F.count("*").alias("runs"))


@query(f"""WITH {RUNS_SQL}, g AS (SELECT substr(job_id, 1, 2) AS part, count(*) FILTER (change_type IN ('NEW', 'REAPPEARED', 'UPDATED'))::BIGINT AS emitted,
  count(*) FILTER (change_type = 'UNCHANGED')::BIGINT AS unchanged FROM changes GROUP BY 1)
SELECT part, emitted, unchanged, emitted + unchanged AS total, CASE WHEN emitted + unchanged = 0 THEN 'no_results' ELSE '-' END AS reason,
  coalesce(CASE WHEN emitted + unchanged >= 20 AND unchanged > 0 THEN round(unchanged * 0.25, 2) END, -1)::DOUBLE AS saved,
  coalesce(CASE WHEN emitted + unchanged >= 20 AND unchanged > 0 THEN floor(unchanged / (emitted + unchanged) * 100 + 0.5) END, -1)::BIGINT AS saved_percent
FROM g""")
def run_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = C.classified(current_run(spark, sf_dir), prior_state(spark, sf_dir), NOW)
    out = S.run_figures(changes.withColumn("part", F.substring("job_id", 1, 2)), "part", price=0.25)
    return out.select("part", "emitted", "unchanged", "total", _or_dash("reason", "reason"), F.coalesce("saved", F.lit(-1.0)).alias("saved"),
                      F.coalesce("saved_percent", F.lit(-1)).cast("long").alias("saved_percent"))


_FAILURES = (
    ("Monthly usage hard limit exceeded", "platform_usage", "other"), ("Too many requests", "rate_limit", "other"),
    ("blocked by captcha", "auth_block", "other"), ("API returned 503", "http_5xx", "platform"), ("HTTP status 404", "http_other", "other"),
    ("unexpected token in JSON", "parse_error", "other"), ("read ECONNRESET", "network_timeout", "platform"),
    ("state lock lost during run", "lock_lost", "other"), ("what is this", "unknown", "other"), ("403 Forbidden", "auth_block", "permission"),
    ("Insufficient permissions", "unknown", "permission"),
)


@query("SELECT event_id, run_kind, open_kind FROM events JOIN (VALUES "
       + ", ".join(f"({i}, '{run}', '{opened}')" for i, (_, run, opened) in enumerate(_FAILURES))
       + f") AS t(i, run_kind, open_kind) ON event_id % {len(_FAILURES)} = i")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = _choice(F.col("event_id"), [F.lit(m) for m, _, _ in _FAILURES])
    rows = table(spark, sf_dir, "events").select("event_id", message.alias("message"))
    return rows.select("event_id", T.run_error(F.col("message")).alias("run_kind"), T.open_error(F.col("message")).alias("open_kind"))


@query("""WITH t AS (SELECT event_id % 3 = 0 AS a, event_id % 3 = 1 AS b FROM events)
SELECT count(*) FILTER (a)::BIGINT AS km_votes, count(*) FILTER (b)::BIGINT AS mile_votes,
  CASE WHEN count(*) FILTER (a) > count(*) FILTER (b) THEN 'km' WHEN count(*) FILTER (b) > count(*) FILTER (a) THEN 'miles' ELSE 'miles' END AS unit FROM t""")
def unit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    tests = table(spark, sf_dir, "events").select((e % 3 == 0).alias("km_ok"), (e % 3 == 1).alias("miles_ok"), F.lit(1.6).alias("slope"))
    return S.unit_verdict(tests).select("km_votes", "mile_votes", "unit")


@query(f"""WITH {SQL}, m AS (SELECT *, CASE k % 8 WHEN 0 THEN '€' WHEN 4 THEN 'kr ' ELSE '$' END AS sign FROM base)
SELECT k, replace(title, '(', '[') || '_*' AS title, replace(replace(replace(title, '(', '\\['), '_', '\\_'), '*', '\\*') || '\\_\\*' AS title_md,
  'A &amp; &lt;' || company || '&gt;' AS company_slack,
  concat_ws(' · ', company, CASE WHEN k % 4 <> 0 THEN NULL WHEN k % 8 = 0 THEN sign || format('{{:,}}', "salaryMin") || '–' || sign || format('{{:,}}', "salaryMax")
    ELSE sign || format('{{:,}}', "salaryMin") END, location, CASE WHEN k % 3 = 0 THEN '[NEW]' END) AS line FROM m""")
def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("k")
    currency = F.when(k % 8 == 0, "EUR").when(k % 8 == 4, "SEK")
    title = F.concat(F.replace("title", F.lit("("), F.lit("[")), F.lit("_*"))
    change = F.when(k % 3 == 0, "NEW").otherwise("UNCHANGED")
    none = F.lit(None).cast("string")
    return postings(spark, sf_dir).select(
        "k", title.alias("title"), T.escape_markdown(title).alias("title_md"),
        T.escape_slack(F.concat(F.lit("A & <"), "company", F.lit(">"))).alias("company_slack"),
        sinks.one_liner(c("company"), c("salaryMin"), c("salaryMax"), currency, c("location"), none, change).alias("line"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000Z'
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:30:05.000Z' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T08:30:00.250Z' ELSE '-' END AS posted FROM orders""")
def posted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = _choice(F.col("o_orderkey"), [day, F.concat(day, F.lit("T10:30:05Z")), F.concat(day, F.lit("T10:30:00.25+02:00")), F.lit("soon"), F.lit("")])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", _or_dash(T.iso_date(F.col("raw")), "posted"))


_PHONE_WORDS = ("Tel.: ", "(Telefon ", "please call us at ", "x M: ", "טלפון: ", "联系电话：", "هاتف: ", "تلفن: ", "ТЕЛЕФОН: ", "전화: ", "連絡先: ", "फोन: ", "Điện thoại: ",
                "rückfragen ", "hotline:", "tel:")


@query("SELECT o_orderkey, '030 ' || CAST(1000000 + o_orderkey % 1000000 AS VARCHAR) AS phones FROM orders")
def phones_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.lit("030 "), (F.lit(1_000_000) + F.col("o_orderkey") % 1_000_000).cast("string"))
    text = F.concat(F.lit("Ref 12345 from 2024-01-02. "), _choice(F.col("o_orderkey"), [F.lit(w) for w in _PHONE_WORDS]), number, F.lit(" on workdays"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", F.array_join(T.phones(F.col("text")), "|").alias("phones"))


_N = "(1000 + o_orderkey % 9000)"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN {_N} WHEN 1 THEN 45000 WHEN 2 THEN 1200000 WHEN 3 THEN 20 WHEN 5 THEN {_N} WHEN 6 THEN 30 WHEN 7 THEN {_N} * 10
    ELSE -1 END::BIGINT AS low, CASE o_orderkey % 8 WHEN 1 THEN 60000 WHEN 3 THEN 25 WHEN 7 THEN {_N} * 10 + 500 ELSE -1 END::BIGINT AS high,
  CASE o_orderkey % 8 WHEN 1 THEN 'GBP' WHEN 2 THEN 'EUR' WHEN 4 THEN '-' WHEN 7 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE o_orderkey % 8 WHEN 0 THEN 'MONTH' WHEN 3 THEN 'HOUR' WHEN 4 THEN '-' WHEN 6 THEN 'HOUR' ELSE 'YEAR' END AS period FROM orders""")
def salary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lit(1000) + F.col("o_orderkey") % 9000
    plain, grouped = n.cast("string"), F.format_number((n * 10).cast("double"), 0)
    more = F.format_number((n * 10 + 500).cast("double"), 0)
    text = _choice(F.col("o_orderkey"), [
        F.concat(F.lit("pay $"), plain, F.lit("/mo now")), F.lit("£45k - £60k, 4 days"), F.lit("up to €1.2M per year"), F.lit("$20 – 25/hr"),
        F.lit("a $950 bonus"), F.concat(F.lit("from $"), plain), F.lit("$30 per hour, £9"), F.concat(F.lit("€"), grouped, F.lit(" to €"), more, F.lit(" per annum"))])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", T.salary(F.col("text")).alias("s"))
    return rows.select("o_orderkey", *(F.coalesce(F.col("s")[f], F.lit(-1)).cast("long").alias(n) for f, n in (("min", "low"), ("max", "high"))),
                       *(_or_dash(F.col("s")[f], f) for f in ("currency", "period")))


_HOSTS = (("linkedin", "de.linkedin.com"), ("twitter", "x.com"), ("instagram", "www.instagram.com"), ("facebook", "fb.com"), ("youtube", "youtu.be"),
          ("tiktok", "www.tiktok.com"), ("github", "github.com"), ("xing", "www.xing.com"), ("bluesky", "bsky.app"), ("threads", "www.threads.net"),
          ("mastodon", "mastodon.social"))


@query("SELECT o_orderkey, platform || '=https://' || host || '/u' || o_orderkey AS found FROM orders JOIN (VALUES "
       + ", ".join(f"({i}, '{p}', '{h}')" for i, (p, h) in enumerate(_HOSTS)) + f") AS t(i, platform, host) ON o_orderkey % {len(_HOSTS)} = i")
def social_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.concat(F.lit("at https://"), _choice(key, [F.lit(h) for _, h in _HOSTS]), F.lit("/u"), key.cast("string"), F.lit(", or https://other.example/x."))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    rows = rows.select("o_orderkey", T.social_profiles(F.col("text"), T.OWN_HOSTS).alias("s"))
    def named_of(platform: str) -> Column:
        return F.transform(F.col("s")[platform], lambda u: F.concat(F.lit(platform + "="), u))

    named = F.concat(*(named_of(p) for p, _ in _HOSTS))
    return rows.select("o_orderkey", F.array_join(named, "|").alias("found"))


@query(f"""WITH {SQL} SELECT k, 'hr' || c_custkey || '@corp.example.org' AS mail, CASE WHEN k % 2 = 0 THEN 'https://www.xing.com/p' || c_custkey || '|' ELSE '' END
  || 'https://x.com/a' AS links, 'https://x.com/a|https://x.com/b' || c_custkey AS twitter, 'https://github.com/g' AS github FROM base""")
def contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mailto links, social links of a page's markup, and the profiles of two texts together."""
    key = F.regexp_extract("company", "#0*([0-9]+)", 1)
    html = F.concat(F.lit('<a href="mailto:HR'), key, F.lit('@Corp.example.org?subject=a">'), F.when(F.col("k") % 2 == 0, F.concat(
        F.lit('<a href="https://www.xing.com/p'), key, F.lit('">'))).otherwise(""), F.lit('<i>https://x.com/a).</i> https://x.com/a https://no.example/'))
    rows = postings(spark, sf_dir).select("k", html.alias("html"), key.alias("key"))
    one = T.social_profiles(F.lit("https://x.com/a https://github.com/g"), T.OWN_HOSTS, T.SOCIAL_KEPT)
    two = T.social_profiles(F.concat(F.lit("https://x.com/b"), F.col("key"), F.lit(" https://github.com/g")), T.OWN_HOSTS, T.SOCIAL_KEPT)
    rows = rows.withColumn("both", T.merged_profiles(one, two))
    joined = lambda c, n: F.array_join(c, "|").alias(n)
    return rows.select("k", T.mailto(F.col("html")).alias("mail"), joined(T.social_links(F.col("html")), "links"),
                       joined(F.col("both.twitter"), "twitter"), joined(F.col("both.github"), "github"))


@query(f"""WITH {SQL} SELECT k, title, CASE WHEN k % 2 = 0 THEN location ELSE '-' END AS location, coalesce(description, '-') AS description,
  'k,title,location,description,descriptionText' AS text_columns, 'k,title,location,descriptionHtml' AS html_columns,
  'k,title,location,descriptionMarkdown' AS markdown_columns FROM base""")
def output_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns are chosen first, then one kind of description, then empty values become null."""
    rows = postings(spark, sf_dir).select(
        "k", "title", F.when(F.col("k") % 2 == 0, F.col("location")).otherwise("").alias("location"), "description",
        F.lit("").alias("descriptionHtml"), F.lit(None).cast("string").alias("descriptionMarkdown"), F.lit("").alias("descriptionText"))
    shapes = {kind: P.shaped(rows, kind=kind) for kind in ("text", "html", "markdown")}
    names = (F.lit(",".join(shape.columns)).alias(f"{kind}_columns") for kind, shape in shapes.items())
    return shapes["text"].select("k", "title", _or_dash("location", "location"), _or_dash("description", "description"), *names)


@query(f"""WITH {SQL} SELECT k FROM base WHERE epoch(TIMESTAMP '1997-06-01 00:00:00') - epoch("postedAt"[1:19]::TIMESTAMP) <= 2592000
  AND (k % 6 <> 2 OR k % 4 = 1) AND k % 3 <> 1 AND k % 5 <> 0""")
def searched_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the last 30 days before a day, remote or not said, of two levels, part-time or not said."""
    k = F.col("k")
    rows = postings(spark, sf_dir).withColumns({
        "workplaceType": F.when(k % 6 == 2, F.when(k % 4 == 1, "remote").otherwise("onsite")),
        "seniorityLevel": F.when(k % 3 == 0, "Entry level").when(k % 3 == 1, "Executive").otherwise("Mid-Senior level"),
        "employmentType": F.when(k % 5 == 0, "Full-time").when(k % 5 == 1, "Part-time")})
    asked = {"datePosted": "last30d", "workType": ["remote"], "experienceLevel": ["entry", "mid_senior"], "jobType": ["parttime"]}
    return rows.where(P.as_searched(asked, "1997-06-01T00:00:00.000Z")).select("k")


@query(f"""WITH {RUNS_SQL} SELECT job_id, content_hash, tracked_hash, first_seen_at, last_seen_at, active, expired_at, title, ordinal FROM prior""")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state under a lease: an empty version first, then all rows; what is loaded is what the pointer names."""
    store = state.Store(spark, new_folder(spark))
    state.acquire(store, "feeds", "run")
    state.commit(store, "feeds", "f", C.empty_state(spark), NOW)
    state.commit(store, "feeds", "f", prior_state(spark, sf_dir), NOW)
    state.release(store, "feeds", "run")
    found, coverage = state.load(store, "feeds", "f")
    if not coverage.complete or state.holds(store, "feeds", "run"):
        raise ValueError("the state is not the one that was committed")
    return found.select("job_id", "content_hash", "tracked_hash", "first_seen_at", "last_seen_at", "active", "expired_at",
                        F.col("snapshot.title").alias("title"), "ordinal")


@query(f"""WITH {SQL} SELECT "sourceJobId", title, coalesce(description, '-') AS description, coalesce("salaryMin", -1) AS "salaryMin", 'SQL|Spark' AS skills FROM base""")
def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written as JSON, nulls left out, and read again; arrays stay arrays."""
    known = {c: F.col(c) for c in ("sourceJobId", "title", "description", "salaryMin")} | {"skills": F.array(F.lit("SQL"), F.lit("Spark"))}
    rows = P.as_postings(postings(spark, sf_dir), known)
    out = new_folder(spark)
    sinks.write(rows, out, "json")
    found = spark.read.schema(rows.schema).json(out)
    return found.select("sourceJobId", "title", _or_dash("description", "description"), F.coalesce("salaryMin", F.lit(-1)).alias("salaryMin"),
                        F.array_join("skills", "|").alias("skills"))


@query(f"""WITH {_CARDS_SQL}, n AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (description IS NOT NULL)::BIGINT AS d FROM base),
fields AS (SELECT 'apiJob' AS layer, unnest(['jobId', 'urn', 'title', 'company', 'companyUrl', 'location', 'postedAtIso', 'jobUrl', 'trackingId', 'isPromoted',
    'isEasyApplyOnCard', 'postingBenefits', 'badge']) AS field
  UNION ALL SELECT 'detail', unnest(['description', 'descriptionHtml', 'seniorityLevel', 'employmentType', 'jobFunction', 'industry', 'applicantCount',
    'workplaceType', 'postedRelative', 'salary', 'poster']))
SELECT layer, field, CASE WHEN layer = 'apiJob' THEN n ELSE d END + CASE WHEN field = 'title' THEN 7 ELSE 0 END AS sample_count,
  CASE WHEN field = 'badge' THEN 'pending' ELSE 'mapped' END AS status, field = 'badge' AS pending, FALSE AS disappeared FROM fields, n
UNION ALL SELECT 'apiJob', 'oldField', 5, 'pending', FALSE, TRUE""")
def layer_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of the source against the catalog, on a stored baseline of which other versions, sources and scopes are left out."""
    cards = H.cards(card_pages(spark, sf_dir).select("html")).drop("pos").withColumnRenamed("sourceJobId", "jobId").withColumn("badge", F.lit(1))
    found = H.details(detail_pages(spark, sf_dir)).drop("sourceJobId")
    census = S.field_census(S.as_records(cards), "apiJob", "record").unionByName(S.field_census(S.as_records(found), "detail", "record"))
    kept = spark.createDataFrame([
        (1, "feeds", "default", "apiJob", "oldField", "2024-01-01", "2024-01-01", 5, "pending"),
        (1, "feeds", "default", "apiJob", "title", "2024-01-01", "2024-01-01", 7, "mapped"),
        (0, "feeds", "default", "apiJob", "otherVersion", "2024-01-01", "2024-01-01", 5, "pending"),
        (1, "others", "default", "apiJob", "otherSource", "2024-01-01", "2024-01-01", 5, "pending"),
        (1, "feeds", "test", "apiJob", "otherScope", "2024-01-01", "2024-01-01", 5, "pending")], S.BASELINE_SCHEMA)
    report = S.schema_drift(census, S.adopted_baseline(kept, "feeds"), S.layer_fields(spark, ref.LAYERS), S.layer_fields(spark, ref.LAYERS_IGNORED), NOW)
    return report.select("layer", "field", "sample_count", "status", "pending", "disappeared")


@query("SELECT s_suppkey, s_name AS name, 'City ' || s_nationkey AS city, (s_suppkey * 3)::BIGINT AS employees FROM supplier")
def organisations_at_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations below up to nine levels of lists and graphs."""
    key = F.col("s_suppkey")
    org = F.concat(F.lit('{"@type": ["Thing", "Organization"], "name": "'), "s_name", F.lit('", "numberOfEmployees": '), (key * 3).cast("string"),
                   F.lit(', "address": {"addressLocality": "City '), F.col("s_nationkey").cast("string"), F.lit('"}}'))
    depth = (key % 10).cast("int")
    nested = F.concat(F.repeat(F.lit('[{"@type": "WebPage"}, {"@graph": ['), depth), org, F.repeat(F.lit("]}]"), depth))
    html = F.concat(F.lit('<p>Organization</p><script type="application/ld+json">'), nested, F.lit("</script>"))
    rows = H.organisations(table(spark, sf_dir, "supplier").select("s_suppkey", html.alias("html")))
    return rows.select("s_suppkey", "name", F.col("address.city").alias("city"), F.col("employeeCount").alias("employees"))


@query(f"""WITH {SQL}, d AS (SELECT *, description || ' Second line' AS text, title || ' & more' AS heading, substr("postedAt", 1, 10) || 'T00:00:00.000Z' AS posted
  FROM base WHERE description IS NOT NULL)
SELECT "sourceJobId", '<p>' || description || '</p><br>Second&nbsp;line' AS "descriptionHtml", text AS "descriptionMarkdown",
  substr(heading || ' · ' || company || ' · ' || location || ' — We build feeds.', 1, 280) AS "aiSummary",
  CASE k % 6 WHEN 0 THEN 'SQL' WHEN 1 THEN 'Power Bi' WHEN 2 THEN 'Spark' WHEN 3 THEN 'Project Management' WHEN 4 THEN '' ELSE 'Node.js' END AS skills,
  '' AS phones, '' AS urls, CASE WHEN k % 3 = 0 THEN 'Entry level' ELSE 'Director' END AS "seniorityLevel", 'Full-time' AS "employmentType",
  'A & B' AS "jobFunction", CASE WHEN k % 8 = 0 THEN 'Remote sensing' ELSE 'Other' END AS industry, k % 5000 AS "applicantCount",
  "salaryMin" + 5000 AS "salaryMax", 'USD' AS "salaryCurrency", 'YEAR' AS "salaryPeriod", CASE WHEN k % 12 = 0 THEN 'Ann & Lee' ELSE '-' END AS "recruiterName",
  CASE WHEN k % 12 = 0 THEN 'Ann & Lee' ELSE '-' END AS "contactName", CASE WHEN k % 12 = 0 THEN 'Lead' ELSE '-' END AS "recruiterTitle",
  CASE WHEN k % 12 = 0 THEN 'https://portal.example/in/p' || k ELSE '-' END AS "recruiterUrl",
  CASE WHEN k % 12 = 0 THEN 'https://i.example/a?b&c' ELSE '-' END AS "recruiterPhoto", heading AS title, company, location, posted AS "postedAt",
  CASE WHEN k % 7 = 0 THEN 'onsite' ELSE 'unknown' END AS "applyType", sha256(concat_ws(chr(10), heading, company, location, posted, text)) AS "contentHash" FROM d""")
def detail_enrichment_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns that details bring or change, beside those of detail_enrichment."""
    items = P.transform_cards(landing.scan_cards(card_pages(spark, sf_dir)), SCRAPED)
    whole = P.with_details(items, H.details(detail_pages(spark, sf_dir))).where("description is not null")
    joined = lambda c, n: F.array_join(c, "|").alias(n)
    return whole.select(
        "sourceJobId", "descriptionHtml", "descriptionMarkdown", "aiSummary", joined("skills", "skills"), joined("extractedPhones", "phones"),
        joined("extractedUrls", "urls"), "seniorityLevel", "employmentType", "jobFunction", "industry", "applicantCount", "salaryMax", "salaryCurrency",
        "salaryPeriod", *(_or_dash(c, c) for c in ("recruiterName", "contactName", "recruiterTitle", "recruiterUrl", "recruiterPhoto")),
        "title", "company", "location", "postedAt", "applyType", "contentHash")


@query(f"""WITH {_CARDS_SQL} SELECT page, "sourceJobId" FROM cards WHERE page % 4 IN (0, 1, 3) AND page % 5 IN (0, 1)
  AND (page % 3 <> 2) AND substr("postedAt", 1, 10) >= '1996-03-02'""")
def searched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote postings of two levels since a day, from landed pages; files of searches that asked for others are not opened."""
    pages = card_pages(spark, sf_dir)
    page = F.col("query_ordinal")
    asked = {c: F.lit(searched.ANY) for c in searched.ASKED} | {
        "work_type": F.when(page % 4 == 0, "2").when(page % 4 == 1, "2,3").when(page % 4 == 2, "1").otherwise(searched.ANY),
        "experience": F.when(page % 5 == 0, "2").when(page % 5 == 1, "2,4").otherwise("6"),
        "company": F.when(page % 3 == 2, "17").otherwise(searched.ANY)}
    root = new_folder(spark)
    searched.land(pages, pages.select("query_ordinal", *(c.alias(n) for n, c in asked.items())), root)
    wanted = {"workType": ["remote"], "experienceLevel": ["entry", "mid_senior"], "companies": ["18"]}
    found = searched.for_search(spark, root, wanted, "1996-04-01T00:00:00.000Z", 30 * 86_400)
    cards = H.cards(found.select(page.cast("long").alias("page"), "html"))
    return cards.where(F.col("postedAtIso") >= "1996-03-02").select("page", "sourceJobId")


@query(f"""WITH {_CARDS_SQL}, f AS (SELECT "sourceJobId", substr("postedAt", 1, 10) AS day, page * 100000 + pos AS scan FROM cards
  WHERE epoch(TIMESTAMP '1998-06-01 00:00:00') - epoch(substr("postedAt", 1, 10)::TIMESTAMP) <= 2592000
    AND k % 6 IN (0, 1, 2, 5))
SELECT row_number() OVER (ORDER BY day DESC, scan) - 1 AS emit_order, "sourceJobId" FROM f ORDER BY day DESC, scan LIMIT 120""")
def run_over_other_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over pages that its own searches have not brought: by age and region, newest first; two of six places have no country, and pass."""
    geo = [ref.GEO_IDS[c] for c in ("DE", "AT")]
    run = RunSpec.from_dict({"keywords": "x", "datePosted": "last30d", "geoIds": geo, "maxResults": 120})
    result = pipeline.run_once(run, pipeline.Landed(card_pages(spark, sf_dir), own=False), "1998-06-01T00:00:00.000Z")
    return written(result.rows.select("emit_order", "sourceJobId"), result.held)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS number FROM orders")
def scan_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders numbered from the last to the first."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_orderkey")).alias("place"))
    return ordering.numbered(rows, "place").select("o_orderkey", "number")


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(asked states, stored records) made of suppliers and the customers of their nations."""
    key = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name", F.concat(F.lit("feeds/"), "s_name").alias("state_key"),
                                                       F.md5("s_name").alias("fingerprint"))
    # A record holds what a key-value store holds of one search: here three entries for each supplier.
    entry = lambda i: F.struct(
        F.concat(F.lit(f"job-{2 - i}-"), key.cast("string")).alias("jobId"), F.md5(F.concat("s_name", F.lit(f"c{i}"))).alias("contentHash"),
        F.md5(F.concat("s_name", F.lit(f"t{i}"))).alias("trackedHash"), F.lit("2023-12-01T00:00:00.000Z").alias("firstSeenAt"),
        F.lit("2023-12-31T00:00:00.000Z").alias("lastSeenAt"), F.lit(i != 1).alias("active"),
        F.lit("2023-12-31T00:00:00.000Z" if i == 1 else None).alias("expiredAt"),
        F.when(F.lit(i > 0), F.struct(F.concat(F.lit(f"{i}"), key.cast("string")).alias("linkedinJobId"), F.col("s_name").alias("title"))).alias("snapshot"))
    jobs = F.map_from_arrays(F.array(*(F.concat(F.lit(f"job-{2 - i}-"), key.cast("string")) for i in range(3))), F.array(*map(entry, range(3))))
    one, two = migration.legacy_names(F.col("state_key"))
    own = migration.scoped_name(F.col("state_key"), F.col("fingerprint"))
    legacy = F.to_json(F.struct(F.when(key % 2 == 0, F.lit(1)).alias("version"), F.col("state_key").alias("stateKey"), jobs.alias("jobs")))
    current = F.to_json(F.struct(F.lit(2).alias("version"), F.col("state_key").alias("stateKey"), F.when(key % 16 == 1, "other").otherwise(
        F.col("fingerprint")).alias("queryFingerprint"), jobs.alias("jobs")))
    odd = F.concat(F.lit('{"version": "1", "stateKey": "'), "state_key", F.lit('", "jobs": {}}'))
    kept = {0: [(one, legacy)], 1: [(own, current)], 2: [(two, legacy)], 3: [(one, legacy), (two, legacy)], 4: [(one, odd), (two, legacy)],
            5: [(own, F.lit("{not json")), (one, legacy)], 6: [(one, odd)], 7: []}
    rows = F.array(*(F.struct(name.alias("name"), F.when(key % 8 == k, value).alias("value")) for k, found in kept.items() for name, value in found))
    records = supplier.select(F.inline(F.filter(rows, lambda r: r["value"].isNotNull())))
    return supplier, records


_STATE_KEY = "'feeds/' || s_name"
_OWN = f"'state__' || rtrim(replace(replace(to_base64(({_STATE_KEY})::BLOB), '+', '-'), '/', '_'), '=') || '__' || md5(s_name)"


@query(f"""SELECT {_STATE_KEY} AS state_key, CASE WHEN s_suppkey % 8 = 1 AND s_suppkey % 16 <> 1 THEN {_OWN} ELSE '-' END AS adopted,
  CASE WHEN s_suppkey % 16 = 9 THEN '-' WHEN s_suppkey % 8 IN (1, 5) THEN 'state_corruption_detected' ELSE 'no_prior_state' END AS reason,
  CASE WHEN s_suppkey % 8 IN (0, 3) THEN 'state_' || {_STATE_KEY} WHEN s_suppkey % 8 IN (2, 4) THEN 'state/' || {_STATE_KEY} ELSE '-' END AS migrated_from
FROM supplier""")
def state_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the first layout are reported and not adopted, under either name; damaged ones stop the search for others."""
    asked, records = _records(spark, sf_dir)
    found = migration.openings(asked.select("state_key", "fingerprint"), records)
    return found.select("state_key", _or_dash("adopted", "adopted"), _or_dash("reason", "reason"), _or_dash("migrated_from", "migrated_from"))


@query(f"""WITH r AS (SELECT *, unnest(CASE s_suppkey % 8 WHEN 0 THEN ['state_' || {_STATE_KEY}] WHEN 1 THEN [{_OWN}] WHEN 2 THEN ['state/' || {_STATE_KEY}]
    WHEN 3 THEN ['state_' || {_STATE_KEY}, 'state/' || {_STATE_KEY}] WHEN 4 THEN ['state/' || {_STATE_KEY}] WHEN 5 THEN ['state_' || {_STATE_KEY}] ELSE [] END) AS name FROM supplier)
SELECT name, {_STATE_KEY} AS state_key, 'job-' || (2 - i) || '-' || s_suppkey AS job_id, md5(s_name || 'c' || i) AS content_hash, i <> 1 AS active,
  CASE WHEN i = 1 THEN '2023-12-31T00:00:00.000Z' ELSE '-' END AS expired_at, CASE WHEN i > 0 THEN i || s_suppkey::VARCHAR ELSE '-' END AS "sourceJobId",
  CASE WHEN i > 0 THEN s_name ELSE '-' END AS title, i AS ordinal FROM r, (SELECT unnest(range(3)) AS i)""")
def state_record_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of stored records as a state table, in the order of the record."""
    found = migration.entries(_records(spark, sf_dir)[1])
    return found.select("name", "state_key", "job_id", "content_hash", "active", _or_dash("expired_at", "expired_at"),
                        _or_dash("snapshot.sourceJobId", "sourceJobId"), _or_dash("snapshot.title", "title"), "ordinal")


#: URLs in texts and as browsers write them; {k} is a key.
_WRITTEN_URLS = (
    ("HTTPS://Bücher.Example:443/Straße/{k}?q=ä#teil", "https://xn--bcher-kva.example/Stra%C3%9Fe/{k}?q=%C3%A4"),
    ("http://пример.рф/путь/{k}", "http://xn--e1afmkfd.xn--p1ai/%D0%BF%D1%83%D1%82%D1%8C/{k}"),
    ("http://a.example/x/../y/./z/../{k}", "http://a.example/y/{k}"), ("http://例え。jp:80/{k}/é%20é", "http://xn--r8jz45g.jp/{k}/%C3%A9%20%C3%A9"),
    ("https://A.example:8443/{{{k}}}|b", "https://a.example:8443/%7B{k}%7D|b"), ("http://b.example/%2e%2E/{k}/.?x=😀", "http://b.example/{k}/?x=%F0%9F%98%80"),
    ("http://pročprostě.example?k={k}", "http://xn--proprost-mbb9l.example/?k={k}"), ("https://c.example\\d\\{k}/", "https://c.example/d/{k}"),
)


@query("SELECT o_orderkey, replace(url, '{k}', o_orderkey::VARCHAR) AS url FROM orders JOIN (VALUES "
       + ", ".join(f"({i}, '{url}')" for i, (_, url) in enumerate(_WRITTEN_URLS)).replace("{{", "{").replace("}}", "}")
       + f") AS t(i, url) ON o_orderkey % {len(_WRITTEN_URLS)} = i")
def written_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and paths in other scripts, dot segments, default ports, and characters that are not written plainly."""
    key = F.col("o_orderkey")
    raw = _choice(key, [F.lit(u.replace("{{", "{").replace("}}", "}")) for u, _ in _WRITTEN_URLS])
    text = F.concat(F.lit("see "), F.replace(raw, F.lit("{k}"), key.cast("string")), F.lit(" ."))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", F.array_join(T.urls(F.col("text")), " ").alias("url"))


@query("""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN day || 'T08:00:05.000Z' WHEN 1 THEN day || 'T08:00:00.000Z' WHEN 2 THEN day || 'T00:00:00.000Z'
  WHEN 3 THEN day || 'T00:00:00.000Z' WHEN 4 THEN day || 'T13:05:00.000Z' WHEN 5 THEN day || 'T11:30:00.000Z'
  WHEN 6 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') || 'T04:59:00.000Z' ELSE '-' END AS posted
FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)""")
def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in seven forms that are not ISO, and three that are none."""
    d = F.col("o_orderdate")
    of = lambda pattern, end="": F.concat(F.date_format(d, pattern), F.lit(end))
    raw = _choice(F.col("o_orderkey"), [
        of("EEE, dd MMM yyyy", " 10:00:05 +0200"), of("MMMM d, yyyy", " 10:00 GMT+2"), of("yyyy/M/d"), of("d MMM yyyy"), of("MM/dd/yyyy", " 1:05 PM"),
        of("EEE MMM dd yyyy", " 10:00:00 GMT-0130 (some time)"), of("dd-MMM-yy", " 23:59 EST"), F.concat(F.lit("on "), of("MMMM d")), F.concat(F.lit("13/"), of("dd/yyyy")),
        of("MMM d, yyyy", " 25:00")])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", _or_dash(T.date_of(F.col("raw")), "posted"))


@query("""WITH r AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'busy' WHEN 2 THEN 'degraded' ELSE 'ok' END AS status,
  CASE event_id % 3 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'lock_lost' ELSE 'unknown' END AS kind, value FROM events),
k AS (SELECT day, string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) AS failures FROM (
  SELECT day, kind, count(*) AS n FROM r WHERE status = 'failed' GROUP BY ALL) GROUP BY day),
d AS (SELECT day, count(*)::BIGINT AS runs, count(*) FILTER (status = 'ok')::BIGINT AS ok, round(count(*) FILTER (status = 'ok') / count(*) FILTER (status <> 'busy'), 6) AS success_share,
  sum(event_id % 50) FILTER (status IN ('ok', 'degraded'))::BIGINT AS emitted, quantile_disc(value, 0.5) FILTER (status = 'ok') AS seconds_p50,
  quantile_disc(value, 0.95) FILTER (status = 'ok') AS seconds_p95, max(value) FILTER (status = 'ok') AS seconds_max FROM r GROUP BY day)
SELECT d.*, coalesce(failures, '') AS failures FROM d LEFT JOIN k ON k.day = d.day""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of runs, written and read: how those of each day went."""
    e = F.col("event_id")
    status = F.when(e % 7 == 0, "failed").when(e % 7 == 1, "busy").when(e % 7 == 2, "degraded").otherwise("ok")
    kind = F.when(e % 3 == 0, "rate_limit").when(e % 3 == 1, "lock_lost")
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    rows = table(spark, sf_dir, "events").select(
        e.cast("string").alias("run_id"), F.lit("k").alias("state_key"), F.date_format("ts", C.STAMP).alias("started_at"), status.alias("status"),
        F.when(status == "failed", kind).alias("kind"), none("coverage_reason"), none("migrated_from"),
        F.when(status.isin("ok", "degraded"), e % 50).cast("long").alias("emitted"), none("skipped", "bigint"), *(none(c, "bigint") for c in runs.COUNTS),
        F.col("value").cast("double").alias("seconds"))
    root = new_folder(spark)
    runs.append(rows.repartition(F.to_date("started_at")), root)
    return runs.by_day(runs.read(spark, root)).select(
        "day", "runs", "ok", F.round("success_share", 6).alias("success_share"), "emitted", "seconds_p50", "seconds_p95", "seconds_max", "failures")


#: Addresses of searches, and what tells them apart; {k} is a key.
_SEARCH_URLS = (
    ("HTTPS://Portal.Example/jobs?keywords=a b{k}&utm_source=x&location=Wien#f", "https://portal.example/jobs?keywords=a+b{k}&location=Wien"),
    ("https://p.example/?Zeit=1&ähre=2&apfel={k}&Ähre=3&zeit=4&Apfel=5", "https://p.example/?%C3%A4hre=2&%C3%84hre=3&apfel={k}&Apfel=5&zeit=4&Zeit=1"),
    ("https://p.example?b=2&a={k}&b=1&a=%C3%A4", "https://p.example/?a={k}&a=%C3%A4&b=2&b=1"), ("https://p.example/x/../y?refId=1&trk=2", "https://p.example/y"),
    ("https://p.example/?_x=1&a-b=2&ab={k}&a_b=3&1=4", "https://p.example/?_x=1&1=4&a_b=3&a-b=2&ab={k}"), ("not a url {k}", "not a url {k}"),
    ("https://p.example/?é=1&e={k}&f&É=2&=3", "https://p.example/?=3&e={k}&%C3%A9=1&%C3%89=2&f="),
)


@query("SELECT o_orderkey, replace(url, '{k}', o_orderkey::VARCHAR) AS url FROM orders JOIN (VALUES "
       + ", ".join(f"({i}, '{url}')" for i, (_, url) in enumerate(_SEARCH_URLS)) + f") AS t(i, url) ON o_orderkey % {len(_SEARCH_URLS)} = i")
def search_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters with accents, of both cases and with signs, in dictionary order."""
    key = F.col("o_orderkey")
    raw = F.replace(_choice(key, [F.lit(u) for u, _ in _SEARCH_URLS]), F.lit("{k}"), key.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", U.canonical_url(F.col("raw")).alias("url"))
