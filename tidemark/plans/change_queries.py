"""Queries on change detection, filters, limits, statistics and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changes as C
from tidemark.operators import postings as P
from tidemark.operators import statistics as S
from tidemark.plans import sinks, spec
from tidemark.plans.postings import NOW, RUNS_SQL, SQL, current_run, hashed, postings, prior_state, table
from tidemark.plans.registry import query

CHANGE_COLUMNS = ("job_id", "change_type", "content_hash", "tracked_hash", "first_seen_at", "last_seen_at", "previous_seen_at", "expired_at")
_COLUMNS = ", ".join(CHANGE_COLUMNS)


def _changes(spark: SparkSession, sf_dir: str, complete: bool = True) -> DataFrame:
    return C.classified(current_run(spark, sf_dir), prior_state(spark, sf_dir), NOW, C.Coverage(complete, None if complete else "failed_pages"))


@query(f"WITH {RUNS_SQL} SELECT {_COLUMNS} FROM changes")
def change_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select(*CHANGE_COLUMNS)


@query(f"""WITH {RUNS_SQL} SELECT change_type, count(*)::BIGINT AS postings, count(r.job_id)::BIGINT AS reposts
FROM changes c LEFT JOIN rep r ON c.job_id = r.job_id GROUP BY change_type""")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.reposts(current_run(spark, sf_dir), prior_state(spark, sf_dir)).select("job_id", "repost_of_id")
    rows = _changes(spark, sf_dir).join(found, "job_id", "left")
    return rows.groupBy("change_type").agg(F.count("*").alias("postings"), F.count("repost_of_id").alias("reposts"))


@query(f"WITH {RUNS_SQL} SELECT job_id, change_type FROM changes WHERE change_type IN ('NEW', 'REAPPEARED')")
def emission_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.emitted(_changes(spark, sf_dir), "new-only", emit_unchanged=True).select("job_id", "change_type")


@query(f"WITH {RUNS_SQL} SELECT job_id, change_type FROM changes WHERE change_type = 'UPDATED'")
def emission_changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.emitted(_changes(spark, sf_dir), "changed-only").select("job_id", "change_type")


@query(f"WITH {RUNS_SQL} SELECT job_id, change_type FROM changes")
def emission_all_unchanged_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.emitted(_changes(spark, sf_dir), "all", True, True).select("job_id", "change_type")


@query(f"WITH {RUNS_SQL} SELECT change_type, count(*)::BIGINT AS postings FROM changes WHERE change_type <> 'EXPIRED' GROUP BY change_type")
def expired_suppressed_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir, complete=False).groupBy("change_type").agg(F.count("*").alias("postings"))


@query(f"WITH {RUNS_SQL} SELECT job_id, repost_of_id, repost_expired_at FROM rep")
def repost_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.reposts(current_run(spark, sf_dir), prior_state(spark, sf_dir))
    return found.select("job_id", "repost_of_id", "repost_expired_at")


_STATE_SQL = f"""WITH {RUNS_SQL}, after AS (
  SELECT coalesce(c.job_id, p.job_id) AS job_id, coalesce(c.content_hash, p.content_hash) AS content_hash,
    coalesce(c.tracked_hash, p.tracked_hash) AS tracked_hash, coalesce(p.first_seen_at, '{NOW}') AS first_seen_at,
    CASE WHEN c.job_id IS NULL THEN p.last_seen_at ELSE '{NOW}' END AS last_seen_at, c.job_id IS NOT NULL AS active,
    CASE WHEN c.job_id IS NULL THEN CASE WHEN p.active THEN '{NOW}' ELSE p.expired_at END END AS expired_at,
    coalesce(c.title, p.title) AS title,
    coalesce(p.ordinal, (SELECT max(ordinal) FROM prior) + 1 + c.scan_ordinal) AS ordinal
  FROM cur c FULL JOIN prior p ON c.job_id = p.job_id
) """


def _state_columns(state: DataFrame) -> DataFrame:
    return state.select("job_id", "content_hash", "tracked_hash", "first_seen_at", "last_seen_at", "active", "expired_at",
                        F.col("snapshot.title").alias("title"), "ordinal")


def _after(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    prior = prior_state(spark, sf_dir)
    return C.updated_state(C.compared(current_run(spark, sf_dir), prior, NOW), prior, NOW, days)


@query(_STATE_SQL + "SELECT * FROM after")
def state_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_columns(_after(spark, sf_dir, 36_500))


@query(_STATE_SQL + f"""SELECT * FROM after WHERE active OR CAST('{NOW}'[1:19] AS TIMESTAMP) - CAST(expired_at[1:19] AS TIMESTAMP)
  <= INTERVAL 30 DAY""")
def state_prune_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_columns(_after(spark, sf_dir, 30))


@query(f"""WITH {RUNS_SQL} SELECT c.job_id AS "jobId", p."sourceJobId", p.title, p.company, p.location, p."jobUrl", p."jobUrl" AS "applyUrl",
  p."postedAt", c.change_type AS "changeType", c.expired_at AS "expiredAt", c.content_hash AS "contentHash"
FROM changes c JOIN prior p ON c.job_id = p.job_id WHERE c.change_type = 'EXPIRED'""")
def expired_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.expired_stubs(_changes(spark, sf_dir), NOW).select(
        "jobId", "sourceJobId", "title", "company", "location", "jobUrl", "applyUrl", "postedAt", "changeType", "expiredAt", "contentHash")


@query(f"WITH {SQL} SELECT k, content_hash FROM hashed")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(postings(spark, sf_dir)).select("k", "content_hash")


@query(f"WITH {SQL} SELECT k, tracked_hash FROM hashed")
def tracked_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(postings(spark, sf_dir)).select("k", "tracked_hash")


@query(f"WITH {SQL} SELECT k, job_id FROM hashed")
def job_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(postings(spark, sf_dir)).select("k", "job_id")


def _scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a scan: queries by ship mode of 20 suppliers, ten rows a page."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return rows.select(
        F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 20).alias("query_ordinal"),
        (F.floor(F.col("l_orderkey") / 100) * 10).alias("start"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


_SCAN_SQL = """scan AS (
  SELECT l_partkey AS id, l_suppkey % 20 AS query_ordinal, CAST(floor(l_orderkey / 100) * 10 AS BIGINT) AS start,
    l_orderkey * 10 + l_linenumber AS pos FROM lineitem
)"""


@query(f"""WITH {_SCAN_SQL} SELECT id, query_ordinal, start, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_ordinal, start, pos) AS rn FROM scan) WHERE rn = 1""")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_of(_scan_log(spark, sf_dir), ["id"], "query_ordinal", "start", "pos").select("id", "query_ordinal", "start", "pos")


@query(f"""WITH {_SCAN_SQL}, pages AS (
  SELECT query_ordinal, start, count(*) AS n FROM scan WHERE start < 1000 GROUP BY ALL
), good AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY query_ordinal ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM pages
) SELECT query_ordinal, count(*)::BIGINT AS pages, sum(n)::BIGINT AS rows_taken FROM good WHERE before < 60 GROUP BY query_ordinal""")
def scan_cap_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.capped_per_query(_scan_log(spark, sf_dir), 60)
    return kept.groupBy("query_ordinal").agg(F.count_distinct("start").alias("pages"), F.count("*").alias("rows_taken"))


@query(f"""WITH {_SCAN_SQL}, q AS (
  SELECT query_ordinal, count(*) >= 3000 AS capped, max(pos) % 3 = 0 AS failed FROM scan GROUP BY query_ordinal
) SELECT bool_or(capped) AS any_capped, count(*) FILTER (failed)::BIGINT AS failed_queries, count(*)::BIGINT AS queries FROM q""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _scan_log(spark, sf_dir).groupBy("query_ordinal").agg(
        (F.count("*") >= 3000).alias("capped"), (F.max("pos") % 3 == 0).alias("failed"))
    return C.coverage_summary(outcomes)


@query(f"WITH {SQL} SELECT k, company FROM base WHERE NOT (lower(company) LIKE '%staffing%' OR lower(company) LIKE '%agency%')")
def agency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).where(~P.by_agency()).select("k", "company")


@query(f"""WITH {SQL} SELECT k, title, company FROM base
WHERE title NOT ILIKE '%clerk%' AND title NOT ILIKE '%power bi%' AND company NOT ILIKE '%000000012%'""")
def exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = P.PostingFilters(exclude_keywords=("Clerk", "power BI"), exclude_companies=("000000012",))
    return postings(spark, sf_dir).where(~P.excluded(wanted)).select("k", "title", "company")


@query(f"""WITH {SQL} SELECT k FROM base WHERE CASE WHEN "salaryMin" IS NULL AND "salaryMax" IS NULL THEN FALSE
  ELSE coalesce("salaryMax", "salaryMin") >= 50000 AND coalesce("salaryMin", "salaryMax") <= 150000 END""")
def salary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = P.PostingFilters(salary_min=50_000, salary_max=150_000, salary_include_unknown=False)
    return postings(spark, sf_dir).where(P.within_salary(wanted)).select("k")


@query(f"WITH {SQL} SELECT k FROM base WHERE k % 3 <> 0")
def meaningful_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hollow = F.col("k") % 6 == 0
    blank = {c: F.when(hollow, F.lit("")).otherwise(F.col(c)) for c in ("title", "company", "jobUrl", "location")}
    rows = postings(spark, sf_dir).withColumns(blank).withColumn("sourceJobId", F.when(F.col("k") % 6 != 3, F.col("sourceJobId")))
    return rows.where(P.meaningful()).select("k")


@query(f"""WITH {RUNS_SQL} SELECT c.job_id, c.title, c.scan_ordinal FROM cur c LEFT JOIN rep r ON c.job_id = r.job_id
WHERE r.job_id IS NULL ORDER BY c.scan_ordinal LIMIT 25""")
def top_n_after_repost_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = current_run(spark, sf_dir)
    found = C.reposts(current, prior_state(spark, sf_dir)).select("job_id")
    fresh = current.join(found, "job_id", "left_anti")
    return C.first_rows(fresh.select("job_id", "title", "scan_ordinal"), 25, "scan_ordinal")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 160000 THEN 7 WHEN o_totalprice >= 140000 THEN 6 WHEN o_totalprice >= 120000 THEN 5
  WHEN o_totalprice >= 100000 THEN 4 WHEN o_totalprice >= 80000 THEN 3 WHEN o_totalprice >= 60000 THEN 2 WHEN o_totalprice >= 40000 THEN 1
  ELSE 0 END::BIGINT AS bucket FROM orders""")
def salary_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", P.salary_step(F.col("o_totalprice")).alias("bucket"))


@query(f"""WITH {SQL} SELECT k, sha256('linkedin.com:' || "sourceJobId") AS "jobId", title, company, location, "postedAt", "jobUrl", content_hash AS "contentHash"
FROM hashed""")
def compact_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(postings(spark, sf_dir))
    known = {"jobId": F.col("job_id"), "contentHash": F.col("content_hash"), **{c: F.col(c) for c in (
        "sourceJobId", "title", "company", "companyUrl", "location", "postedAt", "jobUrl", "description", "salaryMin", "salaryMax")}}
    whole = P.compact(P.as_postings(rows, known, "k"), "k")
    return whole.select("k", "jobId", "title", "company", "location", "postedAt", "jobUrl", "contentHash")


@query(f"""WITH {SQL} SELECT k, CASE WHEN length(description) > 30 THEN substr(description, 1, 30) ELSE description END AS description,
  sha256(concat_ws(chr(10), title, company, location, "postedAt", coalesce(substr(description, 1, 30), ''))) AS "contentHash" FROM base""")
def truncate_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(postings(spark, sf_dir)).withColumns({"contentHash": F.col("content_hash"), "descriptionMarkdown": F.lit(None).cast("string")})
    return P.truncated(rows, 30).select("k", "description", "contentHash")


@query("""WITH j AS (SELECT json_keys(props) AS keys FROM events WHERE json_valid(props)),
c AS (SELECT unnest(keys) AS field FROM j)
SELECT 'events' AS layer, field, count(*)::BIGINT AS sample_count, CASE WHEN field = 'k' THEN 'mapped' ELSE 'pending' END AS status,
  field <> 'k' AS pending, FALSE AS disappeared FROM c GROUP BY field
UNION ALL SELECT 'events', 'gone', 3, 'ignored', FALSE, TRUE""")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = S.field_census(table(spark, sf_dir, "events"), "events", "props")
    pairs = lambda *rows: spark.createDataFrame(rows, "layer string, field string")
    baseline = spark.createDataFrame(
        [("events", "gone", "2024-01-01", "2024-01-01", 3, "pending")],
        "layer string, field string, first_seen_at string, last_seen_at string, sample_count long, status string")
    report = S.schema_drift(census, baseline, pairs(("events", "k")), pairs(("events", "gone")), NOW)
    return report.select("layer", "field", "sample_count", "status", "pending", "disappeared")


@query("""SELECT event_type, floor(avg(value) + 0.5)::DOUBLE AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
  min(value) AS min, max(value) AS max FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest_rank(table(spark, sf_dir, "events"), "value", "event_type")


@query("""WITH o AS (SELECT event_type, value, CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'empty' ELSE 'success' END AS status,
  CASE WHEN event_id % 5 = 0 THEN CASE event_id % 15 WHEN 0 THEN 'rate_limit' WHEN 5 THEN 'server_error' ELSE 'network' END END AS cls FROM events)
SELECT event_type, count(*)::BIGINT AS total, count(*) FILTER (status = 'success')::BIGINT AS success_count,
  count(*) FILTER (status = 'empty')::BIGINT AS empty_count, count(*) FILTER (status = 'error')::BIGINT AS error_count,
  count(*) FILTER (cls = 'rate_limit')::BIGINT AS rate_limit, count(*) FILTER (cls = 'server_error')::BIGINT AS server_error,
  0::BIGINT AS timeout, count(*) FILTER (cls = 'network')::BIGINT AS network, 0::BIGINT AS parse_fail, 0::BIGINT AS other,
  floor(avg(value) FILTER (status <> 'error') + 0.5)::DOUBLE AS fetch_avg,
  quantile_disc(value, 0.5) FILTER (status <> 'error') AS fetch_p50, quantile_disc(value, 0.95) FILTER (status <> 'error') AS fetch_p95,
  min(value) FILTER (status <> 'error') AS fetch_min, max(value) FILTER (status <> 'error') AS fetch_max
FROM o GROUP BY event_type""")
def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    message = F.when(e % 15 == 0, "API returned 429").when(e % 15 == 5, "HTTP status 503").otherwise("read ECONNRESET")
    status = F.when(e % 5 == 0, "error").when(e % 5 == 1, "empty").otherwise("success")
    log = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("fetch_ms"), status.alias("status"), message.alias("message"))
    return S.batch_statistics(S.with_error_class(log), "event_type")


@query("""SELECT * FROM (VALUES (0, '104514075'), (1, '105117694'), (2, '103819153'), (3, '100456013'), (4, '105238872'), (5, '101282230'))
  AS t(place, geo_id)""")
def region_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = spec.RunSpec.from_dict({"regions": ["de", "SE", "ZZ"], "regionPresets": "nordic"})
    ids = [s["geoId"] for s, _ in spec.searches(run)]
    return spark.createDataFrame(list(enumerate(ids)), "place int, geo_id string")


@query(f"""WITH {RUNS_SQL}, n AS (SELECT c.scan_ordinal, c.title, c.company, c.location, h.change_type FROM cur c JOIN changes h ON c.job_id = h.job_id
  WHERE h.change_type IN ('NEW', 'UPDATED') ORDER BY c.scan_ordinal LIMIT 5)
SELECT scan_ordinal, title || ' — ' || company || ' · ' || location || ' · [' || change_type || ']' AS line FROM n""")
def notify_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = current_run(spark, sf_dir)
    rows = _changes(spark, sf_dir).select("job_id", F.col("change_type").alias("changeType")).join(current, "job_id")
    picked = sinks.to_notify(rows, only_changes=True, incremental=True)
    first = C.first_rows(picked, 5, "scan_ordinal")
    none = F.lit(None).cast("string")
    line = sinks.one_liner(F.col("company"), F.lit(None).cast("long"), F.lit(None).cast("long"), none, F.col("location"), none, F.col("changeType"))
    return first.select("scan_ordinal", F.concat_ws(" — ", "title", line).alias("line"))


@query("""WITH p AS (SELECT c_custkey, (c_custkey % 140) - 70.0 AS lat, (c_custkey % 300) - 150.0 AS lon FROM customer),
d AS (SELECT c_custkey, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (SELECT c_custkey, pow(sin(radians(lat - 52.0) / 2), 2)
  + cos(radians(52.0)) * cos(radians(lat)) * pow(sin(radians(lon - 13.0) / 2), 2) AS a FROM p))
SELECT c_custkey, round(km, 3) AS km FROM d WHERE km <= 3000""")
def radius_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", (k % 140 - 70.0).alias("lat"), (k % 300 - 150.0).alias("lon"))
    near = S.within_radius(points, 52.0, 13.0, 3000.0)
    km = S.haversine_km(F.lit(52.0), F.lit(13.0), F.col("lat"), F.col("lon"))
    return near.select("c_custkey", F.round(km, 3).alias("km"))


@query("""WITH s AS (SELECT event_type, avg(value) AS v, user_id % 50 AS x FROM events GROUP BY event_type, user_id % 50),
t AS (SELECT event_type, (v - lag(v) OVER w) / (x - lag(x) OVER w) AS step FROM s WINDOW w AS (PARTITION BY event_type ORDER BY x))
SELECT a.event_type, round(a.slope, 6) AS slope, round(b.mean_step_slope, 6) AS mean_step_slope, round(a.p75, 6) AS p75 FROM
  (SELECT event_type, regr_slope(v, x) AS slope, list_sort(list(v))[floor(count(*) * 0.75)::INT + 1] AS p75 FROM s GROUP BY event_type) a
  JOIN (SELECT event_type, avg(step) AS mean_step_slope FROM t GROUP BY event_type) b USING (event_type)""")
def sweep_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 50).alias("x")).agg(F.avg("value").alias("v"))
    whole = sweep.groupBy("event_type").agg(S.slope("x", "v").alias("slope"))
    steps = S.mean_step_slope(sweep, "x", "v", "event_type")
    return whole.join(steps, "event_type").join(S.floor_rank(sweep, "v", 0.75, "event_type", name="p75"), "event_type").select(
        "event_type", *(F.round(c, 6).alias(c) for c in ("slope", "mean_step_slope", "p75")))


@query("""SELECT array_to_string(list_sort(list(DISTINCT event_type)), '|') AS values, count(*) FILTER (event_type IS NULL)::BIGINT AS nulls FROM events""")
def enum_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.value_census(table(spark, sf_dir, "events"), "event_type")
    return found.select(F.array_join("values", "|").alias("values"), "nulls")
