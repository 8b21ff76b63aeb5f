"""A posting fixture over relational tables, and two runs of it.

``SQL`` says the same in ANSI SQL, written for itself and not derived from the Spark code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.operators.changes import STATE_SCHEMA

NOW = "2024-02-10T12:00:00.000Z"
FIRST, LAST, OLD, RECENT = (f"2024-{d}T00:00:00.000Z" for d in ("01-01", "02-09", "01-02", "02-01"))
ROLES = ("SQL Engineer", "Power BI Analyst", "Spark Developer (Remote)", "Project Management Lead", "Clerk", "Hybrid Node.js Engineer")
PLACES = ("Germany", "Deutschland", "TX", "UK", "XX", "Atlantis")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key, values):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and the posting columns of each order with its customer and nation."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    # Spark broadcasts customers and nations while they are small enough, and sorts and merges otherwise.
    # Keys are never null; with ==, Spark 4.1 infers a filter of a mixed side from filters on company, and fails.
    rows = orders.join(customers, F.col("o_custkey").eqNullSafe(F.col("c_custkey"))).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    k, cust = F.col("o_orderkey"), F.col("c_custkey")
    pay = F.floor("o_totalprice").cast("long")
    text = F.concat(
        F.lit("We build feeds. Pay $"), pay.cast("string"), F.lit("/yr - $"), (pay + 5000).cast("string"),
        F.lit("/yr. Write to hr"), cust.cast("string"), F.lit("@corp.example.org now."),
    )
    return rows.select(
        k.alias("k"), k.cast("string").alias("sourceJobId"),
        F.concat_ws(" ", "c_mktsegment", _pick(k, ROLES)).alias("title"),
        F.concat("c_name", F.when(cust % 11 == 0, " Staffing").otherwise("")).alias("company"),
        F.concat(F.lit("https://portal.example/company/supplier-"), (cust % 100).cast("string"), F.lit("?trk=x")).alias("companyUrl"),
        F.concat(F.lit("City "), F.col("n_nationkey").cast("string"), F.lit(", "), _pick(k, PLACES)).alias("location"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("postedAt"),
        F.concat(F.lit("https://portal.example/view/"), k.cast("string")).alias("jobUrl"),
        F.when(k % 4 == 0, text).alias("description"),
        F.when(k % 4 == 0, pay).alias("salaryMin"), F.when(k % 8 == 0, pay + 5000).alias("salaryMax"),
    )


SQL = """
base AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS "sourceJobId",
    c_mktsegment || ' ' || CASE o_orderkey % 6 WHEN 0 THEN 'SQL Engineer' WHEN 1 THEN 'Power BI Analyst'
      WHEN 2 THEN 'Spark Developer (Remote)' WHEN 3 THEN 'Project Management Lead' WHEN 4 THEN 'Clerk'
      ELSE 'Hybrid Node.js Engineer' END AS title,
    c_name || CASE WHEN c_custkey % 11 = 0 THEN ' Staffing' ELSE '' END AS company,
    'https://portal.example/company/supplier-' || (c_custkey % 100) || '?trk=x' AS "companyUrl",
    'City ' || n_nationkey || ', ' || CASE o_orderkey % 6 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Deutschland'
      WHEN 2 THEN 'TX' WHEN 3 THEN 'UK' WHEN 4 THEN 'XX' ELSE 'Atlantis' END AS location,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "postedAt",
    'https://portal.example/view/' || o_orderkey AS "jobUrl",
    CASE WHEN o_orderkey % 4 = 0 THEN 'We build feeds. Pay $' || CAST(floor(o_totalprice) AS BIGINT) || '/yr - $'
      || (CAST(floor(o_totalprice) AS BIGINT) + 5000) || '/yr. Write to hr' || c_custkey || '@corp.example.org now.' END AS description,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS "salaryMin",
    CASE WHEN o_orderkey % 8 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) + 5000 END AS "salaryMax",
    c_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), hashed AS (
  SELECT *, sha256('linkedin.com:' || "sourceJobId") AS job_id,
    sha256(concat_ws(chr(10), title, company, location, "postedAt", coalesce(description, ''))) AS content_hash,
    sha256(title || '|' || company || '|' || location || '|' || coalesce("salaryMin"::VARCHAR, '') || '|'
      || coalesce("salaryMax"::VARCHAR, '') || '||||' || coalesce(description, '') || '|' || "postedAt" || '||'
      || "jobUrl" || '|' || "jobUrl") AS tracked_hash
  FROM base
)"""


def hashed(rows: DataFrame) -> DataFrame:
    """postings with job_id, content_hash, tracked_hash."""
    none = F.lit(None).cast("string")
    whole = rows.withColumns({"salaryCurrency": none, "salaryPeriod": none, "employmentType": none, "applyUrl": F.col("jobUrl")})
    return whole.withColumns({
        "job_id": H.job_id(F.col("sourceJobId")), "content_hash": H.content_hash_of_columns(), "tracked_hash": H.tracked_hash(),
    })


def prior_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(postings(spark, sf_dir)).where("k % 10 <> 0 or k % 130 = 0")
    active, k = F.col("k") % 13 != 0, F.col("k")
    gone = F.when(k % 39 == 0, OLD).otherwise(RECENT)
    snapshot = F.struct("sourceJobId", "title", "company", "location", "jobUrl", "postedAt")
    out = rows.select(
        "job_id", "content_hash", "tracked_hash", F.lit(FIRST).alias("first_seen_at"), F.lit(LAST).alias("last_seen_at"),
        active.alias("active"), F.when(~active, gone).alias("expired_at"), snapshot.alias("snapshot"), k.alias("ordinal"),
    )
    return spark.createDataFrame([], STATE_SCHEMA).unionByName(out)


def current_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the second run: some altered, some under a new id with their old content."""
    rows = hashed(postings(spark, sf_dir)).where("k % 10 <> 1")
    altered = F.when(F.col("k") % 7 == 0, F.sha2(F.concat("tracked_hash", F.lit("!")), 256)).otherwise(F.col("tracked_hash"))
    seen = rows.withColumns({"tracked_hash": altered, "scan_ordinal": F.col("k") * 2})
    again = rows.where("k % 130 = 0").withColumns({
        "sourceJobId": F.concat(F.lit("R"), "sourceJobId"), "scan_ordinal": F.col("k") * 2 + 1,
    }).withColumn("job_id", H.job_id(F.col("sourceJobId")))
    return seen.unionByName(again.select(seen.columns))


RUNS_SQL = SQL + f""", prior AS (
  SELECT job_id, content_hash, tracked_hash, '{FIRST}' AS first_seen_at, '{LAST}' AS last_seen_at, k % 13 <> 0 AS active,
    CASE WHEN k % 13 = 0 THEN CASE WHEN k % 39 = 0 THEN '{OLD}' ELSE '{RECENT}' END END AS expired_at,
    "sourceJobId", title, company, location, "jobUrl", "postedAt", k AS ordinal
  FROM hashed WHERE k % 10 <> 0 OR k % 130 = 0
), cur AS (
  SELECT job_id, content_hash, CASE WHEN k % 7 = 0 THEN sha256(tracked_hash || '!') ELSE tracked_hash END AS tracked_hash,
    "sourceJobId", title, company, location, "jobUrl", "postedAt", k * 2 AS scan_ordinal
  FROM hashed WHERE k % 10 <> 1
  UNION ALL
  SELECT sha256('linkedin.com:R' || "sourceJobId"), content_hash, tracked_hash,
    'R' || "sourceJobId", title, company, location, "jobUrl", "postedAt", k * 2 + 1
  FROM hashed WHERE k % 10 <> 1 AND k % 130 = 0
), ch AS (
  SELECT coalesce(c.job_id, p.job_id) AS job_id,
    CASE WHEN p.job_id IS NULL THEN 'NEW' WHEN c.job_id IS NULL THEN CASE WHEN p.active THEN 'EXPIRED' END
      WHEN NOT p.active THEN 'REAPPEARED' WHEN c.tracked_hash <> p.tracked_hash THEN 'UPDATED' ELSE 'UNCHANGED' END AS change_type,
    coalesce(c.content_hash, p.content_hash) AS content_hash, coalesce(c.tracked_hash, p.tracked_hash) AS tracked_hash,
    coalesce(p.first_seen_at, '{NOW}') AS first_seen_at,
    CASE WHEN c.job_id IS NULL THEN p.last_seen_at ELSE '{NOW}' END AS last_seen_at,
    p.last_seen_at AS previous_seen_at, CASE WHEN c.job_id IS NULL THEN '{NOW}' END AS expired_at,
    c.scan_ordinal, p.ordinal AS state_ordinal
  FROM cur c FULL JOIN prior p ON c.job_id = p.job_id
), changes AS (SELECT * FROM ch WHERE change_type IS NOT NULL), rep AS (
  SELECT c.job_id, arg_min(p.job_id, p.ordinal) AS repost_of_id, arg_min(p.expired_at, p.ordinal) AS repost_expired_at
  FROM cur c JOIN prior p ON c.content_hash = p.content_hash AND c.job_id <> p.job_id AND NOT p.active GROUP BY c.job_id
)"""
