"""Identity and change hashes of postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_NAME = "linkedin.com"
CONTENT_FIELDS = ("title", "company", "location", "postedAt", "description")
#: Fields whose change makes a posting UPDATED, in the order they are hashed.
TRACKED_FIELDS = (
    "title", "company", "location", "salaryMin", "salaryMax", "salaryCurrency", "salaryPeriod", "employmentType",
    "description", "postedAt", "validThrough", "jobUrl", "applyUrl",
)


def _joined(values: list[Column], separator: str) -> Column:
    return F.sha2(F.concat_ws(separator, *(F.coalesce(v.cast("string"), F.lit("")) for v in values)), 256)


def job_id(source_id: Column, source: str = SOURCE_NAME) -> Column:
    return F.sha2(F.concat(F.lit(source + ":"), source_id), 256)


def content_hash(title: Column, company: Column, location: Column, posted_at: Column, description: Column) -> Column:
    return _joined([title, company, location, posted_at, description], "\n")


def content_hash_of_columns() -> Column:
    return content_hash(*(F.col(c) for c in CONTENT_FIELDS))


def tracked_hash() -> Column:
    """Of the columns named in TRACKED_FIELDS; validThrough has no source and counts as empty."""
    return _joined([F.lit(None) if c == "validThrough" else F.col(c) for c in TRACKED_FIELDS], "|")
