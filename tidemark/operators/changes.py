"""Change detection against persisted state: one full outer join carries the whole state machine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.postings import PORTAL_URL, SOURCE, as_postings

SNAPSHOT = "struct<sourceJobId:string,title:string,company:string,location:string,jobUrl:string,postedAt:string>"
#: The state table, one row for each posting ever seen in a universe.
STATE_SCHEMA = (
    "job_id string, content_hash string, tracked_hash string, first_seen_at string, last_seen_at string, "
    f"active boolean, expired_at string, snapshot {SNAPSHOT}, ordinal bigint"
)
SNAPSHOT_FIELDS = ("sourceJobId", "title", "company", "location", "jobUrl", "postedAt")
RETENTION_DAYS = 30
KINDS = ("NEW", "REAPPEARED", "UPDATED", "UNCHANGED", "EXPIRED")
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


@dataclass(frozen=True)
class Coverage:
    """Whether a run saw its whole universe; if not, why."""

    complete: bool
    reason: str | None = None

    def after_scan(self, *, capped: bool = False, page_cap: bool = False, failed_pages: int = 0,
                   degraded: bool = False, pagination_known: bool = True) -> Coverage:
        """With what the scan says; a reason that is there already stays."""
        if not self.complete:
            return self
        reasons = (("max_results_cap", capped), ("page_cap", page_cap), ("failed_pages", failed_pages > 0),
                   ("fallback_degraded", degraded), ("pagination_metadata_missing", not pagination_known))
        reason = next((name for name, holds in reasons if holds), None)
        return Coverage(reason is None, reason)


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def compared(current: DataFrame, state: DataFrame, now: str, coverage: Coverage = Coverage(True)) -> DataFrame:
    """All postings of the run and of the state, one row each; one full outer join that all else is read from.

    current: job_id, content_hash, tracked_hash, scan_ordinal (unique ids), and the snapshot fields if a new
    state is to be made.  change_type is NEW, REAPPEARED, UPDATED, UNCHANGED or EXPIRED, and null for a row of
    the state that is neither current nor expired; expiry needs complete coverage.  seen: whether the run has it;
    prior: its row of the state; snap: what the run knows of the snapshot fields.
    """
    fields = [f for f in SNAPSHOT_FIELDS if f in current.columns]
    snap = F.struct(*SNAPSHOT_FIELDS) if len(fields) == len(SNAPSHOT_FIELDS) else F.lit(None).cast(SNAPSHOT)
    c = current.select("job_id", "content_hash", "tracked_hash", "scan_ordinal", snap.alias("snap")).alias("c")
    p = state.select(F.struct(*state.columns).alias("prior"), F.col("job_id").alias("prior_id")).alias("p")
    both = c.join(p, F.col("c.job_id") == F.col("p.prior_id"), "full_outer")
    here, before, prior = F.col("c.job_id").isNotNull(), F.col("p.prior_id").isNotNull(), F.col("p.prior")
    kind = (
        F.when(~before, "NEW")
        .when(here & ~prior["active"], "REAPPEARED")
        .when(here & ~F.col("c.tracked_hash").eqNullSafe(prior["tracked_hash"]), "UPDATED")
        .when(here, "UNCHANGED")
        .when(prior["active"] & F.lit(coverage.complete), "EXPIRED")
    )
    stamp = F.lit(now)
    return both.select(
        F.coalesce("c.job_id", "p.prior_id").alias("job_id"),
        kind.alias("change_type"),
        F.when(here, F.col("c.content_hash")).otherwise(prior["content_hash"]).alias("content_hash"),
        F.when(here, F.col("c.tracked_hash")).otherwise(prior["tracked_hash"]).alias("tracked_hash"),
        F.coalesce(prior["first_seen_at"], stamp).alias("first_seen_at"),
        F.when(here, stamp).otherwise(prior["last_seen_at"]).alias("last_seen_at"),
        prior["last_seen_at"].alias("previous_seen_at"),
        F.when(~here, stamp).alias("expired_at"),
        F.col("c.scan_ordinal").alias("scan_ordinal"),
        prior["snapshot"].alias("snapshot"),
        prior["ordinal"].alias("state_ordinal"),
        here.alias("seen"), prior.alias("prior"), F.col("c.snap").alias("snap"),
    )


def changes_of(both: DataFrame) -> DataFrame:
    """The changes among the rows of :func:`compared`."""
    return both.where("change_type is not null").drop("seen", "prior", "snap")


def classified(current: DataFrame, state: DataFrame, now: str, coverage: Coverage = Coverage(True)) -> DataFrame:
    """NEW, REAPPEARED, UPDATED, UNCHANGED and EXPIRED postings, one row each.

    Rows of the state that are neither current nor expired are left out; else as :func:`compared`.
    """
    return changes_of(compared(current, state, now, coverage))


def emitted(changes: DataFrame, output_mode: str | None = "all", emit_unchanged: bool = False,
            emit_expired: bool = False) -> DataFrame:
    """The changes that a run's policy lets out."""
    kind = F.col("change_type")
    return changes.where(
        (kind.isin("NEW", "REAPPEARED") & F.lit(output_mode in (None, "", "all", "new-only")))
        | ((kind == "UPDATED") & F.lit(output_mode in (None, "", "all", "changed-only")))
        | ((kind == "UNCHANGED") & F.lit(output_mode == "all" and emit_unchanged))
        | ((kind == "EXPIRED") & F.lit(emit_expired))
    )


def reposts(current: DataFrame, state: DataFrame) -> DataFrame:
    """(job_id, repost_of_id, ...): for each current row the first inactive state row of equal content.

    The row's own id never counts.  An inactive content may be shared by many ids, so of each content
    only the first two in state order are kept before the join: one of them is not the row itself.
    """
    gone = state.where(~F.col("active") & F.col("content_hash").isNotNull())
    entry = F.struct("ordinal", "job_id", "first_seen_at", "last_seen_at", "expired_at")
    first = gone.groupBy("content_hash").agg(F.min(entry).alias("first"))
    second = (
        gone.join(first, "content_hash").where(F.col("job_id") != F.col("first.job_id"))
        .groupBy("content_hash").agg(F.min(entry).alias("second"))
    )
    known = first.join(second, "content_hash", "left")
    rows = current.select("job_id", "content_hash").join(known, "content_hash")
    best = F.when(F.col("first.job_id") != F.col("job_id"), F.col("first")).otherwise(F.col("second"))
    return rows.select("job_id", best.alias("match")).where("match is not null").select(
        "job_id", F.col("match.job_id").alias("repost_of_id"), F.col("match.first_seen_at").alias("repost_first_seen_at"),
        F.col("match.last_seen_at").alias("repost_last_seen_at"), F.col("match.expired_at").alias("repost_expired_at"),
    )


def updated_state(both: DataFrame, state: DataFrame, now: str, retention_days: int = RETENTION_DAYS,
                  committed: DataFrame | None = None) -> DataFrame:
    """The state after a run, from the rows of :func:`compared`: seen rows active with new hashes, expired ones
    inactive, others as they were.

    committed: the job_ids that count as seen, if not all do.  Rows inactive for longer than the retention go; one
    whose expiry can't be read stays.  New rows come after all others, in scan order.
    """
    seen, prior = F.col("seen"), F.col("prior")
    if committed is not None:
        out = committed.select("job_id", F.lit(True).alias("_out"))
        both = both.join(out, "job_id", "left").where(~F.col("seen") | F.col("_out").isNotNull() | F.col("prior").isNotNull())
        seen = seen & F.col("_out").isNotNull()
    # The place in the scan orders new rows among themselves, so they need no global numbering.
    highest = F.coalesce(state.agg(F.max("ordinal")).scalar(), F.lit(-1).cast("long"))
    gone = F.col("change_type").eqNullSafe("EXPIRED")
    after = both.select(
        "job_id",
        *(F.when(seen, F.col(c)).otherwise(prior[c]).alias(c) for c in ("content_hash", "tracked_hash", "first_seen_at", "last_seen_at")),
        (seen | (prior["active"] & ~gone)).alias("active"),
        F.when(~seen, F.when(gone, F.lit(now)).otherwise(prior["expired_at"])).alias("expired_at"),
        F.when(seen, F.coalesce("snap", prior["snapshot"])).otherwise(prior["snapshot"]).alias("snapshot"),
        F.coalesce(prior["ordinal"], highest + 1 + F.col("scan_ordinal")).alias("ordinal"),
    )
    return pruned(after, now, retention_days)


def pruned(state: DataFrame, now: str, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Without rows that have been inactive for more than the retention."""
    millis = lambda c: F.unix_millis(F.try_to_timestamp(c))
    age = millis(F.lit(now)) - millis(F.col("expired_at"))
    old = ~F.col("active") & F.coalesce(age > retention_days * 86_400_000, F.lit(False))
    return state.where(~old)


def expired_stubs(changes: DataFrame, scraped_at: str) -> DataFrame:
    """EXPIRED changes as postings, from what the state remembers of them."""
    gone = changes.where("change_type = 'EXPIRED'")
    known = {f: F.col("snapshot")[f] for f in SNAPSHOT_FIELDS}
    known |= {
        "scrapedAt": F.lit(scraped_at), "portalUrl": F.lit(PORTAL_URL), "source": F.lit(SOURCE), "jobId": F.col("job_id"),
        "applyUrl": F.col("snapshot")["jobUrl"], "changeType": F.lit("EXPIRED"), "firstSeenAt": F.col("first_seen_at"),
        "lastSeenAt": F.col("last_seen_at"), "previousSeenAt": F.col("previous_seen_at"),
        "expiredAt": F.col("expired_at"), "contentHash": F.col("content_hash"),
    }
    return as_postings(gone, known)


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in order; all of them for 0."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def first_of(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of rows with equal keys the first one in order, all columns.

    The least row of each key is found with sums on the map side, so a key with very many rows does
    not gather in a task.
    """
    rest = [c for c in df.columns if c not in {*keys, *order}]
    least = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    columns = [F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns]
    return least.select(*columns)


def capped_per_query(scan: DataFrame, cap: int, query: str = "query_ordinal", page: str = "start",
                     hard_cap: int = 1000) -> DataFrame:
    """Whole pages of each query until its cap is reached, below the source's hard cap; cap 0: no cap.

    The cap is looked at after a page has been taken: a page goes only if the pages before it have
    reached the cap.  Counts are kept by page, not by row.
    """
    scan = scan.where(F.col(page) < hard_cap)
    if cap <= 0:
        return scan
    pages = scan.groupBy(query, page).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(query).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    good = pages.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < cap)
    return scan.join(good.select(query, page), [query, page], "left_semi")


def scan_cap(incremental: bool, max_results: int, floor: int = 600) -> int:
    """Rows to scan for each query, 0 for all: an incremental run scans at least floor."""
    return max(max_results, floor) if incremental else max(0, max_results)


def coverage_summary(queries: DataFrame, rows: str | None = None) -> DataFrame:
    """One row: any_capped, failed_queries, queries, from capped and failed of each query; with rows also collected."""
    collected = [F.coalesce(F.sum(rows), F.lit(0)).alias("collected")] if rows else []
    return queries.agg(
        F.coalesce(F.bool_or("capped"), F.lit(False)).alias("any_capped"),
        F.count_if("failed").alias("failed_queries"), F.count("*").alias("queries"), *collected,
    )


def incomplete_because(capped: Column, page_cap: Column, failed_pages: Column, degraded: Column, pagination_known: Column) -> Column:
    """The reason why coverage is incomplete, by the facts of a scan in the order they count; null if it is complete."""
    return (
        F.when(capped, "max_results_cap").when(page_cap, "page_cap").when(failed_pages > 0, "failed_pages")
        .when(degraded, "fallback_degraded").when(~pagination_known, "pagination_metadata_missing")
    )


def all_targets_failed(targets: int, failed: int, collected: int) -> bool:
    """Whether a run has nothing because every search of it failed; that is no run without results."""
    return targets > 0 and collected == 0 and failed >= targets
