"""Whole runs: landed pages to postings, once or against the state of earlier runs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import text as T
from tidemark.operators import changes as C
from tidemark.operators import html as HT
from tidemark.operators import ordering as O  # noqa: E741
from tidemark.operators import postings as P
from tidemark.operators import statistics as S
from tidemark.plans.spec import RunSpec, asked_of
from tidemark.sources import landing, runs, state


@dataclass(frozen=True)
class Landed:
    """What a crawl has left: list pages, and pages of details, companies and related postings.

    own: whether the pages come from the run's own searches.  Pages of other origin may hold anything, so
    their postings are held to the spec, and come in the order in which the source would bring them.
    """

    pages: DataFrame
    details: DataFrame | None = None
    companies: DataFrame | None = None
    related: DataFrame | None = None
    own: bool = True


class AllTargetsFailed(RuntimeError):
    """Every search of a run has failed and nothing was collected."""


class RunFailed(RuntimeError):
    """A run that did not end well; kind says of what sort the failure is."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


@dataclass
class RunResult:
    """Rows to write, in order of emit_order, and how the run went.

    The parsed pages are kept in executors' memory and disk until :meth:`release`; rows and state are lazy.
    """

    rows: DataFrame
    coverage: C.Coverage
    counts: dict = field(default_factory=dict)
    changes: DataFrame | None = None
    state: DataFrame | None = None
    held: list[DataFrame] = field(default_factory=list)
    counted: Observation | None = None

    def changes_by_kind(self) -> dict[str, int]:
        """How many postings of each kind of change there were, as counted when the state was written."""
        return {k: n for k, n in self.counted.get.items() if n} if self.counted is not None else {}

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()


def _filters(spec: RunSpec) -> P.PostingFilters:
    return P.PostingFilters(
        spec.removeAgency, tuple(spec.excludeKeywords), tuple(spec.excludeCompanies), spec.salaryMin, spec.salaryMax,
        spec.salaryIncludeUnknown)


def _outcome(landed: Landed, cap: int) -> Row:
    """How the searches went; a run of which all have failed is an error, not a run without results."""
    found = C.coverage_summary(landing.query_outcomes(landed.pages, cap), "rows").first()
    if C.all_targets_failed(found.queries, found.failed_queries, found.collected):
        raise AllTargetsFailed("all search targets failed")
    return found


def items_of(spec: RunSpec, landed: Landed, scraped_at: str, held: list[DataFrame], salary_stage: str = "detail",
             often: bool = False) -> DataFrame:
    """Postings of a run with scan_ordinal: projected, filtered, enriched.

    held takes what is persisted on the way; the caller unpersists it when the postings are written.  Details are looked up
    for the first maxResults rows, and of the detail pages only theirs are parsed.  Pay is known from details only, so the
    salary filter stands behind them; salary_stage='card' puts it before, where all pay is unknown.  often: the postings
    are read more than once.  What is kept for that are cards, which have a fourth of the columns, unless pages are joined.
    """
    cap = C.scan_cap(spec.incrementalMode, spec.maxResults)
    cards = landing.scan_cards(landed.pages, cap, landed.related if spec.discoverRelated else None, spec.relatedSeedCount)
    enriched, by_company = spec.enrichDetails and landed.details is not None, spec.scrapeCompany and landed.companies is not None
    if often or (enriched and spec.maxResults > 0):
        cards = cards.persist()
        held.append(cards)
    items = P.filtered(P.transform_cards(cards, scraped_at, "scan_ordinal"), _filters(spec), salary_stage == "card")
    if enriched:
        details = landed.details
        if spec.maxResults > 0:
            first = C.first_rows(items.select("sourceJobId", "scan_ordinal"), spec.maxResults, "scan_ordinal")
            details = details.join(first.select("sourceJobId"), "sourceJobId", "left_semi")
        items = P.with_details(items, HT.details(details), spec.phoneExtractionMode)
    if salary_stage != "card":
        items = items.where(P.within_salary(_filters(spec)))
    if by_company:
        items = P.with_companies(items, HT.organisations(landed.companies))
    if often and (enriched or by_company):
        items = items.persist()
        held.append(items)
    return items if landed.own else items.where(P.as_searched(asked_of(spec), scraped_at))


def _in_order(items: DataFrame, spec: RunSpec, landed: Landed, held: list[DataFrame]) -> DataFrame:
    """The first maxResults rows, with emit_order: as scanned, or in the source's order for pages of other origin.

    Those of the second kind are numbered, so they are read more than once: held takes them, and no row beyond the first ones.
    """
    order = P.source_order(asked_of(spec) if not landed.own else {"sortBy": "relevant"})
    first = C.first_rows(items, spec.maxResults, *order)
    if len(order) == 1:
        return first.withColumnRenamed("scan_ordinal", "emit_order")
    ranked = first.withColumn("emit_order", P.source_rank()).persist()
    held.append(ranked)
    return O.numbered(ranked, "emit_order", "emit_order").drop("scan_ordinal")


def _shaped(rows: DataFrame, spec: RunSpec) -> DataFrame:
    order = ["emit_order"]
    body = P.shaped(rows.drop(*order), spec.compact, spec.descriptionFormat, False)
    out = rows.select(*order, *body.columns)
    return P.without_empty(out) if spec.excludeEmptyFields else out


def _empty(spark: SparkSession) -> DataFrame:
    return P.as_postings(spark.range(0).select(F.col("id").alias("emit_order")), {}, "emit_order")


def run_once(spec: RunSpec, landed: Landed, scraped_at: str) -> RunResult:
    """A run without state: the first maxResults postings."""
    if not spec.has_target():
        return RunResult(_empty(landed.pages.sparkSession), C.Coverage(True), {"targets": 0})
    outcome = _outcome(landed, C.scan_cap(False, spec.maxResults))
    coverage = C.Coverage(True).after_scan(capped=outcome.any_capped, failed_pages=outcome.failed_queries)
    held: list[DataFrame] = []
    items = items_of(spec, landed, scraped_at, held)
    rows = P.truncated(_in_order(items, spec, landed, held), spec.descriptionMaxLength)
    return RunResult(_shaped(rows, spec), coverage, {"failed_queries": outcome.failed_queries}, held=held)


def run_incremental(spec: RunSpec, landed: Landed, scraped_at: str, prior: DataFrame, known: C.Coverage,
                    commit_only_emitted: bool = False) -> RunResult:
    """A run against prior state; rows and the new state are lazy and share the scan.

    Gone postings come first, then active ones in scan order, of which maxResults are let out.  Rows
    beyond that still count as seen, unless commit_only_emitted is set.
    """
    cap = C.scan_cap(True, spec.maxResults)
    outcome = _outcome(landed, cap)
    coverage = known.after_scan(capped=outcome.any_capped, failed_pages=outcome.failed_queries)
    # The parsed pages feed both outputs; kept in executors' memory and disk, recomputed if lost.
    held: list[DataFrame] = []
    items = items_of(spec, landed, scraped_at, held, often=True)
    current = items.select(
        F.col("jobId").alias("job_id"), F.col("contentHash").alias("content_hash"),
        H.tracked_hash().alias("tracked_hash"), "scan_ordinal", *C.SNAPSHOT_FIELDS)
    # The state's order grows by the rows of a run, not by the places that a scan has for them.
    current = O.numbered(current, "scan_ordinal", "scan_ordinal")
    both = C.compared(current, prior, scraped_at, coverage)
    changes = C.changes_of(both)
    policy = C.emitted(changes, spec.outputMode, spec.emitUnchanged, spec.emitExpired)
    found = C.reposts(current, prior).select("job_id", "repost_of_id")
    kinds = policy.where("change_type <> 'EXPIRED'").select("job_id", "change_type", "first_seen_at", "last_seen_at", "previous_seen_at")
    active = items.join(kinds, items["jobId"] == kinds["job_id"]).drop("job_id").join(
        found, F.col("jobId") == found["job_id"], "left").drop("job_id")
    if spec.skipReposts:
        active = active.where("repost_of_id is null")
    active = _in_order(active, spec, landed, held)
    again = F.col("repost_of_id").isNotNull()
    active = P.truncated(active, spec.descriptionMaxLength).withColumns({
        "changeType": F.col("change_type"), "firstSeenAt": F.col("first_seen_at"), "lastSeenAt": F.col("last_seen_at"),
        "previousSeenAt": F.col("previous_seen_at"), "isRepost": again, "repostOfId": F.col("repost_of_id"),
        "repostDetectedAt": F.when(again, F.lit(scraped_at)),
    })
    active = active.select("emit_order", *P.POSTING_FIELDS)
    gone = C.expired_stubs(policy, scraped_at).select(F.lit(-1).cast("long").alias("emit_order"), *P.POSTING_FIELDS)
    out = active.select(F.col("jobId").alias("job_id")) if commit_only_emitted else None
    counted = Observation()
    kind = F.col("change_type")
    watched = both.observe(counted, *(F.count_if(kind == k).alias(k) for k in C.KINDS))
    after = C.updated_state(watched, prior, scraped_at, committed=out)
    return RunResult(_shaped(gone.unionByName(active), spec), coverage, {"failed_queries": outcome.failed_queries}, changes, after, held, counted)


def run_and_commit(spec: RunSpec, landed: Landed, scraped_at: str, store: state.Store, key: str, fingerprint: str, run_id: str,
                   out: str, kind: str = "parquet", price: float = 0.0, log: str | None = None) -> dict:
    """:func:`_run_and_commit`, with a row for it in the log of runs (a folder), whatever becomes of it."""
    begin, spark = time.monotonic(), landed.pages.sparkSession

    def logged(**values) -> None:
        if log is not None:
            runs.record(spark, log, run_id=run_id, state_key=key, started_at=scraped_at, seconds=time.monotonic() - begin, **values)

    try:
        done = _run_and_commit(spec, landed, scraped_at, store, key, fingerprint, run_id, out, kind, price)
    except RunFailed as error:
        logged(status="failed", kind=error.kind)
        raise
    counts = {k.lower(): n for k, n in done.get("changes", {}).items()}
    summary, coverage = done.get("summary") or {}, done.get("coverage")
    logged(status=done["status"], kind=done.get("reason"), coverage_reason=coverage.reason if coverage else None, migrated_from=done.get("migrated_from"),
           emitted=summary.get("emitted"), skipped=summary.get("unchangedSkipped"), **counts)
    return done


def _run_and_commit(spec: RunSpec, landed: Landed, scraped_at: str, store: state.Store, key: str, fingerprint: str, run_id: str,
                    out: str, kind: str, price: float) -> dict:
    """Take the lease, run, write the rows, then move the state, if the lease still holds.

    Returns how it went: status, coverage, changes by kind, the run's summary and, with a price for each row, what
    skipping unchanged rows has saved.  A state that can't be opened fails the run, or lets it go on without one if
    the spec allows that.  Failures are raised as :class:`RunFailed` with their kind.
    """
    begin = time.monotonic()
    spark = landed.pages.sparkSession
    try:
        held, why = state.acquire(store, key, run_id)
    except Exception as error:
        return _without_state(spec, landed, scraped_at, out, kind, begin, error)
    if not held:
        return {"status": "busy", "reason": why}
    result = None
    try:
        try:
            found = state.load_with_migration(store, key, fingerprint)
        except Exception as error:
            return _without_state(spec, landed, scraped_at, out, kind, begin, error)
        result = run_incremental(spec, landed, scraped_at, found.rows, found.coverage)
        emitted = _written(result.rows, out, kind)
        state.commit(store, key, fingerprint, result.state, scraped_at, run_id)
        counts = result.changes_by_kind()
        skipped = 0 if spec.emitUnchanged and spec.outputMode == "all" else counts.get("UNCHANGED", 0)
        return {"status": "ok", "coverage": result.coverage, "changes": counts, "migrated_from": found.migrated_from,
                "summary": S.run_summary(emitted, skipped, int((time.monotonic() - begin) * 1000)),
                "savings": S.savings(emitted, skipped, price)}
    except Exception as error:
        raise RunFailed(_kind_of(spark, T.run_error, error), str(error)) from error
    finally:
        if result is not None:
            result.release()
        state.release(store, key, run_id)


def _written(rows: DataFrame, out: str, kind: str) -> int:
    """Write rows; how many they are is counted on the way."""
    counted = Observation()
    rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.format(kind).mode("overwrite").save(out)
    return counted.get["rows"]


def _kind_of(spark: SparkSession, classify: Callable[[Column], Column], error: Exception) -> str:
    return spark.range(1).select(classify(F.lit(str(error)))).first()[0]


def _without_state(spec: RunSpec, landed: Landed, scraped_at: str, out: str, kind: str, begin: float, error: Exception) -> dict:
    """What becomes of a run whose state can't be opened."""
    why = _kind_of(landed.pages.sparkSession, T.open_error, error)
    if state.open_decision("unavailable", spec.allowNonIncrementalFallback) == "fail":
        raise RunFailed(why, str(error)) from error
    result = run_once(spec, landed, scraped_at)
    try:
        emitted = _written(result.rows, out, kind)
    finally:
        result.release()
    return {"status": "degraded", "reason": why, "coverage": result.coverage,
            "summary": S.run_summary(emitted, 0, int((time.monotonic() - begin) * 1000)), "savings": None}
