"""Runs as micro-batches: each landed file of pages is one run against the state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.pipeline import Landed, run_and_commit
from tidemark.plans.spec import RunSpec
from tidemark.sources import landing, state


def stream_runs(spark: SparkSession, landed: str, spec: RunSpec, store: state.Store, key: str, fingerprint: str, out: str,
                checkpoint: str, now: Callable[[int], str], kind: str = "parquet") -> StreamingQuery:
    """Start a query that takes what has landed, a file a batch, and ends when there is no more.

    A gone posting can only be told from a complete run, so expiry belongs to the batch and not to a
    state of each key.  A batch that is repeated writes its rows again and finds them in the state, if
    that was committed: rows are written at least once, the state moves after them.
    """
    pages = spark.readStream.format(kind).schema(landing.PAGE_SCHEMA).option("maxFilesPerTrigger", 1).load(landed)

    def one_run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            run_and_commit(spec, Landed(batch), now(number), store, key, fingerprint, f"batch-{number}", f"{out}/batch={number}")
        finally:
            batch.unpersist()

    return pages.writeStream.foreachBatch(one_run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
