"""Runs of a document: their log, and cancelling them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RUN = "id string, document_id string, status string, metrics map<string,bigint>, started_at string, completed_at string, error string"


def run_row(spark: SparkSession, document_id: str, status: str, started_at: str, completed_at: str | None = None, metrics: dict[str, int] | None = None, error: str | None = None) -> DataFrame:
    """One row of the run log; its id is made of the document and the start, so later states of a run have the same."""
    key = "run_" + hashlib.sha256(f"{document_id}|{started_at}".encode()).hexdigest()[:8]
    return spark.createDataFrame([(key, document_id, status, metrics or {}, started_at, completed_at, error)], RUN)


def cancel(spark: SparkSession, document_id: str) -> None:
    """Interrupts what ``run_document`` has running of a document, wherever it is."""
    spark.interruptTag(f"run-{document_id}") if hasattr(spark, "interruptTag") else spark.sparkContext.cancelJobsWithTag(f"run-{document_id}")


def run_document(
    spark: SparkSession, document_id: str, job: Callable[[], dict[str, int]], rollback: Callable[[], None], clock: Callable[[], str], cancelled: Callable[[], bool] = lambda: False
) -> DataFrame:
    """Runs ``job`` (it returns its metrics) and gives the run's last state: completed, cancelled or failed.

    A cancelled or failed run is rolled back.  Its Spark jobs carry a tag, by which ``cancel`` interrupts them.
    """
    started = clock()
    tag = f"run-{document_id}"
    spark.sparkContext.addJobTag(tag)
    try:
        metrics = job()
        if not cancelled():
            return run_row(spark, document_id, "completed", started, clock(), metrics)
        state, error = "cancelled", None
    except Exception as e:
        state, error = ("cancelled", None) if cancelled() or "cancel" in str(e).lower() else ("failed", str(e)[:1000])
    finally:
        spark.sparkContext.removeJobTag(tag)
    rollback()
    return run_row(spark, document_id, state, started, clock(), None, error)
