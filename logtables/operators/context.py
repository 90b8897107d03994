"""Bounded text contexts per cluster, and their summaries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.functions.ids import cluster_fingerprint
from logtables.operators.health import latest
from logtables.sources.store import read_or_empty

# Samples kept per cluster, samples quoted in a prompt, seconds per summary.
SAMPLES = 20
PROMPT_LINES = 15
SUMMARY_TIMEOUT = 8.0
# The form of a prompt, and of its line for the time range.
PROMPT = "Template: %s\nOccurrences: %s\n%sSample lines:\n%s"
PROMPT_RANGE = "Time range: %s\n"
# Summaries that a task asks for at the same time.
ASKERS = 8


def cluster_samples(
    events: DataFrame,
    cluster: Sequence[str],
    order: Sequence[str] = ("ts", "event_id"),
    n: int = SAMPLES,
) -> DataFrame:
    """``cluster..., samples``: the latest ``n`` raw lines of each cluster, oldest first."""
    newest = latest(events.select(*cluster, *order, "raw"), [F.desc(c) for c in order], n, cluster)
    lines = F.sort_array(F.collect_list(F.struct(*order, "raw")))
    return newest.groupBy(*cluster).agg(F.transform(lines, lambda r: r["raw"]).alias("samples"))


def prompt_text(
    template: Column, count: Column, samples: Column, time_range: Column | None = None
) -> Column:
    """Template, occurrences, optional time range, and the first sample lines.

    Without a time range (null or empty) its line is left out.
    """
    shown = F.lit("")
    if time_range is not None:
        known = F.nullif(time_range, F.lit(""))
        shown = F.when(known.isNull(), "").otherwise(F.format_string(PROMPT_RANGE, known))
    quoted = F.array_join(F.slice(samples, 1, PROMPT_LINES), "\n")
    return F.format_string(PROMPT, template, count.cast("string"), shown, quoted)


def cluster_context(
    counted: DataFrame, samples: DataFrame, cluster: Sequence[str], template: str = "template"
) -> DataFrame:
    """Clusters with ``fingerprint`` and ``prompt``; ``time_range`` is used if present."""
    time_range = F.col("time_range") if "time_range" in counted.columns else None
    named = F.col(template)
    return counted.join(samples, list(cluster)).withColumns(
        {
            "fingerprint": cluster_fingerprint(named, F.col("count")),
            "prompt": prompt_text(named, F.col("count"), F.col("samples"), time_range),
        }
    )


def attach_summaries(contexts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Contexts with the stored ``summary`` of their fingerprint, NULL if there is none."""
    return contexts.join(summaries.select("fingerprint", "summary"), "fingerprint", "left")


def summary_hit_rate(attached: DataFrame) -> DataFrame:
    """One row: share of contexts with a summary, 0 if there are no contexts."""
    hit = F.col("summary").isNotNull().cast("double")
    return attached.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("hit_rate"))


def _summarise(
    batches: Iterator[pd.DataFrame], fn: Callable[[str], str | None], timeout: float
) -> Iterator[pd.DataFrame]:
    """Call ``fn`` on each prompt, several at a time; a failing, slow or empty answer is NULL.

    The prompts asked together share a deadline. Threads still busy at that time are
    given up, and the next prompts get fresh ones.
    """
    pool = ThreadPoolExecutor(ASKERS)
    for batch in batches:
        prompts, answers = batch["prompt"].tolist(), []
        for first in range(0, len(prompts), ASKERS):
            asked = [pool.submit(fn, p) for p in prompts[first : first + ASKERS]]
            deadline, late = time.monotonic() + timeout, False
            for call in asked:
                try:
                    answers.append(call.result(max(0.0, deadline - time.monotonic())) or None)
                except Exception:  # a failing summary leaves the cluster without one
                    answers.append(None)
                    late = late or not call.done()
            if late:
                pool.shutdown(wait=False, cancel_futures=True)
                pool = ThreadPoolExecutor(ASKERS)
        yield batch.assign(summary=answers)[["fingerprint", "summary"]]
    pool.shutdown(wait=False, cancel_futures=True)


def summarize_missing(
    contexts: DataFrame,
    summaries: DataFrame,
    fn: Callable[[str], str | None] | None,
    timeout: float = SUMMARY_TIMEOUT,
) -> DataFrame:
    """``fingerprint, summary`` for the fingerprints without a stored summary.

    ``fn`` turns a prompt into text, on the executors; with None nothing is
    called. Append the rows with a summary to the summary table.
    """
    missing = (
        contexts.join(summaries.select("fingerprint"), "fingerprint", "left_anti")
        .groupBy("fingerprint")
        .agg(F.min("prompt").alias("prompt"))
    )
    if fn is None:
        return missing.select("fingerprint", F.lit(None).cast("string").alias("summary"))
    return missing.mapInPandas(
        lambda batches: _summarise(batches, fn, timeout), "fingerprint string, summary string"
    )


def summarize(
    contexts: DataFrame,
    path: str,
    fn: Callable[[str], str | None] | None,
    timeout: float = SUMMARY_TIMEOUT,
) -> DataFrame:
    """Contexts with ``summary``: looked up in the table at ``path``, else asked for and kept.

    Only fingerprints without a stored summary reach ``fn``, and what it answers is
    appended, so a second run asks nothing. A fingerprint without an answer has NULL
    and is asked for again next time. One writer at a time.
    """
    spark = contexts.sparkSession
    schema = "fingerprint string, summary string"
    stored = read_or_empty(spark, path, schema)
    made = summarize_missing(contexts, stored, fn, timeout).filter("summary is not null")
    made.write.mode("append").parquet(path)
    return attach_summaries(contexts, spark.read.schema(schema).parquet(path))
