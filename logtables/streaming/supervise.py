"""Several sources followed at once: one that fails doesn't stop the others."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

_STATUS = "source string, state string, failures int, error string"


@dataclass
class _Source:
    open: Callable[[], DataFrame]
    query: StreamingQuery | None = None
    state: str = "new"
    failures: int = 0
    error: str | None = None


class Supervisor:
    """A query of its own for each source, started again when it fails.

    ``sources`` gives, by name, a function that opens a streaming frame; it is called at each
    start, so a folder that appears later is found then. ``start`` turns the frame and the
    name into a running query; with a checkpoint of its own, a query that is started again
    goes on where it stopped. A source that fails more than ``retries`` times in a row without
    a batch in between is given up until :meth:`revive`.
    """

    def __init__(
        self,
        spark: SparkSession,
        sources: Mapping[str, Callable[[], DataFrame]],
        start: Callable[[DataFrame, str], StreamingQuery],
        retries: int = 2,
    ) -> None:
        self.spark, self.start, self.retries = spark, start, retries
        self.sources = {name: _Source(open) for name, open in sources.items()}
        self.check()

    def _begin(self, name: str, source: _Source) -> None:
        try:
            source.query, source.state = self.start(source.open(), name), "running"
        except Exception as error:  # whatever a source raises is its own affair
            self._failed(source, error)

    def _failed(self, source: _Source, error: Exception) -> None:
        if source.query is not None and source.query.lastProgress:
            source.failures = 0
        source.query = None
        source.failures += 1
        source.error = str(error).splitlines()[0][:500]
        source.state = "failed" if source.failures > self.retries else "waiting"

    def check(self) -> bool:
        """Start what is new or failed; whether any source is still at work."""
        for name, source in self.sources.items():
            if source.query is not None and not source.query.isActive:
                if (error := source.query.exception()) is not None:
                    self._failed(source, error)
                else:
                    source.query, source.state = None, "done"
            if source.state in ("new", "waiting"):
                self._begin(name, source)
        return any(s.state in ("running", "waiting") for s in self.sources.values())

    def wait(self, seconds: float = 0.2) -> None:
        """Until every source has ended or is given up."""
        while self.check():
            for source in self.sources.values():
                if source.query is not None and source.query.isActive:
                    _settled(source.query, seconds)
                    break

    def revive(self) -> None:
        """Try the sources again that were given up."""
        for source in self.sources.values():
            if source.state == "failed":
                source.state, source.failures = "new", 0
        self.check()

    def stop(self) -> None:
        for source in self.sources.values():
            if source.query is not None:
                source.query.stop()

    def status(self) -> DataFrame:
        """A row per source: ``source, state, failures, error`` (the latest one)."""
        rows = [(n, s.state, s.failures, s.error) for n, s in self.sources.items()]
        return self.spark.createDataFrame(rows, _STATUS)


def _settled(query: StreamingQuery, seconds: float) -> None:
    try:
        query.awaitTermination(seconds)
    except Exception:  # told by exception() at the next check
        return


def follow_sources(
    spark: SparkSession,
    sources: Mapping[str, Callable[[], DataFrame]],
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    retries: int = 2,
) -> Supervisor:
    """Write the rows of each source to ``path/<name>``, whatever happens to the others."""

    def start(rows: DataFrame, name: str) -> StreamingQuery:
        writer = rows.writeStream.option("checkpointLocation", f"{checkpoint}/{name}")
        if trigger:
            writer = writer.trigger(**trigger)
        return writer.format("parquet").start(f"{path}/{name}")

    return Supervisor(spark, sources, start, retries)
