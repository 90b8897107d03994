"""Scores of closed buckets from keyed state: the last buckets of each series."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logtables.streaming.tables import schema_of

#: State of this kind needs this store; set for the query that asks for it alone.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_SCORES = "mean double, stddev double, z_score double, is_anomaly boolean"


class _Scorer(StatefulProcessor):
    """Holds, for each series, its first bucket and the ``window`` buckets before now that
    have events: at most ``window`` pairs, however long the series runs."""

    def __init__(self, bucket_ms: int, window: int, k: float, min_count: int) -> None:
        self.bucket_ms = bucket_ms
        self.window, self.k, self.min_count = window, k, min_count

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState(
            "seen", "first_ms bigint, starts array<bigint>, counts array<bigint>"
        )

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("start_ms")
        before = self.seen.get() if self.seen.exists() else None
        first = int(before[0]) if before else int(fresh["start_ms"].iloc[0])
        starts = [int(x) for x in before[1]] if before else []
        counts = [int(x) for x in before[2]] if before else []
        scores = []
        for start, count in zip(fresh["start_ms"].tolist(), fresh["count"].tolist()):
            oldest = start - self.window * self.bucket_ms
            while starts and starts[0] < oldest:
                starts.pop(0)
                counts.pop(0)
            scores.append(self._score(count, min(self.window, (start - first) // self.bucket_ms), counts))
            starts.append(start)
            counts.append(count)
        self.seen.update((first, starts[-self.window :], counts[-self.window :]))
        told = fresh[["start_ms", "count"]].reset_index(drop=True)
        names = ["mean", "stddev", "z_score", "is_anomaly"]
        told = pd.concat([told, pd.DataFrame(scores, columns=names)], axis=1)
        told.insert(0, "_series", key[0])
        yield told

    def _score(self, count: int, n: int, counts: list[int]) -> tuple[float, float, float, bool]:
        """Empty buckets add nothing to the sums; ``n`` counts them."""
        mean = sum(counts) / n if n else 0.0
        square = sum(float(c) * c for c in counts) / n if n else 0.0
        stddev = math.sqrt(max(0.0, square - mean * mean))
        above = count - mean
        if n < 2:
            z = 0.0
        elif stddev > 0:
            z = above / stddev
        else:
            z = math.inf if above > 0 else 0.0
        return mean, stddev, z, n >= 2 and count >= self.min_count and z >= self.k

    def close(self) -> None:
        pass


def score_series(
    buckets: DataFrame, by: Sequence[str], bucket_seconds: int, window: int, k: float, min_count: int
) -> DataFrame:
    """Closed buckets of a stream (``by..., start_ms, count``) with their scores.

    Buckets of a series must come in order from batch to batch, as closing gives them. The
    state of a series is its last ``window`` buckets; no batch reads older ones.
    """
    # A series is told by text, so that null is a name like any other.
    named = F.struct(*by) if by else F.struct((F.col("count") * 0).alias("all"))
    series = F.to_json(named, _EXACT).alias("_series")
    names = schema_of(buckets, *by) if by else "all bigint"
    scorer = _Scorer(bucket_seconds * 1000, window, k, min_count)
    scored = (
        buckets.select(series, "start_ms", "count")
        .groupBy("_series")
        .transformWithStateInPandas(
            scorer,
            outputStructType=f"_series string, start_ms bigint, count bigint, {_SCORES}",
            outputMode="Append",
            timeMode="None",
        )
    )
    name = F.from_json("_series", names, _EXACT)
    return scored.select(
        *(name.getField(x).alias(x) for x in by),
        "start_ms",
        "count",
        "mean",
        "stddev",
        "z_score",
        "is_anomaly",
    )
