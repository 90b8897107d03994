"""Content hashes: the event id and the cluster fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtables.functions.times import epoch_ms


def event_id(source: Column, raw: Column, ts: Column) -> Column:
    """Stable id of an event: SHA-1 of source, raw line and epoch milliseconds."""
    return F.sha1(
        F.concat(source, F.lit("|"), raw, F.lit("|"), epoch_ms(ts).cast("string"))
    )


def cluster_fingerprint(template: Column, count: Column) -> Column:
    """Stable id of a cluster at its order of magnitude: SHA-1 of template and digits."""
    digits = F.length(count.cast("string")).cast("string")
    return F.sha1(F.concat(template, F.lit("|"), digits))
