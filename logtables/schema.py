"""The fixed event columns."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("raw", T.StringType(), False),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("ingest_ts", T.TimestampType(), True),
        T.StructField("template_id", T.LongType(), True),
        T.StructField("event_date", T.DateType(), False),
    ]
)
