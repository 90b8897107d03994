"""Event batches as JSON text: ``{version, agent_id, events: [...]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.functions.ids import event_id
from logtables.functions.levels import FATAL
from logtables.functions.times import parse_iso, utc, utc_date
from logtables.operators.numbering import numbered

# The batch version, events per batch, and the name of an unnamed agent.
BATCH_VERSION = 1
BATCH_SIZE = 100
UNKNOWN_AGENT = "unknown"

_ENVELOPE = """array<struct<version: string, agent_id: string, events: array<struct<
    ts: string, level: string, source: string, message: string, raw: string,
    fields: map<string,string>>>>>"""
_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _iso(ts: Column) -> Column:
    """ISO time in UTC, with microseconds only if there are any."""
    fraction = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    whole, full = (F.date_format(utc(ts), shape) for shape in (_ISO, _ISO + ".SSSSSS"))
    return F.concat(F.when(fraction == 0, whole).otherwise(full), F.lit("+00:00"))


def pack_batches(
    events: DataFrame, agent: str = "source", batch_size: int = BATCH_SIZE
) -> DataFrame:
    """``agent_id, chunk, n, first_ts, last_ts, payload``: runs of each agent's events.

    Events are taken by time and id, at most ``batch_size`` to a batch.
    """
    text = F.to_json(
        F.struct(
            _iso(F.col("ts")).alias("ts"),
            "level",
            "source",
            "message",
            "raw",
            F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"),
        )
    )
    rows = events.select(F.col(agent).alias("agent_id"), "ts", "event_id", text.alias("_json"))
    rows = numbered(rows, ["agent_id"], ["ts", "event_id"], "_n")
    chunk = F.floor(F.col("_n") / batch_size).cast("bigint").alias("chunk")
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct("_n", "_json"))), lambda e: e["_json"]
    )
    name = F.to_json(F.struct("agent_id"))
    payload = F.concat(
        F.lit(f'{{"version":{BATCH_VERSION},'),
        F.substring(name, F.lit(2), F.length(name) - 2),
        F.lit(',"events":['),
        F.array_join("_events", ","),
        F.lit("]}"),
    )
    return (
        rows.groupBy("agent_id", chunk)
        .agg(
            F.count("*").alias("n"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            listed.alias("_events"),
        )
        .select("agent_id", "chunk", "n", "first_ts", "last_ts", payload.alias("payload"))
    )


def checked_batches(batches: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``agent_id``, ``events`` and ``reason``; the reason is NULL for a good batch."""
    read = F.from_json(
        F.concat(F.lit("["), F.col(payload), F.lit("]")),
        _ENVELOPE,
        {"allowSingleQuotes": "false"},
    )
    # Here and for the typed events, one inline() per batch keeps what was read: without it
    # Catalyst would copy the reading into every later use and filter of it.
    batch = F.when(F.size("_read") == 1, F.get("_read", F.lit(0))).alias("_batch")
    df = batches.select("*", F.inline(F.array(F.struct(read.alias("_read")))))
    df = df.select(*batches.columns, batch)
    events = F.coalesce(F.col("_batch.events"), F.array().cast(_event_array()))

    def typed(e: Column) -> Column:
        return F.struct(
            parse_iso(e["ts"]).alias("ts"),
            e["level"].try_cast("int").alias("level"),
            e["source"].alias("source"),
            e["message"].alias("message"),
            e["raw"].alias("raw"),
            F.coalesce(e["fields"], F.create_map().cast("map<string,string>")).alias("fields"),
        )

    df = df.select("*", F.inline(F.array(F.struct(F.transform(events, typed).alias("events")))))
    needed = ("ts", "level", "source", "message", "raw")
    incomplete = F.exists(
        "events", lambda e: F.greatest(*[e[c].isNull() for c in needed])
    )
    bad_level = F.exists("events", lambda e: ~e["level"].between(0, FATAL))
    reason = (
        F.when(F.col("_batch").isNull(), "not one JSON object")
        .when(
            F.coalesce(F.col("_batch.version") != str(BATCH_VERSION), F.lit(True)),
            "unsupported version",
        )
        .when(incomplete, "event field missing or malformed")
        .when(bad_level, "level out of range")
    )
    agent = F.coalesce(F.col("_batch.agent_id"), F.lit(UNKNOWN_AGENT))
    return df.withColumns({"agent_id": agent, "reason": reason}).drop("_read", "_batch")


def _event_array() -> str:
    return _ENVELOPE[_ENVELOPE.index("events: ") + len("events: ") :].rsplit(">>", 1)[0]


def unpack_batches(batches: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Events of the good batches, and the refused batches with a reason.

    A batch is refused whole: bad JSON, another version, a level outside 0..5, or
    an event without time, level, source, message or raw line.
    """
    checked = checked_batches(batches, payload)
    good = checked.filter("reason is null").select("agent_id", F.inline("events"))
    events = good.select(
        "agent_id",
        event_id(F.col("source"), F.col("raw"), F.col("ts")).alias("event_id"),
        "ts",
        "level",
        "source",
        "message",
        "raw",
        "fields",
        F.lit(None).cast("timestamp").alias("ingest_ts"),
        F.lit(None).cast("bigint").alias("template_id"),
        utc_date(F.col("ts")).alias("event_date"),
    )
    refused = checked.filter("reason is not null").select(
        F.col(payload).alias("payload"), "agent_id", "reason"
    )
    return events, refused


def batch_totals(batches: DataFrame, payload: str = "payload") -> DataFrame:
    """``agent_id, batches, refused, events_received`` per agent."""
    checked = checked_batches(batches, payload)
    good = F.col("reason").isNull()
    return checked.groupBy("agent_id").agg(
        F.count_if(good).alias("batches"),
        F.count_if(~good).alias("refused"),
        F.coalesce(F.sum(F.when(good, F.size("events"))), F.lit(0)).alias("events_received"),
    )
