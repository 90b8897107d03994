"""Raw log lines to events: JSON, logfmt, leveled text, or unstructured.

Everything is native columns. A detector adds one struct column that is NULL
where its format does not apply, so a line that fits nothing is never an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.functions.ids import event_id
from logtables.functions.levels import INFO, normalize_level, scan_level
from logtables.functions.text import strip
from logtables.functions.times import parse_timestamp, utc_date

# The keys read as message, time and level, first in the list
# first, and the shapes of a logfmt pair and of a leveled line.
MESSAGE_KEYS = ("message", "msg", "log", "text")
TIME_KEYS = ("timestamp", "time", "ts", "@timestamp", "datetime")
LEVEL_KEYS = ("level", "lvl", "severity", "loglevel")
LOGFMT_PAIR = r'(\w+)=("(?:[^"\\]|\\.)*"|\S+)'
LINE_TIME = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
LINE_LEVEL = "TRACE|DEBUG|INFO|INFORMATION|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL"
LEVELED_LINE = rf"^\s*(?:\[?({LINE_TIME})\]?\s+)?\[?({LINE_LEVEL})\]?\s+(?:({LINE_TIME})\s+)?(.*\S)\s*$"

SPECIAL_KEYS = MESSAGE_KEYS + TIME_KEYS + LEVEL_KEYS

# The same matches as LOGFMT_PAIR at less cost: a key is tried once, from its first
# letter, and the possessive repeats spare the stack Java spends per repeat of a group.
_PAIR = "(?U)(?<!\\w)" + LOGFMT_PAIR.replace(r"(\w+)", r"(\w++)").replace(
    r'[^"\\]|\\.)*', r'[^"\\]++|\\.)*+'
)
_LEVELED = "(?isU)" + LEVELED_LINE
_SEP = "\u0001"

Detector = Callable[[DataFrame, str, str], DataFrame]


def _structured(df: DataFrame, keys: str, values: str, out: str, when: str) -> DataFrame:
    """Add the extraction struct for parallel arrays of keys and values.

    Both arrays, given as SQL, run from the last pair to the first, because of
    keys equal but for case the last one counts.
    """
    df = df.withColumns(
        {
            f"{out}_keys": F.expr(keys),
            f"{out}_values": F.expr(values),
            f"{out}_folded": F.expr(f"transform({keys}, k -> lower(k))"),
        }
    )
    keys, values, folded = f"{out}_keys", f"{out}_values", f"{out}_folded"

    def first_present(names: Sequence[str]) -> str:
        places = [f"cast(array_position({folded}, '{n}') - 1 as int)" for n in names]
        return f"coalesce({', '.join(f'get({values}, {p})' for p in places)})"

    special = ", ".join(f"'{k}'" for k in SPECIAL_KEYS)
    pairs, plain = f"arrays_zip({keys}, {values})", f"lower(e.{keys}) not in ({special})"
    repeated = f"array_contains(slice({keys}, 1, i), e.{keys})"
    struct = f"""named_struct(
        'message', {first_present(MESSAGE_KEYS)},
        'level', {first_present(LEVEL_KEYS)},
        'timestamp', {first_present(TIME_KEYS)},
        'fields', map_from_entries(if(size(array_distinct({keys})) = size({keys}),
            filter({pairs}, e -> {plain}),
            filter({pairs}, (e, i) -> {plain} and not {repeated}))))"""
    df = df.withColumn(out, F.expr(f"case when {when} then {struct} end"))
    return df.drop(keys, values, folded)


def detect_json(df: DataFrame, line: str, out: str) -> DataFrame:
    """One JSON object per line.

    Wrapped in brackets and read as an array, so text after the object makes
    two elements or none, and the line is refused.
    """
    raw, text, objects = F.col(line), f"{out}_text", f"{out}_objects"
    braced = raw.startswith("{") & raw.endswith("}")
    # trimming costs more than the test for it, and most lines need none
    df = df.withColumn(text, F.when(braced, raw).when(raw.contains("}"), strip(raw)))
    read = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")),
        "array<map<string,string>>",
        {"allowSingleQuotes": "false"},
    )
    braced = F.col(text).startswith("{") & F.col(text).endswith("}")
    df = df.withColumn(objects, F.when(braced, read)).drop(text)
    one = f"case when size({objects}) = 1 then get({objects}, 0) end"
    keys, values = f"reverse(map_keys({one}))", f"reverse(map_values({one}))"
    return _structured(df, keys, values, out, f"{out}_keys is not null").drop(objects)


def detect_logfmt(df: DataFrame, line: str, out: str) -> DataFrame:
    """``key=value`` pairs, values optionally quoted, at least one special key."""
    found = F.reverse(F.regexp_extract_all(F.col(line), F.lit(_PAIR), F.lit(0)))
    pairs = f"{out}_pairs"
    df = df.withColumn(pairs, F.when(F.col(line).contains("="), found))
    value = "substring(p, instr(p, '=') + 1)"
    quoted = f"startswith({value}, '\"') and endswith({value}, '\"')"
    inner = "substring(p, instr(p, '=') + 2, length(p) - instr(p, '=') - 2)"
    plain = f"if({quoted}, replace({inner}, r'\\\"', '\"'), {value})"
    keys = f"transform({pairs}, p -> substring_index(p, '=', 1))"
    special = ", ".join(f"'{k}'" for k in SPECIAL_KEYS)
    known = f"arrays_overlap({out}_folded, array({special}))"
    return _structured(df, keys, f"transform({pairs}, p -> {plain})", out, known).drop(pairs)


def detect_leveled(df: DataFrame, line: str, out: str) -> DataFrame:
    """``[time] LEVEL [time] message`` in plain text."""
    df = df.withColumn(f"{out}_level", F.regexp_extract(F.col(line), _LEVELED, 2))
    rest = F.split(
        F.regexp_replace(F.col(line), _LEVELED, f"$1{_SEP}$3{_SEP}$4"), _SEP, 3
    )
    df = df.withColumn(f"{out}_rest", F.when(F.col(f"{out}_level") != "", rest))
    before, after, message = (F.get(f"{out}_rest", F.lit(i)) for i in range(3))
    struct = F.struct(
        message.alias("message"),
        F.col(f"{out}_level").alias("level"),
        F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))).alias("timestamp"),
        F.create_map().cast("map<string,string>").alias("fields"),
    )
    df = df.withColumn(out, F.when(F.col(f"{out}_rest").isNotNull(), struct))
    return df.drop(f"{out}_level", f"{out}_rest")


DETECTORS: dict[str, Detector] = {
    "json": detect_json,
    "logfmt": detect_logfmt,
    "leveled": detect_leveled,
}


def _there(df: DataFrame, name: str) -> list[Column]:
    return [F.col(name)] if name in df.columns else []


def parse_logs(
    lines: DataFrame,
    detectors: dict[str, Detector] | None = None,
    line: str = "value",
    ingest_ts: Column | None = None,
) -> DataFrame:
    """Parse ``line`` of a frame with ``source`` and ``ingest_ts`` into events.

    ``detectors`` are tried in order, each only on lines no earlier one took.
    Lines without a usable time take ``ingest_ts``; without a level, the first
    severity word in the message, else INFO. Further columns are kept. A line
    without source is from ``-``; one without ingest time came at the argument
    ``ingest_ts``, by default now.
    """
    detectors = DETECTORS if detectors is None else detectors
    others = [c for c in lines.columns if c not in (line, "source", "ingest_ts")]
    now = F.current_timestamp() if ingest_ts is None else ingest_ts
    df = lines.withColumnRenamed(line, "raw").withColumns(
        {
            "source": F.coalesce(*_there(lines, "source"), F.lit("-")),
            "ingest_ts": F.coalesce(*_there(lines, "ingest_ts"), now),
        }
    )
    found: list[str] = []
    for name, detect in detectors.items():
        # NULL for a line already taken: every detector is NULL on NULL input
        left = F.when(F.coalesce(*[F.col(f) for f in found], F.lit(None)).isNull(), F.col("raw"))
        df = df.withColumn(f"_in_{name}", left if found else F.col("raw"))
        df = detect(df, f"_in_{name}", f"_{name}")
        found.append(f"_{name}")

    nothing = F.struct(
        F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("string").alias("level"),
        F.lit(None).cast("string").alias("timestamp"),
        F.create_map().cast("map<string,string>").alias("fields"),
    )
    shape = F.lit("raw")
    for name in reversed(found):
        shape = F.when(F.col(name).isNotNull(), F.lit(name[1:])).otherwise(shape)
    df = df.withColumns({"_parsed": F.coalesce(*found, nothing), "_format": shape})
    message = F.coalesce(F.nullif(F.col("_parsed.message"), F.lit("")), F.col("raw"))
    df = df.withColumns({"_message": message, "_time": strip(F.col("_parsed.timestamp"))})
    time = parse_timestamp(F.col("_time"), trimmed=True)
    event = F.struct(
        F.coalesce(time, F.col("ingest_ts")).alias("ts"),
        F.coalesce(
            normalize_level(F.col("_parsed.level")), scan_level(F.col("_message")), F.lit(INFO)
        ).alias("level"),
        F.col("_message").alias("message"),
        F.col("_parsed.fields").alias("fields"),
        F.col("_format").alias("format"),
    )
    # One inline() per line keeps the parsed values together: without it Catalyst
    # would copy the whole parse into every later filter on them.
    df = df.select(*others, "source", "raw", "ingest_ts", F.inline(F.array(event)))
    return df.select(
        *others,
        event_id(F.col("source"), F.col("raw"), F.col("ts")).alias("event_id"),
        "ts",
        "level",
        "source",
        "message",
        "raw",
        "fields",
        "ingest_ts",
        F.lit(None).cast("bigint").alias("template_id"),
        utc_date(F.col("ts")).alias("event_date"),
        "format",
    )
