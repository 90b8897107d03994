"""DuckDB statements giving the same rows as the queries of the same name."""

from __future__ import annotations

from logtables.functions.text import ACCENTED, MASKS, PLAIN
from logtables.operators.parse import LEVELED_LINE
from logtables.plans.views import LOGS_SQL

_LOGS = LOGS_SQL.format(
    iso="strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')",
    ingest="ts + to_seconds(event_id % 7)",
)

_PAIR = r"""("(?:[^"\\]|\\.)*"|\S+)"""


def _json_first(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(raw, '$.\"{k}\"')" for k in keys) + ")"


def _logfmt_first(*keys: str) -> str:
    found = [f"nullif(regexp_extract(raw, '(?:^|\\s){k}={_PAIR}', 1), '')" for k in keys]
    return "replace(trim(coalesce(" + ", ".join(found) + "), '\"'), '\\\"', '\"')"


_MESSAGE = ("message", "msg", "log", "text")
_TIME = ("timestamp", "time", "ts", "@timestamp", "datetime")
_LEVEL = ("level", "lvl", "severity", "loglevel")

LEVEL_OF = """case lower(trim({0}))
 when 'trace' then 0 when 't' then 0 when '10' then 0 when '0' then 0
 when 'debug' then 1 when 'd' then 1 when '20' then 1 when '1' then 1
 when 'info' then 2 when 'information' then 2 when 'notice' then 2 when 'i' then 2
 when '30' then 2 when '2' then 2
 when 'warn' then 3 when 'warning' then 3 when 'w' then 3 when '40' then 3 when '3' then 3
 when 'error' then 4 when 'err' then 4 when 'e' then 4 when '50' then 4 when '4' then 4
 when 'fatal' then 5 when 'critical' then 5 when 'crit' then 5 when 'emergency' then 5
 when 'f' then 5 when '60' then 5
 else case when regexp_full_match(trim({0}), '[0-9]+') then 5 end end"""

_SCANNED = r"regexp_extract(message, '(?i)\b(fatal|critical|error|warn(?:ing)?|debug|trace)\b', 1)"

# events: arrival, event_id, ts, level, source, message, raw, user_id, ingest_ts, format
EVENTS = f"""with logs as ({_LOGS}),
shaped as (
 select *, case
  when raw like '{{%' and raw like '%}}' and json_valid(raw) then 'json'
  when regexp_matches(raw, '(?:^|\\s)({"|".join(k for k in _MESSAGE + _TIME + _LEVEL if k[0] != "@")})=\\S') then 'logfmt'
  when regexp_matches(raw, '{LEVELED_LINE}', 'i') then 'leveled'
  else 'raw' end as format from logs),
taken as (
 select *,
  case format when 'json' then {_json_first(*_MESSAGE)} when 'logfmt' then {_logfmt_first(*_MESSAGE)}
   when 'leveled' then regexp_extract(raw, '{LEVELED_LINE}', 4, 'i') end as message0,
  case format when 'json' then {_json_first(*_LEVEL)} when 'logfmt' then {_logfmt_first(*_LEVEL)}
   when 'leveled' then regexp_extract(raw, '{LEVELED_LINE}', 2, 'i') end as level0,
  case format when 'json' then {_json_first(*_TIME)} when 'logfmt' then {_logfmt_first(*_TIME)}
   when 'leveled' then coalesce(nullif(regexp_extract(raw, '{LEVELED_LINE}', 1, 'i'), ''),
    nullif(regexp_extract(raw, '{LEVELED_LINE}', 3, 'i'), '')) end as time0,
  case format when 'json' then json_extract_string(raw, '$.user_id')
   when 'logfmt' then nullif(regexp_extract(raw, 'user_id=(\\S+)', 1), '') end as user_id
 from shaped),
timed as (
 select *, coalesce(nullif(message0, ''), raw) as message,
  coalesce(try_cast(replace(time0, 'Z', '') as timestamp), ingest_ts) as ts from taken),
events1 as (
 select arrival, source, message, raw, user_id, ingest_ts, format, ts,
  cast(coalesce({LEVEL_OF.format("level0")}, {LEVEL_OF.format(_SCANNED)}, 2) as integer) as level,
  epoch_us(ts) as ts_us, epoch_us(ts) // 1000 as ts_ms,
  epoch_us(ingest_ts) as ingest_us from timed),
events as (
 select *, sha1(concat(source, '|', raw, '|', cast(ts_ms as varchar))) as event_id from events1)
"""

DOCLINES = """with doclines as (
 select doc_id, source, unnest(string_split(text, chr(10))) as line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)
"""

ROW = "event_id, ts_us, level, source, message, raw"


def masked(value: str) -> str:
    """The four masks, one after the other."""
    for mask in MASKS:
        value = f"regexp_replace({value}, '{mask}', '<*>', 'g')"
    return value


def pattern(value: str) -> str:
    return f"trim(regexp_replace({masked(value)}, '\\s+', ' ', 'g'))"


def search_form(value: str) -> str:
    plain = f"translate(lower({value}), '{ACCENTED}', '{PLAIN}')"
    return f"(' ' || trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"


def _matching(where: str) -> str:
    return f"{EVENTS} select {ROW} from events where {where}"


def _newest(where: str, limit: int = 100) -> str:
    return f"{_matching(where)} order by ts desc, event_id limit {limit}"


_PATTERNS = DOCLINES + f""", placed as (
 select {pattern("line")} as pattern, doc_id * 4294967296 + line_no as ord from doclines),
patterns as (select pattern, count(*) as count, min(ord) as first from placed group by pattern)"""

_TOKENS = "case when pattern = '' then [] else string_split(pattern, ' ') end"

_LEVEL_STEP = """
seen{n} as (select leaf{p}, t{n}, row_number() over (partition by leaf{p} order by min(first)) as place
 from keys{p} where t{n} is not null group by leaf{p}, t{n}),
keys{n} as (select k.*, case when k.t{n} is null then k.leaf{p}
  when s.place <= 100 then k.leaf{p} || ' ' || k.t{n} else k.leaf{p} || ' <*>' end as leaf{n}
 from keys{p} k left join seen{n} s on k.leaf{p} = s.leaf{p} and k.t{n} = s.t{n})"""

# Spikes of any frame named counts(series, start_ms, count).
_SPIKES = """, span as (select series, min(start_ms) as first_ms, max(start_ms) as last_ms from counts group by series),
sums as (
 select c.series, c.start_ms, c.count, s.last_ms,
  least({window}, (c.start_ms - s.first_ms) // {ms}) as n,
  coalesce(sum(cast(c.count as double)) over w, 0) as s1,
  coalesce(sum(cast(c.count as double) * c.count) over w, 0) as s2
 from counts c join span s on c.series = s.series
 window w as (partition by c.series order by c.start_ms
  range between {window} * {ms} preceding and {ms} preceding)),
stats as (
 select *, case when n > 0 then s1 / n else 0 end as mean,
  case when n > 0 then sqrt(greatest(0, s2 / n - (s1 / n) * (s1 / n))) else 0 end as stddev from sums),
scored as (
 select *, case when n < 2 then 0 when stddev > 0 then (count - mean) / stddev
  when count > mean then 'infinity'::double else 0 end as z from stats)
select {series} start_ms, cast(count as bigint) as count, round(mean, 6) as mean,
 round(stddev, 6) as stddev, round(case when isinf(z) then null else z end, 6) as z_score,
 n >= 2 and count >= 5 and z >= 3.0 as is_anomaly
from scored where {closed}"""


def _bucket(seconds: int) -> str:
    return f"ts_ms // {seconds * 1000} * {seconds * 1000}"


def _pattern_clusters() -> str:
    """Masked messages of the log events with counts and fingerprints."""
    return f"""{EVENTS}, clusters as (
 select pattern, count(*) as count,
  sha1(concat(pattern, '|', cast(length(cast(count(*) as varchar)) as varchar))) as fingerprint
 from (select {pattern("message")} as pattern from events) group by pattern),
summaries as (select fingerprint, concat('known: ', pattern) as summary from clusters
 where pattern like '%connect%')"""


_BATCHES = """, numbered as (
 select *, row_number() over (partition by source order by ts, event_id) - 1 as n from events)"""

ORACLES: dict[str, str] = {
    "read_logs": f"with logs as ({_LOGS}) select 'app.log' as source, raw as value from logs",
    "stream_logs": f"with logs as ({_LOGS}) select 'app.log' as source, raw as value from logs",
    "merge_sources": f"""{DOCLINES}, logs as ({_LOGS})
        select source, raw as value from logs
        union all select 'documents', line from doclines where line <> ''
        union all select 'conversations', line from (
            select unnest(string_split(text, chr(10))) as line from conversations) where line <> ''""",
    "pack_batches": f"""{EVENTS}{_BATCHES}
        select source as agent_id, n // 100 as chunk, count(*) as n,
         min(ts_us) as first_us, max(ts_us) as last_us from numbered group by source, n // 100""",
    "unpack_batches": f"{EVENTS} select source as agent_id, {ROW}, coalesce(user_id, '') as user_id from events",
    "batch_totals": f"""{EVENTS}{_BATCHES}
        select source as agent_id, count(distinct n // 100) as batches,
         count(distinct n // 100) as refused, count(*) as events_received from numbered group by source""",
    "append_dedup": f"{EVENTS} select {ROW} from events",
    "count_events": f"{EVENTS} select count(*) as events from events",
    "dedup_events": f"{EVENTS} select {ROW}, ingest_us from events",
    "format_events": f"""{EVENTS} select event_id, printf('%s %-5s [%s] %s', strftime(ts, '%H:%M:%S'),
        ['TRACE','DEBUG','INFO','WARN','ERROR','FATAL'][level + 1], source, message) as line from events""",
    "parse_json": f"{EVENTS} select arrival, message0 as message, level0 as level, time0 as time, user_id from events2 where format = 'json'",
    "parse_logfmt": f"{EVENTS} select arrival, message0 as message, level0 as level, time0 as time, user_id from events2 where format = 'logfmt'",
    "parse_leveled": f"{EVENTS} select arrival, message0 as message, level0 as level, time0 as time from events2 where format = 'leveled'",
    "parse_logs": f"{EVENTS} select arrival, format, {ROW}, coalesce(user_id, '') as user_id, ingest_us from events",
    "normalize_level": f"""select event_id, event_type, token, cast(coalesce({LEVEL_OF.format("token")}, -1) as integer) as level from (
        select event_id, event_type, case when event_id % 2 = 0 then event_type else cast(user_id % 70 as varchar) end as token from events)""",
    "scan_level": f"{EVENTS} select arrival, cast(coalesce({LEVEL_OF.format(_SCANNED.replace('message', 'raw'))}, -1) as integer) as level from events",
    "parse_timestamp": """select event_id, form, case when form in (0, 1, 2, 3) then epoch_us(ts)
         when form = 4 then epoch_us(date_trunc('millisecond', ts)) else -1 end as ts_us
        from (select event_id, ts, event_id % 7 as form from events)""",
    "event_id": f"{EVENTS} select arrival, event_id from events",
    "mask_messages": f"{DOCLINES} select doc_id, line_no, {masked('line')} as masked from doclines",
    "token_counts": f"""{_PATTERNS} select cast(len({_TOKENS}) as integer) as n_tokens,
        count(*) as lines from placed group by 1""",
    "template_similarity": f"""{DOCLINES}, pairs as (
         select a.doc_id, a.line_no, case when {pattern('a.line')} = '' then [] else string_split({pattern('a.line')}, ' ') end as t,
          case when {pattern('b.line')} = '' then [] else string_split({pattern('b.line')}, ' ') end as m
         from doclines a join doclines b on a.doc_id = b.doc_id and a.line_no + 1 = b.line_no)
        select doc_id, line_no, round(case when len(t) <> len(m) then 0.0 when len(t) = 0 then 1.0
         else len(list_filter(list_zip(t, m), lambda x: x[1] = '<*>' or x[1] = x[2])) / len(t) end, 6) as similarity
        from pairs""",
    "merge_templates": f"""{DOCLINES}, pairs as (
         select a.doc_id, a.line_no, case when {pattern('a.line')} = '' then [] else string_split({pattern('a.line')}, ' ') end as t,
          case when {pattern('b.line')} = '' then [] else string_split({pattern('b.line')}, ' ') end as m
         from doclines a join doclines b on a.doc_id = b.doc_id and a.line_no + 1 = b.line_no)
        select doc_id, line_no, coalesce(array_to_string(list_transform(list_zip(t, m),
         lambda x: case when x[1] = x[2] then x[1] else '<*>' end), ' '), '') as merged
        from pairs where len(t) = len(m)""",
    "ingest_lag": f"{EVENTS} select event_id, greatest(0, (ingest_us - ts_us) / 1000.0) as lag_ms from events",
    "search_level": _matching("level >= 3"),
    "search_source": _matching("source = 'svc-2'"),
    "search_field": _matching("user_id = '8'"),
    "search_field_loose": _matching("user_id ilike '%4%'"),
    "search_last": _matching("ts >= timestamp '2024-01-31 00:00:00' - interval 5 day"),
    "search_text": f"""{DOCLINES} select doc_id, line_no, source, line as message from doclines
        where ({search_form('line')} like '% la %' or {search_form('source')} like '% la %')
         and ({search_form('line')} like '% de %' or {search_form('source')} like '% de %')""",
    "search_substring": _matching("lower(message) like '%db-3 after%'"),
    "search_like": _matching("message ilike '%user%took%'"),
    "search_combined": _matching(
        "level >= 4 and source = 'svc-1' and ts >= timestamp '2024-01-31 00:00:00' - interval 20 day"
        f" and {search_form('message')} like '% failed to connect %'"
    ),
    "search_latest": _newest("true"),
    "search_oldest_first": _newest("level >= 4"),
    "search_semi": f"{EVENTS} select {ROW} from events where event_id in (select event_id from events where message like '%db-3%')",
    "filter_any": f"{EVENTS} select {ROW} from events where lower(message) like '%signup%' or lower(source) like '%svc-4%'",
    "latest_events": _newest("true", 2000),
    "bucket_counts": f"""{EVENTS} select source, {_bucket(3600)} as start_ms, count(*) as count
        from events group by source, {_bucket(3600)}""",
    "error_spikes": f"""{EVENTS}, counts as (select 0 as series, {_bucket(3600)} as start_ms, count(*) as count
        from events where level >= 4 group by 2)"""
    + _SPIKES.format(window=30, ms=3600000, series="", closed="start_ms < last_ms"),
    "source_spikes": f"""{EVENTS}, counts as (select source as series, {_bucket(600)} as start_ms, count(*) as count
        from events where level >= 4 group by 1, 2)"""
    + _SPIKES.format(window=30, ms=600000, series="series as source,", closed="start_ms < last_ms"),
    "recent_counts": f"""{EVENTS}, counts as (select source, {_bucket(3600)} as start_ms, count(*) as count
         from events where level >= 4 group by 1, 2),
        span as (select source, min(start_ms) as first_ms, max(start_ms) as last_ms from counts group by source),
        slots as (select source, unnest(range(greatest(first_ms, last_ms - 30 * 3600000), last_ms, 3600000)) as start_ms from span)
        select s.source, string_agg(cast(coalesce(c.count, 0) as varchar), ',' order by s.start_ms) as counts
        from slots s left join counts c on s.source = c.source and s.start_ms = c.start_ms group by s.source""",
    "ingest_rate": f"""{EVENTS}, counts as (select ingest_us // 1000000 as second, count(*) as count from events group by 1)
        select second, count, cast(sum(count) over (order by second range between 4 preceding and current row) as bigint) / 5 as rate
        from counts""",
    "lag_percentiles": f"""{EVENTS}, latest as (
         select greatest(0, (ingest_us - ts_us) / 1000.0) as lag_ms from events order by ingest_us desc, event_id limit 1024)
        select round(quantile_cont(lag_ms, 0.5), 6) as p50, round(quantile_cont(lag_ms, 0.95), 6) as p95 from latest""",
    "health_snapshot": f"""{EVENTS}, latest as (
         select greatest(0, (ingest_us - ts_us) / 1000.0) as lag_ms from events order by ingest_us desc, event_id limit 1024),
        snap as (select count(*) as events_total,
         round_even(count(*) filter (where ingest_us // 1000000 between 1706659200 - 86400 + 1 and 1706659200) / 86400, 1) as ingest_per_s,
         cast(trunc(max_by(greatest(0, (ingest_us - ts_us) / 1000.0), {{'a': ingest_us, 'b': event_id}})) as bigint) as ingest_lag_ms,
         (select count(distinct {pattern('message')}) from events) as clusters,
         (select round_even(quantile_cont(lag_ms, 0.5), 1) from latest) as query_p50_ms,
         (select round_even(quantile_cont(lag_ms, 0.95), 1) from latest) as query_p95_ms from events)
        select *, concat('in ', cast(ingest_per_s as varchar), '/s  |  q 0  |  lag ', ingest_lag_ms, 'ms  |  clusters ', clusters,
         '  |  total ', events_total) as status from snap""",
    "pattern_counts": f"{_PATTERNS} select pattern, count, first as first_ord from patterns",
    "leaf_keys": f"""{_PATTERNS}, tokenised as (select *, {_TOKENS} as tokens from patterns),
        keys0 as (select *, cast(len(tokens) as varchar) as leaf0, tokens[1] as t1, tokens[2] as t2 from tokenised),
        {_LEVEL_STEP.format(n=1, p=0)},
        {_LEVEL_STEP.format(n=2, p=1)}
        select pattern, count, leaf2 as leaf from keys2""",
    "top_patterns": f"""{EVENTS}, counted as (select {pattern('message')} as pattern, count(*) as count from events group by 1),
        top as (select * from counted order by count desc, pattern limit 10)
        select pattern, count, cast(round_even(4.0 * count / (select max(count) from top), 0) as integer) as bar from top""",
    "cluster_fingerprint": f"{_pattern_clusters()} select pattern, count, fingerprint from clusters",
    "cluster_samples": f"""{EVENTS}, ranked as (select {pattern('message')} as pattern, raw, ts, event_id,
         row_number() over (partition by {pattern('message')} order by ts desc, event_id desc) as place from events)
        select pattern, string_agg(raw, chr(10) order by ts, event_id) as samples from ranked where place <= 20 group by pattern""",
    "cluster_context": f"""{EVENTS}, ranked as (select {pattern('message')} as pattern, raw, ts, event_id,
         row_number() over (partition by {pattern('message')} order by ts desc, event_id desc) as place,
         count(*) over (partition by {pattern('message')}) as count from events)
        select pattern, count, concat('Template: ', pattern, chr(10), 'Occurrences: ', count, chr(10), 'Sample lines:', chr(10),
         string_agg(raw, chr(10) order by ts, event_id) filter (where place > least(count, 20) - 15)) as prompt
        from ranked where place <= 20 group by pattern, count""",
    "attach_summaries": f"""{_pattern_clusters()} select c.pattern, c.count, s.summary
        from clusters c left join summaries s on c.fingerprint = s.fingerprint""",
    "summary_hit_rate": f"""{_pattern_clusters()} select round(avg(case when s.summary is null then 0.0 else 1.0 end), 6) as hit_rate
        from clusters c left join summaries s on c.fingerprint = s.fingerprint""",
    "summarize_missing": f"""{_pattern_clusters()} select c.fingerprint, concat('lines of Template: ', c.pattern) as summary
        from clusters c where c.fingerprint not in (select fingerprint from summaries)""",
    "stream_dedup": f"{EVENTS} select {ROW} from events",
    "stream_filter": f"{EVENTS} select {ROW} from events where lower(message) like '%signup%' or lower(source) like '%svc-4%'",
    "stream_buckets": f"""{EVENTS} select source, {_bucket(3600)} as start_ms, count(*) as count
        from events group by source, {_bucket(3600)}
        having {_bucket(3600)} + 3600000 <= (select max(ts_us) // 1000 from events) - 600000""",
    "stream_spikes": f"""{EVENTS}, counts as (select source as series, {_bucket(600)} as start_ms, count(*) as count
        from events where level >= 4 group by 1, 2)"""
    + _SPIKES.format(
        window=30,
        ms=600000,
        series="series as source,",
        closed="start_ms + 600000 <= (select max(ts_us) // 1000 from events where level >= 4) - 600000",
    ),
    "stream_rate": f"""{EVENTS}, marks as (select unnest(range(ingest_us // 1000000, ingest_us // 1000000 + 5)) as second from events)
        select second, count(*) / 5 as rate from marks group by second
        having second + 1 <= (select max(ingest_us) / 1000000.0 from events) - 600""",
}
for _name in ("parse_json", "parse_logfmt", "parse_leveled"):
    ORACLES[_name] = ORACLES[_name].replace("events2", "taken")
