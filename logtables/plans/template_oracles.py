"""DuckDB statements that mine templates one message after the other.

All leaves go forward together: step k of the recursion lets the k-th distinct pattern
of each leaf meet the templates that its leaf has by then.
"""

from __future__ import annotations

from logtables.plans.oracles import EVENTS, ROW, _LEVEL_STEP, _LOGS, _PATTERNS, _TOKENS, pattern

_LINES = _PATTERNS.replace("with ", "with recursive ", 1)
_LOG_LINES = f"""with recursive logs as ({_LOGS}),
placed as (select {pattern("raw")} as pattern, arrival as ord from logs),
patterns as (select pattern, count(*) as count, min(ord) as first from placed group by pattern)"""

_EVENT_LINES = EVENTS.replace("with ", "with recursive ", 1) + f""",
placed as (select {pattern("message")} as pattern, arrival as ord from events),
patterns as (select pattern, count(*) as count, min(ord) as first from placed group by pattern)"""

_FOLD = f""",
keys0 as (
 select *, cast(len(tokens) as varchar) as leaf0, tokens[1] as t1, tokens[2] as t2
 from (select *, {_TOKENS} as tokens from patterns) q),
{_LEVEL_STEP.format(n=1, p=0)},
{_LEVEL_STEP.format(n=2, p=1)},
numbered as (
 select leaf2 as leaf, pattern, tokens, first,
  row_number() over (partition by leaf2 order by first) as k from keys2),
fold as (
 select distinct leaf, cast(0 as bigint) as k,
  cast([] as struct(toks varchar[], founding varchar, since bigint)[]) as ts from numbered
 union all
 select leaf, k, case
  when nearest is null then list_append(ts, {{'toks': tokens, 'founding': pattern, 'since': first}})
  else list_transform(ts, lambda t, j: case when j <> nearest then t else {{
   'toks': list_transform(t.toks, lambda x, i: case when x = tokens[i] then x else '<*>' end),
   'founding': t.founding, 'since': t.since}} end) end
 from (
  select *, case
   when len(ts) = 0 then null
   when len(tokens) = 0 then 1
   when list_max(scores) / len(tokens) >= 0.4 then list_position(scores, list_max(scores)) end as nearest
  from (
   select f.leaf, n.k, n.pattern, n.tokens, n.first, f.ts, list_transform(f.ts, lambda t:
     len(list_filter(t.toks, lambda x, i: x = '<*>' or x = n.tokens[i]))) as scores
   from fold f join numbered n on n.leaf = f.leaf and n.k = f.k + 1) met) chosen),
last as (select leaf, max(k) as k from fold group by leaf),
made as (
 select leaf, unnest(range(1, len(ts) + 1)) as no, unnest(ts) as t
 from fold join last using (leaf, k)),
named as (
 select leaf, no, row_number() over (order by t.since) - 1 as template_id,
  sha1(concat(leaf, '|', t.founding)) as template_key,
  array_to_string(t.toks, ' ') as template from made)"""

# the earliest template that covers a message in the state of its leaf at that place
_HOMES = """,
at_place as (
 select p.ord, n.leaf, n.pattern, n.tokens, s.k
 from placed p join numbered n on n.pattern = p.pattern
 asof join numbered s on s.leaf = n.leaf and p.ord >= s.first),
homes as (
 select leaf, pattern, k, list_position(list_transform(ts, lambda t:
   len(list_filter(t.toks, lambda x, i: x <> '<*>' and x <> tokens[i])) = 0), true) as no
 from (select distinct leaf, pattern, tokens, k from at_place) q join fold using (leaf, k)),
tagged as (
 select a.ord, t.template_id, t.template
 from at_place a join homes using (leaf, pattern, k) join named t using (leaf, no))"""

_TAGGED_LOGS = f"{_LOG_LINES}{_FOLD}{_HOMES} select ord as arrival, template_id from tagged"

TEMPLATE_ORACLES = {
    "mine_templates": f"{_LINES}{_FOLD} select template_id, template_key, template from named",
    "ranked_templates": f"""{_LINES}{_FOLD}{_HOMES}
        select template_id, template, count(*) as count from tagged group by all""",
    "assign_templates": _TAGGED_LOGS,
    "stream_templates": _TAGGED_LOGS,
    "search_template": f"""{_EVENT_LINES}{_FOLD}{_HOMES}
        select {ROW} from events join tagged on arrival = ord where template_id = 0""",
}
