"""The operators over the given tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.llm import html_extract
from logtables.llm.collocations import collocations
from logtables.llm.decontaminate import find_passages
from logtables.llm.jaccard_join import jaccard_classes
from logtables.llm.kd_shards import shard
from logtables.llm.language_id import identify, learn
from logtables.llm.license_scan import TEMPLATES, scan_licenses
from logtables.llm.line_dedup import drop_recurring
from logtables.llm.packing import pack
from logtables.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt
from logtables.llm.pseudonyms import KINDS, replace_private
from logtables.llm.quality import measured
from logtables.llm.secret_scan import digest, find_secrets

#: The key of the registered query; a deployment passes one of its own.
PSEUDONYM_KEY = b"a key for the given tables"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable) -> Callable:
    QUERIES[run.__name__] = run
    return run


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary is; the same on the driver and the workers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


ORACLES["op1_ngram_jaccard_join"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when coalesce(len(w), 0) = 0 then []
    when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))
    end as s
  from words),
post as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as x, b.doc_id as y
  from post a join post b on a.g = b.g and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges as (select x, y from pairs union select y, x from pairs),
reach as (
  select doc_id as x, doc_id as y from documents
  union select r.x, e.y from reach r join edges e on r.y = e.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.component_id
from sets s join (select x, min(y) as component_id from reach group by x) c on c.x = s.doc_id
"""


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


ORACLES["op4_benchmark_decontamination"] = r"""
with d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
pat as (
  select distinct item_id, least(len(w), 10) as m,
    array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0) q),
win as (
  select r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') as g
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i
    from d cross join (select distinct m from pat) lengths where len(w) >= m) q),
occ as (select win.r, win.i, win.m, pat.item_id from win join pat using (m, g)),
hit as (
  select r, count(distinct p) as n_hit
  from (select distinct r, unnest(range(i, i + m)) as p from occ) q group by r),
ids as (
  select r, count(distinct item_id) as n_items,
    string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s
  from occ group by r)
select d.doc_id, cast(coalesce(len(d.w), 0) as bigint) as n_words,
  cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join ids using (r)
"""


@query
def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents"))


ORACLES["op9_quality_cascade"] = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
win as (
  select r, i, array_to_string(list_slice(w, i, i + 7), ' ') as g
  from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8) q),
rep as (
  select r, count(distinct p) as n from (
    select r, unnest(range(i, i + 8)) as p
    from (select r, i, count(*) over (partition by r, g) as c from win) q where c > 1) q2
  group by r),
m as (
  select doc_id, t, lines, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from d left join rep using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * (length(t) - length(translate(t, '#*$%&<>', ''))) > 25 * n_words
    or 2 * len(regexp_extract_all(t, '!!')) > n_words
    or 2 * n_dup_lines > len(lines)
    or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from b
"""


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


ORACLES["op3_secret_scan"] = r"""
with d as (
  select row_number() over () as r, doc_id,
    translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as t
  from documents),
kinds as (
  select * from (values
    (0, 'assign', '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
    (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'),
    (3, 'entropy_hex', '[0-9a-fA-F]+'), (4, 'entropy_base64', '[A-Za-z0-9+/_=-]+')) k(rank, kind, p)),
marked as (
  select r, rank, kind, string_split(
    case rank
      when 0 then regexp_replace(t, '(?i)((?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)', chr(1) || '\1' || chr(2), 'g')
      when 1 then regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(1) || '\1' || chr(2), 'g')
      when 2 then regexp_replace(t, '([0-9a-f]+)', chr(1) || '\1' || chr(2), 'g')
      when 3 then regexp_replace(t, '([0-9a-fA-F]+)', chr(1) || '\1' || chr(2), 'g')
      else regexp_replace(t, '([A-Za-z0-9+/_=-]+)', chr(1) || '\1' || chr(2), 'g') end, chr(1)) as parts
  from d cross join kinds),
parts as (
  select r, rank, kind, unnest(parts) as part, unnest(range(len(parts))) as k from marked),
spans as (
  select r, rank, kind, string_split(part, chr(2))[1] as found,
    sum(length(replace(part, chr(2), ''))) over (partition by r, rank order by k)
      - length(replace(part, chr(2), '')) as s, k
  from parts),
cand as (
  select r, rank, kind, found, cast(s as bigint) as s, cast(s + length(found) as bigint) as e
  from spans where k > 0 and case rank
    when 0 then length(regexp_extract(found, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 12
    when 1 then length(found) >= 18 when 2 then length(found) >= 16
    else length(found) >= 20 and regexp_matches(found, '[0-9]') and regexp_matches(found, '[A-Za-z]')
      and (rank = 3 or regexp_matches(found, '[^0-9a-fA-F]'))
      and not regexp_matches(found, '(?i)example|0123456789abcdef|abcdefghijklmnop')
      and lower(found) not in ('d41d8cd98f00b204e9800998ecf8427e', 'da39a3ee5e6b4b0d3255bfef95601890afd80709',
        'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855') end),
chars as (
  select r, rank, s, w, c, count(*) as n from (
    select r, rank, s, w, unnest(string_split(substr(found, w, 20), '')) as c
    from (select r, rank, s, found, unnest(range(1, length(found) - 18)) as w from cand where rank >= 3) q) q2
  group by all),
tops as (
  select r, rank, s, min(x) as x from (
    select r, rank, s, w, sum(cast(round(1000000 * n * log2(n)) as bigint)) as x from chars group by all) q
  group by all),
kept as (
  select cand.* from cand left join tops using (r, rank, s)
  where rank < 3 or x <= cast(round(1000000 * 20 * (log2(20) - case rank when 3 then 3.0 else 3.7 end)) as bigint)),
agg as (
  select r, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access,
    count(*) filter (rank = 2) as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 3) as base,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans
  from kept group by r)
select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign,
  cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join agg using (r)
"""


@query
def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"), 40)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_recurring(table(spark, sf_dir, "documents"))
    return found.select("document.doc_id", "n_lines", "n_dropped", "text")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    as_text = F.transform(
        "licenses",
        lambda x: F.concat_ws(":", x["license"], x["dice"], x["unit"], x["place"]),
    )
    return found.select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",").alias("names"),
        F.array_join(as_text, ",").alias("found"),
    )


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.filter(~held_out))
    found = identify(docs, model, with_spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replace_private(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    as_text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return found.select(
        "doc_id",
        "text",
        *(number(kind).alias(f"n_{kind}") for kind, *_ in KINDS),
        F.array_join(as_text, ",").alias("spans"),
    )


ORACLES["op10_line_templates"] = r"""
with d as (
  select row_number() over () as r, doc_id, text, string_split(text, chr(10)) as lines from documents),
l as (
  select r, doc_id, text, unnest(range(len(lines))) as i,
    unnest(list_transform(lines, lambda x:
      list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda t: t <> ''))) as raw
  from d),
masked as (
  select *, len(raw) as n,
    list_transform(raw, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as tok
  from l where len(raw) >= 3),
m as (
  select r, doc_id, text, i, n, alone, case when alone then raw else tok end as tok,
    case when alone then raw else tok[1:3] end as lead, case when n >= 50 then 2 else 10 end as needed,
    row_number() over (partition by r order by i) as seq
  from (select *, 100 * len(list_filter(tok, lambda t: t <> '<*>')) < 70 * n as alone from masked) q),
leaves as (
  select n, alone, lead from m group by n, alone, lead, needed having count(distinct text) >= needed),
weights as (
  select tok, n, alone, lead, needed, count(distinct text) as weight
  from m join leaves using (n, alone, lead) group by all),
fields as (
  select tok, n, alone, lead, needed, weight, unnest(range(n)) as place, unnest(tok) as token from weights),
support as (select n, alone, lead, place, token, sum(weight) as s from fields group by all),
marked as (
  select tok, n, alone, lead, place, token, s >= needed and token <> '<*>' as is_fixed
  from fields join support using (n, alone, lead, place, token)),
general as (
  select tok, n, alone, lead, count(*) filter (is_fixed) as n_fixed,
    list(case when is_fixed then token else '<*>' end order by place) as shape
  from marked group by all),
templates as (
  select tok, n, alone, lead, case when 100 * n_fixed >= 70 * n then shape else tok end as template from general),
recurring as (
  select alone, lead, template, min(doc_id) as first
  from m join templates using (tok, n, alone, lead) group by alone, lead, template, needed
  having count(distinct text) >= needed),
shared as (select tok, alone from m group by tok, alone having count(distinct text) >= 2),
islands as (
  select r, doc_id, text, i, seq, n, cast(alone as varchar) || array_to_string(tok, ' ') as line,
    seq - row_number() over (partition by r order by seq) as island,
    sum(n) over (partition by r order by seq) as upto
  from m join shared using (tok, alone)),
ahead as (
  select a.r, a.seq as s, min(b.seq) as e
  from islands a join islands b on a.r = b.r and a.island = b.island and b.seq >= a.seq
    and b.upto - a.upto + a.n >= 50
  group by a.r, a.seq),
behind as (
  select b.r, max(a.seq) as s, b.seq as e
  from islands a join islands b on a.r = b.r and a.island = b.island and b.seq >= a.seq
    and b.upto - a.upto + a.n >= 50
  group by b.r, b.seq),
runs as (select * from ahead where s < e union select * from behind where s < e),
said as (
  select runs.r, s, e, x.doc_id, x.text, string_agg(x.line, chr(10) order by x.seq) as run
  from runs join islands x on x.r = runs.r and x.seq between s and e group by all),
again as (select run, min(doc_id) as first from said group by run having count(distinct text) >= 2),
gone as (
  select r, i from m join templates using (tok, n, alone, lead) join recurring using (alone, lead, template)
  where doc_id <> first
  union
  select said.r, m.i from said join again using (run) join m on m.r = said.r and m.seq between s and e
  where said.doc_id <> first),
kept as (
  select r, unnest(range(len(lines))) as i, unnest(lines) as line from d),
texts as (
  select r, count(gone.i) as n_dropped,
    string_agg(line, chr(10) order by i) filter (gone.i is null) as text
  from kept left join gone using (r, i) group by r)
select doc_id, cast(coalesce(len(lines), 0) as bigint) as n_lines,
  cast(coalesce(n_dropped, 0) as bigint) as n_dropped,
  case when d.text is not null then coalesce(texts.text, '') end as text
from d left join texts using (r)
"""


def _licenses_sql() -> str:
    known = [(name, t) for name in sorted(TEMPLATES) for t in TEMPLATES[name]]
    rows = ", ".join(
        "({}, '{}', '{}')".format(rank, name, text.replace("'", "''"))
        for rank, (name, text) in enumerate(known)
    )

    def words(text: str) -> str:
        lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"string_split(trim(regexp_replace({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ')"

    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g"
    return rf"""
with templates as (
  select rank, name, {grams}
  from (select rank, name, {words("t")} as w from (values {rows}) v(rank, name, t)) q),
d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
    regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09-\x0D]*\n') as parts
  from documents),
units as (
  select r, 0 as kind, 'line' as unit, unnest(range(len(string_split(t, chr(10))))) as place,
    unnest(string_split(t, chr(10))) as u from d
  union all select * from (
    select r, 1, 'paragraph', unnest(range(len(parts))) as place, unnest(parts) as u from d) q
  where contains(u, chr(10))
  union all select r, 2, 'text', 0, t from d where len(parts) > 1),
grams as (
  select r, kind, unit, place, {grams}
  from (select r, kind, unit, place, {words("u")} as w from units where len(u) > 4) q),
scored as (
  select r, kind, unit, place, name, rank, 200 * len(list_intersect(grams.g, templates.g)) as hit,
    len(grams.g) + len(templates.g) as size
  from grams join templates on
    200 * least(len(grams.g), len(templates.g)) >= 80 * (len(grams.g) + len(templates.g))
  where len(grams.g) > 0),
best as (
  select r, kind, unit, place, arg_max(name, {{'d': hit // size, 'k': -rank}}) as name, max(hit // size) as dice
  from scored where hit >= 80 * size group by all),
found as (
  select r, count(*) as n, string_agg(distinct name, ',' order by name) as names,
    string_agg(name || ':' || dice || ':' || unit || ':' || place, ',' order by kind, place) as found
  from best group by r)
select doc_id, cast(coalesce(n, 0) as bigint) as n_licenses, coalesce(names, '') as names,
  coalesce(found, '') as found
from d left join found using (r)
"""


ORACLES["op5_license_scan"] = _licenses_sql()


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = numbered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie(*rebuilt(turns, block=20, choices=4))


ORACLES["op13_prefix_trie"] = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as said
  from conversations where conv_id is not null),
own as (select conv_id as c, list(said order by i) as said from t group by conv_id),
h as (
  select c, said, c - c % 20 as c0, (xor(list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ord(x) as bigint))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)) % 4 as h
  from own),
seqs as (
  select h.c, list_concat(coalesce(o.said[1:h.h], []), h.said[h.h + 1:]) as said
  from h left join own o on o.c = h.c0),
prefixes as (select c, unnest(range(0, len(said) + 1)) as d, said from seqs),
nodes as (
  select d, said[1:d] as p, count(*) as n_convs, min(c) as conv_id,
    string_agg(cast(c as varchar), ',' order by c) filter (len(said) = d) as ends
  from prefixes group by d, said[1:d]),
worth as (
  select *, (n_convs - 1) * case when d = 0 then 0 else
    len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) end as spared,
    (select count(*) from nodes k where k.d = nodes.d + 1 and k.p[1:nodes.d] = nodes.p) as kids
  from nodes),
above as (select unnest(range(0, d + 1)) as a, p, spared, kids from worth),
below as (
  select a as d, p[1:a] as p, sum(spared) as saved, count(*) filter (kids = 0) as n_leaves
  from above group by a, p[1:a])
select w.conv_id, w.d as depth, u.conv_id as parent_conv_id, w.n_convs, w.kids as n_children,
  b.n_leaves, cast(b.saved as bigint) as saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
from worth w join below b on b.d = w.d and b.p = w.p
  left join nodes u on u.d = w.d - 1 and u.p = w.p[1:w.d - 1]
"""


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), top=2000, longest=5, least=100)


ORACLES["op12_phrase_collocations"] = r"""
with pieces as (
  select lang, row_number() over () as piece, list_filter(string_split(replace(p, chr(9), ' '), ' '), lambda x: x <> '') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
    from documents) q),
sizes as (select lang, sum(len(w)) as n from pieces group by lang),
grams as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m, count(*) as f
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i
    from pieces, (select unnest(range(1, 6)) as m) lengths where len(w) >= m) q
  group by all having count(*) >= 100),
cand as (select lang, phrase, m, f, string_split(phrase, ' ') as w from grams where m > 1),
inside as (
  select distinct s.lang, s.phrase
  from (select lang, f, array_to_string(w[i:i + k - 1], ' ') as phrase
    from (select lang, w, m, f, k, unnest(range(1, m - k + 2)) as i
      from (select lang, w, m, f, unnest(range(2, m)) as k from cand) q1) q2) b
  join cand s on s.lang = b.lang and s.phrase = b.phrase where 100 * b.f >= 100 * s.f),
cuts as (
  select lang, phrase, f as a, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:], ' ') as y
  from (select *, unnest(range(1, m)) as k from cand) q
  where not exists (select 1 from inside where inside.lang = q.lang and inside.phrase = q.phrase)),
scored as (
  select c.lang, phrase, a, k, x.f as l, y.f as r, n,
    cast((cast(1000 as hugeint) * a * n) // (cast(x.f as hugeint) * y.f) as bigint) as score
  from cuts c join sizes using (lang)
    join (select lang, phrase as x, f from grams) x using (lang, x)
    join (select lang, phrase as y, f from grams) y using (lang, y)),
best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank,
  phrase, a, l, r, cast(n as bigint) as n, score
from best qualify rank <= 2000
"""


@query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.learn(pages))
