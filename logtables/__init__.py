"""Log analytics as Spark jobs: lines in, tables out."""

from logtables.functions.ids import cluster_fingerprint, event_id
from logtables.functions.levels import level_name, level_number, normalize_level, scan_level
from logtables.functions.text import (
    mask_variables,
    merge_templates,
    message_pattern,
    pattern_tokens,
    search_form,
    template_similarity,
)
from logtables.functions.times import bucket_start, ingest_lag_ms, parse_timestamp
from logtables.operators.context import (
    attach_summaries,
    cluster_context,
    cluster_samples,
    summarize,
    summarize_missing,
    summary_hit_rate,
)
from logtables.operators.health import (
    health_snapshot,
    ingest_rate,
    lag_percentiles,
    latest,
    percentiles,
    rate_per_second,
    status_line,
)
from logtables.operators.parse import DETECTORS, parse_logs
from logtables.operators.search import (
    add_search_text,
    filter_any,
    format_events,
    newest,
    oldest_first,
    only_listed,
    search,
    where,
)
from logtables.operators.spikes import bucket_counts, recent_counts, spikes
from logtables.operators.templates import (
    assign_templates,
    assignment_intervals,
    describe_templates,
    leaf_keys,
    mine_templates,
    pattern_counts,
    tag_events,
    template_counts,
    template_table,
    top_templates,
)
from logtables.schema import EVENT_SCHEMA
from logtables.sources.batches import batch_totals, pack_batches, unpack_batches
from logtables.sources.files import merge_sources, read_logs, stream_logs
from logtables.sources.store import append_events, count_events, dedup_events, read_events, unseen
from logtables.streaming.jobs import (
    closed_buckets,
    dedup_stream,
    keep_events,
    sliding_rate,
    start_all,
    tag_templates,
    watch_spikes,
)
from logtables.streaming.supervise import Supervisor, follow_sources

__all__ = [
    "Supervisor",
    "follow_sources",
    "DETECTORS",
    "EVENT_SCHEMA",
    "add_search_text",
    "append_events",
    "assign_templates",
    "assignment_intervals",
    "attach_summaries",
    "batch_totals",
    "bucket_counts",
    "bucket_start",
    "closed_buckets",
    "cluster_context",
    "cluster_fingerprint",
    "cluster_samples",
    "count_events",
    "dedup_events",
    "dedup_stream",
    "describe_templates",
    "event_id",
    "filter_any",
    "format_events",
    "health_snapshot",
    "ingest_lag_ms",
    "ingest_rate",
    "keep_events",
    "lag_percentiles",
    "latest",
    "leaf_keys",
    "level_name",
    "level_number",
    "mask_variables",
    "merge_sources",
    "merge_templates",
    "message_pattern",
    "mine_templates",
    "newest",
    "normalize_level",
    "oldest_first",
    "only_listed",
    "pack_batches",
    "parse_logs",
    "parse_timestamp",
    "pattern_counts",
    "pattern_tokens",
    "percentiles",
    "rate_per_second",
    "read_events",
    "read_logs",
    "recent_counts",
    "scan_level",
    "search",
    "search_form",
    "sliding_rate",
    "spikes",
    "start_all",
    "status_line",
    "stream_logs",
    "summarize_missing",
    "summary_hit_rate",
    "tag_events",
    "tag_templates",
    "template_counts",
    "template_similarity",
    "template_table",
    "top_templates",
    "unpack_batches",
    "unseen",
    "watch_spikes",
    "where",
]
