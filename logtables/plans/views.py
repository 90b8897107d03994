"""Log lines derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.operators.parse import parse_logs

# One log line per row of ``events``, in four formats. {iso} and {hex} are the
# two expressions Spark and DuckDB spell differently.
LOGS_SQL = """
select event_id as arrival, concat('svc-', cast(user_id % 5 as string)) as source,
 case event_id % 4
  when 0 then concat('{{"level":"', lvl, '","msg":"', body, '","ts":"', iso, 'Z","user_id":', cast(user_id as string), '}}')
  when 1 then concat('level=', lvl, ' msg="', body, '" ts=', iso, 'Z user_id=', cast(user_id as string))
  when 2 then concat(upper(lvl), ' ', iso, ' ', body)
  else concat(body, case when event_type = 'error' then ' fatal condition' else '' end)
 end as raw,
 {ingest} as ingest_ts
from (
 select *, {iso} as iso,
  case event_type when 'error' then 'error' when 'signup' then 'warn' when 'purchase' then 'info'
                  when 'click' then 'debug' else 'trace' end as lvl,
  case event_type
   when 'error'    then concat('Failed to connect to db-', cast(user_id % 9 as string), ' after ', cast(event_id % 5 as string), ' retries')
   when 'signup'   then concat('slow signup for user ', cast(user_id as string), ' took ', cast(event_id % 900 as string), ' ms')
   when 'purchase' then concat('payment processed for order ', cast(event_id as string))
   when 'click'    then concat('GET /api/users/', cast(user_id as string), ' from 10.0.0.', cast(user_id % 250 as string))
   else concat('cache lookup key 0x', lower(hex(event_id)), ' hit') end as body
 from events) t
"""

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, if the scan has fewer splits than that.

    A table of one small file is one split; parsing its lines is worth the move.
    A table large enough to matter has more splits than cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``arrival, source, value, ingest_ts``: one raw line per row of ``events``."""
    lines = LOGS_SQL.format(
        iso=f'date_format(ts, "{ISO}")',
        ingest=f"""cast(concat(date_format(
            ts + make_interval(0, 0, 0, 0, 0, 0, event_id % 7), "{ISO}"), 'Z') as timestamp)""",
    )
    lines = lines.replace("from events", f"from parquet.`{sf_dir}/events.parquet`")
    return spread(spark.sql(lines).withColumnRenamed("raw", "value"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of :func:`logs`, parsed."""
    return parse_logs(logs(spark, sf_dir))


def doclines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line_no, source, line``: the lines of ``documents``."""
    lines = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spread(documents).select("doc_id", "source", lines)
