"""Queries of event windows and incremental deduplication, over finished tables.

stream_dedup runs as a stream over the table's file until it has read all of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators.graph import shared_folder
from millrace.plans.base import Tables, query
from millrace.streaming import windows as S


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(t: Tables):
    return S.tumbling(t.events, "ts", "1 hour", ["event_type"], "value").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("events_sliding", "SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 MINUTE AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def events_sliding(t: Tables):
    return S.sliding(t.events, "ts", "1 hour", "30 minutes", ["event_type"], "value").select("start", "event_type", "n")


@query("events_session", 'WITH g AS (SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS INT) AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k')
def events_session(t: Tables):
    return S.sessions(t.events, "ts", "30 minutes", ["user_id"]).select("user_id", "start", "end", "n")


@query("stream_dedup", "SELECT text_md5, count(*) AS n FROM (SELECT DISTINCT md5(text) AS text_md5 FROM documents) GROUP BY text_md5")
def stream_dedup(t: Tables):
    at = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = t.spark.readStream.schema(t.documents.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{t.sf_dir}/documents.parquet*")
    new = S.first_seen(rows.select(F.md5(F.col("text").cast("binary")).alias("text_md5")), ["text_md5"])
    new.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("text_md5 string").parquet(f"{at}/rows").groupBy("text_md5").agg(F.count("*").alias("n"))
