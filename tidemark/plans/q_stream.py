"""Streaming monitor check (optional extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table_path
from ..streaming.monitor import run_monitor
from .catalog import query


@query("s01_daily_event_monitor", """SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n_events, ROUND(AVG(value), 9) AS mean_value,
  COUNT(*) FILTER (WHERE value IS NULL OR isnan(value) OR isinf(value)) AS n_bad FROM events GROUP BY ALL""")
def s01_daily_event_monitor(spark, sf):
    run = uuid.uuid4().hex[:12]
    out = run_monitor(spark, table_path(sf, "events"), scratch_path(spark, f"monitor-out-{run}"),
                      scratch_path(spark, f"monitor-ckpt-{run}"))
    return out.withColumn("mean_value", F.round("mean_value", 9))
