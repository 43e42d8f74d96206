"""New rows as they arrive: the stateless normalisation under Structured Streaming.

Statements depend on their row only, so a stream needs no state for them; rows
delivered twice are dropped within a watermark, and counts per window close
once the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.plans import compile as P
from tabloom.plans.model import Plan


def statement_stream(rows: DataFrame, plan: Plan, source: P.Source, event_time: str, key: list[str], late: str = "7 days") -> DataFrame:
    """A stream of statements; ``rows`` has _row, the columns and an event time. The plan's evidence is given, not asked of the stream."""
    once = rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)
    norm = P.normalised(once, plan, numeric={})
    return P.statements(P.facts(norm, plan, source), plan, source)


def window_counts(rows: DataFrame, event_time: str, by: list[str], width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per tumbling window of event time; late rows count until the watermark passes their window."""
    return rows.withWatermark(event_time, late).groupBy(F.window(event_time, width), *by).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("window_start"), *by, "rows")


def write_batches(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to Parquet; with ``once`` what is there is processed and the query ends."""
    w = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
