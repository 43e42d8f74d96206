"""What the planner knows of a column: the profile rows, collected (one small row per column)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text as X
from tabloom.operators import profile as P
from tabloom.operators import statistics as S
from tabloom.session import Files, scratch


@dataclass
class ColumnFacts:
    id: str
    index: int
    header: str | None = None
    label: str | None = None
    group: str | None = None
    count: int = 0
    filled: int = 0
    fill_rate: float = 0.0
    distinct: int = 0
    distinct_ratio: float = 0.0
    min_len: int = 0
    max_len: int = 0
    shapes: list[tuple[str, float]] = field(default_factory=list)
    detectors: dict[str, float] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)
    sentinel_share: float = 0.0
    modal_share: float = 0.0
    distinct_ex_modal: float = 0.0
    text_share: float = 0.0

    def rate(self, *names: str) -> float:
        return max((self.detectors.get(n, 0.0) for n in names), default=0.0)

    @property
    def identification(self) -> float:
        """How well the column tells rows apart."""
        return max(self.distinct_ratio, self.distinct_ex_modal) * self.fill_rate


def profile_frame(frame: DataFrame, columns: list[dict]) -> list[ColumnFacts]:
    """All columns' facts. The value counts of all columns are one shuffle; everything else is computed from them."""
    ids = [c["id"] for c in columns]
    if not ids:
        return []
    spark, folder = frame.sparkSession, scratch(frame.sparkSession, "counts")
    try:
        # Written, not cached: a plan that joins the counts with themselves doesn't always find them in the cache and makes them again.
        P.value_counts(frame.select(F.lit(0).alias("__all"), *ids), ["__all"], ids).drop("__all").withColumn("shape", X.shape("value")).write.parquet(folder)
        counts = spark.read.parquet(folder)
        base = P.profiles(counts, []).join(S.modal(counts).select("column_id", "distinct_ex_modal"), "column_id", "left")
        base = base.join(S.detector_rates(counts), "column_id", "left").join(S.samples(counts), "column_id", "left").join(P.top_shapes(counts, []), "column_id", "left")
        wordy = counts.where("value IS NOT NULL").groupBy("column_id").agg((F.sum(F.when(S.is_wordy(F.col("value")), F.col("n")).otherwise(0)) / F.sum("n")).alias("text_share"))
        rows = {r["column_id"]: r for r in base.join(wordy, "column_id", "left").drop("buckets").collect()}
    finally:
        Files(spark, folder).delete("")
    out = []
    for c in columns:
        r, known = rows.get(c["id"]), {k: c.get(k) for k in ("id", "index", "header", "label", "group")}
        if r is None:
            out.append(ColumnFacts(**known))
            continue
        out.append(ColumnFacts(
            **known, count=r["row_count"], filled=r["filled"], fill_rate=r["fill_rate"] or 0.0, distinct=r["distinct_values"], distinct_ratio=r["distinct_ratio"] or 0.0,
            min_len=r["min_len"] or 0, max_len=r["max_len"] or 0, shapes=[(x["shape"], x["share"]) for x in r["shapes"] or []], detectors=dict(r["detectors"] or {}), samples=list(r["samples"] or []),
            sentinel_share=r["sentinel_share"] or 0.0, modal_share=r["modal_share"] or 0.0, distinct_ex_modal=r["distinct_ex_modal"] or 0.0, text_share=r["text_share"] or 0.0,
        ))
    return out


def bloc_profiles(frame: DataFrame, columns: list[dict], selections: list[tuple[str, str]]) -> dict[tuple[str, str], list[ColumnFacts]]:
    """Facts of all columns over the rows of each selection (column, value): what a column is in one bloc may not hold in another."""
    return {(c, v): profile_frame(frame.where(F.col(c) == F.lit(v)), columns) for c, v in selections}
