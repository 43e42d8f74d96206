"""The review log as an event stream: last word per column, state of approval, cards.

An event is (source_id, seq, action, column, entity, prop, generation, revision, actor, at);
``seq`` is unique within its source, so every result is a total order's last row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAPPING = ("bind", "reject", "clear")
SCHEMA = "source_id string, seq long, action string, column string, entity string, prop string, generation long, revision long, actor string, at timestamp"


def overrides(events: DataFrame) -> DataFrame:
    """The last mapping event of each source's column; a ``clear`` takes it back."""
    last = events.where(F.col("action").isin(*MAPPING)).groupBy("source_id", "column").agg(F.max_by(F.struct("action", "entity", "prop", "actor", "seq"), "seq").alias("e"))
    return last.select("source_id", "column", "e.*").where("action <> 'clear'")


def override_revision(events: DataFrame) -> DataFrame:
    """How many events changed each source's mapping."""
    return events.groupBy("source_id").agg(F.count_if(F.col("action").isin(*MAPPING)).alias("revision"))


def review_state(events: DataFrame, current: DataFrame) -> DataFrame:
    """pending, approved or stale per source of ``current`` (source_id, generation).

    An approval holds for the generation and the revision it was given for; a
    later ``reopen`` withdraws it.
    """
    marks = events.where(F.col("action").isin("approve", "reopen")).groupBy("source_id").agg(F.max_by(F.struct("action", "generation", "revision"), "seq").alias("m"))
    df = current.join(marks, "source_id", "left").join(override_revision(events), "source_id", "left")
    same = F.col("m.generation").eqNullSafe(F.col("generation")) & (F.col("m.revision") == F.coalesce(F.col("revision"), F.lit(0)))
    state = F.when(F.col("m").isNull() | (F.col("m.action") == "reopen"), "pending").when(same, "approved").otherwise("stale")
    return df.select("source_id", "generation", F.coalesce("revision", F.lit(0)).alias("revision"), state.alias("state"))


class ApprovalRefused(RuntimeError):
    """The output is older than the decisions."""


def check_approval(output_revision: int, events: DataFrame, source_id: str) -> None:
    row = override_revision(events.where(F.col("source_id") == source_id)).first()
    now = row["revision"] if row else 0
    if output_revision != now:
        raise ApprovalRefused(f"{source_id}: the output has revision {output_revision}, the decisions {now}")


def cards(profile: DataFrame, bindings: DataFrame, decisions: DataFrame, events: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per column: its profile, bindings, last decision, override and candidates. Left joins on the column."""
    bound = bindings.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("entity", "prop"))).alias("bindings"))
    last = decisions.groupBy("column").agg(F.max_by(F.struct("verdict", "reason", "decided_by"), "seq").alias("decision"))
    over = overrides(events).groupBy("column").agg(F.max_by(F.struct("action", "entity", "prop"), "seq").alias("override"))
    listed = candidates.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "qname", "score"))).alias("candidates"))
    out = profile
    for side in (bound, last, over, listed):
        out = out.join(side, "column", "left")
    return out
