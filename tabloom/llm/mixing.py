"""Sources combined to target shares of the size in tokens, by hash-threshold histograms.

A document's hash is its place in its source. Tokens are summed by source and
leading hash bits; a budget falls into one bucket of the cumulated sums, and
only that bucket is summed again by its next bits, until the last document that
fits is known exactly. Documents below the threshold are taken: no sort, and a
larger budget takes a superset. Histograms and thresholds are tables, a source's
at most ``2 ** BITS`` rows, so the number of sources is free.

Defined results: documents without tokens aren't taken; sources without target
aren't taken; a source of the targets without documents makes the mix empty
unless its share is 0; documents of equal hash are told apart by their id, and
rows of one id are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import cut

#: Hash bits told apart per round, and bits of the whole hash; ids decide between equal hashes.
BITS, KEY_BITS = 20, 60


def _reached(sums: DataFrame, step: Column) -> DataFrame:
    """Per source: the first step whose tokens don't fit into ``remaining`` any more (null if all fit), and the tokens before it."""
    before = F.sum("n").over(Window.partitionBy("source").orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    placed = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    over = F.col("before") + F.col("n") > F.col("remaining")
    return placed.groupBy("source").agg(
        F.min(F.when(over, F.struct(step.alias("at"), F.col("before")))).alias("first"), F.sum("n").alias("all"), F.first("remaining").alias("remaining")
    ).select("source", F.col("first.at").alias("at"), F.coalesce("first.before", "all").alias("taken"), "remaining")


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold, threshold_id, reached) of budgets (source, budget): the most documents, in the order of hash and id, that fit.

    Taken are the documents with key < threshold, and those with key = threshold and id <= threshold_id.
    A round's window holds the buckets of a source, at most ``2 ** BITS``; the last one the ids of one hash.
    """
    state = budgets.where("budget > 0").select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("done"), F.col("budget").alias("remaining"))
    found = []
    for shift in range(KEY_BITS - BITS, -1, -BITS):
        within = sizes.join(state, "source").where(F.shiftrightunsigned("key", shift + BITS) == F.col("prefix"))
        sums = within.groupBy("source", "remaining", F.shiftrightunsigned("key", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        got = state.select("source", "prefix", "done").join(_reached(sums, F.col("bucket")), "source")
        got = cut(got.select("source", "prefix", (F.col("done") + F.col("taken")).alias("done"), (F.col("remaining") - F.col("taken")).alias("remaining"), "at"))
        end = F.shiftleft(F.col("prefix") + 1, shift + BITS)
        found.append(got.where("at IS NULL").select("source", end.alias("threshold"), F.lit(None).cast("long").alias("threshold_id"), F.col("done").alias("reached")))
        state = got.where("at IS NOT NULL").select("source", F.col("at").alias("prefix"), "done", "remaining")
    # One hash is left of each source: its documents in the order of their ids.
    same = sizes.join(state, "source").where(F.col("key") == F.col("prefix"))
    ids = same.groupBy("source", "remaining", "prefix", "done", "doc_id").agg(F.sum("n_tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("doc_id"))
    fits = ids.withColumn("run", run).withColumn("fits", F.col("run") <= F.col("remaining"))
    last = fits.groupBy("source", "prefix", "done").agg(F.max(F.when(F.col("fits"), F.col("doc_id"))).alias("threshold_id"), F.max(F.when(F.col("fits"), F.col("run"))).alias("more"))
    out = last.select("source", F.col("prefix").alias("threshold"), "threshold_id", (F.col("done") + F.coalesce("more", F.lit(0))).alias("reached"))
    for df in found:
        out = out.unionByName(df)
    return out


def plan_mix(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """The plan of a mix, a row per source with a target: budget, whole passes, thresholds of the rest, tokens reached.

    ``total`` tokens, or as many as the repeats allow.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    wanted = targets.where("target_share > 0").select(F.col("doc_source").alias("source"), "target_share", "max_repeats")
    known = cut(wanted.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))))
    most = known.agg(F.min(F.floor(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).alias("most")).first()["most"] or 0
    total = most if total is None else min(total, most)
    budget = F.floor(F.col("target_share") * F.lit(total)).cast("long")
    passes = F.least(F.coalesce(F.floor(F.try_divide(budget, F.col("tokens"))), F.lit(0)), F.col("max_repeats")).cast("long")
    rest = F.when(F.col("passes") < F.col("max_repeats"), F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0)
    plan = known.withColumn("budget", budget).withColumn("passes", passes).withColumn("rest", rest)
    cuts = thresholds(sizes, plan.select("source", F.col("rest").alias("budget")))
    whole = F.col("passes") * F.col("tokens")
    return cut(plan.join(cuts, "source", "left").select(
        "source", "target_share", "max_repeats", "tokens", "budget", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold"), "threshold_id",
        (whole + F.coalesce("reached", F.lit(0))).alias("reached"),
    ))


def sized(counts: DataFrame, row_id: str, source: str) -> DataFrame:
    """(doc_id, source, key, n_tokens) of documents with tokens, computed once into the shared checkpoint folder."""
    key = F.shiftrightunsigned(F.xxhash64(F.col(row_id).cast("long")), 64 - KEY_BITS)
    df = counts.where("n_tokens > 0").select(F.col(row_id).cast("long").alias("doc_id"), F.col(source).alias("source"), key.alias("key"), "n_tokens")
    return cut(df)


def mix(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, copies, n_tokens) of the documents taken.

    The plan has a row per source; Spark joins it by its size, as a broadcast where it is small, else salted by AQE's skew join.
    """
    below = (F.col("key") < F.col("threshold")) | ((F.col("key") == F.col("threshold")) & (F.col("doc_id") <= F.col("threshold_id")))
    taken = sizes.join(plan.select("source", "passes", "threshold", "threshold_id"), "source")
    copies = (F.col("passes") + F.when(below, 1).otherwise(0)).cast("int")
    return taken.select("doc_id", "source", copies.alias("copies"), "n_tokens").where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: target_share, tokens reached, documents, most repeats, actual share."""
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("repeats"))
    all_ = got.agg(F.sum("tokens").alias("all_tokens"))
    df = targets.join(got, targets["doc_source"] == got["source"], "left").crossJoin(F.broadcast(all_))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return df.select("doc_source", "target_share", "max_repeats", zero("tokens"), zero("documents"), zero("repeats"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
