"""Column profiles from maintained value-count tables.

A value-count table has one row per key (source, load, ...), column and value
with its count n. Loading adds rows with positive n, unloading a load adds its
rows with negative n; ``merge_deltas`` sums them. All profile figures, entropy
included, are exact functions of these counts:

* one shuffle on (key, column, value), with map-side combine, makes the counts
  of all columns at once;
* one small shuffle on (key, column, bucket) and one on (key, column) make the
  figures. Hot values and nulls are combined before they are sent.

Defined results: null and blank cells count as rows but not as filled; a column
without values has fill_rate 0 and null shares; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions import text as X
from tabloom.session import Files

#: Figures in which a load is held against the usual ones.
FIGURES = ("fill_rate", "sentinel_share", "modal_share", "distinct_ratio", "shape_share", "outline_share")
#: Difference from the usual figure that makes a departure; ordinary columns keep within half of it.
DEPARTURE = 0.3
#: Share of values outside the usual range beyond which most of them are there.
OUTSIDE = 0.5
#: Shapes of a catalogue up to which each is a branch of one expression; beyond, values are joined with theirs.
BRANCHES = 1_000


def value_counts(df: DataFrame, by: list[str], columns: list[str], sign: int = 1) -> DataFrame:
    """The (signed) value-count table of ``df``: by, column_id, value, n. Values are stripped; blank is null."""
    long = df.select(*by, *columns).unpivot(by, columns, "column_id", "value")
    value = X.strip_ends("value")
    counts = long.groupBy(*by, "column_id", F.when(value != "", value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts if sign == 1 else counts.withColumn("n", F.col("n") * sign)


def merge_deltas(*tables: DataFrame) -> DataFrame:
    """The sum of signed value-count tables; values whose count falls to 0 go."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


class ValueCountStore:
    """Value-count tables kept in a shared folder, a segment per applied delta.

    A segment counts from the moment its writer has completed it. As deltas only
    add up, several writers need no lock; a delta costs a shuffle of its own
    rows, not of what is there. ``read`` sums the segments, and those of one
    delta need no sum. ``compact`` replaces segments by their sum.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._files = spark, folder.rstrip("/"), Files(spark, folder)

    def segments(self) -> list[str]:
        """Complete segments that no compaction has replaced."""
        done = [x for x in self._files.names() if x.startswith(("delta-", "sum-")) and self._files.exists(f"{x}/_SUCCESS")]
        gone = {y for x in done if x.startswith("sum-") for y in self._files.read(f"{x}/_replaces").split()}
        return [x for x in done if x not in gone]

    def read(self) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.folder}/{x}") for x in self.segments()]
        return None if not parts else parts[0].where("n <> 0") if len(parts) == 1 else merge_deltas(*parts)

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The counts of the given keys only; they are chosen before anything is summed."""
        parts = [self.spark.read.parquet(f"{self.folder}/{x}").join(keys, keys.columns, "left_semi") for x in self.segments()]
        return merge_deltas(*parts)

    def apply(self, delta: DataFrame) -> str:
        """Adds a signed delta (one row per key, column and value, as of ``value_counts``)."""
        name = f"delta-{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.folder}/{name}")
        return name

    def compact(self) -> None:
        """One segment in place of the present ones; what is applied meanwhile stays."""
        old = self.segments()
        if len(old) < 2:
            return
        name = uuid.uuid4().hex
        merge_deltas(*[self.spark.read.parquet(f"{self.folder}/{x}") for x in old]).write.parquet(f"{self.folder}/new-{name}")
        self._files.write(f"new-{name}/_replaces", "\n".join(old))
        self._files.rename(f"new-{name}", f"sum-{name}")
        for x in old:
            self._files.delete(x)


def refreshed(figures: DataFrame, store: ValueCountStore, touched: DataFrame, usual_shapes: DataFrame | None = None) -> DataFrame:
    """``figures`` (of ``profiles``) after deltas for the keys ``touched``: only these are computed again.

    Keys whose rows have all been taken back are gone. ``touched`` is small where
    loads are (a row per key); without hint, Spark picks the join by its size.
    """
    keys = touched.distinct()
    again = profiles(store.read_keys(keys), keys.columns, usual_shapes)
    return figures.join(keys, keys.columns, "left_anti").unionByName(again)


def bucket_of(value: Column) -> Column:
    """Range bucket of a value: years by one, other numbers by quarter octaves with their sign; null for other text."""
    first = F.substring(value, 1, 1)
    day = value.rlike(r"^(?:[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})$")
    year = F.when(F.substring(value, 3, 1) == ".", F.substring(value, 7, 4)).otherwise(F.substring(value, 1, 4))
    plain = value.rlike(r"^-?[0-9]{1,18}(?:[.,][0-9]{1,9})?$")
    number = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
    step = F.ceil(F.log2(F.abs(number) + 1) * 4).cast("int")
    other = F.when(day, year.try_cast("int")).when(plain, F.when(number < 0, -step).otherwise(step))
    return F.when((first >= "0") & (first <= "9") | (first == "-"), other)


def shape_pattern(shape: str, *, runs: bool) -> str:
    """The pattern of the values of a shape; with ``runs`` of its outline, whatever the runs' lengths."""
    mark = {"d": r"\p{Nd}", "C": "[\u0400-\u052f]", "L": "[\\p{L}&&[^\u0400-\u052f]]"}
    out, k = [], 0
    while k < len(shape):
        ch, n = shape[k], 1
        while k + n < len(shape) and shape[k + n] == ch and ch in mark:
            n += 1
        k += n
        open_end = k < len(shape) and shape[k] == "+" and ch in mark
        k += open_end
        text = mark.get(ch, "\\" + ch if ch in r"\^$.|?*+()[]{}-&" else ch)
        out.append(text + ("" if ch not in mark else "+" if runs else "{9,}" if open_end else f"{{{n}}}"))
    return "^" + "".join(out) + r"\z"


def _in_shape(value: Column, usual: Column, shapes: list[str], *, runs: bool) -> Column:
    """Whether a value is of the shape that ``usual`` numbers; a branch per distinct shape of the catalogue."""
    out = F.when(F.lit(False), F.lit(False))
    for k, text in enumerate(shapes):
        out = out.when(usual == k, value.rlike(shape_pattern(text, runs=runs)))
    return out


def usual_shape_numbers(usual_shapes: DataFrame, most: int = BRANCHES) -> tuple[list[str], DataFrame] | None:
    """The distinct shapes of a catalogue of columns and the catalogue with their numbers; None beyond ``most`` columns."""
    rows = usual_shapes.limit(most + 1).collect()
    if len(rows) > most:
        return None
    shapes = sorted({r["usual_shape"] for r in rows if r["usual_shape"] is not None})
    numbers = {x: k for k, x in enumerate(shapes)}
    keys = [c for c in usual_shapes.columns if c != "usual_shape"]
    schema = ", ".join(f"`{c}` {usual_shapes.schema[c].dataType.simpleString()}" for c in keys) + ", usual int"
    numbered = [tuple(r[c] for c in keys) + (numbers.get(r["usual_shape"]),) for r in rows]
    return shapes, usual_shapes.sparkSession.createDataFrame(numbered, schema)


def profiles(counts: DataFrame, by: list[str], usual_shapes: DataFrame | None = None, branches: int = BRANCHES) -> DataFrame:
    """ColumnProfile figures per key and column from a value-count table.

    ``usual_shapes`` (column keys, usual_shape) names the shape whose share is
    reported. A catalogue of at most ``branches`` columns is broadcast and its
    shapes are patterns; a larger one is joined as Spark sees fit, and the shape
    of every value is computed. Without one shape_share and outline_share are null.
    """
    n, value = F.col("n"), F.col("value")
    filled = value.isNotNull()
    in_shape = in_outline = F.lit(None).cast("boolean")
    if usual_shapes is not None:
        on = [c for c in usual_shapes.columns if c != "usual_shape"]
        small = usual_shape_numbers(usual_shapes, branches)
        if small:
            counts = counts.join(F.broadcast(small[1]), on, "left")
            in_shape, in_outline = (_in_shape(value, F.col("usual"), small[0], runs=r) for r in (False, True))
        else:
            counts = counts.join(usual_shapes, on, "left").withColumn("shape", X.shape("value"))
            in_shape, in_outline = F.col("shape") == F.col("usual_shape"), X.outline(F.col("shape")) == X.outline(F.col("usual_shape"))
    seen = counts.select(
        *by,
        "column_id",
        "n",
        "value",
        bucket_of(value).alias("bucket"),
        X.is_placeholder("value").alias("sentinel"),
        in_shape.alias("in_shape"),
        in_outline.alias("in_outline"),
        F.length("value").alias("len"),
    )
    own = lambda flag: F.coalesce(F.sum(F.when(flag, n)), F.lit(0))
    small = seen.groupBy(*by, "column_id", "bucket").agg(
        F.sum("n").alias("rows"),
        own(filled).alias("filled"),
        F.count("value").alias("distinct_values"),
        F.max(F.when(filled, n)).alias("modal"),
        own(F.col("sentinel")).alias("sentinels"),
        own(F.col("in_shape")).alias("shaped"),
        own(F.col("in_outline")).alias("outlined"),
        F.sum(F.when(filled, n * F.log(n.cast("double")))).alias("n_log_n"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
    )
    total = small.groupBy(*by, "column_id").agg(
        *[F.sum(c).alias(c) for c in ("rows", "filled", "distinct_values", "sentinels", "shaped", "outlined", "n_log_n")],
        F.max("modal").alias("modal"),
        F.min("min_len").alias("min_len"),
        F.max("max_len").alias("max_len"),
        F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", F.col("filled").alias("n"))))).alias("buckets"),
    )
    part = lambda c: F.try_divide(F.col(c).cast("double"), F.col("filled"))
    return total.select(
        *by,
        "column_id",
        F.col("rows").alias("row_count"),
        "filled",
        F.try_divide(F.col("filled").cast("double"), F.col("rows")).alias("fill_rate"),
        "distinct_values",
        part("distinct_values").alias("distinct_ratio"),
        "min_len",
        "max_len",
        part("sentinels").alias("sentinel_share"),
        part("modal").alias("modal_share"),
        part("shaped").alias("shape_share"),
        part("outlined").alias("outline_share"),
        (F.log("filled") - F.try_divide(F.col("n_log_n"), F.col("filled"))).alias("entropy"),
        "buckets",
    )


def _quantile(buckets: Column, q: float) -> Column:
    """The bucket in which the cumulated count reaches the share q."""
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("at"))

    def step(a: Column, x: Column) -> Column:
        s = a["sum"] + x["n"]
        hit = a["at"].isNull() & (s >= total * F.lit(q))
        return F.struct(s.alias("sum"), F.when(hit, x["bucket"]).otherwise(a["at"]).alias("at"))

    return F.aggregate(buckets, start, step, lambda a: a["at"])


def departures(profile: DataFrame, source: list[str], threshold: float = DEPARTURE) -> DataFrame:
    """Each load's distance from its source's usual profile, and whether it departs.

    Usual is the median over the source's loads, figure by figure, and the
    median of the loads' 1 % and 99 % range buckets. The window holds one row
    per load of a source's column, not the rows loaded.
    """
    w = Window.partitionBy(*source, "column_id")
    median = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(10_000)).over(w)
    df = profile.withColumns({"lo": _quantile(F.col("buckets"), 0.01), "hi": _quantile(F.col("buckets"), 0.99)})
    df = df.withColumns({f"usual_{c}": median(F.col(c)) for c in (*FIGURES, "lo", "hi")})
    far = {f"{c}_off": F.abs(F.col(c) - F.col(f"usual_{c}")) for c in FIGURES}
    count = lambda keep: F.aggregate(
        F.col("buckets"), F.lit(0).cast("long"), lambda a, x: a + F.when(keep(x["bucket"]), x["n"]).otherwise(F.lit(0).cast("long"))
    )
    outside = count(lambda b: (b < F.col("usual_lo") - 1) | (b > F.col("usual_hi") + 1))
    df = df.withColumns(far).withColumn("outside_share", F.coalesce(F.try_divide(outside.cast("double"), F.col("filled")), F.lit(0.0)))
    worst = F.greatest(*[F.coalesce(F.col(f"{c}_off"), F.lit(0.0)) for c in FIGURES])
    return df.withColumn("distance", worst).withColumn("departs", (worst >= threshold) | (F.col("outside_share") > OUTSIDE))


def top_shapes(counts: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The k commonest shapes of each key and column as an array of (shape, share), ties by shape."""
    shaped = counts.where("value IS NOT NULL").groupBy(*by, "column_id", (F.col("shape") if "shape" in counts.columns else X.shape("value")).alias("shape")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "column_id")
    ranked = shaped.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "shape")))
    first = ranked.where(F.col("rank") <= k)
    return first.groupBy(*by, "column_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "shape", "share"))), lambda x: F.struct(x["shape"].alias("shape"), x["share"].alias("share"))).alias("shapes")
    )
