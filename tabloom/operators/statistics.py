"""Statistics of columns and of pairs of columns that the planner asks for; each is one aggregate plan.

All take a frame with a row number ``_row`` and string columns, work in the JVM
and return small DataFrames. Values are compared stripped; blank is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import canonical as C
from tabloom.functions import detectors as D
from tabloom.functions import text as X
from tabloom.operators import profile as PR

ROW = "_row"


def cell(c: str) -> Column:
    return F.nullif(X.strip_ends(F.col(c)), F.lit(""))


def modal(counts: DataFrame) -> DataFrame:
    """Per column: distinct_ex_modal, modal value and its share, of a value-count table (column_id, value, n)."""
    seen = counts.where("value IS NOT NULL")
    per = seen.groupBy("column_id").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("filled"), F.max(F.struct("n", F.col("value"))).alias("top"), F.max("n").alias("modal"))
    rest = F.col("filled") - F.col("modal")
    return per.select("column_id", (F.col("modal") / F.col("filled")).alias("modal_share"), F.col("top.value").alias("modal_value"), F.when(rest > 0, (F.col("distinct") - 1) / rest).otherwise(0.0).alias("distinct_ex_modal"))


def samples(counts: DataFrame, n: int = 5) -> DataFrame:
    """n values per column that stand for its lengths: the rows in order of (length, value) are cut into n
    equal parts, and of each part the value that fills most of it comes first; then the commonest others.

    Values are placed by running sums in two steps: over the buckets (length, first
    two characters) of a column, a small table, and then inside each bucket, so that
    no task sorts a column's values as a whole. Each part keeps its best n + 1, and
    only those few meet to be told apart.
    """
    seen = counts.where("value IS NOT NULL")
    seen = seen if "shape" in counts.columns else seen.withColumn("shape", X.shape("value"))
    by_shape = seen.groupBy("column_id", "shape").agg(F.sum("n").alias("shape_n"))
    total = seen.groupBy("column_id").agg(F.sum("n").alias("total"))
    seen = seen.withColumns({"len": F.length("value"), "head": F.substring("value", 1, 2)})
    buckets = seen.groupBy("column_id", "len", "head").agg(F.sum("n").alias("bucket_n"))
    running = Window.partitionBy("column_id").orderBy("len", "head").rowsBetween(Window.unboundedPreceding, 0)
    offsets = buckets.withColumn("offset", F.sum("bucket_n").over(running) - F.col("bucket_n")).drop("bucket_n")
    inside = Window.partitionBy("column_id", "len", "head").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.join(offsets, ["column_id", "len", "head"]).withColumn("hi", F.col("offset") + F.sum("n").over(inside)).withColumn("lo", F.col("hi") - F.col("n"))
    placed = placed.join(by_shape, ["column_id", "shape"]).join(total, "column_id")
    near = lambda at, step: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(at) * n / F.col("total")).cast("int") + step))
    part = placed.withColumn("part", F.explode(F.sequence(near("lo", -1), near("hi", 1))))
    a, b = F.floor(F.col("part") * F.col("total") / n), F.floor((F.col("part") + 1) * F.col("total") / n)
    part = part.withColumn("inside", F.least("hi", b) - F.greatest("lo", a)).where("inside > 0")
    rank = Window.partitionBy("column_id", "part").orderBy(F.desc("inside"), F.desc("shape_n"), "value")
    best = part.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= n + 1)
    common = Window.partitionBy("column_id").orderBy(F.desc("n"), F.desc("shape_n"), "value")
    more = placed.withColumn("place", F.row_number().over(common)).where(F.col("place") <= 2 * n).withColumn("part", F.lit(n))
    few = best.select("column_id", "part", "place", "value").unionByName(more.select("column_id", "part", "place", "value"))
    listed = few.groupBy("column_id").agg(F.array_sort(F.collect_list(F.struct("part", "place", "value"))).alias("c"))
    start = F.struct(F.lit(-1).alias("part"), F.array().cast("array<string>").alias("chosen"))

    def step(s: Column, x: Column) -> Column:
        # One value of every part that isn't chosen yet; of the last part as many as are missing.
        free = ~F.array_contains(s["chosen"], x["value"]) & (F.size(s["chosen"]) < n) & ((x["part"] > s["part"]) | (x["part"] == n))
        return F.when(free, F.struct(x["part"].alias("part"), F.array_append(s["chosen"], x["value"]).alias("chosen"))).otherwise(s)

    return listed.select("column_id", F.aggregate("c", start, step, lambda s: s["chosen"]).alias("samples"))


def detector_rates(counts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per column the share of its non-placeholder values that each detector accepts; on distinct values, weighted."""
    return counts.groupBy("column_id").agg(D.rates(F.col("value"), F.col("n"), names).alias("detectors"))


def acceptance(frame: DataFrame, pairs: list[tuple[str, str]], numeric: dict[str, bool] | None = None, most: int = 5) -> DataFrame:
    """Per (column, type): share of non-placeholder values that canonicalise, and the first ``most`` different refused ones.

    All placeholders: 0; no values: 1; a free type: 1. One scan for the shares; the refused values are ranked with a limit
    per partition before they are shuffled, and with ``most`` = 0 not looked for: then each distinct value is judged once.
    """
    if not most:
        return _acceptance_of_values(frame, pairs, numeric or {})
    checks = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.lit(t in C.FREE_TYPES).alias("free"), cell(c).alias("value"),
                 F.lit(True).alias("ok") if t in C.FREE_TYPES else F.coalesce(C.canonical(F.col(c), t, F.lit((numeric or {}).get(c, False)))["ok"], F.lit(False)).alias("ok"))
        for c, t in pairs
    ]
    long = frame.select(ROW, F.explode(F.array(*checks)).alias("x")).select(ROW, "x.*")
    real = F.col("value").isNotNull() & ~X.is_placeholder("value")
    agg = long.groupBy("column", "type", "free").agg(F.count("value").alias("filled"), F.count_if(real).alias("real"), F.count_if(real & F.col("ok")).alias("accepted"))
    share = F.when(F.col("free") | (F.col("filled") == 0), 1.0).when(F.col("real") == 0, 0.0).otherwise(F.col("accepted") / F.col("real"))
    out = agg.select("column", "type", share.alias("share"), (F.col("real") - F.col("accepted")).alias("refused"))
    first = long.where(real & ~F.col("ok")).groupBy("column", "type", "value").agg(F.min(ROW).alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("column", "type").orderBy("first", "value"))).where(F.col("rank") <= most)
    listed = ranked.groupBy("column", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("refused_values"))
    return out.join(listed, ["column", "type"], "left").withColumn("refused_values", F.coalesce("refused_values", F.array().cast("array<string>")))


def _acceptance_of_values(frame: DataFrame, pairs: list[tuple[str, str]], numeric: dict[str, bool]) -> DataFrame:
    """The shares of ``acceptance`` from value counts; a row per pair, on an empty frame too."""
    columns = sorted({c for c, _ in pairs})
    counts = PR.value_counts(frame.select(F.lit(0).alias("__all"), *columns), ["__all"], columns).where("value IS NOT NULL")
    real, total = ~X.is_placeholder("value"), lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    sums = [x for k, c in enumerate(columns) for x in (total(F.col("column_id") == c).alias(f"filled{k}"), total((F.col("column_id") == c) & real).alias(f"real{k}"))]
    for k, (c, t) in enumerate(pairs):
        ok = F.lit(True) if t in C.FREE_TYPES else F.coalesce(C.canonical(F.col("value"), t, F.lit(numeric.get(c, False)))["ok"], F.lit(False))
        sums.append(total((F.col("column_id") == c) & real & ok).alias(f"accepted{k}"))
    row, out = counts.agg(*sums), []
    for k, (c, t) in enumerate(pairs):
        filled, real, accepted = F.col(f"filled{columns.index(c)}"), F.col(f"real{columns.index(c)}"), F.col(f"accepted{k}")
        share = F.when(F.lit(t in C.FREE_TYPES) | (filled == 0), 1.0).when(real == 0, 0.0).otherwise(F.try_divide(accepted.cast("double"), real))
        out.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), share.alias("share"), (real - accepted).alias("refused"), F.array().cast("array<string>").alias("refused_values")))
    return row.select(F.explode(F.array(*out)).alias("p")).select("p.*")


def kind_columns(counts: DataFrame, rows: int, least_fill: float = 0.9, most: int = 12) -> DataFrame:
    """Columns of 2 to ``most`` values, well filled and not all different: value and n in order of frequency."""
    seen = counts.where("value IS NOT NULL")
    fit = seen.groupBy("column_id").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("filled")).where((F.col("d").between(2, most)) & (F.col("filled") >= least_fill * rows) & (F.col("d") < F.col("filled")))
    return seen.join(fit.select("column_id"), "column_id", "left_semi").select("column_id", "value", "n")


def values_per_key(frame: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Median over keys of the distinct values of a column; rows with an empty key part don't count."""
    whole = reduce(lambda a, b: a & b, [cell(k).isNotNull() for k in keys])
    per = frame.where(whole).groupBy(*[cell(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count_distinct(cell(column)).alias("d"))
    return per.agg(F.median("d").alias("median_values"), F.max("d").alias("most_values"), F.count(F.lit(1)).alias("keys"))


def values_under_modal_key(frame: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct values of a column under the key with most rows; placeholders are no keys; ties: the first seen."""
    k = cell(key)
    real = frame.where(k.isNotNull() & ~X.is_placeholder(k))
    per = real.groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(cell(column)).alias("values"), F.min(ROW).alias("first"))
    return per.agg(F.max_by(F.struct("key", "rows", "values"), F.struct(F.col("rows"), -F.col("first"))).alias("m")).select("m.*")


def one_to_one(frame: DataFrame, a: list[str], b: str) -> DataFrame:
    """Whether a and b determine each other over the rows where both are filled; and the pairs."""
    both = reduce(lambda x, y: x & y, [cell(c).isNotNull() for c in (*a, b)])
    pairs = frame.where(both).select(X.composite(*[cell(c) for c in a]).alias("a"), cell(b).alias("b")).distinct()
    left = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("l"), F.count(F.lit(1)).alias("pairs"))
    right = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("r"))
    return left.crossJoin(right).select(F.coalesce((F.col("l") == 1) & (F.col("r") == 1), F.lit(False)).alias("one_to_one"), "pairs")  # one row each


def nested(frame: DataFrame, inner: str, outer: str, floor: float = 0.9) -> DataFrame:
    """Whether inner values (nearly) determine outer ones, of which there are fewer."""
    pairs = frame.where(cell(inner).isNotNull() & cell(outer).isNotNull()).groupBy(cell(inner).alias("i"), cell(outer).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("i").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg(F.sum("top").alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("inner_values"))
    outers = pairs.agg(F.count_distinct("o").alias("outer_values"))
    share = F.try_divide(F.col("top").cast("double"), F.col("n"))
    return per.crossJoin(outers).select(share.alias("share"), "inner_values", "outer_values", F.coalesce((share >= floor) & (F.col("outer_values") < F.col("inner_values")), F.lit(False)).alias("nested"))


def key_identification(profile: DataFrame) -> DataFrame:
    """Per column how well it tells rows apart: max(distinct_ratio, distinct_ex_modal) times fill."""
    return profile.select("column_id", (F.greatest("distinct_ratio", "distinct_ex_modal") * F.col("fill_rate")).alias("identification"))


def twin_columns(frame: DataFrame, pairs: list[tuple[str, str]], floor: float = 0.9) -> DataFrame:
    """Share of co-filled rows on which two columns are equal, and whether the later is a copy; one scan."""
    sums = [(F.count_if(cell(a) == cell(b)).alias(f"{a}|{b}|e"), F.count_if(cell(a).isNotNull() & cell(b).isNotNull()).alias(f"{a}|{b}|n")) for a, b in pairs]
    row = frame.agg(*[x for p in sums for x in p])
    out = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.col(f"`{a}|{b}|e`").cast("double"), F.col(f"`{a}|{b}|n`")).alias("equal_share")) for a, b in pairs]
    return row.select(F.explode(F.array(*out)).alias("p")).select("p.*", F.coalesce(F.col("p.equal_share") >= floor, F.lit(False)).alias("twin"))


def is_ordinal(frame: DataFrame, column: str) -> DataFrame:
    """Whether the values in row order are n, n + 1, ... (three or more).

    No sort of all rows in one task: for consecutive integers value - rank is
    constant, and so is value - position once the filled rows are numbered; that
    holds exactly if values are distinct, max - min + 1 = count, and value and
    row number rise together, which the running maximum per block of rows shows.
    """
    v = cell(column).try_cast("long")
    filled = frame.where(cell(column).isNotNull()).select(F.col(ROW).alias("r"), v.alias("v"))
    total = filled.agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("numbers"), F.count_distinct("v").alias("d"), (F.max("v") - F.min("v") + 1).alias("span"))
    block = 65_536
    inside = Window.partitionBy("block").orderBy("r")
    steps = filled.withColumn("block", F.floor(F.col("r") / block)).withColumn("before", F.lag("v").over(inside))
    blocks = steps.groupBy("block").agg(F.coalesce(F.bool_and(F.col("v") > F.col("before")), F.lit(True)).alias("rises"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    across = Window.orderBy("block")  # a row per 65,536 rows
    joined = blocks.withColumn("prior", F.lag("hi").over(across)).agg(F.bool_and(F.col("rises") & (F.col("prior").isNull() | (F.col("lo") > F.col("prior")))).alias("rises"))
    ok = (F.col("n") >= 3) & (F.col("numbers") == F.col("n")) & (F.col("d") == F.col("n")) & (F.col("span") == F.col("n")) & F.col("rises")
    return total.crossJoin(joined).select(F.coalesce(ok, F.lit(False)).alias("ordinal"))  # one row each


def is_wordy(v: Column) -> Column:
    """A run of two letters, and more letters than digits."""
    letters = F.length(F.regexp_replace(v, r"[^\p{L}]+", ""))
    digits = F.length(F.regexp_replace(v, r"[^\p{Nd}]+", ""))
    return v.rlike(r"\p{L}{2}") & (letters > digits)


def text_share(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the share of values that are words."""
    return frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_id"), cell(c).alias("v")) for c in columns])).alias("x")).select("x.*").where("v IS NOT NULL").groupBy("column_id").agg(F.avg(is_wordy(F.col("v")).cast("double")).alias("text_share"))


def pack_rates(frame: DataFrame, column: str) -> DataFrame:
    """Share of values with a phone number of each calling code, packed cells counted."""
    got = C.canonical(F.col(column), "phone")
    values = F.filter(F.split(F.coalesce(got["value"], F.lit("")), ";"), lambda p: p != "")
    share = lambda code: F.avg(F.exists(values, lambda p: p.startswith(f"+{code}")).cast("double"))
    rates = [share(code).alias(f"rate_{code}") for code, *_ in C.PHONE_RULES]
    return frame.where(cell(column).isNotNull()).agg(*rates)


def disagreement(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Share of co-filled rows on which two name columns differ after folding."""
    return frame.where(cell(a).isNotNull() & cell(b).isNotNull()).agg(F.avg((X.fold(cell(a)) != X.fold(cell(b))).cast("double")).alias("differ_share"))


def redaction(counts: DataFrame, floor: float = 0.5) -> DataFrame:
    """Columns whose commonest value is a placeholder on at least ``floor`` of the filled rows."""
    m = modal(counts)
    return m.where((F.col("modal_share") >= floor) & X.is_placeholder("modal_value")).select("column_id", "modal_value", "modal_share")


def record_fill(frame: DataFrame, furniture: DataFrame, columns: list[str]) -> DataFrame:
    """Fill of columns over rows that aren't sparse furniture (an anti join on row numbers)."""
    body = frame.join(furniture.where("kind = 'sparse'").select(F.col("index").alias(ROW)), ROW, "left_anti")
    return body.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_id"), cell(c).alias("v")) for c in columns])).alias("x")).groupBy("x.column_id").agg((F.count("x.v") / F.count(F.lit(1))).alias("fill_rate"))
