"""Delimited text: encoding, separator and header repair from its head, rows by Spark.

Only the head of a file (at most ``HEAD`` bytes) is looked at on the driver.
The width is that of the widest row of the whole file: one pass counts the
fields of the rows that don't fit the head's width.
Rows are numbered without sorting or shuffling them: by the file order of
Spark's partitions, each counted once.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.records import Record, RecordGrammar
from tabloom.session import map_batches

ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "cp1252")
SEPARATORS = (",", ";", "\t", "|")
HEAD, ENCODING_HEAD, ROWS = 8 << 20, 200_000, 50


def sniff_encoding(head: bytes) -> str:
    """The first encoding that reads the head; a character cut at its end doesn't count."""
    for name in ENCODINGS:
        if name == "utf-8-sig" and not head.startswith(codecs.BOM_UTF8):
            continue
        try:
            codecs.getincrementaldecoder(name)().decode(head[:ENCODING_HEAD])
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def _rows(text: str, separator: str, most: int = ROWS) -> list[list[str]]:
    out = []
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=separator):
        if any(c.strip() for c in row):
            out.append(row)
            if len(out) == most:
                break
    return out


def sniff_separator(text: str) -> str:
    """The separator that cuts most rows into one and the same, large number of fields."""
    scored = []
    for s in SEPARATORS:
        widths = Counter(map(len, _rows(text, s)))
        if widths:
            width, n = max(widths.items(), key=lambda x: (x[1], x[0]))
            if width > 1:
                scored.append((n / sum(widths.values()), width, s))
    return max(scored)[2] if scored else ","


def repaired_header(rows: list[list[str]], separator: str) -> list[str] | None:
    """The header's fields if its line was written with another separator than the body."""
    if len(rows) < 2 or len(rows[0]) != 1:
        return None
    width = Counter(len(r) for r in rows[1:]).most_common(1)[0][0]
    if width <= 1:
        return None
    for s in SEPARATORS:
        if s != separator:
            fields = next(csv.reader([rows[0][0]], delimiter=s), [])
            if len(fields) == width:
                return fields
    return None


def widest(broken: DataFrame, separator: str) -> int:
    """Fields of the widest of the records in ``_broken``; 0 without any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for pdf in batches:
            yield pd.DataFrame({"n": [max((len(r) for text in pdf["_broken"] for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator)), default=0)]})

    return map_batches(broken, run, "n int").agg(F.max("n").alias("n")).first()["n"] or 0


def read_grid(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None) -> DataFrame:
    """(_row, cells) of one delimited file; every cell is text, quotes may hold separators and line breaks."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, HEAD).alias("h")).first()["h"]
    encoding = encoding or sniff_encoding(bytes(head))
    text = bytes(head).decode(encoding, "ignore")
    separator = separator or sniff_separator(text)
    names = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1251": "windows-1251", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}
    rows = _rows(text, separator)
    width = max(max(map(len, rows), default=1), 1)
    fixed = repaired_header(rows, separator)
    if names[encoding] != "UTF-8" and names[encoding] != "ISO-8859-1":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")

    def records(width: int) -> DataFrame:
        schema = ", ".join(f"c{k} string" for k in range(width)) + ", _broken string"
        return (
            spark.read.schema(schema)
            .option("sep", separator).option("encoding", names[encoding]).option("quote", '"').option("escape", '"').option("multiLine", "true")
            .option("header", "false").option("columnNameOfCorruptRecord", "_broken").option("mode", "PERMISSIVE").csv(path)
        )

    # Spark drops the surplus fields of a row wider than its schema; such a row, as a narrower one, is in _broken.
    width = max(width, widest(records(width).select("c0", "_broken").where("_broken IS NOT NULL"), separator))
    df = records(width)
    cells = F.array(*[F.nullif(F.regexp_replace(F.regexp_replace(F.col(f"c{k}"), "^\\x{FEFF}", ""), r"(?U)^\s+|\s+$", ""), F.lit("")) for k in range(width)])
    out = numbered(df.select(cells.alias("cells")))
    if fixed:
        line = F.array(*[F.lit(x.strip()) for x in fixed], *[F.lit(None).cast("string")] * (width - len(fixed)))
        out = out.select("_row", F.when(F.col("_row") == 0, line).otherwise(F.col("cells")).alias("cells"))
    return out


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Rows numbered from 0 in the order of their partitions: partition sizes are counted, then added up."""
    tagged = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if not starts:
        return tagged.withColumn(name, F.lit(0)).drop("__at")
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), part)
    return tagged.select((base + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("int").alias(name), *df.columns)


def read_recovering(spark: SparkSession, path: str, separator: str, types: list[str], encoding: str = "utf-8", keep_broken: bool = True) -> DataFrame:
    """Typed records of whole files, resuming behind broken quotes: (path, start, ok, reason, error_field, error_at, typed).

    A file is read by one task, as its quotes can only be followed from its start;
    give many files, or ``read_grid`` for files too large for that.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = RecordGrammar(separator, types)
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                got: list[Record] = list(grammar.blob(bytes(content).decode(encoding, "replace")))
                if not keep_broken:
                    got = [r for r in got if not r.reason]
                yield pd.DataFrame({
                    "path": [p] * len(got), "start": [r.start for r in got], "ok": [r.reason is None for r in got], "reason": [r.reason for r in got],
                    "error_field": pd.Series([r.error_field for r in got], dtype="Int32"), "error_at": pd.Series([r.error_at for r in got], dtype="Int32"),
                    "typed": pd.Series([None if r.reason else r.values for r in got], dtype=object),
                })

    return map_batches(files, run, "path string, start int, ok boolean, reason string, error_field int, error_at int, typed array<string>")
