"""One call for any supported source: a path to frames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.layout import Frame, build_frame
from tabloom.sources import delimited, workbook
from tabloom.sources.inventory import DELIMITED, WORKBOOKS


def read_source(spark: SparkSession, path: str) -> dict[str, tuple[DataFrame, list]]:
    """Sheet name ('' for text) -> (grid, merged ranges)."""
    kind = Path(path).suffix.lower()
    if kind in DELIMITED:
        return {"": (delimited.read_grid(spark, path, "\t" if kind == ".tsv" else None), [])}
    if kind in WORKBOOKS:
        workbook.preflight(path)
        book = workbook.read_workbook(spark, path)
        return {s.name: (book.where(F.col("sheet") == s.name).drop("sheet"), workbook.merges(path, s)) for s in workbook.sheets(path)}
    raise ValueError(f"not a supported source: {path}")


def frames(spark: SparkSession, path: str, drop_furniture: bool = False) -> dict[str, Frame]:
    return {name: build_frame(grid, merged, drop_furniture) for name, (grid, merged) in read_source(spark, path).items()}
