"""Raw grids to relational frames: merges, header search, furniture.

A grid is a DataFrame (_row INT, cells ARRAY<STRING>). The header is searched on
the driver in the first rows of the grid; everything that touches all rows is a
narrow projection, and merged ranges are filled by a broadcast range join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text as X

ROW = "_row"
#: Rows in which a header is looked for, and rows below it that it is compared with.
SEARCHED, BELOW = 10, 5
FLOOR, MARGIN = 0.55, 0.20
#: Merged ranges up to which they are broadcast.
MOST_MERGES = 100_000
TOTALS = r"(?iu)^\s*(?:всього|усього|разом|підсумок|итого|всего|total|sum)(?!\p{L})"


@dataclass
class Header:
    row: int | None
    names: list[str | None]
    label_row: int | None = None
    labels: list[str | None] = field(default_factory=list)
    group_row: int | None = None
    groups: list[str | None] = field(default_factory=list)


def pad(grid: DataFrame, width: int) -> DataFrame:
    """Ragged rows squared with nulls; blank cells are null."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda i: F.nullif(X.strip(F.get("cells", i)), F.lit("")))
    return grid.select(ROW, cells.alias("cells"))


def fill_merges(grid: DataFrame, merges: DataFrame, width: int) -> DataFrame:
    """The anchor's value in the null cells of each merged range; ranges as wide as the grid stay.

    ``merges`` (r0, c0, r1, c1 inclusive) is the metadata of one sheet.
    """
    used = merges.where((F.col("c1") - F.col("c0") + 1 < width) & ((F.col("r1") > F.col("r0")) | (F.col("c1") > F.col("c0"))))
    if used.limit(MOST_MERGES + 1).count() > MOST_MERGES:
        raise ValueError(f"more than {MOST_MERGES} merged ranges")
    anchors = grid.join(F.broadcast(used), F.col(ROW) == F.col("r0")).select("r0", "c0", "r1", "c1", F.get("cells", F.col("c0")).alias("anchor")).where("anchor IS NOT NULL")
    hit = grid.select(ROW).join(F.broadcast(anchors), F.col(ROW).between(F.col("r0"), F.col("r1")))
    fills = hit.groupBy(ROW).agg(F.collect_list(F.struct("c0", "c1", "anchor")).alias("fills"))

    def value(i: Column) -> Column:
        match = F.filter(F.coalesce(F.col("fills"), F.array().cast("array<struct<c0:int,c1:int,anchor:string>>")), lambda m: (m["c0"] <= i) & (i <= m["c1"]))
        return F.coalesce(F.get("cells", i), F.get(match, F.lit(0))["anchor"])

    return grid.join(fills, ROW, "left").select(ROW, F.transform(F.sequence(F.lit(0), F.size("cells") - 1), value).alias("cells"))


def _filled(row: list[str | None]) -> list[str]:
    return [c for c in row if c and c.strip()]


def _kind(c: str) -> str:
    return "n" if re.fullmatch(r"[\d\s.,:/\-+%]+", c) else "s"


def header_score(row: list[str | None], below: list[list[str | None]], width: int) -> float:
    """How much a row looks like a header over the rows below it: filled, distinct, wordy, unlike them, as wide."""
    own = _filled(row)
    if not own:
        return 0.0
    below = [r for r in below if _filled(r)][:BELOW]
    fill = len(own) / max(width, 1)
    distinct = len(set(own)) / len(own)
    wordy = sum(_kind(c) == "s" for c in own) / len(own)
    return 0.30 * fill + 0.20 * distinct + 0.15 * wordy + 0.15 * _differs(row, below) + 0.20 * _width_match(row, below)


def _differs(row: list[str | None], below: list[list[str | None]]) -> float:
    """Share of columns whose values below are of another kind or length than the header's cell."""
    scores = []
    for k, c in enumerate(row):
        under = [r[k] for r in below if k < len(r) and r[k]]
        if c and under:
            scores.append(sum(u != c and (_kind(u) != _kind(c) or abs(len(u) - len(c)) > 2) for u in under) / len(under))
    return sum(scores) / len(scores) if scores else 0.0


def _width_match(row: list[str | None], below: list[list[str | None]]) -> float:
    widths = [max((k + 1 for k, c in enumerate(r) if c), default=0) for r in below]
    own = max((k + 1 for k, c in enumerate(row) if c), default=0)
    return sum(min(own, w) / max(own, w, 1) for w in widths) / len(widths) if widths else 0.0


def _script(row: list[str | None]) -> str:
    text = "".join(_filled(row))
    return "C" if len(re.findall("[Ѐ-ӿ]", text)) > len(re.findall("[A-Za-z]", text)) else "L"


def find_header(head: list[list[str | None]], width: int, merges: list[tuple[int, int, int, int]] = ()) -> Header:
    """The earliest row near the best score, its label row and the band above it. ``head``: the grid's first rows."""
    scores = [header_score(r, head[i + 1 : i + 1 + BELOW * 2], width) for i, r in enumerate(head[:SEARCHED])]
    best = max(scores, default=0.0)
    at = next((i for i, s in enumerate(scores) if s >= FLOOR and s >= best - MARGIN), None)
    if at is None:
        return Header(None, [None] * width)
    square = lambda r: (r + [None] * width)[:width]
    out = Header(at, square(head[at]))
    if at + 1 < len(scores) and scores[at + 1] >= FLOOR:
        below, row = head[at + 2 : at + 2 + BELOW], head[at + 1]
        if _differs(row, below) > 0.5 and _script(row) != _script(head[at]) and all(any(ch.isalpha() for ch in c) for c in _filled(row)):
            out.label_row, out.labels = at + 1, square(row)
    bands = [m for m in merges if m[0] == at - 1 and m[3] > m[1] and m[3] - m[1] + 1 < width]
    if bands:
        out.group_row, out.groups = at - 1, [None] * width
        for r0, c0, _, c1 in bands:
            for k in range(c0, min(c1, width - 1) + 1):
                out.groups[k] = head[r0][c0] if c0 < len(head[r0]) else None
    return out


def furniture_kind(header: Header, width: int, sums: bool = True) -> Column:
    """What a row (its number and cells) is if no record: blank, repeat_header, totals, sparse, or title, group above the body; null for records.

    A function of the row alone; the cells, which are computed, are named once. Without ``sums`` totals and sparse rows count as records.
    """
    body = max([x for x in (header.row, header.label_row) if x is not None], default=-1)
    named = [(k, n) for k, n in enumerate(header.names) if n is not None]

    def kind(cells: Column) -> Column:
        blank = ~F.exists(cells, lambda c: c.isNotNull())
        again = reduce(lambda a, b: a & b, [F.get(cells, F.lit(k)) == n for k, n in named], F.lit(bool(named)))
        out = (
            F.when(F.col(ROW) <= F.lit(body), F.when(F.col(ROW) == F.lit(header.group_row), "group").when(blank, "blank").when(F.col(ROW).isin([x for x in (header.row, header.label_row) if x is not None] or [-1]), None).otherwise("title"))
            .when(blank, "blank")
            .when(again, "repeat_header")
        )
        if not sums:
            return out
        label = F.get(F.filter(cells, lambda c: c.isNotNull()), F.lit(0))
        tail = F.forall(F.filter(cells, lambda c: c.isNotNull() & (c != label)), lambda c: c.rlike(r"^[\d\s.,\-+%]+$"))
        return out.when(label.rlike(TOTALS) & tail, "totals").when(F.lit(width >= 3) & (F.size(F.filter(cells, lambda c: c.isNotNull())) == 1), "sparse")

    return F.get(F.transform(F.array("cells"), kind), F.lit(0))


def furniture(grid: DataFrame, header: Header, width: int) -> DataFrame:
    """(index, kind, reason) of rows that are no records: blank, repeat_header, totals, sparse; and those above the body."""
    why = F.element_at(F.create_map(*[F.lit(x) for kv in {"blank": "no cell is filled", "repeat_header": "the header again", "totals": "a sum of the rows", "sparse": "one cell of several", "title": "above the header", "group": "names of column groups"}.items() for x in kv]), F.col("kind"))
    return grid.select(F.col(ROW).alias("index"), furniture_kind(header, width).alias("kind")).where("kind IS NOT NULL").withColumn("reason", why)


@dataclass
class Frame:
    """A relational frame: rows (_row, c0 ... cN), columns and what was left out."""

    rows: DataFrame
    columns: list[dict]
    furniture: DataFrame
    header: Header


def build_frame(grid: DataFrame, merges: list[tuple[int, int, int, int]] = (), drop_furniture: bool = False) -> Frame:
    """A grid as a frame; row numbers stay those of the source."""
    width = grid.agg(F.max(F.size("cells")).alias("w")).first()["w"] or 0
    square = pad(grid, width)
    if merges:
        table = grid.sparkSession.createDataFrame([tuple(m) for m in merges], "r0 int, c0 int, r1 int, c1 int")
        square = fill_merges(square, table, width)
    head = [list(r["cells"]) for r in square.where(F.col(ROW) < SEARCHED + 2 * BELOW).orderBy(ROW).collect()]  # a fixed number of rows
    header = find_header(head, width, list(merges))
    rest = furniture(square, header, width)
    left_out = ["blank", "repeat_header", "title", "group"] + (["totals", "sparse"] if drop_furniture else [])
    body = max([x for x in (header.row, header.label_row) if x is not None], default=-1)
    rows = square.where((F.col(ROW) > body) & ~F.coalesce(furniture_kind(header, width, drop_furniture).isin(left_out), F.lit(False)))
    columns = [
        {"id": f"c{k}", "index": k, "header": header.names[k], "label": header.labels[k] if header.labels else None, "group": header.groups[k] if header.groups else None} for k in range(width)
    ]
    wide = rows.select(ROW, *[F.get("cells", F.lit(k)).alias(f"c{k}", metadata={x: columns[k][x] or "" for x in ("header", "label", "group")}) for k in range(width)])
    return Frame(wide, columns, rest, header)


def column_values(frame: DataFrame, column: str) -> DataFrame:
    """One column in row order."""
    return frame.select(ROW, column)
