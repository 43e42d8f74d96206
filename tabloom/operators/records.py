"""Rows that fail to parse: an error-recovering recursive-descent record grammar.

The grammar (one production, one method of ``RecordGrammar``)::

    records := record (line-end record)*
    record  := field (separator field)*
    field   := blanks (quoted | bare) blanks
    quoted  := '"' (any char but '"' | '""')* '"'
    bare    := any char but the separator (and, in a blob, the line end)

A broken quote is a located syntax error. The parser doesn't trust anything
behind it until the next *validated anchor*: a line start at which a whole
record parses without quoting error, has the source's number of columns and
begins with a field of the first column's type. From there it goes on, so one
broken quote costs the damaged record only, not the rest of the file. Record
starts that are known beforehand (a record per message) are anchors as they are.

Defined results for odd input: a null or empty text is a record of one empty
field; blank-only text likewise; a source without declared columns refuses all
its records with reason ``source``; very long texts are parsed whole.
"""

from __future__ import annotations

import bisect
import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import map_batches

#: Texts that stand for null in a field, any case.
NULL_TOKENS = frozenset({"", "-", "n/a", "null", "не вказано"})
#: Types that need a value.
REQUIRED_TYPES = frozenset({"identifier", "name"})
GENDERS = {"m": "m", "male": "m", "ч": "m", "f": "f", "female": "f", "ж": "f"}

_IDENTIFIER = re.compile(r"[0-9]{8}")
_DATE = re.compile(r"(?:([0-9]{2})\.([0-9]{2})\.([0-9]{4})|([0-9]{4})-([0-9]{2})-([0-9]{2}))")
_NUMBER = re.compile(r"-?[0-9]+(?:[.,][0-9]+)?")
_EMAIL = re.compile(r"[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+")


class Refused(ValueError):
    """A field isn't of its type."""


def _date(text: str) -> str:
    m = _DATE.fullmatch(text)
    if not m:
        raise Refused(text)
    y, mo, d = (m[3], m[2], m[1]) if m[1] else (m[4], m[5], m[6])
    try:
        return dt.date(int(y), int(mo), int(d)).isoformat()
    except ValueError:
        raise Refused(text) from None


def _matching(pattern: re.Pattern[str], change=lambda x: x):
    def read(text: str) -> str:
        if not pattern.fullmatch(text):
            raise Refused(text)
        return change(text)

    return read


def _gender(text: str) -> str:
    try:
        return GENDERS[text.lower()]
    except KeyError:
        raise Refused(text) from None


def _name(text: str) -> str:
    if not any(map(str.isalpha, text)):
        raise Refused(text)
    return text


#: type -> text to canonical text, or Refused. Other types take any text.
READERS = {
    "identifier": _matching(_IDENTIFIER),
    "name": _name,
    "date": _date,
    "number": _matching(_NUMBER, lambda x: x.replace(",", ".")),
    "gender": _gender,
    "email": _matching(_EMAIL),
}


def typed(text: str, type_name: str) -> str | None:
    """The canonical value of a field, None for a null; Refused if it isn't of its type."""
    if text.lower() in NULL_TOKENS:
        if type_name in REQUIRED_TYPES:
            raise Refused(text)
        return None
    return READERS[type_name](text) if type_name in READERS else text


@dataclass
class Record:
    """One record: its span, its fields, and the first error with its place."""

    start: int
    end: int
    fields: list[str] = field(default_factory=list)
    values: list[str | None] = field(default_factory=list)
    reason: str | None = None
    error_at: int | None = None
    error_field: int | None = None


class _Quotes:
    """Where quoted fields close, from one scan of the text for runs of quotes.

    A field that opens at a quote closes at the last quote of the first run, counted from behind that quote, of
    odd length; so a test of an anchor costs no scan, however far the closing quote is.
    """

    def __init__(self, text: str):
        self.runs = [m.span() for m in re.finditer('"+', text)]
        self.starts = [a for a, _ in self.runs]
        self.next_odd: list[int | None] = [None] * (len(self.runs) + 1)
        for k in range(len(self.runs) - 1, -1, -1):
            a, b = self.runs[k]
            self.next_odd[k] = b - 1 if (b - a) % 2 else self.next_odd[k + 1]

    def closing(self, opening: int) -> int | None:
        """The place of the quote that closes a field opened at ``opening``; None if there is none."""
        k = bisect.bisect_right(self.starts, opening) - 1
        stop = self.runs[k][1]
        return stop - 1 if (stop - opening - 1) % 2 else self.next_odd[k + 1]


class RecordGrammar:
    """The grammar of one source: its separator and its column types."""

    def __init__(self, separator: str, types: list[str]):
        self.separator, self.types = separator, list(types)
        self.blanks = "".join(x for x in " \t " if x != separator)
        blank = f"[{re.escape(self.blanks)}]*"
        self._lead = re.compile(blank)
        self._quoted = re.compile(r'"((?:[^"]|"")*+)"')
        self._bare_line = re.compile(rf"[^{re.escape(separator)}\n]*")
        self._bare_row = re.compile(rf"[^{re.escape(separator)}]*")

    # -- productions -----------------------------------------------------
    def _field(self, text: str, at: int, end: int, rows: bool) -> tuple[str, int, bool]:
        """The field at ``at``: its text, where it ends, and whether it is sound."""
        start = self._lead.match(text, at, end).end()
        if start < end and text[start] == '"':
            m = self._quoted.match(text, start, end)
            if m is None:
                return text[start:end], end, False
            close = self._lead.match(text, m.end(), end).end()
            if close < end and text[close] != self.separator and not (rows and text[close] in "\r\n"):
                return m[1], close, False
            return m[1].replace('""', '"').strip(self.blanks), close, True
        m = (self._bare_line if rows else self._bare_row).match(text, start, end)
        return m[0].rstrip("\r" + self.blanks if rows else self.blanks), m.end(), True

    def _record(self, text: str, at: int, end: int, rows: bool) -> Record:
        out = Record(at, end)
        while True:
            value, stop, sound = self._field(text, at, end, rows)
            if not sound:
                out.reason, out.error_at, out.error_field, out.end = "quoting", at, len(out.fields), stop
                return out
            out.fields.append(value)
            if stop < end and text[stop] == self.separator:
                at = stop + 1
                continue
            out.end = stop
            return out

    def _check(self, out: Record) -> Record:
        """Column count and types, after the syntax."""
        if out.reason is None and len(out.fields) != len(self.types):
            out.reason, out.error_at, out.error_field = "columns", out.start, min(len(out.fields), len(self.types))
        if out.reason is None:
            for k, (text, kind) in enumerate(zip(out.fields, self.types, strict=True)):
                try:
                    out.values.append(typed(text, kind))
                except Refused:
                    out.reason, out.error_at, out.error_field, out.values = "value", out.start, k, []
                    break
        return out

    # -- entry points ----------------------------------------------------
    def row(self, text: str | None) -> Record:
        """``text`` as exactly one record, whose line breaks are its own."""
        text = (text or "").rstrip("\r\n")
        return self._check(self._record(text, 0, len(text), rows=False))

    def _whole(self, text: str, at: int, end: int, quotes: _Quotes) -> bool:
        """Whether a record of the right width, begun by a field of the first column's type, stands at ``at``."""
        for k in range(len(self.types)):
            start = self._lead.match(text, at, end).end()
            if start < end and text[start] == '"':
                close = quotes.closing(start)
                if close is None or close >= end:
                    return False
                stop = self._lead.match(text, close + 1, end).end()
                value = text[start + 1 : close].replace('""', '"').strip(self.blanks) if k == 0 else ""
            else:
                stop = self._bare_line.match(text, start, end).end()
                value = text[start:stop].rstrip("\r" + self.blanks) if k == 0 else ""
            if k == 0:
                try:
                    typed(value, self.types[0])
                except Refused:
                    return False
            if k == len(self.types) - 1:
                return stop >= end or text[stop] in "\r\n"
            if stop >= end or text[stop] != self.separator:
                return False
            at = stop + 1
        return False

    def _recover(self, text: str, at: int, end: int, quotes: _Quotes) -> int:
        """The next validated record start behind ``at``; the end if there is none."""
        at = text.find("\n", at, end)
        while at != -1:
            if self._whole(text, at + 1, end, quotes):
                return at + 1
            at = text.find("\n", at + 1, end)
        return end

    def blob(self, text: str | None, starts: list[int] | None = None) -> Iterator[Record]:
        """All records of a text of many lines, resuming behind broken quotes.

        ``starts`` are record starts known beforehand (a record per message, say), in order, the first at 0:
        anchors that need no validation. Between two of them line breaks belong to the record, and only what
        lies behind a broken quote is searched for further records. Without ``starts`` every line end outside
        quotes ends a record.
        """
        text, quotes = text or "", None
        for k, at in enumerate(starts if starts is not None else [0]):
            last = starts is None or k + 1 == len(starts)
            end = len(text) if last else starts[k + 1] - 1
            rows = starts is None
            if not rows:
                while end > at and text[end - 1] in "\r\n":
                    end -= 1
            while at < end or not rows:
                got = self._record(text, at, end, rows)
                if got.reason == "quoting":
                    quotes = quotes or _Quotes(text)
                    got.end = self._recover(text, got.error_at, end, quotes)
                    at, rows = got.end, True
                else:
                    at = got.end
                    while at < end and text[at] in "\r\n":
                        at += 1
                        if text[at - 1] == "\n":
                            break
                yield self._check(got)
                if not rows:
                    break


RESULT = "part_no int, ok boolean, reason string, error_field int, error_at int, typed array<string>"


def parse_records(
    df: DataFrame, text: str, separator: Column, types: Column, keep: list[str], *, failures_only: bool = False
) -> DataFrame:
    """The records of each row's text by its source's grammar.

    The texts of a batch that share a grammar are parsed as one stream in which
    every row is a known record start: a broken quote ends at the latest there.
    A row has one record, part_no 0; where its quoting is broken and further
    whole records follow in later lines of the same text, these come out as
    parts 1, 2, ... . ``keep`` are passed on; part_no, ok, reason, error_field,
    error_at (within the row's text) and typed (the canonical values of a good
    record) are added. ``types`` null: reason ``source``. With ``failures_only``
    good records stay in the workers. No shuffle: a narrow map over Arrow batches.
    """
    source = df.select(*keep, F.col(text).alias("__text"), separator.alias("__sep"), types.alias("__types"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", " + RESULT

    def run(batches):
        grammars: dict[tuple, RecordGrammar] = {}
        for pdf in batches:
            rows, streams = [], {}
            for k, (body, sep, kinds) in enumerate(zip(pdf["__text"], pdf["__sep"], pdf["__types"], strict=True)):
                if kinds is None or sep is None:
                    rows.append((k, 0, False, "source", None, None, None))
                else:
                    streams.setdefault((sep, tuple(kinds)), []).append((k, body or ""))
            for key, texts in streams.items():
                grammar = grammars.get(key) or grammars.setdefault(key, RecordGrammar(key[0], list(key[1])))
                starts = list(accumulate((len(t) + 1 for _, t in texts), initial=0))[:-1]
                at, part = -1, 0
                for got in grammar.blob("\n".join(t for _, t in texts), starts):
                    if at + 1 < len(starts) and got.start == starts[at + 1]:
                        at, part = at + 1, 0
                    else:
                        part += 1
                    if got.reason or not failures_only:
                        place = None if got.error_at is None else got.error_at - starts[at]
                        rows.append((texts[at][0], part, got.reason is None, got.reason, got.error_field, place, None if got.reason else got.values))
            out = pd.DataFrame(rows, columns=["__k", "part_no", "ok", "reason", "error_field", "error_at", "typed"])
            kept = pdf[keep].iloc[out["__k"].to_numpy(dtype=int)].reset_index(drop=True)
            for c in ("part_no", "error_field", "error_at"):
                out[c] = out[c].astype("Int32")
            yield pd.concat([kept, out.drop(columns="__k")], axis=1)

    return map_batches(source, run, schema)


def with_source_grammar(records: DataFrame, sources: DataFrame, *, fixed_rows: int = 10_000) -> DataFrame:
    """Records beside field_sep and column_types of their source.

    ``sources`` is the register of sources. It is broadcast only while it has
    at most ``fixed_rows`` rows; a larger one is joined by shuffle.
    """
    small = sources.select("source_id", F.col("field_sep").alias("__field_sep"), F.col("column_types").alias("__column_types"))
    if sources.limit(fixed_rows + 1).count() <= fixed_rows:
        small = F.broadcast(small)
    return records.join(small, "source_id", "left")
